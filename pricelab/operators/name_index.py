"""Name search by trigram posting lists.

The index has one row for each trigram of each distinct name, sorted by trigram, so a
search reads only the row groups of its own trigrams.  A term is a regular
expression; what every match must contain are its literal parts, and a name
that lacks one of their trigrams cannot match.  The names that have all of them
are held against the expression itself, so the result is that of the scan.  A term
without a trigram goes to the scan.
"""

from __future__ import annotations

import re
import string
from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .search import NAME, name_matches

GRAM = 3
#: Signs after which what stands before them may be missing.
_OPTIONAL = "*?{"


def folded(column: Column) -> Column:
    """ASCII letters in lower case: the case that ``(?i)`` ignores, letter by letter."""
    return F.translate(column, string.ascii_uppercase, string.ascii_lowercase)


def literal_parts(term: str) -> list[str]:
    """Texts that every match of the expression ``term`` contains, ASCII letters in lower case.

    Careful, not clever: groups, classes and anything that may be left out end a part
    and add nothing, and an alternative at the top gives no part at all.
    """
    parts, part, depth, i = [], "", 0, 0
    while i < len(term):
        c = term[i]
        if c == "\\":
            sign = term[i + 1:i + 2]
            if depth == 0:
                if sign and sign not in string.ascii_letters + string.digits:
                    part += sign
                else:
                    parts, part = [*parts, part], ""
            if sign == "Q":                                    # quoted text: taken as unknown up to its end
                end = term.find("\\E", i)
                i = len(term) if end < 0 else end
            i += 2
            continue
        if c == "[":                                           # a class: unknown sign
            end = i + 2 if term[i + 1:i + 2] in ("]", "^") else i + 1
            while end < len(term) and term[end] != "]":
                end += 2 if term[end] == "\\" else 1
            if "[" in term[i + 1:end]:                         # classes within classes
                return []
            parts, part, i = [*parts, part], "", end + 1
            continue
        if c == "(":
            if term[i + 1:i + 2] == "?":                       # flags and look-around change what follows
                return []
            depth += 1
        elif c == ")":
            depth -= 1
        elif depth == 0 and c == "|":
            return []
        if depth == 0 and c not in "()" and c not in "^$.+*?{}":
            part += c
        elif depth == 0 and c in _OPTIONAL:
            parts, part = [*parts, part[:-1]], ""
            if c == "{":
                i = max(i, term.find("}", i))
        elif c in "()^$.+}":
            parts, part = [*parts, part], ""
        i += 1
    fold = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    return [p.translate(fold) for p in [*parts, part] if p]


def grams_of(term: str, literal: bool = False) -> list[str]:
    """Trigrams that every name matching ``term`` has."""
    parts = literal_parts(re.escape(term)) if literal else literal_parts(term)
    return sorted({p[i:i + GRAM] for p in parts for i in range(len(p) - GRAM + 1)})


def build_index(df: DataFrame, path: str, name: str = NAME) -> str:
    """Write the index of the distinct names of ``df``: ``(gram, name)``, sorted by gram."""
    names = df.where(F.col(name).isNotNull()).select(F.col(name).alias("name")).distinct()
    starts = F.sequence(F.lit(1), F.greatest(F.length("name") - (GRAM - 1), F.lit(1)))
    grams = F.array_distinct(F.transform(starts, lambda i: F.substring(folded(F.col("name")), i, F.lit(GRAM))))
    rows = names.select(F.explode(grams).alias("gram"), "name").where(F.length("gram") == GRAM)
    rows.repartitionByRange("gram", "name").sortWithinPartitions("gram", "name").write.mode("overwrite").parquet(path)
    return path


def matching_names(spark: SparkSession, index: str, grams: Sequence[str], term: str, literal: bool = False) -> DataFrame:
    """``(name)``: the distinct names that match ``term``, which has ``grams``."""
    found = spark.read.parquet(index).where(F.col("gram").isin(list(grams)))
    return (found.groupBy("name").agg(F.count("*").alias("n")).where(F.col("n") == len(grams))
            .where(name_matches(term, literal, "name")).select("name"))


def search_by_index(df: DataFrame, index: str, term: str, literal: bool = False) -> DataFrame:
    """P1 over the index: the rows of search_products(); a term without a trigram is scanned for."""
    grams = grams_of(term, literal)
    if not grams:
        return df.where(name_matches(term, literal))
    names = matching_names(df.sparkSession, index, grams, term, literal)
    return df.join(names, df[NAME] == names["name"], "left_semi")
