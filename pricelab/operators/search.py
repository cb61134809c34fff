"""Product search and selection.

Row order in the application is file order; here it is the explicit ``id``
key.  "First" means smallest ``id``.  Grouping by name uses partial
aggregation (``min``/``count``/``min(struct)``), so a name shared by a third
of the catalog is combined map-side instead of landing whole in one task;
no window ranks a whole name group.
"""

from __future__ import annotations

import re
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S

NAME = "productDisplayName"


def name_matches(term: str, literal: bool = False, column: str = NAME) -> Column:
    """Case-insensitive match of ``term`` (a regex unless ``literal``); NULL is no match."""
    pattern = "(?i)" + (re.escape(term) if literal else term)
    return F.coalesce(F.col(column).rlike(pattern), F.lit(False))


def search_products(df: DataFrame, term: str, literal: bool = False) -> DataFrame:
    """Products whose name contains ``term`` (regex, any case)."""
    return df.where(name_matches(term, literal))


def first_names(df: DataFrame, n: int = S.NAME_LIST_SIZE, order: str = "id") -> DataFrame:
    """The first ``n`` distinct names in row order: ``(productDisplayName, first_id)``."""
    g = df.where(F.col(NAME).isNotNull()).groupBy(NAME).agg(F.min(order).alias("first_id"))
    return g.orderBy("first_id").limit(n)


def popular_products(df: DataFrame, n: int = S.POPULAR_LIST_SIZE, order: str = "id") -> DataFrame:
    """The ``n`` most frequent names (ties: first seen)."""
    g = df.where(F.col(NAME).isNotNull()).groupBy(NAME).agg(
        F.count(F.lit(1)).alias("n_products"), F.min(order).alias("first_id"))
    return g.orderBy(F.desc("n_products"), "first_id").limit(n)


def search_with_fallback(df: DataFrame, term: str, n: int = S.NAME_LIST_SIZE,
                         fallback: str = "first", literal: bool = False) -> DataFrame:
    """Names matching ``term``; with no match, the first (or popular) names.

    One plan: whether anything matched is a scalar subquery; rows pass when
    they match or when nothing matched.
    """
    matched = name_matches(term, literal)
    any_match = df.select(F.max(matched.cast("int"))).scalar()
    found = F.coalesce(any_match, F.lit(0)) == 1
    if fallback == "popular":
        hits = first_names(df.where(matched), n).select(NAME, "first_id")
        pop = popular_products(df, n).select(NAME, "first_id")
        return (hits.where(found).withColumn("from_search", F.lit(True))
                .unionByName(pop.where(~found).withColumn("from_search", F.lit(False))))
    pool = df.where(matched | ~found)
    return first_names(pool, n).withColumn("from_search", found)


def first_row_per_name(df: DataFrame, columns: Sequence[str] | None = None,
                       order: str = "id") -> DataFrame:
    """P5: for every name, the row with the smallest ``order`` key (a unique key).

    A narrow hash aggregate, combined before the shuffle, finds the smallest
    key of each name; the rows follow by a semi join on the key.
    """
    columns = [c for c in (columns or df.columns) if c not in (NAME, order)]
    first = df.where(F.col(NAME).isNotNull()).groupBy(NAME).agg(F.min(order).alias(order)).select(order)
    return df.join(first, order, "left_semi").select(NAME, order, *columns)


CARD_COLUMNS = ["id", NAME, "articleType", "baseColour", "season", "material", "location",
                "demand", "inventory", "ratings"]


def product_card(df: DataFrame, floor: float = S.CURRENT_PRICE_FLOOR,
                 missing: float = S.MISSING_PRICE) -> DataFrame:
    """The product card fields with the current (floored) price, for every product."""
    price = F.greatest(F.lit(float(floor)),
                       F.coalesce(F.col("optimal_price").cast("double"), F.lit(float(missing))))
    return df.select(*CARD_COLUMNS, price.alias("current_price"))


def _flagged(df: DataFrame, pred: Column, k: int, order: str = "id") -> DataFrame:
    """Count of rows meeting ``pred`` with the first ``k`` of them as examples."""
    total = df.select(F.count_if(pred)).scalar()
    return (df.where(pred).orderBy(order).limit(k)
            .select(order, NAME, total.alias("n_matching")))


def opportunity_products(df: DataFrame, demand: float = S.OPPORTUNITY_DEMAND,
                         inventory: float = S.OPPORTUNITY_INVENTORY,
                         k: int = S.EXAMPLES_SHOWN) -> DataFrame:
    """High demand and low inventory: count and first examples."""
    return _flagged(df, (F.col("demand") > demand) & (F.col("inventory") < inventory), k)


def discount_candidates(df: DataFrame, inventory: float = S.DISCOUNT_INVENTORY,
                        demand: float = S.DISCOUNT_DEMAND, k: int = S.EXAMPLES_SHOWN) -> DataFrame:
    """High inventory and low demand: count and first examples."""
    return _flagged(df, (F.col("inventory") > inventory) & (F.col("demand") < demand), k)


def premium_candidates(df: DataFrame, rating: float = S.PREMIUM_RATING,
                       competitor: float = S.PREMIUM_COMPETITOR,
                       k: int = S.EXAMPLES_SHOWN) -> DataFrame:
    """P10: high rating and low competitor price: count and first examples."""
    return _flagged(df, (F.col("ratings") >= rating)
                    & (F.col("competitor_price_mean") < competitor), k)
