"""Operator 3: toxicity by a weighted lexicon and Aho-Corasick.

Texts are folded first: homoglyphs of other scripts and width forms become
plain letters, digits and signs that stand for letters inside a word are
turned back, i, l and 1 count as one.  The lexicon holds words and word
beginnings weighted by their log odds, learned from labelled documents, and
phrases that except a word of the lexicon.  An automaton finds all of them in
one pass; a word counts with its strongest entry unless an exception covers
it.  Sums are normalised by length, and a logistic fit turns them into a score.
"""
from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_docs

# Letters of other scripts that look like Latin ones, and signs that stand for letters.
HOMOGLYPHS = str.maketrans({
    "а": "a", "в": "b", "е": "e", "ё": "e", "і": "i", "ї": "i", "к": "k", "м": "m", "н": "h", "о": "o", "п": "n",
    "р": "p", "с": "c", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "α": "a", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "ω": "w", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ᴏ": "o", "օ": "o", "ս": "u", "ո": "n",
})
HIDDEN = re.compile("[­​-‏⁠﻿]")
LEET = str.maketrans("013456789@$!|+", "oieasgtbgasiit")
FOREIGN = re.compile("[^\u0000-ɏ]")
LEET_IN_WORD = re.compile(r"(?<=[^\W\d_])[0-9@$!|+](?=[^\W\d_])|(?<!\S)[0-9@$!|+](?=[^\W\d_])"
                          r"|(?<=[^\W\d_])[0-9@$!|+]{2}(?=[^\W\d_])")
LETTERS = re.compile(r"[^\W\d_]+")


def fold(text: str | None) -> str:
    """`` word word ... `` of the folded words, with a space at either end; a space alone for none."""
    if not text:
        return " "
    t = text.lower()
    if FOREIGN.search(t):
        t = unicodedata.normalize("NFKC", HIDDEN.sub("", t)).lower().translate(HOMOGLYPHS)
    elif "­" in t:
        t = t.replace("­", "")
    t = LEET_IN_WORD.sub(lambda m: m[0].translate(LEET), t)
    found = LETTERS.findall(t)
    return f" {' '.join(found)} ".replace("l", "i") if found else " "


def terms(folded: str, shortest: int, longest: int) -> set[str]:
    """Whole words ("`` word ``") and word beginnings ("`` wor``") of a folded text."""
    out = set()
    for w in set(folded.split()):
        n = len(w)
        out.add(f" {w} ")
        for k in range(shortest, min(longest, n) + 1):
            out.add(" " + w[:k])
    return out


@dataclass
class Lexicon:
    weights: dict[str, float]
    exceptions: list[str]
    coef: np.ndarray = field(default_factory=lambda: np.zeros(4))

    def __post_init__(self):
        self._automaton = None

    def __getstate__(self):
        return {**self.__dict__, "_automaton": None}

    @property
    def automaton(self) -> ahocorasick.Automaton:
        if self._automaton is None:
            a = ahocorasick.Automaton()
            for t, w in self.weights.items():
                a.add_word(t, (len(t), w))
            for e in self.exceptions:
                p = fold(e)
                a.add_word(p, (len(p), 0.0))
            if len(a):
                a.make_automaton()
            self._automaton = a
        return self._automaton

    def features(self, text: str | None) -> tuple[float, float, float, float]:
        """(1, log of the summed weights, summed weights per word, strongest weight)."""
        folded = fold(text)
        best: dict[int, float] = {}
        excepted: list[tuple[int, int]] = []
        if len(self.automaton):
            for end, (n, w) in self.automaton.iter(folded):
                start = end - n + 1
                if w == 0.0:
                    excepted.append((start, end))
                elif w > best.get(start, 0.0):
                    best[start] = w
        for s, e in excepted:
            for p in [p for p in best if s <= p < e]:
                del best[p]
        total = sum(best.values())
        words = max(folded.count(" ") - 1, 0)
        return 1.0, np.log1p(total), 20 * total / (words + 20), max(best.values(), default=0.0)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        x = np.array([self.features(t) for t in texts]).reshape(-1, 4)
        return 1 / (1 + np.exp(-np.clip(x @ self.coef, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 50) -> np.ndarray:
    """Newton's method for a ridge logistic regression (the first column, the constant, is not shrunk)."""
    coef = np.zeros(x.shape[1])
    shrink = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ coef, -30, 30)))
        grad = x.T @ (y - p) - shrink @ coef
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + shrink, grad)
        coef += step
        if np.abs(step).max() < 1e-8:
            break
    return coef


def train(docs: DataFrame, labels: DataFrame, learn: Column, max_docs: int = 20_000, max_terms: int = 600,
          min_docs: int = 5, shortest: int = 4, longest: int = 9, exceptions: Sequence[str] = ()) -> Lexicon:
    """Lexicon learned from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic) where ``learn``
    (a condition on doc_id) holds.

    A classifier is fitted on a bounded sample: at most about ``max_docs``
    labelled documents, drawn by a hash of doc_id.  Two thirds of them give
    the lexicon's document counts (a Spark aggregate, at most ``max_terms``
    entries that occur in ``min_docs`` toxic documents), the rest the logistic
    fit.  Repeated texts count once.  Null labels, texts and ids are not
    learned from; with no toxic or no other document the score is the share
    of toxic ones.  ``exceptions``: phrases in which an entry means no harm, beside those learned here.
    """
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & learn)
    usable = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = usable.count()
    draw = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1_000_000))
    chosen = usable.where(draw < int(1e6 * min(1.0, max_docs / max(n, 1))) + 1)
    chosen = chosen.orderBy(draw, "doc_id").limit(max_docs + 5 * int(max_docs ** 0.5))
    own = docs.where(F.col("text").isNotNull()).select("doc_id", F.col("text").cast("string").alias("text"))
    sample = (own.join(F.broadcast(chosen), "doc_id").withColumn("th", F.xxhash64("text")))
    part = F.pmod(F.xxhash64("th", F.lit("part")), F.lit(3))

    def folded_terms(b: pa.RecordBatch) -> dict:
        counts = [Counter(), Counter()]
        seen = set()
        for text, toxic, th in zip(*(c.to_pylist() for c in b.columns)):
            if th not in seen:
                seen.add(th)
                counts[toxic > 0].update(terms(fold(text), shortest, longest))
        names = list(counts[0].keys() | counts[1].keys())
        return {"term": names, "toxic": [counts[1][t] for t in names], "clean": [counts[0][t] for t in names]}

    first = sample.where(part < 2)
    sizes = {bool(r["toxic"]): r["n"] for r in first.groupBy((F.col("toxic") > 0).alias("toxic"))
             .agg(F.count_distinct("th").alias("n")).collect()}
    pos, neg = sizes.get(True, 0), sizes.get(False, 0)
    counted = (map_docs(first.select("text", "toxic", "th"), folded_terms, "term string, toxic long, clean long")
               .groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))
    odds = F.log((F.col("toxic") + 0.5) / (pos + 1)) - F.log((F.col("clean") + 0.5) / (neg + 1))
    spread = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    found = (counted.where(F.col("toxic") >= min_docs).withColumn("weight", odds)
             .where((F.col("weight") > 1.5) & (F.col("weight") / spread > 3.0))
             .orderBy(F.desc(F.col("weight") * F.sqrt("toxic")), "term").limit(4 * max_terms).collect())
    lexicon = Lexicon(prune({r.term: (r.weight, r.toxic) for r in found}, max_terms),
                      [*exceptions, *learned_exceptions(first, {r.term for r in found})])
    rest = sample.where(part == 2).select("text", "toxic").dropDuplicates(["text"])

    def vectors(b: pa.RecordBatch) -> dict:
        x = [lexicon.features(t) for t in b.column(0).to_pylist()]
        return {"x": x, "toxic": b.column(1)}

    rows = map_docs(rest, vectors, "x array<double>, toxic int").collect()
    y = np.array([r.toxic > 0 for r in rows], float)
    x = np.array([r.x for r in rows]).reshape(-1, 4)
    if 0 < y.sum() < len(y):
        lexicon.coef = fit_logistic(x, y)
    else:
        rate = (pos + 0.5) / (pos + neg + 1)
        lexicon.coef = np.array([np.log(rate / (1 - rate)), 0, 0, 1.0 if lexicon.weights else 0])
    return lexicon


def prune(found: dict[str, tuple[float, int]], max_terms: int) -> dict[str, float]:
    """Drop a beginning if a longer entry explains nearly all of its toxic documents, and an
    entry that a shorter, no weaker beginning covers."""
    kept: dict[str, tuple[float, int]] = {}
    for t in sorted(found, key=len, reverse=True):
        w, n = found[t]
        if not any(u.startswith(t) and m >= 0.9 * n for u, (_, m) in kept.items()):
            kept[t] = w, n
    out = {t: w for t, (w, _) in kept.items()
           if not any(u != t and t.startswith(u) and v >= w for u, (v, _) in kept.items())}
    return dict(list(sorted(out.items(), key=lambda x: (-x[1], x[0])))[:max_terms])


def learned_exceptions(sample: DataFrame, entries: set[str], min_docs: int = 5, most: int = 200) -> list[str]:
    """Pairs of neighbouring words, one of them in the lexicon, that occur in at least ``min_docs``
    documents that are not toxic and in no toxic one."""
    def pairs(b: pa.RecordBatch) -> dict:
        counts = [Counter(), Counter()]
        for text, toxic in zip(*(c.to_pylist() for c in b.columns)):
            w = fold(text).split()
            hit = [f" {x} " in entries for x in w]
            counts[toxic > 0].update({f"{x} {y}" for x, y, h, g in zip(w, w[1:], hit, hit[1:]) if h or g})
        names = list(counts[0].keys() | counts[1].keys())
        return {"pair": names, "toxic": [counts[1][t] for t in names], "clean": [counts[0][t] for t in names]}

    found = (map_docs(sample.select("text", "toxic"), pairs, "pair string, toxic long, clean long")
             .groupBy("pair").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
             .where((F.col("toxic") == 0) & (F.col("clean") >= min_docs)).orderBy(F.desc("clean"), "pair").limit(most))
    return [r.pair for r in found.collect()]


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, score) of every row of ``docs`` (doc_id, text): 0 to 1, higher is likelier toxic.

    A null or empty text scores as one without any entry.  Repeated rows and
    null doc_ids are returned as given; other columns are not looked at; an
    empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(b: pa.RecordBatch) -> dict:
        return {"doc_id": b.column(0), "score": shared.value.scores(b.column(1).to_pylist())}

    return map_docs(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run,
                    "doc_id long, score double")
