"""Operator 6: language identification by interpolated Kneser-Ney character models.

One character 4-gram model per language.  Spark counts the 4-grams of a
bounded sample of labelled documents; the models' probabilities and back-off
weights stand in arrays sorted by the gram's 64-bit hash, side by side for all
languages, and are broadcast (their size is bounded by ``max_grams``).  A text
gets the language of the lowest cross-entropy per character.  Documents kept
out of the counts calibrate the score and the cross-entropy beyond which a
text counts as none of the languages.
"""
from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import filter_docs, map_docs

ORDER = 4
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
LETTERS = re.compile(r"[^\W\d_]+").findall
UNKNOWN = "und"
BLOCK = 500_000          # characters scored at once


def characters(text: str | None) -> np.ndarray:
    """Code points of the lower-cased letters; whatever stands between two words is one space."""
    found = LETTERS(text.lower()) if text else []
    return np.frombuffer((" " + " ".join(found) + " ").encode("utf-32-le"), np.uint32) if found else np.zeros(0, np.uint32)


def grams(chars: np.ndarray) -> list[np.ndarray]:
    """Hashes of the grams of 1 to ORDER characters that end at each place."""
    out = [chars.astype(np.uint64) + np.uint64(1)]
    for _ in range(ORDER - 1):
        longer = out[0].copy()
        longer[1:] += out[-1][:-1] * MULTIPLIER
        out.append(longer)
    return out


def padded(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(characters, owner): texts one after another, each behind ORDER - 1 spaces whose owner is -1."""
    pad = np.full(ORDER - 1, 32, np.uint32)
    chars = np.concatenate([x for t in texts for x in (pad, t)]) if texts else pad
    sizes = np.array([len(t) for t in texts], np.int64)
    owner = np.full(len(chars), -1, np.int64)
    ends = np.cumsum(sizes + ORDER - 1)
    inside = np.ones(len(chars), bool)
    for k in range(ORDER - 1):
        inside[ends - sizes - 1 - k] = False
    owner[inside] = np.repeat(np.arange(len(texts)), sizes)
    return chars, owner


@dataclass
class Model:
    """Tables of all languages.  For each order: sorted gram hashes with log probabilities,
    and sorted context hashes with log back-off weights (columns: languages)."""
    langs: list[str]
    keys: list[np.ndarray] = field(default_factory=list)
    logs: list[np.ndarray] = field(default_factory=list)
    contexts: list[np.ndarray] = field(default_factory=list)
    weights: list[np.ndarray] = field(default_factory=list)
    unseen: np.ndarray | None = None        # log probability of a character never seen
    limit: np.ndarray | None = None         # highest cross-entropy of a text of the language
    spread: float = 2.0                     # of a short text's cross-entropy, times 1 / sqrt(characters)
    sharpness: float = 1.0

    def log_probs(self, hashes: list[np.ndarray], at: np.ndarray, order: int) -> np.ndarray:
        """Log probabilities (place, language) of the characters at places ``at``."""
        out = np.empty((len(at), len(self.langs)), np.float32)
        keys, h = self.keys[order], hashes[order][at]
        i = np.searchsorted(keys, h)
        i[i == len(keys)] = 0
        hit = keys[i] == h
        out[hit] = self.logs[order][i[hit]]
        miss = np.flatnonzero(~hit)
        if len(miss):
            if order == 0:
                out[miss] = self.unseen
            else:
                lower = self.log_probs(hashes, at[miss], order - 1)
                contexts, c = self.contexts[order], hashes[order - 1][at[miss] - 1]
                j = np.searchsorted(contexts, c)
                j[j == len(contexts)] = 0
                known = contexts[j] == c
                lower[known] += self.weights[order][j[known]]
                out[miss] = lower
        return out

    def entropies(self, texts: list[np.ndarray]) -> np.ndarray:
        """Cross-entropy per character in nats (text, language); infinite for no characters."""
        chars, owner = padded(texts)
        at = np.flatnonzero(owner >= 0)
        sums = np.zeros((len(texts), len(self.langs)))
        if len(at):
            logs = self.log_probs(grams(chars), at, ORDER - 1)
            for k in range(len(self.langs)):
                sums[:, k] = np.bincount(owner[at], weights=logs[:, k], minlength=len(texts))
        sizes = np.array([len(t) for t in texts], float)[:, None]
        return np.where(sizes > 0, -sums / np.maximum(sizes, 1), np.inf)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(language, score, cross-entropy, rejected) of each text."""
        langs, scores, best, reject = [], [], [], []
        chars = [characters(t) for t in texts]
        i = 0
        while i < len(chars):
            j, size = i, 0
            while j < len(chars) and (j == i or size + len(chars[j]) <= BLOCK):
                size += len(chars[j])
                j += 1
            h = self.entropies(chars[i:j])
            n = np.array([len(c) for c in chars[i:j]])
            k = h.argmin(axis=1)
            low = h[np.arange(len(h)), k]
            some = n > 0
            rel = np.where(some[:, None], h - np.where(some, low, 0)[:, None], 0)
            p = 1 / np.exp(-self.sharpness * np.minimum(rel, 50)).sum(axis=1)
            langs += [self.langs[x] if s else UNKNOWN for x, s in zip(k, some)]
            scores.append(np.where(some, p, 0.0))
            best.append(np.where(some, low, np.nan))
            reject.append(~some | (low > self.limit[k] + self.spread / np.sqrt(np.maximum(n, 1))))
            i = j
        cat = lambda x: np.concatenate(x) if x else np.zeros(0)
        return langs, cat(scores), cat(best), cat(reject).astype(bool)


def kneser_ney(counts: pd.DataFrame, langs: list[str]) -> Model:
    """Interpolated Kneser-Ney models from ``counts`` (lang, a, b, c, d: code points, n)."""
    model = Model(langs)
    cols = ["a", "b", "c", "d"]
    one = np.uint64(1)

    def hashed(frame: pd.DataFrame, names: list[str]) -> np.ndarray:
        h = np.zeros(len(frame), np.uint64)
        for name in names:
            h = h * MULTIPLIER + (frame[name].to_numpy(np.uint64) + one)
        return h

    frames = [counts.rename(columns={"n": "count"})]
    for k in range(1, ORDER):        # lower orders count the distinct characters in front
        frames.append(frames[-1].groupby(["lang", *cols[k:]], sort=False).size().rename("count").reset_index())
    probs = None
    for order, frame in enumerate(reversed(frames)):
        names = cols[ORDER - 1 - order:]
        key, context, suffix = hashed(frame, names), hashed(frame, names[:-1]), hashed(frame, names[1:])
        keys, first, at = np.unique(key, return_index=True, return_inverse=True)
        contexts, cat = np.unique(context, return_inverse=True)
        lang = frame["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy()
        n = frame["count"].to_numpy(float)
        total, types = np.zeros((2, len(contexts), len(langs)))
        np.add.at(total, (cat, lang), n)
        np.add.at(types, (cat, lang), 1)
        n1 = np.bincount(lang[n == 1], minlength=len(langs))
        n2 = np.bincount(lang[n == 2], minlength=len(langs))
        discount = np.clip((n1 + 0.5) / (n1 + 2 * n2 + 1), 0.1, 0.9)
        alpha = np.zeros((len(keys), len(langs)))
        alpha[at, lang] = (n - discount[lang]) / total[cat, lang]
        gamma = np.where(total > 0, discount * types / np.maximum(total, 1), 1.0)
        if order == 0:
            uniform = 1 / (len(keys) + 1)
            model.unseen = np.log(gamma[0] * uniform).astype(np.float32)
            probs = alpha + gamma[0] * uniform
        else:
            lower = probs[np.searchsorted(model.keys[-1], suffix[first])]
            probs = alpha + gamma[cat[first]] * lower
        model.keys.append(keys)
        model.logs.append(np.log(probs).astype(np.float32))
        model.contexts.append(contexts)
        model.weights.append(np.log(gamma).astype(np.float32))
    return model


def count_grams(sample: DataFrame) -> DataFrame:
    """(lang, a, b, c, d, n): how often each 4-gram occurs in the texts of ``sample`` (lang, text)."""
    def run(b: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in ("lang", "a", "b", "c", "d", "n")}
        langs = b.column(0).to_pylist()
        texts = [characters(t) for t in b.column(1).to_pylist()]
        for lang in set(langs):
            chars, owner = padded([t for t, x in zip(texts, langs) if x == lang])
            at = np.flatnonzero(owner >= 0)
            _, first, n = np.unique(grams(chars)[-1][at], return_index=True, return_counts=True)
            out["lang"] += [lang] * len(n)
            out["n"] += n.tolist()
            for back, name in enumerate("dcba"):
                out[name] += chars[at[first] - back].tolist()
        return out

    counted = map_docs(sample.select("lang", "text"), run, "lang string, a int, b int, c int, d int, n long")
    return counted.groupBy("lang", "a", "b", "c", "d").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, learn: Column, sample_docs: int = 1500, max_grams: int = 2_000_000) -> Model:
    """Models of the languages in ``docs`` (doc_id, text, lang) where ``learn`` holds.

    A classifier is fitted on a bounded sample: about ``sample_docs`` documents
    of each language, drawn by a hash of doc_id; a fifth of them is kept out of
    the counts for calibration.  At most ``max_grams`` grams are kept, the most
    frequent ones.  Rows with a null or letterless text or a null lang are not
    learned from; without any language ValueError is raised.
    """
    usable = docs.where(learn & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        raise ValueError("no labelled text to learn a language from")
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("langid")), F.lit(1_000_000))
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, int(1e6 * min(1.0, sample_docs / n)) + 1)])
    sample = usable.withColumn("__draw", draw).where(F.col("__draw") < share[F.col("lang")])
    aside = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("aside")), F.lit(5)) == 0
    counts = (count_grams(sample.where(~aside)).orderBy(F.desc("n"), "lang", "a", "b", "c", "d")
              .limit(max_grams).toArrow().to_pandas())
    if counts.empty:
        counts = count_grams(sample).limit(max_grams).toArrow().to_pandas()
    model = kneser_ney(counts, sorted(counts["lang"].unique()))
    held = sample.where(aside).select("lang", "text").orderBy(F.xxhash64("text")).limit(2000).toPandas()
    held = held[held["lang"].isin(model.langs)]
    if held.empty:
        held = sample.select("lang", "text").limit(500).toPandas()
    calibrate(model, held["lang"].tolist(), held["text"].tolist())
    return model


def calibrate(model: Model, langs: list[str], texts: list[str]) -> None:
    """Set the score's sharpness (least log loss) and each language's highest accepted
    cross-entropy: half-way from the held-out texts' highest to that of random letters."""
    h = model.entropies([characters(t) for t in texts])
    want = np.array([model.langs.index(x) for x in langs])
    own = h[np.arange(len(h)), want]
    rel = np.minimum(h - h.min(axis=1, keepdims=True), 50)
    best = np.inf
    for s in (0.5, 1, 2, 4, 8, 16, 32):
        p = np.exp(-s * rel)
        p = (0.999 * p / p.sum(axis=1, keepdims=True))[np.arange(len(h)), want] + 0.001 / len(model.langs)
        if (loss := -np.log(p).mean()) < best:
            best, model.sharpness = loss, float(s)
    rng = np.random.default_rng(0)
    letters = (model.keys[0] - np.uint64(1)).astype(np.uint32)
    noise = model.entropies([rng.choice(letters, 2000) for _ in range(5)]).min(axis=0)
    high = np.array([own[want == k].max() if (want == k).any() else own.max() for k in range(len(model.langs))])
    model.limit = high + np.maximum(noise - high, 0) / 2


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, cross_entropy, rejected) of every row of ``docs`` (doc_id, text).

    A null text or one without letters gets ``und``, score 0, a null
    cross-entropy, and is rejected.  Whole texts are scored; repeated rows and
    null doc_ids are returned as given; other columns are not looked at; an
    empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(b: pa.RecordBatch) -> dict:
        langs, score, entropy, reject = shared.value.predict(b.column(1).to_pylist())
        return {"doc_id": b.column(0), "lang_pred": langs, "score": score,
                "cross_entropy": [None if np.isnan(x) else x for x in entropy], "rejected": reject}

    return map_docs(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run,
                    "doc_id long, lang_pred string, score double, cross_entropy double, rejected boolean")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """Rows of ``docs`` with all their columns, without those that identify() rejects."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return filter_docs(docs, lambda texts: [not r for r in shared.value.predict(texts)[3]])
