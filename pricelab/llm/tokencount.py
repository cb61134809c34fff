"""Operator 5: token counts of a SentencePiece BPE model from pre-token frequencies.

No piece of the model has a space mark after another character, so no merge
crosses from a word into the spaces that follow it: a text's pieces are those
of its pre-tokens (a run of spaces and the word behind it), counted apart.

1. Spark counts the pre-tokens of all texts, combined in the tasks: one row for
   each distinct pre-token of the corpus.
2. Each of them is cut into pieces once (many at a time, by the rank queue of
   rankqueue.py, ranks being the model's scores); only the number is kept.
3. Each document's pre-token frequencies are joined to these numbers and summed:
   the most frequent pre-tokens, a bounded number, come to the tasks as one sorted
   table of hashes; the others are joined by hash.  No document's ids are ever held.
"""
from __future__ import annotations

from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import map_docs
from .rankqueue import Merger

SPACE = "▁"
#: Pre-tokens cut into pieces at a time.
PRE_TOKENS = 50_000


class PieceCounter:
    """Numbers of pieces by pre-token for one model."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        m = self.model
        pieces = [i for i in range(m.vocab_size())
                  if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
        if any(SPACE in m.id_to_piece(i).lstrip(SPACE) for i in pieces):
            raise ValueError("a piece of this model crosses from a word into spaces")
        if m.normalize(" A  \u00c5 ") != SPACE * 2 + "A" + SPACE * 2 + "\u00c5" + SPACE:
            raise ValueError("this model changes the text or adds no leading space mark")
        pieces.sort(key=lambda i: (-m.get_score(i), i))
        self.symbol = {m.id_to_piece(i): n for n, i in enumerate(pieces)}
        rules = {(self.symbol[p[:k]], self.symbol[p[k:]]): n for p, n in self.symbol.items()
                 for k in range(1, len(p)) if p[:k] in self.symbol and p[k:] in self.symbol}
        self.merger = Merger(rules, np.arange(len(pieces)))

    @staticmethod
    def pre_tokens(text: str) -> list[str]:
        """The text, behind the space mark that the model puts in front, cut before every
        run of space marks; each pre-token without its first mark."""
        parts = text.replace(" ", SPACE).split(SPACE) if text else []
        if "" not in parts:
            return parts
        out, run = [], ""
        for p in parts:
            if p:
                out.append(run + p)
                run = ""
            else:
                run += SPACE
        return [*out, run[1:]] if run else out

    def count_pieces(self, pre_tokens: list[str]) -> list[int]:
        """Number of pieces of each pre-token; a character without a piece counts as its bytes."""
        chars = SPACE + SPACE.join(pre_tokens)
        codes = np.frombuffer(chars.encode("utf-32-le"), np.uint32)
        known, at = np.unique(codes, return_inverse=True)
        symbol = np.array([self.symbol.get(chr(c), -1) for c in known.tolist()])
        width = np.array([1 if s >= 0 else len(chr(c).encode()) for c, s in zip(known.tolist(), symbol)])
        lengths = np.array([len(p) + 1 for p in pre_tokens])
        _, counts, redo = self.merger.run(symbol[at], lengths)
        counts += np.add.reduceat(width[at] - 1, np.cumsum(lengths) - lengths)
        out = counts.tolist()
        for k in redo.tolist():
            out[k] = len(self.model.encode(pre_tokens[k].replace(SPACE, " "), num_threads=1))
        return out

    def count(self, texts: list[str]) -> list[int]:
        """Number of pieces of each of a few texts."""
        split = [self.pre_tokens(t) for t in texts]
        distinct = list(set().union(*split))
        pieces = dict(zip(distinct, self.count_pieces(distinct) if distinct else ()))
        return [sum(map(pieces.__getitem__, p)) for p in split]


@lru_cache(maxsize=2)
def counter(path: str) -> PieceCounter:
    """One counter for each Python worker."""
    return PieceCounter(path)


def hashes(pre_tokens: list[str]) -> np.ndarray:
    """64-bit hash of each pre-token, by which its numbers are joined."""
    digest = xxhash.xxh64_intdigest
    return np.array([digest(p) for p in pre_tokens], np.uint64).view(np.int64)


def pre_token_table(docs: DataFrame, model_path: str) -> DataFrame:
    """(h, n, pieces), written: each distinct pre-token of ``docs`` (text) by its hash, in how many places
    it stands, and its number of pieces, counted here once for the whole corpus."""
    def frequencies(b: pa.RecordBatch) -> dict:
        freq: Counter = Counter()
        for t in b.column(0).to_pylist():
            freq.update(PieceCounter.pre_tokens(t))
        return {"pre": list(freq), "n": list(freq.values())}

    def numbers(b: pa.RecordBatch) -> dict:
        pre = b.column(0).to_pylist()
        return {"h": hashes(pre), "n": b.column(1), "pieces": _in_blocks(counter(model_path), pre)}

    distinct = map_docs(docs.select(_text().alias("text")), frequencies, "pre string, n long").groupBy("pre").agg(F.sum("n").alias("n"))
    return materialize(map_docs(distinct, numbers, "h long, n long, pieces int", rows=PRE_TOKENS), "pre-tokens")


def _in_blocks(c: PieceCounter, pre: list[str], size: int = 3_000_000) -> list[int]:
    """count_pieces() some MB at a time."""
    out: list[int] = []
    i = held = 0
    for j, p in enumerate(pre, 1):
        held += len(p)
        if held >= size or j == len(pre):
            out += c.count_pieces(pre[i:j])
            i, held = j, 0
    return out


def frequent(table: DataFrame, most: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Least frequency of the most frequent pre-tokens, at most ``most`` of them, their hashes (rising) and numbers
    of pieces; the frequency comes from a histogram of a few hundred classes."""
    size = F.floor(F.log2("n") * 8).cast("int")
    classes = sorted(((r["size"], r["c"]) for r in table.groupBy(size.alias("size")).agg(F.count("*").alias("c")).collect()), reverse=True)
    least, held = None, 0
    for k, c in classes:
        held += c
        if held > most:
            break
        least = k
    if least is None:
        return classes[0][0] + 1 if classes else 0, np.zeros(0, np.int64), np.zeros(0, np.int32)
    got = table.where(size >= least).select("h", "pieces").toArrow().sort_by("h")
    h, pieces = (got.column(k).combine_chunks().to_numpy() for k in range(2))
    return least, h, pieces


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, table_size: int = 4_000_000) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of ``docs`` (doc_id, text).

    ``model_path`` names a SentencePiece model file that every executor can
    read.  A null text counts as empty: no bytes, no tokens.  over_limit:
    n_tokens > ``limit``.  Repeated rows and null doc_ids are returned as
    given; other columns are not looked at; an empty table gives no rows.
    At most ``table_size`` pre-tokens (12 bytes each) go to the tasks as a table.
    """
    spark = docs.sparkSession
    table = pre_token_table(docs, model_path)
    least, known, pieces = frequent(table, table_size)
    shared = spark.sparkContext.broadcast((known, pieces))

    def look_up(b: pa.RecordBatch) -> dict:
        known, pieces = shared.value
        out: dict[str, list] = {"n_tokens": [], "rare": [], "times": []}
        for t in b.column(2).to_pylist():
            freq = Counter(PieceCounter.pre_tokens(t))
            h, times = hashes(list(freq)), np.fromiter(freq.values(), np.int64, len(freq))
            at = np.searchsorted(known, h)
            at[at == len(known)] = 0
            hit = known[at] == h if len(known) else np.zeros(len(h), bool)
            out["n_tokens"].append(int(times[hit] @ pieces[at[hit]]) if hit.any() else 0)
            out["rare"].append(h[~hit])
            out["times"].append(times[~hit])
        return {"doc_id": b.column(0), "n_bytes": b.column(1), **out}

    texts = docs.select(F.col("doc_id").cast("long"), F.octet_length(_text()).cast("long"), _text())
    found = map_docs(texts, look_up, "doc_id long, n_bytes long, n_tokens long, rare array<long>, times array<long>")
    found = materialize(found.withColumn("row", F.monotonically_increasing_id()), "tokens-found")
    rare = (found.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x"))
            .select("row", F.col("x.rare").alias("h"), F.col("x.times").alias("times")))
    others = table.where(F.floor(F.log2("n") * 8) < least).select("h", "pieces")
    rest = rare.join(others, "h").groupBy("row").agg(F.sum(F.col("times") * F.col("pieces")).alias("more"))
    n_tokens = F.col("n_tokens") + F.coalesce("more", F.lit(0))
    return (found.select("row", "doc_id", "n_bytes", "n_tokens").join(rest, "row", "left")
            .select("doc_id", "n_bytes", n_tokens.alias("n_tokens"), (n_tokens > limit).alias("over_limit")))


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))
