"""Content-chosen anchors: where two documents may share a passage.

Of every ``span`` consecutive words the run of ``k`` words with the smallest
hash is the anchor (a minimiser).  Equal stretches of ``span`` words choose
equal anchors at equal places, so a stretch can only recur if its anchor does.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import materialize
from .common import as_bytes, did, map_docs, words

_MIX = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(tokens: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.array([digest(t) for t in tokens], np.uint64)


def run_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words that start at each place."""
    n = len(hashes) - k + 1
    out = np.zeros(max(n, 0), np.uint64)
    for i in range(k):
        out = out * _MIX + hashes[i:i + n]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def minimisers(tokens: list[bytes], k: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of the anchor of each window of ``span`` words, hash of the k words at each place)."""
    if len(tokens) < span:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    runs = run_hashes(word_hashes(tokens), k)
    w = span - k + 1
    best = np.lib.stride_tricks.sliding_window_view(runs, w)
    step = 1 << 16                     # very long texts: bounded memory
    at = np.concatenate([best[i:i + step].argmin(axis=1) for i in range(0, len(best), step)])
    return at + np.arange(len(best)), runs


def packed(docs: DataFrame, carry: list[str] = ()) -> DataFrame:
    """(did, th, z, carried columns): the texts compressed for a shuffle."""
    names = [c for c in docs.columns if c in carry]
    row = F.struct(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c) for c in names]).alias("row")
    df = docs.select(did().alias("did"), F.xxhash64(_text()).alias("th"), _text().alias("text"), row)
    schema = StructType.fromDDL("did long, th long, z binary").add("row", df.schema["row"].dataType)

    def run(b: pa.RecordBatch) -> dict:
        pack = zstandard.ZstdCompressor(level=3).compress
        return {"did": b.column(0), "th": b.column(1), "z": [pack(t) for t in as_bytes(b.column(2))],
                "row": b.column(3)}

    return map_docs(df, run, schema)


def unpack(z: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(z)


def _text():
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def shared_anchors(docs: DataFrame, k: int, span: int) -> tuple[DataFrame, DataFrame]:
    """Which documents (doc_id, text) may share ``span`` consecutive words with others or themselves.

    Returns two tables of documents of at least ``span`` words: copies (did,
    th, n_words, first_did, first_th) whose word sequence is that of the earlier,
    first document; and candidates (did, th, anchors): of the other documents
    those with anchors that recur, within the document or in one of another
    word sequence.  Exact copies count once, so a large group of them costs a
    row each; anchors are combined before the shuffle.
    """
    rows = docs.select(did().alias("did"), F.xxhash64(_text()).alias("th"), _text().alias("text"))
    # one pass over the texts: a row for each document, written once
    table = materialize(map_docs(rows, _of_documents(k, span), "did long, th long, n_words int, c1 long, c2 long, "
                                 "anchors array<long>, again array<long>"), "anchors")
    first = table.groupBy("c1", "c2").agg(F.min(F.struct("did", "th")).alias("first"))
    copies = (table.select("did", "th", "n_words", "c1", "c2").join(first, ["c1", "c2"])
              .where(F.struct("did", "th") != F.col("first"))
              .select("did", "th", "n_words", F.col("first.did").alias("first_did"), F.col("first.th").alias("first_th")))
    places = table.select("c1", F.explode("anchors").alias("anchor"))
    within = table.select(F.explode("again").alias("anchor")).distinct()
    across = (places.groupBy("anchor").agg(F.min("c1").alias("lo"), F.max("c1").alias("hi"))
              .where("lo <> hi").select("anchor"))
    recurring = across.union(within).distinct()
    of_content = (places.join(recurring, "anchor").groupBy("c1")
                  .agg(F.collect_set("anchor").alias("anchors")))
    candidates = (of_content.join(first, "c1")
                  .select(F.col("first.did").alias("did"), F.col("first.th").alias("th"), "anchors"))
    return copies, materialize(candidates, "candidates")


def _of_documents(k: int, span: int):
    """Per document of at least ``span`` words: the 128-bit digest of its word sequence, its
    distinct anchors, and those of them that occur again in it.  Of copies within a batch
    one has the anchors."""
    def run(b: pa.RecordBatch) -> dict:
        at: list[int] = []
        out: dict[str, list] = {c: [] for c in ("n_words", "c1", "c2", "anchors", "again")}
        seen = set()
        for i, t in enumerate(as_bytes(b.column(2))):
            tokens = words(t)
            if len(tokens) < span:
                continue
            digest = xxhash.xxh3_128_digest(b" ".join(tokens))
            c1, c2 = np.frombuffer(digest, np.int64).tolist()
            own = again = np.zeros(0, np.int64)
            if digest not in seen:
                seen.add(digest)
                place, runs = minimisers(tokens, k, span)
                own, n = np.unique(runs[np.unique(place)].view(np.int64), return_counts=True)
                again = own[n > 1]
            at.append(i)
            for c, v in zip(out, (len(tokens), c1, c2, own, again)):
                out[c].append(v)
        at_rows = pa.array(at, pa.int64())
        return {"did": b.column(0).take(at_rows), "th": b.column(1).take(at_rows), **out}

    return run
