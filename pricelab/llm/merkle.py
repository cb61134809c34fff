"""Operator 10: document fingerprints from a Merkle tree over paragraphs and sections.

Leaves are pieces of a paragraph (a line), cut where the words themselves say
so, about every four words: an edit changes the pieces it touches and no
others.  A paragraph's digest covers its pieces, a section's its paragraphs
(a section ends at an empty line or where a paragraph's digest says so), the
root all sections.  Equal roots mean equal texts; descending only into
branches that differ locates an edit.  The fingerprint is the root, the
section digests and a bounded sketch of the leaves, so two fingerprints alone
tell equality, the sections that differ and the share of leaves in common.
"""
from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MAX_ID, did, map_docs, small_batches

#: A piece ends behind a word whose CRC is 0 mod this, at the latest after 4 times as many words.
PIECE_WORDS = 4
#: A section ends behind a paragraph whose digest is 0 mod this.
SECTION_PARAGRAPHS = 8
#: Leaves kept in a fingerprint: all of a text with no more, else those of the smallest digests.
SKETCH = 256
DIGEST = 8          # hex digits of a section or leaf in the fingerprint


def pieces(paragraph: bytes) -> list[bytes]:
    """The paragraph cut at single spaces; joining the pieces by a space gives it back."""
    parts = paragraph.split(b" ")
    out, start, end = [], 0, 0
    for end, w in enumerate(parts, 1):
        if crc32(w) % PIECE_WORDS == 0 or end - start == 4 * PIECE_WORDS:
            out.append(b" ".join(parts[start:end]))
            start = end
    if start < end:
        out.append(b" ".join(parts[start:end]))
    return out


def tree(text: bytes) -> list[list[tuple[bytes, list[bytes]]]]:
    """Sections of (paragraph digest, its leaf digests)."""
    digest = xxhash.xxh3_128_digest
    sections, current = [], []
    for paragraph in text.split(b"\n"):
        leaves = [digest(p) for p in pieces(paragraph)]
        d = digest(b"".join(leaves))
        current.append((d, leaves))
        if not paragraph or d[0] % SECTION_PARAGRAPHS == 0:
            sections.append(current)
            current = []
    if current:
        sections.append(current)
    return sections


def fingerprint(text: str | bytes) -> str:
    """``root:sections:n_leaves:sketch``; equal texts, and only those, have equal ones."""
    text = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text
    sections = tree(text)
    tops = [xxhash.xxh3_128_digest(b"".join(d for d, _ in s)) for s in sections]
    root = hashlib.sha256(b"".join(tops) + len(text).to_bytes(8, "big")).hexdigest()[:32]
    counts: Counter = Counter()
    leaves = []
    for section in sections:
        for _, part in section:
            for d in part:
                counts[d] += 1               # the second copy of a leaf is another member
                leaves.append(d if counts[d] == 1 else xxhash.xxh3_128_digest(d + counts[d].to_bytes(8, "big")))
    marks = sorted(d.hex()[:DIGEST] for d in leaves)
    return f"{root}:{''.join(t.hex()[:DIGEST] for t in tops)}:{len(leaves)}:{''.join(marks[:SKETCH])}"


def _cut(s: str) -> list[str]:
    return [s[i:i + DIGEST] for i in range(0, len(s), DIGEST)]


def likeness(a: str, b: str) -> float:
    """Share (0 to 1) of two texts' leaves that they have in common, from their
    fingerprints: twice the common ones over all, exact while neither text has
    more than SKETCH leaves, else estimated from the smallest of the union."""
    if a == b:
        return 1.0
    _, _, na, sa = a.split(":")
    _, _, nb, sb = b.split(":")
    xa, xb = _cut(sa), _cut(sb)
    if max(int(na), int(nb)) <= SKETCH:
        return 2 * sum((Counter(xa) & Counter(xb)).values()) / max(int(na) + int(nb), 1)
    ua, ub = set(xa), set(xb)
    low = sorted(ua | ub)[:SKETCH]
    j = sum(x in ua and x in ub for x in low) / len(low)
    return 2 * j / (1 + j)


def differing_sections(a: str, b: str) -> tuple[int, int, int, int]:
    """(start, end in a, start, end in b) of the sections between the equal first and equal
    last ones: where an edit lies, from the fingerprints.  Equal roots give empty ranges."""
    x, y = _cut(a.split(":")[1]), _cut(b.split(":")[1])
    if a.split(":")[0] == b.split(":")[0]:
        return 0, 0, 0, 0
    i = 0
    while i < min(len(x), len(y)) and x[i] == y[i]:
        i += 1
    k = 0
    while k < min(len(x), len(y)) - i and x[-1 - k] == y[-1 - k]:
        k += 1
    return i, len(x) - k, i, len(y) - k


def differing_leaves(a: str, b: str) -> list[tuple[int, int]]:
    """(section, paragraph) of text ``b`` whose leaves differ from those of every equal
    place in ``a``: the tree is entered only where digests differ."""
    ta, tb = tree(a.encode()), tree(b.encode())
    tops = {tuple(d for d, _ in s) for s in ta}
    paragraphs = {d for s in ta for d, _ in s}
    return [(i, j) for i, s in enumerate(tb) if tuple(d for d, _ in s) not in tops
            for j, (d, _) in enumerate(s) if d not in paragraphs]


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of every row of ``docs`` (doc_id, text); a null text counts as empty."""
    def run(b: pa.RecordBatch) -> dict:
        return {"doc_id": b.column(0), "fingerprint": [fingerprint(t or "") for t in b.column(1).to_pylist()]}

    return map_docs(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run,
                    "doc_id long, fingerprint string")


def _bounds(docs: DataFrame, buckets: int) -> list[tuple[int, int]]:
    """Smallest (did, th) of each of about ``buckets`` ranges of (doc_id, text hash), ascending.

    A doc_id that several quantiles fall on (null ids, or one id with very many
    texts) is cut by its text hashes, which are spread evenly.
    """
    cuts = docs.approxQuantile("did", [i / buckets for i in range(1, buckets)], 0.2 / buckets) if buckets > 1 else []
    edges = [(d, -(1 << 63) + (1 << 64) * j // n) for d, n in sorted(Counter(min(int(c), MAX_ID) for c in cuts).items()) for j in range(n)]

    def lowest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low: dict[int, tuple[int, int]] = {}
        for b in batches:
            for key in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                k = bisect_right(edges, key)
                low[k] = min(low.get(k, key), key)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(low), pa.int32()), pa.array([d for d, _ in low.values()], pa.int64()),
             pa.array([t for _, t in low.values()], pa.int64())], names=["bucket", "did", "th"])

    rows = (docs.mapInArrow(lowest, "bucket int, did long, th long")
            .groupBy("bucket").agg(F.min(F.struct("did", "th")).alias("low")).collect())
    return sorted((r.low.did, r.low.th) for r in rows)


def edited_fingerprints(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    The edited text has its last floor(n_chars / 4) code points replaced by
    the first as many (or all) of the next document by ascending doc_id; the
    first follows the last.  Columns: doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next.

    A null text counts as empty; a null doc_id as the largest.  Rows with one
    doc_id and different texts follow each other by text hash; fully repeated
    rows are one document, returned as often as given.  A single document
    follows itself.  Other columns are not looked at.  An empty table gives no
    rows.

    Texts are dealt once, by ranges of doc_id and text hash whose bounds the driver holds (a
    few for each shuffle partition); the first document of a range is also
    sent behind the range before it.  Within a range rows stream in order.
    """
    spark = docs.sparkSession
    small_batches(spark)
    buckets = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), did().alias("did"), F.xxhash64(text).alias("th"), text.alias("text"))
    low = _bounds(rows.select("did", "th"), buckets)
    firsts = {key: i for i, key in enumerate(low)}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            keys = list(zip(b.column(1).to_pylist(), b.column(2).to_pylist()))
            bucket = [bisect_right(low, key) - 1 for key in keys]
            data = [pack(t.encode("utf-8", "surrogatepass")) for t in b.column(3).to_pylist()]
            ahead = [(i, k) for i, key in enumerate(keys) if (k := firsts.get(key)) is not None]
            take = pa.array([*range(b.num_rows), *(i for i, _ in ahead)], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array([*bucket, *((k - 1) % len(low) for _, k in ahead)], pa.int32()),
                 pa.array([False] * b.num_rows + [True] * len(ahead)),
                 b.column(0).take(take), b.column(1).take(take), b.column(2).take(take),
                 pa.array(data, pa.binary()).take(take)],
                names=["bucket", "guard", "doc_id", "did", "th", "data"])

    dealt = rows.mapInArrow(deal, "bucket int, guard boolean, doc_id long, did long, th long, data binary")
    return (dealt.repartition(F.col("bucket"))
            .sortWithinPartitions("bucket", "guard", "did", "th")
            .mapInArrow(_neighbours, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
                        "edited_fingerprint string, near_edited double, near_next double"))


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    unpack = zstandard.ZstdDecompressor().decompress
    held = None              # (bucket, key, rows, text, fingerprint, doc_id) of the document before
    for b in batches:
        out: list[tuple] = []
        for bucket, guard, doc_id, d, th, data in zip(*(c.to_pylist() for c in b.columns)):
            if held and held[0] == bucket and held[1] == (d, th) and not guard:
                held[2] += 1                                     # a repeated row
                continue
            if held and guard and held[0] != bucket:
                held = None
            text = unpack(data).decode("utf-8", "surrogatepass")
            print_ = fingerprint(text)
            if held and held[0] == bucket:
                out += _compare(held, text, print_)
            held = None if guard else [bucket, (d, th), 1, text, print_, doc_id]
        if out:
            cols = list(zip(*out))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)


def _compare(held: list, following: str, next_print: str) -> list[tuple]:
    _, _, times, text, own, doc_id = held
    k = len(text) // 4
    edited = text[:len(text) - k] + following[:k]
    data = edited.encode("utf-8", "surrogatepass")
    edited_print = own if edited == text else fingerprint(data)
    return [(doc_id, len(text), hashlib.sha256(data).hexdigest(), own, edited_print,
             likeness(own, edited_print), likeness(own, next_print))] * times
