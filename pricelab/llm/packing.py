"""Operator 12: best-fit packing of documents into training sequences by minimum bin slack.

Tasks tokenise the texts, cut what is longer than a sequence and number the
pieces of each length.  What the packing needs to know is only how many pieces
there are of each length: at most ``size`` numbers, however large the corpus.
On them the plan is made bin by bin: the longest length left opens a bin, a
bitset subset-sum program over the lengths that are left finds the fullest
feasible combination beside it, and that combination is removed, at once as
often as the counts allow (the next bins would find it again).  The plan gives
every length ranges of piece numbers with their bins and offsets, so a piece
is placed by its length and number alone.  No group of pieces is ever
collected: numbers are counted within each task and shifted by the counts of
the tasks before it.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType
from tokenizers import Tokenizer

from ..session import materialize
from .chunks import ByteTokens, cut
from .common import small_batches
from .rankqueue import Recent

#: Bits of a piece number in a lookup key (length above it).
NUMBER_BITS = 40
#: Bytes of ids in one Arrow batch of a task.
BATCH_BYTES = 64 << 20
PIECES = "doc_id long, piece int, start long, length long, ids binary, part int, number long"


class DocumentIds:
    """Ids of whole texts as the file's library gives them without added tokens (special
    strings inside a text become their ids); remembers a bounded number of chunks."""

    REMEMBER, BLOCK = 250_000, 3_000_000

    def __init__(self, path: str, pattern: str):
        self.tokens = ByteTokens(path, pattern)
        self.library = Tokenizer.from_file(path)
        self.recent = Recent(self.REMEMBER)

    def _learn(self, keys: set) -> None:
        new = self.recent.missing(keys)
        if not new:
            return
        chunks = [k[0] if type(k) is tuple else " " + k for k in new]
        ids, counts = self.tokens.encode(chunks)
        data, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(counts)).tolist()
        self.recent.new.update((k, data[e - 4 * n:e]) for k, e, n in zip(new, ends, counts.tolist()))

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text as little-endian 32-bit numbers.  Texts are handled some MB at a time."""
        i = 0
        while i < len(texts):
            j, size, split = i, 0, []
            while j < len(texts) and (j == i or size + len(texts[j]) <= self.BLOCK):
                size += len(texts[j])
                if any(s in texts[j] for s in self.tokens.added):
                    split.append(None)
                else:
                    first, *rest = cut(texts[j])
                    split.append([(first,), *rest])
                j += 1
            self._learn(set().union(*(s for s in split if s)))
            get = self.recent.new.__getitem__
            for text, s in zip(texts[i:j], split):
                if s is None:
                    ids = self.library.encode(text, add_special_tokens=False).ids
                    yield np.array(ids, "<u4").tobytes()
                else:
                    yield b"".join(map(get, s))
            self.recent.turn()
            i = j


@lru_cache(maxsize=2)
def document_ids(path: str, pattern: str) -> DocumentIds:
    """One encoder for each Python worker."""
    return DocumentIds(path, pattern)


def cut_pieces(docs: DataFrame, tokenizer_path: str, pattern: str, size: int = 1024, end_id: int = 2) -> DataFrame:
    """Pieces of every row of ``docs`` (doc_id, text), written to the shared folder: doc_id,
    piece (from 0), start (ids of the document before it), length, ids (little-endian 32-bit),
    and part and number, which place() needs.

    A document is its ids and then ``end_id``; a null text counts as empty.  Only
    documents of more than ``size`` ids are cut, into pieces of ``size``; what does not
    fill one is the first piece.  Repeated rows and null doc_ids are documents like
    others; other columns are not looked at; an empty table gives no pieces.
    """
    small_batches(docs.sparkSession)
    arrow = to_arrow_schema(StructType.fromDDL(PIECES))
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = document_ids(tokenizer_path, pattern)
        part = TaskContext.get().partitionId()
        given = [0] * (size + 1)
        rows, held = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            for doc, ids in zip(b.column(0).to_pylist(), encoder.encode(texts)):
                ids += end
                n = len(ids) // 4
                piece, start, stop = 0, 0, n % size or size
                while start < n:
                    length = stop - start
                    rows.append((doc, piece, start, length, ids[4 * start:4 * stop], part, given[length]))
                    given[length] += 1
                    piece, start, stop = piece + 1, stop, stop + size
                held += len(ids)
                if held >= BATCH_BYTES:
                    yield batch()
                    rows, held = [], 0
            if rows:
                yield batch()
                rows, held = [], 0

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return materialize(texts.mapInArrow(run, PIECES), "pieces")


def fullest(lengths: list[int], counts: dict[int, int], room: int, slack: int = 0) -> dict[int, int]:
    """How many of each length (``lengths`` rising) make the largest sum of at most ``room``, or one
    up to ``slack`` less if that takes fewer pieces.  Subset sums are bits of one number; of
    a sum's combinations the one with the longest piece, then the next longest, and so on."""
    window = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in lengths:
        if length > room:
            break
        left, take = min(counts[length], room // length), 1
        while left:                                            # 1, 2, 4, ... copies give every number up to left
            take = min(take, left)
            steps.append((reach, length, take))
            reach |= reach << length * take & window
            left -= take
            take *= 2
    steps.reverse()
    best, fewest = {}, None
    top = reach.bit_length() - 1
    for total in range(top, max(top - slack, 0) - 1, -1):
        if not reach >> total & 1:
            continue
        chosen, n = {}, 0
        for before, length, take in steps:
            rest = total - length * take
            if rest >= 0 and before >> rest & 1:
                chosen[length] = chosen.get(length, 0) + take
                n += take
                total = rest
                if not rest or n == fewest:
                    break
        if not total and (fewest is None or n < fewest):
            best, fewest = chosen, n
    return best


def fill(counts: dict[int, int], size: int, slack: int) -> list[tuple[dict[int, int], int]]:
    """(copies of each length, number of such bins) by minimum bin slack, longest piece first."""
    left = {length: n for length, n in counts.items() if n}
    lengths, bins = sorted(left), []
    while lengths:
        first = lengths[-1]
        left[first] -= 1
        chosen = fullest([v for v in lengths if left[v]], left, size - first, slack)
        left[first] += 1
        chosen[first] = chosen.get(first, 0) + 1
        times = min(left[v] // k for v, k in chosen.items())
        for v, k in chosen.items():
            left[v] -= k * times
        bins.append((chosen, times))
        lengths = [v for v in lengths if left[v]]
    return bins


def plan(counts: dict[int, int], size: int) -> list[tuple[dict[int, int], int]]:
    """The bins of fill() with no slack allowed or with a little, whichever are fewer: exact
    fillings cost many short pieces, which the long pieces of later bins then lack."""
    return min((fill(counts, size, slack) for slack in (0, size // 128)), key=lambda bins: sum(n for _, n in bins))


def ranges(bins: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """The plan by pieces: sorted rows (length and first number as one key, first number,
    copies in a bin, first bin, offset of the first copy)."""
    rows, given, base = [], {}, 0
    for chosen, times in bins:
        offset = 0
        for length in sorted(chosen, reverse=True):
            first, copies = given.get(length, 0), chosen[length]
            rows.append((length << NUMBER_BITS | first, first, copies, base, offset))
            given[length] = first + copies * times
            offset += length * copies
        base += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def place(pieces: DataFrame, size: int = 1024) -> DataFrame:
    """``pieces`` (of cut_pieces(), without columns that are not needed) with sequence_id and
    offset instead of part and number: sequences of at most ``size`` ids, gapless from 0."""
    per_task = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    per_task = materialize(per_task, "piece-counts")
    counts = {r.length: r.n for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `size` rows
    table = ranges(plan(counts, size))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = per_task.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    numbered = pieces.join(shift, ["length", "part"]).withColumn("number", F.col("number") + F.col("shift"))
    kept = [f for f in pieces.schema if f.name not in ("part", "number")]
    schema = StructType([*kept, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, copies, base, offset = table.T
        for b in batches:
            *columns, number = b.columns
            number = number.to_numpy(zero_copy_only=False)
            length = columns[at_length].to_numpy(zero_copy_only=False)
            at = np.searchsorted(key, length << NUMBER_BITS | number, side="right") - 1
            nth = number - first[at]
            bins = base[at] + nth // copies[at]
            starts = offset[at] + nth % copies[at] * length
            yield pa.RecordBatch.from_arrays([*columns, pa.array(bins), pa.array(starts)], schema=arrow)

    at_length = [f.name for f in kept].index("length")
    return numbered.select(*[f.name for f in kept], "number").mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer_path: str, pattern: str, size: int = 1024, end_id: int = 2) -> DataFrame:
    """All pieces of ``docs`` with their ids and places: cut_pieces() and place()."""
    return place(cut_pieces(docs, tokenizer_path, pattern, size, end_id), size)
