"""Operator 13: alignment of two tokenizers' tokens by diagonal run skipping.

Both tokenizations cover the same bytes, so each is a rising array of token
ends.  aligned() walks the two arrays at a shift (index in B minus index in A):
while tokens end together one to one, blocks of doubling length are compared at
that shift and jumped over; where they part, the side that ends first goes on
until both end together, which closes an irregular group and sets the shift
anew.  It runs on the new chunks of a block of texts, one after another as one
pair of arrays (every chunk's end is a common end); a chunk's groups are
remembered as rows of arrays, so a document's groups are those of its chunks.

Id pairs are counted corpus-wide by Spark: one row for each document and
distinct pair, combined before the shuffle.  The most frequent pairs (a bounded
number) come back to the tasks as one sorted table; the others are joined.
"""
from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import materialize
from .chunks import ByteTokens, PieceTokens, cut
from .common import map_docs, small_batches

ALIGNED = ("row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, "
           "groups string, pairs array<long>, times array<long>")


def aligned(a: list[int], b: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Where the groups end in ``a`` and in ``b`` (positions behind their last tokens).

    ``a`` and ``b`` are rising ends over the same bytes, so their last values are equal.
    """
    odd = []                                                   # irregular groups: from and to in a, from and to in b
    arr_a, arr_b = np.asarray(a, np.int64), np.asarray(b, np.int64)
    i, j, n, run = 0, 0, len(a), 0
    while i < n:
        if a[i] == b[j]:                                       # a one-to-one stretch at shift j - i
            i, j, run = i + 1, j + 1, run + 1
            if run < 16:
                continue
            step = 16
            while i < n:
                w = min(step, n - i, len(b) - j)
                differ = arr_a[i:i + w] != arr_b[j:j + w]
                k = int(differ.argmax()) if differ.any() else w
                i, j = i + k, j + k
                if k < step:
                    break
                step *= 2
            run = 0
        else:                                                  # an irregular group
            from_i, from_j, run = i, j, 0
            x, y = a[i], b[j]
            while x != y:
                if x < y:
                    i += 1
                    x = a[i]
                else:
                    j += 1
                    y = b[j]
            i, j = i + 1, j + 1
            odd.append((from_i, i, from_j, j))
    odd = np.array(odd, np.int64).reshape(-1, 4)
    return _ends(n, odd[:, 0], odd[:, 1]), _ends(len(b), odd[:, 2], odd[:, 3])


def _ends(n: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """1 to ``n`` without what lies between each ``low`` and ``high``."""
    inner = np.zeros(n + 1, np.int64)
    np.add.at(inner, low + 1, 1)
    np.add.at(inner, high, -1)
    return np.flatnonzero(np.cumsum(inner)[1:] == 0) + 1


class Memory:
    """What is known of chunks, as arrays; forgets those not met for longest."""

    def __init__(self, size: int):
        self.size, self.now = size, 0
        self.row: dict[str, int] = {}
        self.texts: list[str] = []                             # groups as text
        self.counts = np.zeros((0, 4), np.int64)               # tokens in A and B, groups, links; zeros if B's bytes differ
        self.n_codes = self.start = self.used = np.zeros(0, np.int64)
        self.codes = self.times = np.zeros(0, np.int64)        # codes of linked id pairs, how often each is linked

    def rows(self, chunks: list[str]) -> np.ndarray:
        return np.fromiter(map(self.row.get, chunks, repeat(-1)), np.int64, len(chunks))

    def add(self, chunks: list[str], texts: list[str], *arrays: np.ndarray) -> None:
        """``arrays``: counts, n_codes, codes and times of new ``chunks``."""
        self.row.update(zip(chunks, range(len(self.row), len(self.row) + len(chunks))))
        self.texts += texts
        self.counts, self.n_codes, self.codes, self.times = (
            np.concatenate(x) for x in zip((self.counts, self.n_codes, self.codes, self.times), arrays))
        self.start = np.cumsum(self.n_codes) - self.n_codes
        self.used = np.concatenate([self.used, np.zeros(len(chunks), np.int64)])

    def code_places(self, rows: np.ndarray) -> np.ndarray:
        """Places of the codes of all ``rows``, one row after another."""
        n = self.n_codes[rows]
        return np.repeat(self.start[rows] - np.cumsum(n) + n, n) + np.arange(n.sum())

    def turn(self, rows: np.ndarray) -> None:
        """To be called after each block, with the rows it used."""
        self.now += 1
        self.used[rows] = self.now
        if len(self.row) <= self.size:
            return
        half = self.size // 2
        kept = np.flatnonzero(self.used >= np.partition(self.used, len(self.used) - half)[len(self.used) - half])
        chunks, places, at = list(self.row), self.code_places(kept), kept.tolist()
        self.row = {chunks[k]: i for i, k in enumerate(at)}
        self.texts = [self.texts[k] for k in at]
        self.counts, self.n_codes, self.used = self.counts[kept], self.n_codes[kept], self.used[kept]
        self.codes, self.times = self.codes[places], self.times[places]
        self.start = np.cumsum(self.n_codes) - self.n_codes


class Aligner:
    """Groups of chunks under two tokenizers; remembers a bounded number of chunks."""

    #: Chunks remembered, characters handled at a time, and links of a group that are listed before equal ones are counted.
    REMEMBER, BLOCK, LISTED = 300_000, 2_000_000, 64

    def __init__(self, path_a: str, pattern: str, path_b: str):
        self.a, self.b = ByteTokens(path_a, pattern), PieceTokens(path_b)
        self.labels = [f"{i}{mark}" for n, marks in ((self.a.n_ids, ",|"), (self.b.n_ids, ",;")) for mark in marks for i in range(n)]
        self.label_width = np.fromiter(map(len, self.labels), np.int64, len(self.labels))
        self.memory = Memory(self.REMEMBER)

    def _learn(self, new: list[str]) -> tuple:
        """What Memory.add() takes of the ``new`` chunks."""
        chunks = [" " + k for k in new]
        ids_b, n_b, same = self.b.encode(chunks)
        if not same.all():
            ids_b, n_b = ids_b[np.repeat(same, n_b)], n_b[same]
            chunks = [c for c, s in zip(chunks, same.tolist()) if s]
        ids_a, n_a = self.a.encode(chunks)
        to_a, to_b = aligned(np.cumsum(self.a.width[ids_a]).tolist(), np.cumsum(self.b.width[ids_b]).tolist())
        size, codes, times = self._pairs(ids_a, ids_b, to_a, to_b)
        last = np.searchsorted(to_a, np.cumsum(n_a), side="right")        # groups up to each chunk's end
        upto = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[last], prepend=0)
        links = np.diff(to_a, prepend=0) * np.diff(to_b, prepend=0)
        counts, n_codes = np.zeros((len(new), 4), np.int64), np.zeros(len(new), np.int64)
        counts[same] = np.stack([n_a, n_b, np.diff(last, prepend=0), upto(links)], axis=1)
        n_codes[same] = upto(size)
        texts = np.full(len(new), "", object)
        texts[same] = self._texts(ids_a, ids_b, to_a, to_b, np.cumsum(n_a + n_b))
        return texts.tolist(), counts, n_codes, codes, times

    def _texts(self, ids_a: np.ndarray, ids_b: np.ndarray, to_a: np.ndarray, to_b: np.ndarray, ends: np.ndarray) -> list[str]:
        """Text of the groups of each chunk; ``ends``: tokens in A and B up to each chunk's end."""
        from_a, from_b = (np.concatenate([[0], x])[:-1] for x in (to_a, to_b))
        label = np.empty(len(ids_a) + len(ids_b), np.int64)    # of A's, then B's tokens of each group in turn
        label[np.arange(len(ids_a)) + np.repeat(from_b, to_a - from_a)] = ids_a
        label[np.arange(len(ids_b)) + np.repeat(to_a, to_b - from_b)] = ids_b + 2 * self.a.n_ids
        label[to_a - 1 + from_b] += self.a.n_ids
        label[to_b - 1 + to_a] += self.b.n_ids
        text = "".join(map(self.labels.__getitem__, label.tolist()))
        high = np.cumsum(self.label_width[label])[ends - 1]
        return [text[i:j] for i, j in zip([0, *high.tolist()], (high - 1).tolist())]

    def _pairs(self, ids_a: np.ndarray, ids_b: np.ndarray, to_a: np.ndarray, to_b: np.ndarray):
        """Of groups that end at ``to_a`` and ``to_b``: each one's number of id pairs listed, the pairs'
        codes one group after another, and how often each is linked."""
        from_a, from_b = (np.concatenate([[0], x])[:-1] for x in (to_a, to_b))
        m, width = to_b - from_b, self.b.n_ids
        size = (to_a - from_a) * m
        large = np.flatnonzero(size > self.LISTED)
        more, often = [], []
        for g in large.tolist():
            xs, ys = (Counter(ids[i:u].tolist()).items() for ids, i, u in ((ids_a, from_a[g], to_a[g]), (ids_b, from_b[g], to_b[g])))
            more += [x * width + y for x, _ in xs for y, _ in ys]
            often += [p * q for _, p in xs for _, q in ys]
            size[g] = len(xs) * len(ys)
        group = np.repeat(np.arange(len(size)), size)
        x, y = np.divmod(np.arange(len(group)) - np.repeat(np.cumsum(size) - size, size), m[group])
        listed = np.ones(len(size), bool)
        listed[large] = False
        listed, codes, times = listed[group], np.empty(len(group), np.int64), np.ones(len(group), np.int64)
        x, y = (from_a[group] + x)[listed], (from_b[group] + y)[listed]
        codes[listed] = ids_a[x] * width + ids_b[y]
        codes[~listed], times[~listed] = more, often
        return size, codes, times

    def documents(self, texts: list[str]) -> Iterator[tuple]:
        """Of each text (n_a, n_b, n_groups, n_links, groups, pairs, times), pairs rising and
        distinct; texts are handled some MB at a time."""
        i = 0
        while i < len(texts):
            j, size, split = i, 0, []
            while j < len(texts) and (j == i or size + len(texts[j]) <= self.BLOCK):
                size += len(texts[j])
                split.append(cut(" " + texts[j]) if texts[j] else [])
                j += 1
            for s in split:
                if s and s[0]:                                 # " " + text is cut at its first space unless more white space follows
                    s[0] = s[0][1:]
                elif s:
                    del s[0]
            yield from self._block(split)
            i = j

    def _block(self, split: list[list[str]]) -> Iterator[tuple]:
        known, chunks = self.memory, list(chain.from_iterable(split))
        rows = known.rows(chunks)
        unknown = np.flatnonzero(rows < 0)
        if len(unknown):
            chunks = list(map(chunks.__getitem__, unknown.tolist()))
            new = list(dict.fromkeys(chunks))
            known.add(new, *self._learn(new))
            rows[unknown] = known.rows(chunks)
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        ends, docs = np.cumsum(sizes), np.arange(len(split))
        total = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(known.counts[rows], axis=0)])
        counts = total[ends] - total[ends - sizes]
        doc = np.repeat(docs, sizes)
        none = sizes == 0
        none[doc[known.counts[rows, 0] == 0]] = True
        doc, codes, times = self._linked(doc, rows)
        cuts = np.searchsorted(doc, np.append(docs, len(split))).tolist()
        all_rows, text = rows.tolist(), known.texts.__getitem__
        for k, (c, odd, end) in enumerate(zip(counts.tolist(), none.tolist(), ends.tolist())):
            if odd:
                yield 0, 0, 0, 0, "", [], []
            else:
                part = slice(cuts[k], cuts[k + 1])
                yield *c, ";".join(map(text, all_rows[end - len(split[k]):end])), codes[part], times[part]
        known.turn(rows)

    def _linked(self, doc: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct id pairs of the documents ``doc`` that hold the chunks ``rows``: document, code, links."""
        known, span = self.memory, self.a.n_ids * self.b.n_ids
        key, often = np.unique(doc * max(1, len(known.row)) + rows, return_counts=True)
        doc, rows = np.divmod(key, max(1, len(known.row)))
        at, n = known.code_places(rows), known.n_codes[rows]
        key = np.repeat(doc, n) * span + known.codes[at]
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else order
        times = (np.repeat(often, n) * known.times[at])[order]
        return *np.divmod(key[first], span), np.add.reduceat(times, first) if len(key) else times


@lru_cache(maxsize=2)
def aligner(path_a: str, pattern: str, path_b: str) -> Aligner:
    """One aligner for each Python worker."""
    return Aligner(path_a, pattern, path_b)


def align(docs: DataFrame, path_a: str, pattern: str, path_b: str, digest: bool = False) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): row (a number of its own), doc_id,
    n_a, n_b, n_groups, n_links, groups, pairs (distinct codes of linked ids, rising: A's id times
    B's vocabulary size plus B's id) and times (links of each pair in the document).

    ``path_a`` names a byte-level BPE file (.json), read for a space and the text, ``path_b`` a
    SentencePiece file that adds the space itself; special strings are plain text.
    groups: ``a1,a2|b1;a3|b2`` in order, its SHA-256 if ``digest``.  A text that is null or empty,
    or whose tokens in A or B do not give its bytes back, has no tokens: zeros, an empty
    string and empty arrays.  Repeated rows and null doc_ids are rows like others;
    other columns are not looked at; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    arrow = to_arrow_schema(StructType.fromDDL(ALIGNED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = aligner(path_a, pattern, path_b)
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            rows = []
            for doc, (*counts, groups, pairs, times) in zip(b.column(0).to_pylist(), worker.documents(
                    [t or "" for t in b.column(1).to_pylist()])):
                if digest and groups:
                    groups = hashlib.sha256(groups.encode()).hexdigest()
                rows.append((row, doc, *counts, groups, pairs, times))
                row += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, ALIGNED)


def pair_counts(rows: DataFrame, width: int) -> DataFrame:
    """(pair, n, best): in how many ``rows`` of align() a pair is linked, and whether no pair of
    its A id is in more.  ``width``: B's vocabulary size."""
    counts = rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    counts = materialize(counts.withColumn("a", F.expr(f"pair div {width}")), "pair-counts")
    top = counts.groupBy("a").agg(F.max("n").alias("top"))
    return counts.join(top, "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def frequent(pairs: DataFrame, at_most: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Least count of the most frequent pairs, at most ``at_most`` of them, and these pairs
    (rising), their counts and best marks.  The histogram that decides has a row for each
    power of two."""
    power = F.floor(F.log2("n")).cast("int")
    of = dict(pairs.groupBy(power.alias("p")).agg(F.count("*").alias("c")).collect())
    floor, n = 63, 0
    while floor > 0 and n + of.get(floor - 1, 0) <= at_most:
        floor -= 1
        n += of.get(floor, 0)
    got = pairs.where(F.col("n") >= F.lit(1 << min(floor, 62))).toArrow().sort_by("pair") if n else None
    if got is None:
        return 1 << min(floor, 62), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    pair, count, best = (c.combine_chunks().to_numpy(zero_copy_only=False) for c in got.columns)
    return 1 << floor, pair, count, best


def link_counts(rows: DataFrame, pairs: DataFrame, table_pairs: int) -> DataFrame:
    """``rows`` (written rows of align()) without pairs and times, with n_best (links whose pair is
    a best one) and count_sum (sum of the counts of all links' pairs)."""
    floor, known, count, best = frequent(pairs, table_pairs)

    def look_up(b: pa.RecordBatch) -> dict:
        codes, times = (b.column(k).flatten().to_numpy(zero_copy_only=False) for k in (1, 2))
        row = np.repeat(np.arange(b.num_rows), pa.compute.list_value_length(b.column(1)).to_numpy(zero_copy_only=False))
        at = np.minimum(np.searchsorted(known, codes), max(len(known) - 1, 0))
        hit = known[at] == codes if len(known) else np.zeros(len(codes), bool)
        n = np.zeros((2, b.num_rows), np.int64)
        np.add.at(n[0], row[hit], times[hit] * best[at[hit]])
        np.add.at(n[1], row[hit], times[hit] * count[at[hit]])
        rest = ~hit
        ends = np.searchsorted(row[rest], np.arange(b.num_rows + 1)).astype(np.int32)
        rare, often = (pa.ListArray.from_arrays(ends, pa.array(x[rest])) for x in (codes, times))
        return {"row": b.column(0), "n_best": n[0], "count_sum": n[1], "rare": rare, "often": often}

    found = map_docs(rows.select("row", "pairs", "times"), look_up,
                     "row long, n_best long, count_sum long, rare array<long>, often array<long>")
    found = materialize(found, "links-found")
    rare = found.select("row", F.explode(F.arrays_zip("rare", "often")).alias("z")).select(
        "row", F.col("z.rare").alias("pair"), F.col("z.often").alias("often"))
    rare = rare.join(pairs.where(F.col("n") < floor), "pair").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("often")).otherwise(0)).alias("rare_best"),
        F.sum(F.col("often") * F.col("n")).alias("rare_sum"))
    both = found.select("row", "n_best", "count_sum").join(rare, "row", "left").select(
        "row", (F.col("n_best") + F.coalesce("rare_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("rare_sum", F.lit(0))).alias("count_sum"))
    return rows.drop("pairs", "times").join(both, "row").drop("row")


def linked(docs: DataFrame, path_a: str, pattern: str, path_b: str, digest: bool = False,
           table_pairs: int = 200_000) -> DataFrame:
    """The rows of align(), with n_best and count_sum of link_counts() over all of them.

    At most ``table_pairs`` of the id pairs (17 bytes each) go to the tasks as a table.
    """
    rows = materialize(align(docs, path_a, pattern, path_b, digest), "aligned")
    pairs = materialize(pair_counts(rows, PieceTokens(path_b).n_ids), "pairs")
    return link_counts(rows, pairs, table_pairs)
