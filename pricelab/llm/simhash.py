"""Operator 7: SimHash near-duplicates by a segment-popcount grid.

Fingerprints are cut into 32 segments of two bits; the vector of the segments'
bit counts embeds the fingerprint so that the Manhattan distance of two
vectors never exceeds the Hamming distance of the fingerprints.  Two
fingerprints within ``max_bits`` differ by at most ``max_bits // 2`` in the
counts of one of the two halves of 16 segments, so a range join on a unit grid
over either half (a fingerprint's own cell and the cells within that radius)
meets every pair.  Inside a cell the Manhattan bound over all 32 segments and
then the exact bit distance decide.
"""
from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import as_bytes, did, map_docs, small_batches, words
from .components import connected_components

SEED = 42
_EVEN = np.uint64(0x5555555555555555)
_ONE = np.uint64(1)
_BLOCK = 255 * 64


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the 64-bit hashes have each bit set, highest bit first."""
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8)).reshape(-1, 64)
    bits = np.concatenate([bits, np.zeros((-len(bits) % 255, 64), np.uint8)])
    return bits.reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)


def simhash(tokens: list[bytes], shingle: int) -> int:
    """Fingerprint of a word sequence; 0 for no words."""
    if not tokens:
        return 0
    k = min(shingle, len(tokens))
    runs = zip(*(tokens[i:] for i in range(k)))
    digest, counts, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), 0
    while block := [digest(b" ".join(r), SEED) for r in islice(runs, _BLOCK)]:
        counts += bit_counts(np.array(block, np.uint64))
        n += len(block)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3, text: str = "text") -> DataFrame:
    """(doc_id, th, fp) of every row of ``docs``: th is the text's hash, fp the fingerprint as a signed long."""
    def run(b: pa.RecordBatch) -> dict:
        fps = [simhash(words(t.lower() if t else t), shingle) for t in as_bytes(b.column(1))]
        return {"doc_id": b.column(0), "th": b.column(2), "fp": np.array(fps, np.uint64).view(np.int64)}

    return map_docs(docs.select(F.col("doc_id").cast("long"), F.col(text).cast("string"), text_hash(text)), run,
                    "doc_id long, th long, fp long")


def text_hash(text: str = "text") -> Column:
    return F.xxhash64(F.col(text).cast("string"))


def counts_in_unary(fp: np.ndarray) -> np.ndarray:
    """Segment bit counts with each count as that many ones in the segment's two bits:
    the Manhattan distance of two count vectors is the bit distance of these."""
    hi, lo = (fp >> _ONE) & _EVEN, fp & _EVEN
    return (hi & lo) << _ONE | (hi | lo)


def _shifts(radius: int) -> list[dict[int, int]]:
    """Changes of up to ``radius`` in total of the counts of 16 segments, as {segment: change}."""
    out: list[dict[int, int]] = [{}]
    seen = {()}
    for _ in range(radius):
        for base in list(out):
            for s in range(16):
                for d in (-2, -1, 1, 2):
                    new = {**base, s: base.get(s, 0) + d}
                    new = {k: v for k, v in new.items() if v}
                    key = tuple(sorted(new.items()))
                    if key not in seen and sum(map(abs, new.values())) <= radius:
                        seen.add(key)
                        out.append(new)
    return out


def grid_cells(fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, probe): each fingerprint's own cells and those within the radius.

    A change and its reverse find the same pairs, so just one of the two is probed.
    """
    hi, lo = (fp >> _ONE) & _EVEN, fp & _EVEN
    counts = hi + lo                                  # two-bit fields, each 0, 1 or 2
    rows, cells, probes = [], [], []
    for half in (0, 1):
        own = (counts >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)
        tag = np.uint64(half << 32)
        for change in _shifts(max_bits // 2):
            if change and min(change.items())[1] < 0:
                continue                              # its reverse is probed
            ok = np.ones(len(fp), bool)
            cell = own.copy()
            for seg, d in change.items():
                at = np.uint64(2 * seg)
                now = ((own >> at) & np.uint64(3)).astype(np.int64) + d
                ok &= (now >= 0) & (now <= 2)
                cell = (cell & ~(np.uint64(3) << at)) | (now.clip(0, 2).astype(np.uint64) << at)
            rows.append(np.flatnonzero(ok))
            cells.append(cell[ok] | tag)
            probes.append(np.full(int(ok.sum()), int(bool(change)), np.int8))
    return np.concatenate(rows), np.concatenate(cells), np.concatenate(probes)


def forest(fp: np.ndarray, probe: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links that connect what the pairs within ``max_bits`` of one cell connect.

    A search that compares each reached fingerprint with those not reached yet:
    a dense group costs one sweep for each of its members over what is left,
    and gives a tree, not all pairs.  Two probes of a cell are not compared.
    """
    unary = counts_in_unary(fp)
    left = np.arange(len(fp))
    links: list[tuple[int, int]] = []
    while len(left):
        todo, left = [int(left[0])], left[1:]
        while todo and len(left):
            u = todo.pop()
            near = np.bitwise_count(unary[left] ^ unary[u]) <= max_bits
            near &= np.bitwise_count(fp[left] ^ fp[u]) <= max_bits
            if probe[u]:
                near &= probe[left] == 0
            found = left[near]
            if len(found):
                left = left[~near]
                links += [(u, int(v)) for v in found]
                todo += found.tolist()
    return links


def _cell_links(max_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            now = [b.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            held = now if held is None else [np.concatenate(x) for x in zip(held, now)]
            same = (held[0][1:] == held[0][:-1]) & (held[1][1:] == held[1][:-1])
            cuts = np.flatnonzero(~same)
            if len(cuts):
                done = cuts[-1] + 1                  # the last cell may go on in the next batch
                yield from links_of(*(x[:done] for x in held))
                held = [x[done:] for x in held]
        if held is not None:
            yield from links_of(*held)

    def links_of(cell, part, fp, probe):
        starts = np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1]) | (part[1:] != part[:-1])]))
        ends = np.append(starts[1:], len(cell))
        fp = fp.view(np.uint64)
        keep = (ends - starts > 1) & (probe[starts] == 0)     # sorted: own rows come first
        starts, ends = starts[keep], ends[keep]
        a, b = [], []
        two = ends - starts == 2
        s = starts[two]
        if len(s):
            x, y = fp[s], fp[s + 1]
            near = np.bitwise_count(counts_in_unary(x) ^ counts_in_unary(y)) <= max_bits
            near &= np.bitwise_count(x ^ y) <= max_bits
            a.append(x[near])
            b.append(y[near])
        for i, j in zip(starts[~two].tolist(), ends[~two].tolist()):
            part_fp = fp[i:j]
            if found := forest(part_fp, probe[i:j], max_bits):
                at = np.array(found)
                a.append(part_fp[at[:, 0]])
                b.append(part_fp[at[:, 1]])
        if a and sum(map(len, a)):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(v).view(np.int64)) for v in (a, b)], names=["a", "b"])

    return run


def fingerprint_links(fps: DataFrame, max_bits: int = 3, cell_limit: int = 20_000) -> DataFrame:
    """Links (a, b) that connect exactly what the pairs of distinct ``fp`` within
    ``max_bits`` bits connect (a spanning set, not all pairs).

    A cell with more than ``cell_limit`` own fingerprints is dealt out in
    blocks, each pair of blocks to a task of its own, so no task holds more
    than two blocks and no pair is lost.
    """
    if not 0 <= max_bits <= 5:
        raise ValueError("the grid serves bit distances from 0 to 5")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False)
            rows, cell, probe = grid_cells(fp.view(np.uint64), max_bits)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell.view(np.int64)), pa.array(fp[rows]), pa.array(probe)],
                names=["cell", "fp", "probe"])

    spark = fps.sparkSession
    small_batches(spark)
    dealt = fps.select("fp").mapInArrow(deal, "cell long, fp long, probe byte")
    big = (dealt.where("probe = 0").groupBy("cell").count()
           .where(F.col("count") > cell_limit)
           .select("cell", F.ceil(F.col("count") / cell_limit).cast("int").alias("blocks")))
    big = materialize(big, "simhash-big-cells")
    if big.isEmpty():
        parts = dealt.withColumn("part", F.lit(0))
    else:
        mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        parts = (dealt.join(big, "cell", "left")
                 .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
                 .withColumn("mine", mine).withColumn("other", other)
                 .where("blocks = 1 or mine <> other")
                 .withColumn("part", F.least("mine", "other") * F.col("blocks") + F.greatest("mine", "other")))
    return (parts.select("cell", "part", "fp", "probe")
            .repartition(F.col("cell"), F.col("part"))
            .sortWithinPartitions("cell", "part", "probe", "fp")
            .mapInArrow(_cell_links(max_bits), "a long, b long"))


#: Tasks that the documents of one fingerprint are spread over when they get their component.
SALTS = 16


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 3,
                    cell_limit: int = 20_000) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs`` (doc_id, text).

    fingerprint: 16 lowercase hex digits.  component_id: smallest doc_id among
    the documents reachable by links of at most ``max_bits`` differing bits.
    A null or empty text has fingerprint zero and links like any other.  A row
    with a null doc_id keeps it; a component of such rows alone has a null
    component_id.  Repeated rows are returned as often as given; other columns
    are not looked at.  An empty table gives no rows.
    """
    fps = materialize(fingerprints(docs, shingle).select("doc_id", "fp"), "simhash-docs")
    classes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-classes")
    links = fingerprint_links(classes, max_bits, cell_limit)
    roots = connected_components(links)
    linked = classes.join(roots.select(F.col("node").alias("fp"), "root"), "fp")
    ids = linked.groupBy("root").agg(F.min("rep").alias("low"))
    linked = linked.join(ids, "root").select("fp", "low")
    # documents of one fingerprint may be a third of all: each class stands under every salt
    salts = F.sequence(F.lit(0), F.lit(SALTS - 1))
    reps = (classes.join(linked, "fp", "left")
            .select("fp", F.coalesce("low", "rep").alias("component_id"), F.explode(salts).alias("salt")))
    salted = fps.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    return (salted.join(reps, ["fp", "salt"])
            .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                    "component_id"))


def representatives(docs: DataFrame, shingle: int = 3, max_bits: int = 3, cell_limit: int = 20_000) -> DataFrame:
    """(did, th): the first document, by id and text hash, of each component of near_duplicates().

    Rows that share a doc_id, or have none, stay apart if their texts are in different components.
    """
    fps = fingerprints(docs, shingle).select(did().alias("did"), "th", "fp")
    classes = materialize(fps.groupBy("fp").agg(F.min(F.struct("did", "th")).alias("rep")), "simhash-classes")
    roots = connected_components(fingerprint_links(classes, max_bits, cell_limit))
    return (classes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left")
            .groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("rep").alias("rep"))
            .select("rep.did", "rep.th"))


def one_row_each(kept: DataFrame) -> DataFrame:
    """One row of each document (doc_id and text): the one of the smallest hash, if rows repeat."""
    by_id, by_text = did(), text_hash()
    often = kept.groupBy(by_id.alias("__did"), by_text.alias("__th")).agg(F.count("*").alias("n")).where("n > 1")
    often = materialize(often.select("__did", "__th"), "repeated-rows")
    if often.isEmpty():
        return kept
    same = (by_id == often["__did"]) & (by_text == often["__th"])
    many = kept.join(often, same, "left_semi")
    first = (many.groupBy(by_id.alias("__did"), by_text.alias("__th"))
             .agg(F.min_by(F.struct(*kept.columns), F.xxhash64(*kept.columns)).alias("row"))
             .select("row.*"))
    return kept.join(often, same, "left_anti").unionByName(first)
