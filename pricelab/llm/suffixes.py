"""Operator 1: repeated passages by sparse suffix arrays.

Suffixes are kept only where a minimiser says so (anchors.py): every stretch
of ``min_words`` words holds the start of a kept suffix, and equal stretches
hold equal ones at equal places.  Suffixes that begin with the same anchor go
to one shard and are sorted there; neighbours in that order have the longest
common beginnings, and neighbours in the order of the words read backwards
from the anchor the longest common left contexts.  The two lengths say how far
a match can reach to the right and to the left; inside that reach the stretches
are compared exactly and every occurrence is linked to an earlier one.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .anchors import minimisers, packed, shared_anchors, unpack
from .common import MAX_ID, map_docs, small_batches, words

ANCHOR_WORDS = 8
#: Rows without an anchor: a suffix whose context came before in its batch, and where.
_SUFFIXES = ("anchor long, did long, th long, place int, left binary, right binary, lo int, hi int, led boolean, "
             "first_did long, first_th long, first_lo int")
#: Runs of stretches of the suffix (did, th, lo) with the first occurrence of each, which may be their own.
_RUNS = "did long, th long, lo int, led boolean, start int, n int, first_did long, first_th long, first_start int"


def _suffixes(span: int):
    """Kept suffixes: their place, up to ``span`` words from there on, the words before,
    and the range lo..hi of starts of the stretches that chose this place.  ``led``: others of
    the batch have the same context and name this one."""
    def run(b: pa.RecordBatch) -> dict:
        rows: list[list] = []
        seen: dict[tuple, list] = {}
        for d, th, z, anchors in sorted(zip(*(b.column(i).to_pylist() for i in range(4))), key=lambda x: x[:2]):
            tokens = words(unpack(z))
            place, runs = minimisers(tokens, ANCHOR_WORDS, span)
            first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
            ends = np.append(first[1:], len(place))
            keys = runs[place[first]].view(np.int64)
            for i in np.flatnonzero(np.isin(keys, np.array(anchors, np.int64))).tolist():
                lo, hi = int(first[i]), int(ends[i])
                p = int(place[lo])
                left, right = b" ".join(tokens[lo:p]), b" ".join(tokens[p:hi + span - 1])
                head = seen.get((left, right))
                if head is None:
                    seen[left, right] = head = [int(keys[i]), d, th, p, left, right, lo, hi, False, None, None, None]
                    rows.append(head)
                elif (head[1], head[2], head[6]) != (d, th, lo):      # else a repeated row of the table
                    head[8] = True
                    rows.append([None, d, th, p, None, None, lo, hi, False, head[1], head[2], head[6]])
        names = [f.split(" ")[0] for f in _SUFFIXES.split(", ")]
        return dict(zip(names, zip(*rows))) if rows else {c: [] for c in names}

    return run


def _single_stretches(span: int):
    """Each stretch of a context as a row of its own, by a digest of its words."""
    def run(b: pa.RecordBatch) -> dict:
        out: dict[str, list] = {c: [] for c in ("context", "did", "th", "lo", "start", "stretch")}
        for context, d, th, left, right, lo, hi in zip(*(c.to_pylist() for c in b.columns)):
            tokens = left.split() + right.split()
            for s in range(lo, hi):
                digest = hashlib.sha256(b" ".join(tokens[s - lo:s - lo + span])).digest()
                for c, v in zip(out, (context, d, th, lo, s, digest)):
                    out[c].append(v)
        return out

    return run


def _context_runs(b: pa.RecordBatch) -> dict:
    """Of each context the runs (i, n) of its stretches whose first occurrences follow each other."""
    out: dict[str, list] = {c: [] for c in ("context", "i", "n", "first_did", "first_th", "first_start")}
    for context, links in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
        runs: list[list] = []
        for x in links:
            i, d, th, s = x["i"], x["did"], x["th"], x["start"]
            if runs and runs[-1][2:4] == [d, th] and runs[-1][4] + runs[-1][1] == s:
                runs[-1][1] += 1
            else:
                runs.append([i, 1, d, th, s])
        for r in runs:
            for c, v in zip(out, (context, *r)):
                out[c].append(v)
    return out


def _common(a: list[bytes], b: list[bytes]) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def neighbour_reach(keys: list[list[bytes]]) -> list[int]:
    """For each word sequence, the most words it has in common at the beginning with another
    one: that with a neighbour in sorted order."""
    order = sorted(range(len(keys)), key=keys.__getitem__)
    out = [0] * len(keys)
    for i, j in zip(order, order[1:]):
        n = _common(keys[i], keys[j])
        out[i], out[j] = max(out[i], n), max(out[j], n)
    return out


def _matches(span: int):
    """Runs (``_RUNS``) of the stretches of whole groups of suffixes: those that occur before, and
    of a suffix that leads others all."""
    def of_group(rows: list[tuple]) -> list[tuple]:
        if len(rows) < 2 and not rows[0][7]:
            return []
        rights = [r[4].split() for r in rows]
        lefts = [r[3].split()[::-1] for r in rows]
        right, left = neighbour_reach(rights), neighbour_reach(lefts)
        first: dict[tuple, tuple] = {}
        out: list[tuple] = []
        for i in sorted(range(len(rows)), key=lambda i: rows[i][:3]):
            d, th, p, _, _, lo, hi, led = rows[i]
            tokens = lefts[i][::-1] + rights[i]
            reach = range(max(lo, p - left[i]), min(hi, p + right[i] - span + 1))
            last = None                                        # run of this suffix that may go on
            for s in range(lo, hi) if led else reach:
                here = (d, th, s)
                met = first.setdefault(tuple(tokens[s - lo:s - lo + span]), here) if s in reach else here
                if met == here and not led:
                    last = None
                elif last is not None and last[4] + last[5] == s and last[6:8] == [*met[:2]] and last[8] + last[5] == met[2]:
                    last[5] += 1
                else:
                    last = [d, th, lo, led, s, 1, *met]
                    out.append(last)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        key = None
        for b in batches:
            out: list[tuple] = []
            for anchor, *row in zip(*(c.to_pylist() for c in b.columns)):
                if anchor != key:
                    out += of_group(held) if held else []
                    held, key = [], anchor
                held.append(tuple(row))
            if out:
                yield table(out)
        if held and (out := of_group(held)):
            yield table(out)

    def table(rows: list[list]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]
        names = [f.split(" ")[0] for f in _RUNS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return run


def _big_runs(same: DataFrame, span: int) -> DataFrame:
    """_matches() for anchors with very many suffixes: equal contexts are combined to their first, and
    the first occurrence of each stretch of these is an aggregate, so no task holds such a group."""
    same = same.withColumn("context", F.sha2(F.concat_ws("|", F.hex("left"), F.hex("right")), 256))
    heads = same.groupBy("context").agg(F.min(F.struct("did", "th", "lo", "hi")).alias("head"),
                                        F.any_value("left").alias("left"), F.any_value("right").alias("right"))
    single = materialize(map_docs(heads.select("context", "head.did", "head.th", "left", "right", "head.lo", "head.hi"),
                                  _single_stretches(span),
                                  "context string, did long, th long, lo int, start int, stretch binary"), "stretches")
    first = single.groupBy("stretch").agg(F.min(F.struct("did", "th", "start")).alias("first"))
    links = (single.join(first, "stretch").groupBy("context")      # one entry for each stretch of one suffix
             .agg(F.sort_array(F.collect_list(F.struct((F.col("start") - F.col("lo")).alias("i"), "first.did", "first.th",
                                                       F.col("first.start").alias("start")))).alias("links")))
    runs = map_docs(links, _context_runs, "context string, i int, n int, first_did long, first_th long, first_start int")
    return (same.select("context", "did", "th", "lo", "led").join(runs, "context")
            .select("did", "th", "lo", "led", (F.col("lo") + F.col("i")).alias("start"), "n", "first_did", "first_th", "first_start"))


def repeated_passages(docs: DataFrame, min_words: int = 50, group_limit: int = 5_000) -> DataFrame:
    """(doc_id, start_word, n_words, first_doc_id, first_start): passages of ``docs`` (doc_id, text)
    of at least ``min_words`` words that occur before, in a document of a smaller doc_id or
    further up in the same one, each with an earlier occurrence.

    Every stretch of ``min_words`` words that has occurred before is inside a
    returned passage, linked to the first one; stretches next to each other whose
    first occurrences follow each other are one passage.  A document whose word sequence equals an
    earlier document's is one passage, all of it.  Words are ``[^\\x20\\x09-\\x0D]+``,
    unchanged.  Null, empty and shorter texts give no rows.  A null doc_id
    counts as the largest and is returned as null; documents of one doc_id and
    different texts follow each other by text hash; fully repeated rows are
    one document.  Other columns are not looked at; an empty table gives no rows.

    Equal contexts of a batch go through the shard as one.  Of an anchor that still has more than
    ``group_limit`` suffixes, equal contexts are combined to their first, and the
    different ones are dealt out stretch by stretch.  Neither changes the rows.
    """
    small_batches(docs.sparkSession)
    copies, candidates = shared_anchors(docs, ANCHOR_WORDS, min_words)
    joined = packed(docs).join(candidates, ["did", "th"]).select("did", "th", "z", "anchors")
    rows = materialize(map_docs(joined, _suffixes(min_words), _SUFFIXES), "suffixes")
    followers = rows.where("anchor is null").select(
        F.col("did").alias("by_did"), F.col("th").alias("by_th"), F.col("lo").alias("by_lo"),
        F.col("first_did").alias("did"), F.col("first_th").alias("th"), F.col("first_lo").alias("lo"))
    rows = rows.where("anchor is not null").select("anchor", "did", "th", "place", "left", "right", "lo", "hi", "led")
    big = materialize(rows.groupBy("anchor").count().where(F.col("count") > group_limit).select("anchor"), "big-anchors")
    some_big = not big.isEmpty()
    few = rows.join(big, "anchor", "left_anti") if some_big else rows
    runs = few.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_matches(min_words), _RUNS)
    if some_big:
        runs = runs.unionByName(_big_runs(rows.join(big, "anchor", "left_semi"), min_words))
    runs = materialize(runs, "runs")
    here = F.struct("did", "th", "start") != F.struct("first_did", "first_th", "first_start")
    followed = followers.join(runs.where("led").distinct(), ["did", "th", "lo"]).select(
        F.col("by_did").alias("did"), F.col("by_th").alias("th"), (F.col("by_lo") + F.col("start") - F.col("lo")).alias("start"),
        "n", "first_did", "first_th", "first_start")
    found = runs.where(here).drop("lo", "led").unionByName(followed)
    line = Window.partitionBy("did", "th", "first_did", "first_th", "diagonal").orderBy("start")
    new = F.coalesce(F.col("start") > F.max(F.col("start") + F.col("n")).over(line.rowsBetween(Window.unboundedPreceding, -1)),
                     F.lit(True))
    passages = (found.withColumn("diagonal", F.col("first_start") - F.col("start")).withColumn("new", new.cast("int"))
                .withColumn("island", F.sum("new").over(line))
                .groupBy("did", "th", "first_did", "first_th", "diagonal", "island")
                .agg(F.min("start").alias("start_word"), F.max(F.col("start") + F.col("n") + min_words - 1).alias("end"))
                .select("did", "start_word", (F.col("end") - F.col("start_word")).alias("n_words"), "first_did",
                        (F.col("start_word") + F.col("diagonal")).alias("first_start")))
    whole = copies.distinct().select("did", F.lit(0).alias("start_word"), "n_words", "first_did", F.lit(0).alias("first_start"))
    doc = lambda c: F.when(F.col(c) < MAX_ID, F.col(c))
    return passages.unionByName(whole).select(
        doc("did").alias("doc_id"), "start_word", "n_words", doc("first_did").alias("first_doc_id"), "first_start")
