"""Operator 8: substring dedup by automata of repeated phrases.

1. Anchors that recur (anchors.py) tell which stretches of which documents can
   repeat; each such anchor gives a segment, the words of the windows that
   chose it.  Segments go to the shard of their anchor, so a document reaches
   the shards that its own anchors name and no others.
2. In a shard, windows seen twice are confirmed as recurring phrases, word by
   word, and compiled into Aho-Corasick automata over word numbers.
3. The shard's segments stream through the automaton in document order; of
   each phrase's occurrences the first is kept and the others are cut.

Anchors with very many segments go no such way: the first occurrence of each of
their windows is an aggregate, and the others are cut by a join with it.
"""
from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import materialize
from .anchors import minimisers, packed, shared_anchors, unpack
from .common import map_docs, small_batches, words

ANCHOR_WORDS = 8
#: Windows compiled into one automaton at most, beyond those of one anchor's group.
AUTOMATON_WINDOWS = 30_000


def _segments(span: int):
    """Segments of candidate documents; a segment met before in the batch is cut at once."""
    def run(b: pa.RecordBatch) -> dict:
        out: dict[str, list] = {c: [] for c in ("anchor", "did", "th", "start", "n", "segment")}
        found, docs = [], set()
        for d, th, z, anchors in zip(*(b.column(i).to_pylist() for i in range(4))):
            if (d, th) in docs:              # a repeated row is the same document
                continue
            docs.add((d, th))
            tokens = words(unpack(z))
            place, runs = minimisers(tokens, ANCHOR_WORDS, span)
            first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
            ends = np.append(first[1:], len(place))
            keys = runs[place[first]].view(np.int64)
            for i in np.flatnonzero(np.isin(keys, np.array(anchors, np.int64))).tolist():
                s, e = int(first[i]), int(ends[i])
                found.append((d, th, s, e - s, int(keys[i]), b" ".join(tokens[s:e + span - 1])))
        found.sort(key=lambda r: r[:3])
        seen = set()
        for d, th, s, n, key, segment in found:
            again = segment in seen
            seen.add(segment)
            for c, v in zip(out, (None if again else key, d, th, s, n, None if again else segment)):
                out[c].append(v)
        return out

    return run


def _window_digests(span: int):
    """Each window of a segment by the 128-bit digest of its words."""
    def run(b: pa.RecordBatch) -> dict:
        out: dict[str, list] = {c: [] for c in ("did", "th", "start")}
        digests: list[bytes] = []
        for d, th, s, n, segment in zip(*(c.to_pylist() for c in b.columns)):
            tokens = segment.split(b" ")
            digests += [xxhash.xxh3_128_digest(b" ".join(tokens[i:i + span])) for i in range(n)]
            out["did"] += [d] * n
            out["th"] += [th] * n
            out["start"] += range(s, s + n)
        both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        return {"w1": both[:, 0], "w2": both[:, 1], **out}

    return run


def _later_windows(segments: DataFrame, span: int) -> DataFrame:
    """Cuts (did, th, start, n) among segments of any number for an anchor: of each window all
    occurrences but the first, which is found by a partial aggregate."""
    windows = map_docs(segments.select("did", "th", "start", "n", "segment"), _window_digests(span),
                       "w1 long, w2 long, did long, th long, start int")
    windows = materialize(windows, "frequent-windows")
    place = F.struct("did", "th", "start")
    first = (windows.groupBy("w1", "w2").agg(F.min(place).alias("first"), F.max(place).alias("last"))
             .where("first <> last").select("w1", "w2", "first"))
    return (windows.join(first, ["w1", "w2"]).where(place != F.col("first"))
            .select("did", "th", "start").distinct().withColumn("n", F.lit(1)))


def _locate(span: int):
    """Cuts (did, th, start, n) among the segments of whole groups that arrive in order."""
    def cuts_of(rows: list[tuple]) -> list[tuple]:
        numbers: dict[bytes, int] = {}
        streams = [tuple(numbers.setdefault(w, len(numbers)) for w in r[4].split(b" ")) for r in rows]
        seen = Counter(s[i:i + span] for s in streams for i in range(len(s) - span + 1))
        phrases = [p for p, n in seen.items() if n > 1]
        if not phrases:
            return []
        automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for i, p in enumerate(phrases):
            automaton.add_word(p, i)
        automaton.make_automaton()
        met = bytearray(len(phrases))
        cuts: list[tuple] = []
        for (d, th, start, _, _), stream in zip(rows, streams):
            for end, i in automaton.iter(stream):
                at = start + end - span + 1
                if not met[i]:
                    met[i] = 1
                elif cuts and cuts[-1][:2] == (d, th) and cuts[-1][2] + cuts[-1][3] == at:
                    cuts[-1] = (d, th, cuts[-1][2], cuts[-1][3] + 1)
                else:
                    cuts.append((d, th, at, 1))
        return cuts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []          # segments of whole groups and of the group that goes on
        key, size = None, 0
        for b in batches:
            out: list[tuple] = []
            for anchor, *row in zip(*(c.to_pylist() for c in b.columns)):
                if anchor == key and held and held[-1][:3] == tuple(row[:3]):
                    continue                 # a repeated row of the table
                if anchor != key:
                    if size >= AUTOMATON_WINDOWS:
                        out += cuts_of(held)
                        held, size = [], 0
                    key = anchor
                held.append(tuple(row))
                size += row[3]
            if out:
                yield table(out)
        if held and (out := cuts_of(held)):
            yield table(out)

    def table(cuts: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*cuts))
        return pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()),
             pa.array(cols[3], pa.int32())], names=["did", "th", "start", "n"])

    return run


def repeated_windows(docs: DataFrame, span: int = 20, group_limit: int = 5_000) -> DataFrame:
    """Rows (did, th, start, n): the n windows of ``span`` words from ``start`` on also start earlier,
    in a document before or further up in the same one.  n = -1: all words, as the document is a copy.

    The windows of an anchor with more than ``group_limit`` segments are held against their first
    occurrences by a join, so no task holds such a group.
    """
    spark = docs.sparkSession
    small_batches(spark)
    copies, candidates = shared_anchors(docs, ANCHOR_WORDS, span)
    joined = packed(docs).join(candidates, ["did", "th"]).select("did", "th", "z", "anchors")
    columns = "anchor long, did long, th long, start int, n int, segment binary"
    segments = materialize(map_docs(joined, _segments(span), columns), "segments")
    known = segments.where("segment is null").select("did", "th", "start", "n")
    segments = segments.where("segment is not null")
    big = materialize(segments.groupBy("anchor").count().where(F.col("count") > group_limit).select("anchor"), "big-anchors")
    few = segments
    if not big.isEmpty():
        few = segments.join(big, "anchor", "left_anti")
        known = known.unionByName(_later_windows(segments.join(big, "anchor", "left_semi"), span))
    found = (few.select("anchor", "did", "th", "start", "n", "segment")
             .repartition(F.col("anchor"))
             .sortWithinPartitions("anchor", "did", "th", "start")
             .mapInArrow(_locate(span), "did long, th long, start int, n int"))
    whole = copies.select("did", "th", F.lit(0).alias("start"), F.lit(-1).alias("n"))
    return found.unionByName(known).unionByName(whole)


def cut_repeats(docs: DataFrame, span: int = 20, carry: list[str] = (), group_limit: int = 5_000) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept, carried columns) of every row of ``docs`` (doc_id, text).

    A word goes if a window of ``span`` consecutive words that covers it has a
    word sequence that also starts earlier: in a document of a smaller doc_id
    or further up in the same document.  Windows are judged on the input.
    kept_sha256: of the other words joined by one space.  kept: these, or the
    text as it is if no word goes.  A null text has no words and stays null.  A null doc_id counts as
    the largest; documents of one doc_id and different texts follow each other
    by text hash; fully repeated rows are one document and get one result.
    An empty table gives no rows.
    """
    cuts = (repeated_windows(docs, span, group_limit).groupBy("did", "th")
            .agg(F.collect_list(F.struct("start", "n")).alias("cuts")))
    rows = packed(docs.withColumn("__null", F.col("text").isNull()), ["__null", *carry])
    joined = rows.join(cuts, ["did", "th"], "left").select("z", "cuts", "row")
    schema = (StructType.fromDDL("n_words long, n_removed long, kept_sha256 string, kept string")
              .add("row", joined.schema["row"].dataType))

    def run(b: pa.RecordBatch) -> dict:
        kept, digests, n_words, n_removed = [], [], [], []
        for z, found in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            text = unpack(z)
            tokens = words(text)
            n_words.append(len(tokens))
            if not found:
                kept.append(text)
                digests.append(hashlib.sha256(b" ".join(tokens)).hexdigest())
                n_removed.append(0)
                continue
            gone = np.zeros(len(tokens) + 1, np.int32)
            for c in found:
                if c["n"] < 0:
                    gone[0] += 1
                    gone[-1] -= 1
                else:
                    gone[c["start"]] += 1
                    gone[min(c["start"] + c["n"] + span - 1, len(tokens))] -= 1
            stay = np.cumsum(gone[:-1]) == 0
            kept.append(b" ".join([t for t, s in zip(tokens, stay.tolist()) if s]))
            digests.append(hashlib.sha256(kept[-1]).hexdigest())
            n_removed.append(int((~stay).sum()))
        return {"n_words": n_words, "n_removed": n_removed, "kept_sha256": digests,
                "kept": [k.decode() for k in kept], "row": b.column(2)}

    return map_docs(joined, run, schema).select(
        "row.doc_id", "n_words", "n_removed", "kept_sha256",
        F.when(~F.col("row.__null"), F.col("kept")).alias("kept"), *[F.col(f"row.`{c}`") for c in carry])


def without_repeats(docs: DataFrame, span: int = 20, group_limit: int = 5_000) -> DataFrame:
    """``docs`` (doc_id, text and any columns) with the texts of cut_repeats(); n_chars, if there
    is such a column, is the length of a text that lost words.  Every row stays."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    given = [F.struct(*[F.col(f"`{c}`") for c in others]).alias("given")] if others else []
    cut = cut_repeats(docs.select("doc_id", "text", *given), span, ["given"] if others else [], group_limit)
    new = {"doc_id": F.col("doc_id"), "text": F.col("kept")}
    if "n_chars" in others:
        new["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept")).otherwise(F.col("given.n_chars"))
    return cut.select(*[new.get(c, F.col(f"given.`{c}`")).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])
