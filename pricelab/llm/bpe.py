"""Operator 4: byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The pre-tokens of a block of texts that were not met before go through the
queue of rankqueue.py together; their ids are remembered (a bounded number)
and put together per text.
"""
from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MAX_ID, map_docs
from .rankqueue import Merger, Recent


class Codec:
    """Encoder and decoder of one rank file and pre-token pattern."""

    #: Pre-tokens remembered by each of two generations; characters of text handled at once.
    REMEMBER, BLOCK = 120_000, 3_000_000

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.split = regex.compile(pattern).findall
        rules = {(self.ranks[t[:k]], self.ranks[t[k:]]): r for t, r in self.ranks.items()
                 for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks}
        self.merger = Merger(rules, np.arange(max(self.tokens, default=0) + 1))
        self.bytes = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)])
        self.recent = Recent(self.REMEMBER)

    def merge(self, pieces: list[bytes]) -> list[list[int]]:
        """Token ids of each pre-token; a pre-token that is a token stays whole."""
        out = [[r] if (r := self.ranks.get(p)) is not None else None for p in pieces]
        at = [i for i, ids in enumerate(out) if ids is None and pieces[i]]
        if at:
            lengths = np.array([len(pieces[i]) for i in at])
            symbols = self.bytes[np.frombuffer(b"".join(pieces[i] for i in at), np.uint8)]
            ids, counts, redo = self.merger.run(symbols, lengths)
            ids, ends = ids.tolist(), np.cumsum(counts).tolist()
            for i, e, n in zip(at, ends, counts.tolist()):
                out[i] = ids[e - n:e]
            for k in redo.tolist():
                out[at[k]] = self.merge_alone(pieces[at[k]])
        return [ids or [] for ids in out]

    def merge_alone(self, piece: bytes) -> list[int]:
        """The same for one pre-token, strictly one merge at a time."""
        parts = [piece[i:i + 1] for i in range(len(piece))]
        while True:
            ranks = [self.ranks.get(a + b, MAX_ID) for a, b in zip(parts, parts[1:])]
            low = min(ranks, default=MAX_ID)
            if low == MAX_ID:
                return [self.ranks[p] for p in parts]
            i = ranks.index(low)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]

    def encode(self, text: str) -> list[int]:
        return [t for ids in self.merge([m.encode() for m in self.split(text)]) for t in ids]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """For each text: number of ids, SHA-256 of the ids as decimals joined by commas,
        SHA-256 of the bytes decoded from the ids.  Texts are handled some MB at a time."""
        out, i = [], 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j]) <= self.BLOCK):
                size += len(texts[j])
                j += 1
            split = [self.split(t) for t in texts[i:j]]
            self._learn(split)
            get = self.recent.new.__getitem__
            for matches in split:
                counts, decimals, parts = zip(*map(get, matches)) if matches else ((), (), ())
                out.append((sum(counts), hashlib.sha256(",".join(decimals).encode()).hexdigest(),
                            hashlib.sha256(b"".join(parts)).hexdigest()))
            self.recent.turn()
            i = j
        return out

    def _learn(self, split: list[list[str]]) -> None:
        """Remember (number of ids, ids as decimals, bytes decoded from the ids) of new pre-tokens."""
        pieces = self.recent.missing(set().union(*split))
        new = self.recent.new
        for m, ids in zip(pieces, self.merge([m.encode() for m in pieces])):
            new[m] = len(ids), ",".join(map(str, ids)), self.decode(ids)


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One codec for each Python worker."""
    return Codec(path, pattern)


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, ids array<int>) of every row of ``docs`` (doc_id, text).

    ``ranks_path`` names a .tiktoken rank file that every executor can read.
    A null text counts as empty; an empty text has no ids.  Repeated rows and
    null doc_ids are returned as given; other columns are not looked at; an
    empty table gives no rows.
    """
    def run(b: pa.RecordBatch) -> dict:
        c = codec(ranks_path, pattern)
        return {"doc_id": b.column(0), "ids": [c.encode(t or "") for t in b.column(1).to_pylist()]}

    return map_docs(_doc(docs), run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, data binary): the bytes of each row's ``ids``; null ids give no bytes."""
    def run(b: pa.RecordBatch) -> dict:
        c = codec(ranks_path, pattern)
        return {"doc_id": b.column(0), "data": [c.decode(i or []) for i in b.column(1).to_pylist()]}

    return map_docs(encoded.select(F.col("doc_id").cast("long"), "ids"), run,
                    "doc_id long, data binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of encode() and of
    decode() of its ids, in one pass; edge cases as in encode()."""
    def run(b: pa.RecordBatch) -> dict:
        c = codec(ranks_path, pattern)
        rows = c.digests([t or "" for t in b.column(1).to_pylist()])
        return {"doc_id": b.column(0), "n_tokens": [r[0] for r in rows],
                "ids_sha256": [r[1] for r in rows], "decoded_sha256": [r[2] for r in rows]}

    return map_docs(_doc(docs), run,
                    "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _doc(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
