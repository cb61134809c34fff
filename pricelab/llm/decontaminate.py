"""Operator 2: benchmark decontamination by SimHash of item-sized windows.

Every window of a document that has as many words as a benchmark item (the
whole document, if it has fewer) gets a SimHash over its word shingles.  The items' fingerprints are indexed by eight
blocks of eight bits, each block with its two-bit neighbours: of two
fingerprints within 23 bits one block differs in at most two bits, so the
lookup meets every item within that radius.  Candidates of the window's size
are then verified by the exact weighted Jaccard similarity of their shingles.

A window can only verify if the weights of the shingles in it that some item
has sum to the threshold times the weight of an item of its size: the shingles
in common are among them.  Windows below that are passed over before
fingerprints are made, which loses nothing.
"""
from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import run_hashes, word_hashes
from .common import filter_docs, map_docs

RADIUS = 23
BLOCKS = 8
_PUNCTUATION = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))


def normal_words(text: str | None) -> list[bytes]:
    """Lower-cased words without ASCII punctuation."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_PUNCTUATION).split() if text else []


def window_fingerprints(shingles: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """SimHash of the n shingle hashes from each of ``starts`` on."""
    out = np.zeros(len(starts), np.uint64)
    step, i = 4096, 0
    while i < len(starts):             # a bounded stretch at a time, however far the starts lie apart
        base = int(starts[i])
        j = int(np.searchsorted(starts, base + step))
        s = starts[i:j] - base
        bits = np.unpackbits(shingles[base:base + int(s[-1]) + n].astype(">u8").view(np.uint8)).reshape(-1, 64)
        sums = np.zeros((len(bits) + 1, 64), np.int32)
        np.cumsum(bits, axis=0, out=sums[1:])
        ones = 2 * (sums[s + n] - sums[s]) > n
        out[i:j] = np.packbits(ones, axis=1).view(">u8").ravel()
        i = j
    return out


@dataclass
class Index:
    """A block of benchmark items: fingerprints, their multi-index and shingle weights."""
    ids: list[int]
    tokens: list[list[bytes]]
    shingle: int

    def __post_init__(self):
        k = self.shingle
        self.sizes = np.array([len(t) for t in self.tokens])
        runs = [run_hashes(word_hashes(t), k) for t in self.tokens]
        self.known = np.unique(np.concatenate(runs)) if runs else np.zeros(0, np.uint64)
        self.items = np.array([int(window_fingerprints(r, np.zeros(1, np.int64), len(r))[0]) for r in runs], np.uint64)
        self.counts = [Counter(zip(*(t[i:] for i in range(k)))) for t in self.tokens]
        df = Counter(s for c in self.counts for s in c)
        top = math.log(len(self.tokens) + 1)
        self.weight = {s: 1 + math.log((len(self.tokens) + 1) / n) / top for s, n in df.items()}
        of_hash: dict[int, float] = {}
        for t, r in zip(self.tokens, runs):
            for s, h in zip(zip(*(t[i:] for i in range(k))), r.tolist()):
                of_hash[h] = max(of_hash.get(h, 0.0), self.weight[s])
        self.known_weight = np.array([of_hash[h] for h in self.known.tolist()])
        self.total = np.array([sum(n * self.weight[s] for s, n in c.items()) for c in self.counts])
        self.by_size = {size: np.flatnonzero(self.sizes == size) for size in np.unique(self.sizes).tolist()}
        self.multi = {size: self._multi_index(items) for size, items in self.by_size.items()}

    def _multi_index(self, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per block and value the items whose block has this value or differs in one or two bits:
        (item lists one after another, where each list starts)."""
        bits = 64 // BLOCKS
        ones = [1 << b for b in range(bits)]
        changes = np.array([0, *ones, *(a | b for a, b in combinations(ones, 2))], np.int64)
        entries: list[np.ndarray] = []
        for block in range(BLOCKS):
            value = (self.items[items] >> np.uint64(block * bits)).astype(np.int64) & ((1 << bits) - 1)
            entries.append(((block << bits) + (value[:, None] ^ changes)).ravel())
        keys = np.concatenate(entries)
        owner = np.tile(np.repeat(items, len(changes)), BLOCKS)
        order = np.argsort(keys, kind="stable")
        return owner[order], np.searchsorted(keys[order], np.arange((BLOCKS << bits) + 1))

    def near(self, fingerprints: np.ndarray, size: int) -> list[tuple[int, int]]:
        """(place in ``fingerprints``, item of ``size`` words) of all pairs within RADIUS bits."""
        owner, at = self.multi[size]
        bits = 64 // BLOCKS
        pairs = []
        for block in range(BLOCKS):
            key = (block << bits) + ((fingerprints >> np.uint64(block * bits)).astype(np.int64) & ((1 << bits) - 1))
            n = at[key + 1] - at[key]
            place = np.repeat(np.arange(len(key)), n)
            inside = np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n)
            item = owner[at[key][place] + inside]
            ok = np.bitwise_count(self.items[item] ^ fingerprints[place]) <= RADIUS
            pairs += zip(place[ok].tolist(), item[ok].tolist())
        return sorted(set(pairs))

    def similarity(self, item: int, window: list[bytes]) -> float:
        """Weighted Jaccard similarity of the shingles, repeats included; a shingle of no item weighs 2."""
        a, b = self.counts[item], Counter(zip(*(window[i:] for i in range(self.shingle))))
        weight = self.weight
        common = sum(min(n, b[s]) * weight[s] for s, n in a.items() if s in b)
        total = sum(n * weight[s] for s, n in a.items()) + sum(n * weight.get(s, 2.0) for s, n in b.items())
        return common / (total - common)

    def leaks(self, text: str | None, threshold: float) -> list[tuple[int, int, int, float, int]]:
        """(item_id, start_word, n_words, similarity, bits) of each item's best window, the first of equals."""
        tokens = normal_words(text)
        k = self.shingle
        if len(tokens) < k:
            return []
        shingles = run_hashes(word_hashes(tokens), k)
        at = np.searchsorted(self.known, shingles)
        at[at == len(self.known)] = 0
        hits = self.known[at] == shingles
        if not hits.any():
            return []
        sums = np.concatenate([[0.0], np.cumsum(np.where(hits, self.known_weight[at], 0.0))])
        best: dict[int, tuple] = {}
        for item_size, items in self.by_size.items():
            size = min(item_size, len(tokens))
            n = size - k + 1
            least = threshold * self.total[items].min() - 1e-6
            starts = np.flatnonzero(sums[n:] - sums[:-n] >= least)
            if not len(starts):
                continue
            found = window_fingerprints(shingles, starts, n)
            for place, item in self.near(found, item_size):
                s = int(starts[place])
                sim = self.similarity(item, tokens[s:s + size])
                if sim >= threshold and sim > best.get(item, (0.0,))[0]:
                    best[item] = sim, s, size, (int(self.items[item]) ^ int(found[place])).bit_count()
        return [(self.ids[i], s, size, sim, bits) for i, (sim, s, size, bits) in sorted(best.items())]


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, shingle: int = 5,
                 block_words: int = 2_000_000) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, similarity, bits): documents (doc_id, text) with a window
    that holds a benchmark item (item_id, text), one row for each document and item.  A document of
    fewer words than an item is one window, of all its words.

    Words are lower-cased, without ASCII punctuation.  An item of fewer words
    than a shingle is one shingle, its whole sequence; null and empty ones match nothing; a null or empty text
    holds nothing.  Items with one text are found each under its own id; a
    null item_id or doc_id is returned as null.  Repeated documents are
    returned as often as given.  Other columns are not looked at.  An empty
    table on either side gives no rows.

    The benchmark is the stated query set: it is taken in blocks of at most
    ``block_words`` words (or one item), each broadcast and held against all
    documents, so what is broadcast does not grow with either table.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    schema = "doc_id long, item_id long, start_word int, n_words int, similarity double, bits int"
    out = spark.createDataFrame([], schema)
    for index in _blocks(benchmark, shingle, block_words):
        out = out.unionByName(map_docs(rows, _search(spark.sparkContext.broadcast(index), threshold), schema))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, shingle: int = 5,
          block_words: int = 2_000_000) -> DataFrame:
    """Rows of ``docs`` with all their columns, without the documents that contaminated() finds."""
    for index in _blocks(benchmark, shingle, block_words):
        shared = docs.sparkSession.sparkContext.broadcast(index)
        docs = filter_docs(docs, lambda texts, shared=shared: [not shared.value.leaks(t, threshold) for t in texts])
    return docs


def _search(shared, threshold: float):
    def run(b: pa.RecordBatch) -> dict:
        found = [(d, *leak) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())
                 for leak in shared.value.leaks(t, threshold)]
        cols = list(zip(*found)) or [()] * 6
        return dict(zip(("doc_id", "item_id", "start_word", "n_words", "similarity", "bits"), cols))

    return run


def _blocks(benchmark: DataFrame, shingle: int, block_words: int) -> Iterator[Index]:
    """Indexes of the items, at most ``block_words`` words (or one item) in each.  Items of fewer
    words than a shingle have indexes of their own, whose shingle is the whole item."""
    blocks: dict[int, list[tuple[int, list[bytes]]]] = {}
    sizes: Counter = Counter()
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).orderBy("item_id", "text")
    for item_id, text in items.toLocalIterator():
        tokens = normal_words(text)
        k = min(len(tokens), shingle)
        if not k:
            continue
        if sizes[k] and sizes[k] + len(tokens) > block_words:
            yield _index(blocks.pop(k), k)
            sizes[k] = 0
        blocks.setdefault(k, []).append((item_id, tokens))
        sizes[k] += len(tokens)
    for k, block in sorted(blocks.items()):
        yield _index(block, k)


def _index(block: list[tuple[int, list[bytes]]], shingle: int) -> Index:
    return Index([i for i, _ in block], [t for _, t in block], shingle)
