"""Best-fit packing: ids against the tokenizers library, sequences against their definition."""
import bisect
import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pricelab.llm import packing
from pricelab.llm.queries import op12_best_fit_packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", None, "  a  b \n c", "foo\n  bar", "x \n\n y  ", "a\tb ", "<|endoftext|> hi <|endoftext|>", "日本 語  テスト",
       "it's 'll  don't", "é 🙂🙂   x", "z" * 9000 + "  q", " lead", "\x1c \x85 c"]


LIBRARY = Tokenizer.from_file(PATH)


def library_ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids + [2]


def check(rows, texts, size):
    """rows: (doc, piece, start, length, crc, sequence, offset); texts: doc -> texts under that id."""
    want = sorted((doc, p, s, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes()))
                  for doc, many in texts.items() for t in many
                  for p, (s, piece) in enumerate(cut_by_rule(library_ids(t), size)))
    assert sorted(r[:5] for r in rows) == want
    bins = {}
    for r in rows:
        bins.setdefault(r[5], []).append((r[6], r[3]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return len(bins)


def cut_by_rule(ids, size):
    if len(ids) <= size:
        return [(0, ids)]
    first = len(ids) % size or size
    cuts = [0, *range(first, len(ids), size)]
    return [(a, ids[a:b]) for a, b in zip(cuts, [*cuts[1:], len(ids)])]


def test_whole_table(spark, med_docs):
    rows = [tuple(r) for r in op12_best_fit_packing(spark, "/root/testdata/sf0.01").select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset").collect()]
    texts = {}
    for d, t in med_docs:
        texts.setdefault(d, []).append(t)
    n = check(rows, texts, 1024)
    lengths = sorted((r[3] for r in rows), reverse=True)
    rooms = []                                           # best fit, longest first
    for v in lengths:
        at = bisect.bisect_left(rooms, v)
        room = rooms.pop(at) if at < len(rooms) else 1024
        bisect.insort(rooms, room - v)
    assert n <= min(len(rooms), 1.005 * sum(lengths) / 1024)


@pytest.mark.parametrize("parts", [1, 4])
def test_odd_texts(spark, parts):
    data = [(k // 2, t, k) for k, t in enumerate(ODD)] + [(7, "same row", 1)] * 40 + [(8, None, None)]
    df = spark.createDataFrame(data, "doc_id int, text string, sequence_id int").repartition(parts)
    got = packing.pack(df, PATH, public_tokenizers.PATTERN, size=64)
    rows = [(r.doc_id, r.piece, r.start, r.length, zlib.crc32(r.ids), r.sequence_id, r.offset) for r in got.collect()]
    texts = {}
    for d, t, _ in data:
        texts.setdefault(d, []).append(t)
    check(rows, texts, 64)


def test_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")
    rows = packing.pack(df, PATH, public_tokenizers.PATTERN).collect()
    assert sorted(r.length for r in rows) == [1, 3] and len({r.sequence_id for r in rows}) == 1
    assert packing.pack(df.limit(0), PATH, public_tokenizers.PATTERN).collect() == []


def test_fullest_is_the_best_subset_sum():
    rng = random.Random(4)
    for _ in range(200):
        lengths = sorted(rng.sample(range(1, 40), rng.randint(1, 6)))
        counts = {v: rng.randint(1, 3) for v in lengths}
        room = rng.randint(0, 60)
        sums = {sum(k * v for k, v in zip(ks, lengths)) for ks in itertools.product(*(range(counts[v] + 1) for v in lengths))}
        got = packing.fullest(lengths, counts, room)
        assert all(k <= counts[v] for v, k in got.items())
        assert sum(k * v for v, k in got.items()) == max(s for s in sums if s <= room)


def test_plan_uses_every_piece_once_and_each_bin_is_fullest():
    rng = random.Random(5)
    counts = {rng.randint(1, 100): rng.randint(1, 10 ** 9) for _ in range(30)}
    bins = packing.plan(counts, 100)
    left = dict(counts)
    for chosen, times in bins:
        assert sum(v * k for v, k in chosen.items()) <= 100
        for v, k in chosen.items():
            left[v] -= k * times
    assert set(left.values()) == {0}


def test_ids_follow_the_library_for_the_whole_vocabulary():
    tokens = packing.ByteTokens(PATH, public_tokenizers.PATTERN)
    words = [" " + t.decode() for t in tokens.token if t and t.isascii() and not t.isspace() and b" " not in t]
    ids, counts = tokens.encode(words)
    want = [tokens.library.encode(w, add_special_tokens=False).ids for w in words]
    assert counts.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])
