"""Operators 4 and 5 against the public tokenizer libraries, and exact round trips."""
import base64
import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from pricelab.llm import bpe, tokencount
from pricelab.llm.queries import QUERIES
from pricelab.llm.rankqueue import Merger, RankQueue

RANKS, MODEL = P.path("byte_bpe_multi_50k.tiktoken"), P.path("piece_bpe_32k.model")
CODEC, COUNTER = bpe.Codec(RANKS, P.PATTERN), tokencount.PieceCounter(MODEL)
TIK = tiktoken.Encoding("own", pat_str=P.PATTERN, special_tokens={}, mergeable_ranks={
    base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))})
SP = sentencepiece.SentencePieceProcessor(model_file=MODEL)
EDGE = ["", " ", "  ", "a ", " a", "a  \n\n b\t", "▁▁a▁ b", "\x00 ", "<s> </s><unk><|endoftext|>", "aaaa" * 700,
        "漢字🙂 é é", "it's 12 345's!!", "x" * 100_000 + " y" * 3, " " * 5000, "\n" * 301 + "q"]


def sha(x):
    return hashlib.sha256(x).hexdigest()


def expected(text):
    ids = TIK.encode_ordinary(text or "")
    return len(ids), sha(",".join(map(str, ids)).encode()), sha(TIK.decode_bytes(ids))


def test_op4_query(spark, med_docs):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256)
           for r in QUERIES["op4_bpe_round_trip"](spark, "/root/testdata/sf0.01").collect()}
    assert got == {d: expected(t) for d, t in med_docs}
    assert all(v[2] == sha((t or "").encode()) for (_, t), v in zip(med_docs, map(got.get, (d for d, _ in med_docs))))


def test_op5_query(spark, med_docs):
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit)
           for r in QUERIES["op5_token_counts"](spark, "/root/testdata/sf0.01").collect()}
    want = {}
    for d, t in med_docs:
        n = len(SP.encode(t or ""))
        want[d] = len((t or "").encode()), n, n > 4096
    assert got == want


def test_edge_rows(spark):
    rows = [(i, t, "x") for i, t in enumerate(EDGE)] + [(None, None, "y"), (3, EDGE[3], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    want = sorted((str(d), *expected(t)) for d, t, _ in rows)
    assert sorted((str(r[0]), *r[1:]) for r in bpe.round_trip(df, RANKS, P.PATTERN).collect()) == want
    back = bpe.decode(bpe.encode(df, RANKS, P.PATTERN), RANKS, P.PATTERN).collect()
    assert sorted((str(r.doc_id), bytes(r.data)) for r in back) == sorted((str(d), (t or "").encode()) for d, t, _ in rows)
    counts = tokencount.token_counts(df, MODEL, limit=2).collect()
    assert sorted((str(r[0]), *r[1:]) for r in counts) == sorted(
        (str(d), len((t or "").encode()), len(SP.encode(t or "")), len(SP.encode(t or "")) > 2) for d, t, _ in rows)
    none = df.limit(0)
    assert bpe.round_trip(none, RANKS, P.PATTERN).count() == tokencount.token_counts(none, MODEL).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="abcé ▁\n'1漢<>st", max_size=60), max_size=8))
def test_any_text(texts):
    assert [x[:2] for x in CODEC.digests(texts)] == [expected(t)[:2] for t in texts]
    assert COUNTER.count(texts) == [len(SP.encode(t)) for t in texts]


@settings(max_examples=80, deadline=None)
@given(st.permutations(["ab", "bc", "abc", "aa", "aaa", "cab", "bb", "aab", "bbc"]), st.text(alphabet="abc", min_size=1, max_size=25))
def test_any_order_of_ranks(order, text):
    """Odd vocabularies, where a merge opens one of a lower rank, give tiktoken's ids too."""
    ranks = {bytes([b]): b for b in range(256)} | {t.encode(): 256 + i for i, t in enumerate(order)}
    c = bpe.Codec.__new__(bpe.Codec)
    c.ranks, c.bytes = ranks, np.arange(256)
    c.merger = Merger({(ranks[t[:k]], ranks[t[k:]]): r for t, r in ranks.items() for k in range(1, len(t))
                       if t[:k] in ranks and t[k:] in ranks}, np.arange(256 + len(order)))
    own = tiktoken.Encoding("odd", pat_str=r"[abc]+", mergeable_ranks=ranks, special_tokens={})
    assert c.merge([text.encode(), b"ab", text[::-1].encode()]) == [
        own.encode_ordinary(t) for t in (text, "ab", text[::-1])]


def test_queue_pops_lowest_rank_first():
    q, rng = RankQueue(50_257), np.random.default_rng(1)
    ranks = rng.integers(0, 50_257, 3000)
    q.push_all(ranks, np.arange(3000))
    q.push_all(np.array([-1, 7, 7]), np.array([1, 2, 3]))
    out = []
    while (top := q.pop()) is not None:
        out.append(top[0])
    assert out == sorted({*ranks.tolist(), 7})


@pytest.mark.parametrize("n", [1_000_000])
def test_very_long_pre_token(n):
    ids = CODEC.encode("ab" * (n // 2))
    assert CODEC.decode(ids) == b"ab" * (n // 2)


def test_each_pre_token_is_counted_once(spark):
    """One row for each distinct pre-token of the corpus, with all its occurrences; the join gives the same for any table."""
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["a", "bb", "ccé", "日本", "x" * 30, ""]) + str(rng.randrange(30)) * rng.randrange(2) for _ in range(rng.randrange(40))))
            for i in range(300)] + [(None, None), (7, ""), (7, "  lead and  trail  "), (8, "tab\tand\nline ")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_tokens int").repartition(5)
    want = Counter(p for _, t in rows for p in tokencount.PieceCounter.pre_tokens(t or ""))
    table = tokencount.pre_token_table(df, MODEL).collect()
    assert len({r.h for r in table}) == len(table) == len(want) and sorted(r.n for r in table) == sorted(want.values())
    assert {r.h: r.pieces for r in table} == dict(zip(tokencount.hashes(list(want)).tolist(), COUNTER.count_pieces(list(want))))
    expect = sorted((str(d), len((t or "").encode()), len(SP.encode(t or ""))) for d, t in rows)
    for size in (0, 10, 40, 10 ** 6):
        got = tokencount.token_counts(df, MODEL, table_size=size).collect()
        assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == expect
