"""Operator 10 against a brute-force neighbour walk, and the fingerprints' properties."""
import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from pricelab.llm import merkle
from pricelab.llm.queries import QUERIES

COLS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def brute(rows):
    """rows in the order of documents; repeated rows are one document."""
    docs = list(dict.fromkeys(rows))
    out = []
    for i, (d, t) in enumerate(docs):
        t, n = t or "", docs[(i + 1) % len(docs)][1] or ""
        k = len(t) // 4
        e = t[:len(t) - k] + n[:k]
        f, g = merkle.fingerprint(t), merkle.fingerprint(e)
        out += [(d, len(t), hashlib.sha256(e.encode()).hexdigest(), f, g, merkle.likeness(f, g),
                 merkle.likeness(f, merkle.fingerprint(n)))] * rows.count((d, t or None) if t == "" and (d, None) in rows else (d, t))
    return sorted(map(str, out))


def result(df):
    assert df.columns[:7] == COLS
    return sorted(str(tuple(r)) for r in df.collect())


def test_query(spark, med_docs):
    got = QUERIES["op10_merkle_fingerprints"](spark, "/root/testdata/sf0.01")
    rows = got.collect()
    assert sorted(str(tuple(r)) for r in rows) == brute(med_docs)
    long = [r for r in rows if r.n_chars > 400]
    assert sum(r.near_edited > r.near_next for r in long) > 0.97 * len(long)


def test_edge_rows(spark):
    big = " ".join(f"w{random.Random(i).random():.3f}" for i in range(60_000))
    rows = [(1, "a b c d"), (4, None), (7, "é漢🙂x" * 50), (7, "é漢🙂x" * 50), (9, big), (12, "\n\n \n"), (13, big + "x")]
    for buckets in (1, 3, 40):
        df = spark.createDataFrame([(d, t, 5) for d, t in rows], "doc_id long, text string, th int")
        assert result(merkle.edited_fingerprints(df, buckets)) == brute(rows)
        one = spark.createDataFrame([(3, "abcdefgh")], "doc_id long, text string")
        assert result(merkle.edited_fingerprints(one, buckets)) == brute([(3, "abcdefgh")])
        assert merkle.edited_fingerprints(df.limit(0), buckets).count() == 0
    nulls = spark.createDataFrame([(None, "x y"), (2, "a b"), (2, "c d")], "doc_id long, text string")
    got = merkle.edited_fingerprints(nulls, 2).collect()
    assert sorted(str(r.doc_id) for r in got) == ["2", "2", "None"]


def test_one_id_with_very_many_texts(spark):
    """Null ids, or one id, for most rows: cut by text hash, neighbours as in one bucket."""
    for hot in (None, 5):
        rows = [(hot, f"text {i} " * (i % 7)) for i in range(300)] + [(i, f"own {i}") for i in range(20)]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        one, many = (result(merkle.edited_fingerprints(df, n)) for n in (1, 24))
        assert one == many and len(one) == len(rows)
        low = merkle._bounds(df.selectExpr("coalesce(doc_id, 9223372036854775807) AS did", "xxhash64(text) AS th"), 24)
        assert len(low) > 12 and low == sorted(low)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab \n", max_size=80), st.text(alphabet="ab \n", max_size=80))
def test_equal_fingerprints_are_equal_texts(a, b):
    assert (merkle.fingerprint(a) == merkle.fingerprint(b)) == (a == b)
    n = merkle.likeness(merkle.fingerprint(a), merkle.fingerprint(b))
    assert 0 <= n <= 1 and n == merkle.likeness(merkle.fingerprint(b), merkle.fingerprint(a))


def test_an_edit_is_located():
    rng = random.Random(3)
    lines = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(30)) for _ in range(200)]
    a = "\n".join(lines)
    lines[120] = lines[120].replace("w", "v", 1)
    b = "\n".join(lines)
    fa, fb = merkle.fingerprint(a), merkle.fingerprint(b)
    i, j, _, _ = merkle.differing_sections(fa, fb)
    assert j - i <= 2 and 0.9 < merkle.likeness(fa, fb) <= 1
    assert len(merkle.differing_leaves(a, b)) == 1
    assert merkle.differing_sections(fa, fa) == (0, 0, 0, 0)
