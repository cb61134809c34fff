"""Operator 7 against a brute-force version in plain Python."""
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pricelab.llm import simhash
from pricelab.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, fp string, root int"


def brute_fp(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    sh = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    hs = [xxhash.xxh64_intdigest(s, seed=42) for s in sh]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs)) if hs else 0


def brute(rows, bits=3):
    fps = [brute_fp(t) for _, t in rows]
    comp = list(range(len(rows)))

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    vals = sorted(set(fps))
    at = {}
    for i, f in enumerate(fps):
        at.setdefault(f, []).append(i)
    arr = np.array(vals, np.uint64)
    for f in vals:
        for g in arr[np.bitwise_count(arr ^ np.uint64(f)) <= bits].tolist():
            for j in at[g] + at[f]:
                a, b = find(at[f][0]), find(j)
                if a != b:
                    comp[max(a, b)] = min(a, b)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted((str(d), f"{fps[i]:016x}", str(low.get(find(i)))) for i, (d, _) in enumerate(rows))


def run(spark, rows, **kw):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA)
    return sorted((str(r.doc_id), r.fingerprint, str(r.component_id))
                  for r in simhash.near_duplicates(df, **kw).collect())


def test_query_equals_brute_force(spark, med_docs):
    got = QUERIES["op7_simhash_near_dedup"](spark, "/root/testdata/sf0.01").collect()
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == brute(med_docs)


def test_edge_rows(spark):
    long = " ".join(f"w{i % 977}" for i in range(90_000))
    rows = [(5, None), (3, ""), (None, "a b c d"), (9, "a b c d"), (9, "a b c d"), (4, "A b C d"), (7, long),
            (8, long + " x"), (6, "one"), (None, "alone here now"), (2, " \t\n")]
    assert run(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == []


@pytest.mark.parametrize("bits", [0, 1, 3, 4])
def test_dense_group_and_block_pairs(spark, bits):
    """A dense cluster, dealt out in block pairs, gives the components of all pairs."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = [int(b) for b in base]
    for b in base[:6]:
        for _ in range(60):
            x = int(b)
            for s in rng.integers(0, 64, rng.integers(1, 6)):
                x ^= 1 << int(s)
            fps.append(x)
    fps = np.unique(np.array(fps, np.uint64))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    for limit in (20_000, 7):
        links = [(r.a, r.b) for r in simhash.fingerprint_links(df, bits, limit).collect()]
        near = {(i, j) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= bits).tolist()}
        idx = {int(v): i for i, v in enumerate(fps.view(np.int64))}
        assert all((idx[a], idx[b]) in near for a, b in links)

        def parts(pairs):
            p = list(range(len(fps)))

            def find(i):
                while p[i] != i:
                    i = p[i]
                return i
            for i, j in pairs:
                a, b = find(i), find(j)
                p[max(a, b)] = min(a, b)
            return [find(i) for i in range(len(fps))]
        assert parts((idx[a], idx[b]) for a, b in links) == parts(near)


def test_many_documents_of_one_fingerprint(spark):
    """All copies get their component, and no task of the last join holds them all."""
    rows = [(i, "one and the same text for very many documents") for i in range(4000)] + [(5000, "another one entirely, alone here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash.near_duplicates(df)
    assert sorted((r.doc_id, r.component_id) for r in got.collect()) == [(i, 0) for i in range(4000)] + [(5000, 5000)]
    salts = df.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(simhash.SALTS))).groupBy("salt").count().collect()
    assert len(salts) == simhash.SALTS and max(r["count"] for r in salts) < 1000
