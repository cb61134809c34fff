"""Operator 2 against an exhaustive comparison of all windows with all items."""
import math
import random
import re
from collections import Counter

import duckdb

from pricelab.llm import decontaminate
from pricelab.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def normal(t):
    return re.sub(r"[!-/:-@\[-`{-~\x00-\x1f\x7f]", " ", (t or "").lower()).split(" ")


def brute(docs, items, k=5, threshold=0.8):
    """{(doc, item): similarity of the best window}, exact for every window."""
    words = lambda t: [w for w in normal(t) if w]
    grams = lambda w: Counter(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    its = [(i, words(t)) for i, t in items if len(words(t)) >= k]
    df = Counter(g for _, w in its for g in grams(w))
    weight = {g: 1 + math.log((len(its) + 1) / n) / math.log(len(its) + 1) for g, n in df.items()}
    wt = lambda c: sum(n * weight.get(g, 2.0) for g, n in c.items())
    where = {}
    for j, (_, w) in enumerate(its):
        for g in grams(w):
            where.setdefault(g, set()).add(j)
    out = {}
    for d, t in docs:
        w = words(t)
        for j in {j for g in grams(w) for j in where.get(g, ())}:
            i, v = its[j]
            a = grams(v)
            for s in range(len(w) - len(v) + 1):
                b = grams(w[s:s + len(v)])
                common = wt(a & b)
                sim = common / (wt(a) + wt(b) - common)
                if sim >= threshold:
                    out[d, i] = max(out.get((d, i), 0), sim)
    return out


def test_query(spark, med_docs):
    items = duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()
    want = brute(med_docs, items)
    got = {(r.doc_id, r.item_id): r.similarity for r in QUERIES["op2_benchmark_decontamination"](spark, SF).collect()}
    assert len(want) > 3 and got.keys() == want.keys()
    assert all(abs(got[x] - want[x]) < 1e-9 for x in want)
    whole = {(d, i) for d, t in med_docs for i, b in items if b in (t or "")}
    assert whole <= got.keys()


def test_edits_and_edge_rows(spark):
    rng = random.Random(2)
    word = lambda: f"w{rng.randrange(5000)}"
    items = [(i, " ".join(word() for _ in range(rng.choice([12, 40, 90])))) for i in range(30)]
    items += [(90, items[3][1]), (None, items[4][1]), (91, None), (92, ""), (93, "too short")]
    docs = []
    for i in range(80):
        w = items[i % 30][1].split()
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = word()
        text = [word() for _ in range(rng.randrange(60))] + w + [word() for _ in range(20)]
        docs.append((i, " ".join(x.upper() + rng.choice(["", ",", "!"]) for x in text)))
    docs += [(200, None), (201, ""), (202, "a b"), docs[0], (None, docs[1][1]),
             (300, " ".join(f"q{i}" for i in range(100_000)) + " " + items[5][1])]
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.contaminated(df, bench).collect()}
    want = brute(docs, items)
    assert got.keys() <= want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in got)
    assert len(got) >= 0.97 * len(want)          # what verifies lies within the radius but for rare cases
    alone = decontaminate.contaminated(df, bench.where("item_id < 4"), block_words=1).collect()
    assert {r.item_id for r in alone} == {i for i in range(4)}
    assert decontaminate.contaminated(df.limit(0), bench).count() == 0
    assert decontaminate.contaminated(df, bench.limit(0)).count() == 0


def test_no_window_at_the_threshold_is_lost():
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(10**6)}"
    items = [[word() for _ in range(rng.choice([25, 50, 59]))] for _ in range(1500)]
    index = decontaminate.Index(list(range(len(items))), [[w.encode() for w in t] for t in items], 5)
    for i, t in enumerate(items):
        text = list(t)
        text[0 if len(t) == 25 else len(t) // 2] = word()
        got = {x[0]: x[3] for x in index.leaks(" ".join(text), 0.8)}
        want = brute([(0, " ".join(text))], [(i, " ".join(t))])
        assert got.keys() == {x[1] for x in want} == {i}


def test_items_shorter_than_a_shingle(spark):
    """They match where their whole sequence stands."""
    items = spark.createDataFrame([(1, "Four words, it is!"), (2, "one"), (3, "..."), (4, "Four words it was")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x four words it is y z"), (2, "four words it"), (3, "four it words is"), (4, "One"), (5, "done"), (6, "")],
                                 "doc_id long, text string")
    got = {(r.doc_id, r.item_id, r.start_word, r.n_words) for r in decontaminate.contaminated(docs, items).collect()}
    assert got == {(1, 1, 1, 4), (4, 2, 0, 1)}
    assert sorted(r.doc_id for r in decontaminate.clean(docs, items).collect()) == [2, 3, 5, 6]


def test_fingerprints_of_scattered_windows():
    """A long text whose windows lie far apart is handled a stretch at a time, with the same result."""
    import numpy as np
    rng = np.random.default_rng(1)
    shingles = rng.integers(0, 1 << 63, 300_000).astype(np.uint64)
    starts = np.unique(np.concatenate([rng.integers(0, 299_900, 300), np.arange(5000, 5300)]))
    got = decontaminate.window_fingerprints(shingles, starts, 40)
    for s, g in zip(starts[::37].tolist(), got[::37].tolist()):
        ones = [sum(int(x) >> b & 1 for x in shingles[s:s + 40]) * 2 > 40 for b in range(64)]
        assert g == sum(1 << b for b, one in enumerate(ones) if one)


def test_documents_shorter_than_an_item(spark):
    item = [f"w{i}" for i in range(50)]
    docs = [(1, " ".join(item[:-1])), (2, " ".join(item[4:])), (3, " ".join(item[:30])), (4, "w0 w1"), (5, " ".join(item))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(item)), (8, " ".join(f"z{i}" for i in range(60)))], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.start_word, r.n_words, round(r.similarity, 4))
                 for r in decontaminate.contaminated(df, bench).collect())
    assert got == [(1, 7, 0, 49, round(45 / 46, 4)), (2, 7, 0, 46, round(42 / 46, 4)), (5, 7, 0, 50, 1.0)]
    assert sorted(r.doc_id for r in decontaminate.clean(df, bench).collect()) == [3, 4]
