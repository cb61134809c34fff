"""Operator 8 against its SQL twin and a brute-force version."""
import hashlib
import random
import re

import duckdb

from pricelab.llm import phrases
from pricelab.llm.queries import QUERIES, SQL

SCHEMA = "doc_id long, text string, row int, anchor string"


def brute(rows, span=20):
    top = 2**63
    docs = sorted({(top if d is None else d, t) for d, t in rows}, key=lambda r: r[0])
    toks = {k: re.findall(r"[^\x20\x09-\x0D]+", k[1] or "") for k in docs}
    seen, gone = set(), {k: set() for k in docs}
    for k in docs:
        w = toks[k]
        for i in range(len(w) - span + 1):
            p = tuple(w[i:i + span])
            if p in seen:
                gone[k].update(range(i, i + span))
            seen.add(p)
    out = []
    for d, t in rows:
        k = (top if d is None else d, t)
        left = [x for i, x in enumerate(toks[k]) if i not in gone[k]]
        out.append((str(d), len(toks[k]), len(gone[k]), hashlib.sha256(" ".join(left).encode()).hexdigest(),
                    None if t is None else " ".join(left) if gone[k] else t))
    return sorted(out, key=str)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(d, t, 1, "q") for d, t in rows], SCHEMA)
    return sorted(((str(r[0]), *r[1:]) for r in phrases.cut_repeats(df, **kw).collect()), key=str)


def test_query_equals_sql_and_brute_force(spark, med_docs):
    got = sorted((str(r[0]), *r[1:]) for r in QUERIES["op8_substring_dedup"](spark, "/root/testdata/sf0.01").collect())
    assert got == [r[:4] for r in brute(med_docs)]
    con = duckdb.connect()
    con.execute("create view documents as select * from '/root/testdata/sf0.01/documents.parquet'")
    assert got == sorted((str(r[0]), *r[1:]) for r in con.execute(SQL["op8_substring_dedup"]).fetchall())


def shared_rows():
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(4000)}"
    passage = [word() for _ in range(70)]
    rows = [(None, " ".join(passage)), (500, None), (501, ""), (502, "a b c"), (503, "x " * 300), (504, "é漢 " * 25)]
    for i in range(60):
        text = [word() for _ in range(rng.randrange(5, 80))]
        at, a = rng.randrange(len(text)), rng.randrange(0, 40)
        text[at:at] = passage[a:a + rng.randrange(10, 70)]
        rows.append((i, rng.choice([" ", "\n", "\t  "]).join(text)))
    rows += [(i + 100, rows[i + 6][1]) for i in range(0, 30, 3)]       # exact copies
    rows += [(7, " ".join(word() for _ in range(3000)))] + rows[10:14]  # one id again, repeated rows
    rows.append((900, " ".join(str(i) for i in range(120_000)) + " " + " ".join(passage)))
    return rows


def test_shared_passages_and_edge_rows(spark):
    rows = shared_rows()
    want = brute(rows)
    assert run(spark, rows) == want
    assert run(spark, rows, group_limit=2) == want          # every frequent anchor dealt out by windows
    assert run(spark, rows, carry=["row", "anchor"]) == [(*r, 1, "q") for r in want]


def test_empty_table(spark):
    assert run(spark, []) == []


def test_no_task_holds_a_frequent_group(spark, monkeypatch):
    passage = [f"p{i}" for i in range(25)]
    rows = [(i, " ".join([f"a{i}", *passage, f"b{i}"])) for i in range(400)]
    locate = phrases._locate

    def watched(span):
        run = locate(span)

        def checked(batches):
            def counted():
                n = 0
                for b in batches:
                    n += b.num_rows
                    if n > 100:
                        raise AssertionError("a frequent group in one task")
                    yield b

            yield from run(counted())

        return checked

    monkeypatch.setattr(phrases, "_locate", watched)
    assert run(spark, rows, group_limit=50) == brute(rows)
