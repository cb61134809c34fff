"""Operator 1 against a brute-force search for repeated stretches."""
import random

from pricelab.llm import suffixes
from pricelab.llm.queries import QUERIES

SPAN = 50


def check(rows, got):
    """Passages equal their first occurrences; what they cover are the stretches seen before."""
    top = 2**63
    docs = {}
    for d, t in rows:
        docs.setdefault(top if d is None else d, (t or "").split())
    first, again = {}, set()
    for d in sorted(docs):
        w = docs[d]
        for i in range(len(w) - SPAN + 1):
            p = tuple(w[i:i + SPAN])
            if first.setdefault(p, (d, i)) != (d, i):
                again.add((d, i))
    covered = set()
    for r in got:
        d, f = (top if x is None else x for x in (r.doc_id, r.first_doc_id))
        assert r.n_words >= SPAN and (f, r.first_start) < (d, r.start_word)
        assert docs[d][r.start_word:r.start_word + r.n_words] == docs[f][r.first_start:r.first_start + r.n_words]
        covered |= {(d, i) for i in range(r.start_word, r.start_word + r.n_words - SPAN + 1)}
    assert covered == again
    return again


def test_query(spark, med_docs):
    got = QUERIES["op1_suffix_array_dedup"](spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(set(got)) and check(med_docs, got)


def test_shared_passages_and_edge_rows(spark):
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(3000)}"
    passage = [word() for _ in range(160)]
    rows = [(None, " ".join(passage)), (500, None), (501, ""), (502, "a b c"), (503, "x " * 300), (504, " ".join(passage[:49]))]
    for i in range(60):
        text = [word() for _ in range(rng.randrange(5, 80))]
        at, a = rng.randrange(len(text)), rng.randrange(0, 100)
        text[at:at] = passage[a:a + rng.randrange(30, 120)]
        rows.append((i, " ".join(text)))
    rows += [(i + 100, rows[i + 6][1]) for i in range(0, 30, 3)] + rows[10:14]
    rows.append((900, " ".join(str(i) for i in range(120_000)) + " " + " ".join(passage)))
    df = spark.createDataFrame([(d, t, 1, "q") for d, t in rows], "doc_id long, text string, start int, anchor string")
    for limit in (5_000, 2):
        got = suffixes.repeated_passages(df, group_limit=limit).collect()
        assert check(rows, got)
    assert suffixes.repeated_passages(df.limit(0)).count() == 0


def test_rows_do_not_depend_on_partitions_or_limits(spark):
    """One passage in twelve documents is eleven rows, however the documents are dealt out."""
    rng = random.Random(5)
    passage = " ".join(f"p{rng.randrange(5000)}" for _ in range(400))
    rows = [(i, f"{' '.join(f'a{i}x{rng.randrange(99)}' for _ in range(30))} {passage} end{i}") for i in range(12)]
    rows += [(100 + i, " ".join(f"p{rng.randrange(40)}" for _ in range(20)) + " " + passage[60 * i:]) for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    seen = set()
    for parts in (1, 2, 4, 20):
        for limit in (5_000, 3):
            got = suffixes.repeated_passages(df.repartition(parts), group_limit=limit).collect()
            assert check(rows, got)
            assert sorted((r.doc_id, r.first_doc_id) for r in got if r.doc_id < 12) == [(i, 0) for i in range(1, 12)]
            seen.add(tuple(sorted(map(tuple, got))))
    assert len(seen) == 1
