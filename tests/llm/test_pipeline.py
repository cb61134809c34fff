"""The pipeline, stage by stage, against the operators' brute-force versions."""
import hashlib

import corpus_pipeline as P
from test_decontaminate import brute as leaks
from test_phrases import brute as cut
from test_simhash import brute as groups
from test_tokenizers import expected

SF = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    rows = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()]
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns
        got = sorted((r.doc_id, r.text) for r in docs.collect())
        if name == "language_id":
            want = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
        elif name == "simhash_near_dedup":
            keep = {d for d, _, c in groups(rows) if d == c}
            want = [r for r in rows if str(r[0]) in keep]
        elif name == "substring_dedup":
            text = {r[0]: r[4] for r in cut(rows)}
            want = [(d, text[str(d)]) for d, _ in rows]
        else:
            bad = {d for d, _ in leaks(rows, items)}
            want = [r for r in rows if r[0] not in bad]
            assert bad
        assert got == want
        rows = want
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    got = {r.doc_id: tuple(r)[1:] for r in P.run(spark, SF).collect()}
    assert got == {d: expected(t) for d, t in rows}
    assert all(v[2] == hashlib.sha256(t.encode()).hexdigest() for (_, t), v in zip(rows, map(got.get, dict(rows))))


def test_odd_rows_go_through(spark, tmp_path):
    more = ["kept", "n_words", "n_removed", "kept_sha256", "__null", "__did", "__th", "z", "n", "given"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, row int, " + ", ".join(f"`{c}` string" for c in more)
    rows = [(1, "the cat sat on the mat and so did the dog", "en", "s", 1, 1), (None, None, None, None, None, None),
            (2, "", "en", None, 0, 2), (1, "der hund sitzt auf der matte und bellt laut", "de", "s", 2, 3),
            (1, "the cat sat on the mat and so did the dog", "en", "s", 1, 1), (5, "12 %%% 34", "en", "s", 3, 4)]
    rows = [(*r, *[f"{c}{r[5]}" for c in more]) for r in rows]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        (tmp_path / str(len(data))).mkdir()
        spark.createDataFrame([(1, "x"), (2, None)], "item_id long, text string").write.parquet(
            f"{tmp_path}/{len(data)}/benchmark.parquet")
        for name, stage in P.STAGES[:-1]:
            out = stage(spark, docs, f"{tmp_path}/{len(data)}")
            assert out.columns == docs.columns
            docs = spark.createDataFrame(out.collect(), docs.schema)
        kept = [r.doc_id for r in docs.collect()]
        assert P.STAGES[-1][1](spark, docs, "").count() == len(kept)
        assert kept == [] if not data else set(kept) == {1}
        assert {tuple(r)[6:] for r in docs.collect()} == {r[6:] for r in data if r[0] == 1}


def test_near_dedup_keeps_one_row_of_each_group(spark):
    text = ["the cat sat on the mat and so did the dog", "der hund sitzt auf der matte und bellt laut",
            "seven ships sailed past seven grey islands before noon", "ein ganz anderer satz ohne jede wiederholung darin"]
    rows = [(1, text[0], 1), (0, text[1], 2), (1, text[1], 3),        # the second row of id 1 is a duplicate of id 0
            (None, text[2], 4), (None, text[3], 5), (None, text[3], 5), (None, text[0], 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int")
    kept = sorted((r.row, r.doc_id, r.text) for r in P.simhash_near_dedup(spark, docs, SF).collect())
    assert kept == [(1, 1, text[0]), (2, 0, text[1]), (4, None, text[2]), (5, None, text[3])]
