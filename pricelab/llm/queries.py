"""Queries opN_<name>: each applies one operator, with production parameters, to
its whole table and returns the columns of its contract."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, conversations, decontaminate, langid, lbl, merkle, packing, phrases, simhash, suffixes, tokencount, toxicity
from .common import crc_mod, table


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_passages(table(spark, sf_dir, "documents"), min_words=50)


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"),
                                      threshold=0.8, shingle=5)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod("doc_id", 5) == 0
    lexicon = toxicity.train(docs, table(spark, sf_dir, "labels"), ~held_out)
    scored = toxicity.score(docs, lexicon)
    return scored.select("doc_id", held_out.alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"),
                          public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"),
                                   public_tokenizers.path("piece_bpe_32k.model"), limit=4096)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod("doc_id", 4) == 2
    model = langid.train(docs, ~held_out)
    return (langid.identify(docs, model).withColumn("held_out", held_out)
            .select("doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, max_bits=3)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (phrases.cut_repeats(table(spark, sf_dir, "documents"), span=20)
            .select("doc_id", "n_words", "n_removed", "kept_sha256"))


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_mod("doc_id", 10) == 0
    scored = lbl.score(table(spark, sf_dir, "documents"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.edited_fingerprints(table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations")
    return conversations.repair(conversations.damage(given), ids=given)


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.cut_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                                public_tokenizers.PATTERN, size=1024, end_id=2)
    digests = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "part", "number")
    return packing.place(digests, size=1024)


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = alignment.linked(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                            public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model"), digest=True)
    return rows.withColumnRenamed("groups", "groups_sha256")


QUERIES = {f.__name__: f for f in (
    op1_suffix_array_dedup,
    op2_benchmark_decontamination,
    op3_toxicity,
    op4_bpe_round_trip,
    op5_token_counts,
    op6_language_id,
    op7_simhash_near_dedup,
    op8_substring_dedup,
    op9_lm_scores,
    op10_merkle_fingerprints,
    op11_conversation_repair,
    op12_best_fit_packing,
    op13_tokenizer_alignment,
)}

#: DuckDB twins of the queries that SQL can express.
SQL: dict[str, str] = {
    # the grammar's states forward, turn by turn: cheapest least (cost, audit, text) of each
    "op11_conversation_repair": r"""
        WITH RECURSIVE given AS (
          SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                 coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k
          FROM conversations),
        keys AS (
          SELECT k, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(k) + 1), lambda i: CAST(ascii(k[i]) AS BIGINT))),
                        lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, z: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 20 AS m
          FROM (SELECT DISTINCT k FROM given)),
        damaged AS (
          SELECT conv_id, turn, CASE WHEN m = 4 THEN 'user' ELSE role END AS role,
                 CASE WHEN m = 1 THEN '' WHEN m = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                 unnest(range(CASE WHEN m = 3 THEN 2 ELSE 1 END)) AS copy
          FROM given JOIN keys USING (k) WHERE m <> 0),
        numbered AS (
          SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
                 row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
                 regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS ink FROM damaged),
        rows_ AS (
          SELECT conv_id, i, turn, role, text, left(role, 1) AS r,
                 CASE WHEN ink = '' THEN 'b' WHEN again THEN 'd' WHEN right(ink, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '.' END AS fault,
                 lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM numbered),
        ins(q, p, edits, added, c) AS (VALUES
          (0, 0, '', '', 0), (1, 1, '', '', 0), (2, 2, '', '', 0), (3, 3, '', '', 0),
          (0, 2, 'I', chr(10) || 'user:', 5), (1, 2, 'I', chr(10) || 'user:', 5), (3, 2, 'I', chr(10) || 'user:', 5), (2, 3, 'I', chr(10) || 'assistant:', 5),
          (0, 3, 'II', chr(10) || 'user:' || chr(10) || 'assistant:', 10), (1, 3, 'II', chr(10) || 'user:' || chr(10) || 'assistant:', 10),
          (3, 3, 'II', chr(10) || 'user:' || chr(10) || 'assistant:', 10), (2, 2, 'II', chr(10) || 'assistant:' || chr(10) || 'user:', 10)),
        steps(p, r, n) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
        walk AS (
          SELECT DISTINCT conv_id, 0 AS i, 0 AS q, {'c': CAST(0 AS BIGINT), 'a': '', 't': ''} AS best FROM rows_
          UNION ALL
          SELECT conv_id, i, q, min({'c': c, 'a': a, 't': t}) AS best FROM (
            SELECT w.conv_id, x.i, e.n AS q, w.best.c + ins.c + e.cost AS c, w.best.a || ins.edits || e.edit AS a, w.best.t || ins.added || e.t AS t
            FROM walk AS w JOIN rows_ AS x ON x.conv_id IS NOT DISTINCT FROM w.conv_id AND x.i = w.i + 1 JOIN ins ON ins.q = w.q
            JOIN (SELECT y.conv_id, y.i, s.p, s.n, 'K' AS edit, CASE WHEN y.fault = 't' THEN 5 ELSE 0 END AS cost, chr(10) || y.role || ':' || y.text AS t
                  FROM rows_ AS y JOIN steps AS s ON s.r = y.r WHERE y.fault IN ('.', 't')
                  UNION ALL
                  SELECT y.conv_id, y.i, s.p, s.n, 'R', CASE WHEN y.fault = 't' THEN 6 ELSE 1 END,
                         chr(10) || CASE WHEN s.r = 'u' THEN 'user:' ELSE 'assistant:' END || y.text
                  FROM rows_ AS y JOIN steps AS s ON s.r <> 's' WHERE y.fault IN ('.', 't')
                  UNION ALL
                  SELECT y.conv_id, y.i, s.p, s.p, 'D', 2, '' FROM rows_ AS y, (VALUES (0), (1), (2), (3)) AS s(p)) AS e
              ON e.conv_id IS NOT DISTINCT FROM x.conv_id AND e.i = x.i AND e.p = ins.p)
          GROUP BY conv_id, i, q),
        counts AS (
          SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                 count(*) FILTER (WHERE fault = 'b') AS blank, count(*) FILTER (WHERE fault = 'd') AS duplicate,
                 count(*) FILTER (WHERE fault = 't') AS truncated,
                 count(*) FILTER (WHERE before IS NOT NULL AND before || r NOT IN ('su', 'ua', 'au')) AS illegal
          FROM rows_ GROUP BY conv_id),
        closed AS (
          SELECT w.conv_id, min({'c': w.best.c + ins.c, 'a': w.best.a || ins.edits, 't': w.best.t || ins.added}) AS best
          FROM walk AS w JOIN counts AS n ON n.conv_id IS NOT DISTINCT FROM w.conv_id AND n.n = w.i JOIN ins ON ins.q = w.q AND ins.p IN (0, 3)
          GROUP BY w.conv_id)
        SELECT g.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
               coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost,
               coalesce(best.a, '') AS audit, sha256(coalesce(substr(best.t, 2), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM given) AS g LEFT JOIN counts AS c ON c.conv_id IS NOT DISTINCT FROM g.conv_id
        LEFT JOIN closed AS d ON d.conv_id IS NOT DISTINCT FROM g.conv_id""",
    "op8_substring_dedup": r"""
        WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
        windows AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS phrase
                    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
        later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY phrase ORDER BY doc_id, i) AS n
                                         FROM windows) WHERE n > 1),
        gone AS (SELECT DISTINCT doc_id, i + j AS p FROM later, range(20) AS t(j)),
        word AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
        kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS s FROM word
                 WHERE (doc_id, p) NOT IN (SELECT doc_id, p FROM gone) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
               sha256(coalesce(s, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)""",
}
