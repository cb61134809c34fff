"""Operators 3, 6 and 9: held-out accuracy, exact parts against brute force, edge rows."""
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pricelab.llm import langid, lbl, toxicity
from pricelab.llm.common import portions
from pricelab.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
LONG = "the cat sat on the mat " * 20_000


def edge(spark):
    rows = [(1, None, "q"), (2, "", "q"), (3, "12 %%% 34", "q"), (4, "one", "q"), (4, "one", "q"), (None, "two words", "q"),
            (5, LONG, "q"), (5, "other text here", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, score string")


def crc(d):
    return zlib.crc32(str(d).encode())


# --- toxicity

def test_op3_query(spark):
    got = QUERIES["op3_toxicity"](spark, SF).collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(got) == 1000
    assert all(r.held_out == (crc(r.doc_id) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [(labels[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in labels]
    assert np.mean([a == b for a, b in held]) > 0.93
    assert not any(p for t, p in held if t == 0)


def test_folding_and_exceptions(spark):
    lex = toxicity.Lexicon({" idiot ": 5.0, " stup": 4.0, " clown ".replace("l", "i"): 5.0}, ["clown fish", "trash can"],
                           np.array([-2.0, 0, 3.0, 0]))
    for t in ("an idiot", "an IDIOT!!", "an id1ot", "an 1d10t", "ｉｄｉｏｔ", "an іdіоt", "idi​ot", "$tupid!", "stupidity"):
        assert lex.scores([t])[0] > 0.5, t
    for t in (None, "", "idiots", "an idi ot", "a clown fish swims", "10 1 5", "$$$ !!!", "über straße"):
        assert lex.scores([t])[0] < 0.5, t
    assert lex.scores(["clown " + "word " * 50])[0] < lex.scores(["clown word"])[0]          # by length
    assert toxicity.fold("loser$$$ 100% a1b") == " ioser aib "


def plain_score(lex, text):
    """The score by searching the folded text for one entry after another."""
    folded = toxicity.fold(text)

    def places(term):
        at = folded.find(term)
        while at >= 0:
            yield at
            at = folded.find(term, at + 1)

    best = {}
    for t, w in lex.weights.items():
        for p in places(t):
            best[p] = max(best.get(p, 0.0), w)
    for e in map(toxicity.fold, lex.exceptions):
        for p in places(e):
            best = {q: w for q, w in best.items() if not p <= q < p + len(e) - 1}
    total, n = sum(best.values()), len(folded.split())
    x = [1.0, math.log1p(total), 20 * total / (n + 20), max(best.values(), default=0.0)]
    return 1 / (1 + math.exp(-max(-30, min(30, float(np.dot(x, lex.coef))))))


def test_op3_equals_a_plain_search(spark, med_docs):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lex = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"), F.expr("crc32(cast(cast(doc_id as string) as binary)) % 5 != 0"),
                         min_docs=2, exceptions=("clown fish", next(t for _, t in med_docs if t)[:12]))
    assert lex.weights and lex.exceptions
    got = {r.doc_id: r.score for r in toxicity.score(docs, lex).collect()}
    assert all(abs(got[d] - plain_score(lex, t)) < 1e-9 for d, t in med_docs)


def test_op3_edge_rows(spark):
    docs = edge(spark)
    labels = spark.createDataFrame([(4, 1, "x"), (5, 0, None), (None, 1, "x"), (77, None, "x")], "doc_id long, toxic int, text string")
    for data in (labels, labels.limit(0)):
        lex = toxicity.train(docs, data, F.lit(True))
        got = toxicity.score(docs, lex).collect()
        assert len(got) == 8 and all(0 <= r.score <= 1 for r in got)
        assert toxicity.score(docs.limit(0), lex).count() == 0


# --- language

def test_op6_query(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op6_language_id"](spark, SF).collect()
    assert len(got) == 1000 and all(r.held_out == (crc(r.doc_id) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.98
    assert sum(r.rejected for r in got) == 0


@pytest.fixture(scope="module")
def language_model(spark):
    return langid.train(spark.read.parquet(f"{SF}/documents.parquet"), F.lit(True), sample_docs=100)


def test_kneser_ney_sums_to_one(language_model):
    """After any context, seen or not, the characters' probabilities sum to one in every language."""
    m = language_model
    letters = (m.keys[0] - np.uint64(1)).astype(np.uint32)
    for context in (" th", "que", "zzz", "一丁丂"):
        head = np.array([ord(c) for c in context], np.uint32)
        total = np.zeros(len(m.langs))
        for c in letters:
            h = langid.grams(np.append(head, c))
            total += np.exp(m.log_probs(h, np.array([3]), 3)[0].astype(float))
        total += np.exp(m.log_probs(langid.grams(np.append(head, np.uint32(0x5000))), np.array([3]), 3)[0].astype(float))
        assert np.allclose(total, 1, atol=1e-3), (context, total)


def test_rejection(language_model):
    rng = np.random.default_rng(3)
    noise = " ".join("".join(chr(c) for c in rng.integers(0x4e00, 0x5000, 6)) for _ in range(200))
    random = " ".join("".join(chr(c) for c in rng.integers(97, 123, 7)) for _ in range(400))
    langs, _, _, rejected = language_model.predict([noise, random, "", None, "12 34"])
    assert rejected.all() and langs[2:] == ["und"] * 3 and all(x != "und" for x in langs[:2])


def test_op6_edge_rows(spark, language_model):
    docs = edge(spark)
    got = sorted((str(r.doc_id), r.lang_pred, r.rejected) for r in langid.identify(docs, language_model).collect())
    assert len(got) == 8 and [g[1:] for g in got if g[0] in "123"] == [("und", True)] * 3
    assert langid.identify(docs.limit(0), language_model).count() == 0
    with pytest.raises(ValueError):
        langid.train(docs.withColumn("lang", F.lit(None).cast("string")), F.lit(True))
    two = docs.withColumn("lang", F.lit("xx"))
    assert {r.lang_pred for r in langid.identify(docs, langid.train(two, F.lit(True))).collect()} == {"xx", "und"}


# --- language-model scores

def brute_scores(rows, learn):
    toks = [(t or "").encode().lower().split() + [None] for _, t in rows]
    c = Counter()
    for (d, _), w in zip(rows, toks):
        if learn(d):
            c.update(w)
    n, v = sum(c.values()), len(c)
    return sorted((str(d), len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 6))
                  for (d, _), w in zip(rows, toks))


def found(got):
    return sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got)


def test_op9_query(spark, med_docs):
    got = QUERIES["op9_lm_scores"](spark, SF).collect()
    assert found(got) == brute_scores(med_docs, lambda d: crc(d) % 10)
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {d for d, _ in med_docs if crc(d) % 10 == 0}
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


@pytest.mark.parametrize("table_words", [0, 3, 1000])
def test_op9_edge_rows_and_normalisation(spark, table_words):
    docs = edge(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    learn = F.coalesce(F.col("doc_id") != 5, F.lit(True))
    options = dict(table_words=table_words, n_words=2)
    got = lbl.score(docs, learn, **options).collect()
    assert found(got) == brute_scores(rows, lambda d: d != 5)
    assert lbl.score(docs.limit(0), learn, **options).count() == 0
    none = lbl.score(docs, F.lit(False), **options).collect()
    assert len(none) == 8 and all(r.n_known == 0 and r.train_tokens == 0 for r in none)


def by_hand(model, outputs):
    """Log10 probability of an output sequence by the definition, one product after another."""
    r, c, q, bias, class_q, class_bias = (x.astype(float) for x in model.params)
    bias, class_bias = bias[:, 0], class_bias[:, 0]
    used = {*model.outputs.tolist(), *range(0, model.end, model.width)}
    past, total = [model.end] * lbl.CONTEXT, 0.0
    for o in [*outputs, model.end]:
        hidden = sum(r[past[-k]] * c[k - 1] for k in range(1, lbl.CONTEXT + 1))
        weights = [math.exp(class_q[k] @ hidden + class_bias[k]) for k in range(len(class_bias))]
        total += math.log10(weights[o // model.width] / sum(weights))
        if o != model.end:
            members = [x for x in range(o // model.width * model.width, (o // model.width + 1) * model.width) if x in used]
            weights = {x: math.exp(q[x] @ hidden + bias[x]) for x in members}
            total += math.log10(weights[o] / sum(weights.values()))
        past.append(o)
    return total


def test_op9_score_by_hand(spark, med_docs):
    """The whole score against the definition: network, classes, shares of the rest."""
    data = [(d, t[:3000]) for d, t in med_docs[:120]] + [(500, "never seen words zzz"), (501, ""), (502, None)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    learn = F.col("doc_id") < 100
    rows = docs.where(learn)
    counts = lbl.count_words(rows)
    model = lbl.train(rows, counts, rows.count(), n_words=300, table_words=1000)
    by_word = {r.word.encode(): r.c for r in counts.collect()}
    single = {w for w, i in model.index.items() if model.outputs[i] % model.width}
    group_of = lambda w: max(k for k, f in enumerate(model.first) if k == 0 or f <= w)
    rest = Counter()
    for w, c in by_word.items():
        if w not in single:
            rest[group_of(w)] += c + 0.1
    want = {}
    for d, t in data:
        shares, outputs = 0.0, []
        for w in lbl.tokens_of((t or "").encode()):
            outputs.append(int(model.outputs[model.index[w]]) if w in single else group_of(w) * model.width)
            if w not in single:
                shares += math.log10((by_word.get(w, 0) + 0.1) / (rest[group_of(w)] + 0.1))
        want[d] = by_hand(model, outputs) + shares
    got = {r.doc_id: r.score for r in lbl.score(docs, learn, n_words=300, table_words=1000).collect()}
    assert all(abs(got[d] - want[d]) < 1e-3 * max(1, abs(want[d])) for d, _ in data)


def test_op9_scores_do_not_depend_on_partitions(spark, med_docs):
    docs = spark.createDataFrame([(d, t[:2000]) for d, t in med_docs[:300]], "doc_id long, text string")
    one, four = ({r.doc_id: r.score for r in lbl.score(docs.repartition(n), F.col("doc_id") % 10 != 0, n_words=200).collect()}
                 for n in (1, 4))
    assert one.keys() == four.keys() and all(abs(one[d] - four[d]) < 1e-6 * abs(one[d]) for d in one)


def test_nce_learns_what_follows():
    rng = np.random.default_rng(0)
    # outputs 1, 2 and 4, 5 in two classes of width 3, the end is 6
    texts = [np.append(np.tile(np.roll([1, 4, 2, 5], -k), 60), 6) for k in rng.integers(0, 4, 200)]
    net = lbl.Network(np.bincount(np.concatenate(texts), minlength=7), 3)
    net.sweep([p for t in texts for p in lbl.pieces(t, 6)], rng)
    m = lbl.Model(0, 0, 0, {}, np.zeros(0), np.array([1, 2, 4, 5]), [b"", b"m"], 3, np.ones(2), net.params)
    logs = lambda outputs: m.log_probs(lbl.pieces(np.array(outputs), 6)).sum()
    assert logs(texts[0]) / len(texts[0]) > -0.1
    total = sum(10 ** (logs([1, 4, x]) - logs([1, 4])) for x in range(7))
    assert abs(total - 1) < 1e-4


def test_op9_fits_long_texts_and_grows(spark):
    rows = [(i, "alpha beta gamma delta " * 12_500) for i in range(10)]          # 500,000 tokens, all in long texts
    docs = spark.createDataFrame(rows + [(99, "alpha beta gamma delta " * 50)], "doc_id long, text string")
    scored = {r.doc_id: r for r in lbl.score(docs, F.col("doc_id") < 50, n_words=8).collect()}
    assert scored[99].score > 0.1 * scored[99].base_score                        # near-certain words, not shares
    learned = docs.where("doc_id < 50")
    more = learned.unionByName(learned.selectExpr("doc_id + 100 AS doc_id", "text")).unionByName(
        learned.selectExpr("doc_id + 200 AS doc_id", "text"))
    own = [len(set(lbl.train(x, lbl.count_words(x), n, n_words=3).outputs.tolist())) for x, n in ((learned, 10), (more, 30))]
    assert own == [3 + 1, 4]                                                     # three words and a rest; then four words


def test_pieces_keep_every_token():
    out = np.arange(5000, dtype=np.int32)
    parts = lbl.pieces(out, 9999)
    assert np.array_equal(np.concatenate([p[lbl.CONTEXT:] for p in parts]), out)
    assert all(np.array_equal(p[:lbl.CONTEXT], q[-lbl.CONTEXT:]) for p, q in zip(parts[1:], parts))


ODD_TEXTS = ["", " ", "a", " The the\tTHE \n\r\x0b\x0cend ", "É é ÀB c\x1cd x", "new1 new1 the new2", "\n\n", None, "x" * 9000 + " the" * 5000]


def test_op9_tokens_of_many_texts_are_those_of_each():
    for kind in (pa.string(), pa.large_string()):
        tokens, sizes = lbl.tokens_in(pa.array(ODD_TEXTS, kind))
        want = [lbl.tokens_of(t.encode() if t else None) for t in ODD_TEXTS]
        assert [t.encode() for t in tokens.to_pylist()] == [t for x in want for t in x] and sizes.tolist() == [len(x) for x in want]
        assert [t.encode() for t in tokens.to_pylist()[3:]] == lbl._cut(tokens.slice(3)) and lbl._cut(tokens.slice(0, 0)) == []
    part = pa.record_batch({"text": pa.array(ODD_TEXTS)})
    split = [*portions(part, 0, 10)]
    assert pa.Table.from_batches(split).to_pylist() == part.to_pylist() and len(split) > 2


def test_op9_words_are_looked_up_once_for_many_texts(monkeypatch):
    """Each distinct word out of the table is hashed once for all texts; what comes out is that of each text alone."""
    digest, asked = lbl.xxhash.xxh64_intdigest, []
    monkeypatch.setattr(lbl.xxhash, "xxh64_intdigest", lambda w, seed: asked.append(w) or digest(w, seed))
    m = lbl.Model(9, 5, 4, {b"the": 0, b"a": 1, b"end": 2}, np.array([7.0, 3, 2]), np.array([2, 1, 3]), [b"a", b"the"], 3, np.array([2.5, 1.5]))
    texts = [t or "" for t in ODD_TEXTS] * 3
    outputs, columns = lbl.Table(m).described(pa.array(texts))
    assert len(asked) == len(set(asked))
    for t, out, *got in zip(texts, outputs, *(c.to_pylist() for c in columns), strict=True):
        tokens = lbl.tokens_of(t.encode())
        rest = lambda w: lbl.class_of(m.first, w) * m.width
        assert out.tolist() == [int(m.outputs[m.index[w]]) if w in m.index else rest(w) for w in tokens] + [m.end]
        known, other = [w for w in tokens if w in m.index], Counter(w for w in tokens if w not in m.index)
        logs = {w: math.log10(m.counts[i] + 0.1) for w, i in m.index.items()}
        part = sum(logs.get(w, 0) - math.log10(m.rest_total[o // 3]) for w, o in zip(tokens, out.tolist()) if o % 3 == 0)
        assert got[0] == len(tokens) + 1 and got[1] == len(known) + 1
        assert math.isclose(got[2], sum(map(logs.get, known)) + math.log10(4.1)) and math.isclose(got[3], part, abs_tol=1e-9)
        assert dict(zip(*got[4:], strict=True)) == {(h := digest(w, 42)) - (h >> 63 << 64): n for w, n in other.items()}


def test_op9_sums_of_rows():
    rng = np.random.default_rng(3)
    rows, grad, one = rng.integers(0, 40, 700), rng.standard_normal((700, 16)).astype(np.float32), np.ones((700, 1), np.float32)
    found, total, n = lbl._summed(rows, grad, one)
    assert found.tolist() == sorted(set(rows.tolist())) and total.dtype == n.dtype == np.float32
    assert n[:, 0].tolist() == np.bincount(rows)[found].tolist()
    assert np.allclose(total, [grad[rows == k].sum(axis=0) for k in found], atol=1e-4)
