"""KPI thresholds and boundaries (K, M); model tests."""
import math

import pytest
from pyspark.sql import functions as F

from pricelab.operators import kpi as K
from pricelab.operators import model as M
from pricelab.operators import scenarios as J


def test_price_change_zero_current(spark):
    df = spark.createDataFrame([(1, 120.0, 0.0), (2, 90.0, 100.0), (3, 100.0, 100.0)],
                               "id long, predicted_price double, current_price double")
    out = {r.id: r for r in K.price_direction(K.price_change(df)).collect()}
    assert out[1]["change_percent"] == 0.0 and out[1]["direction"] == "INCREASE"
    assert out[2]["change_percent"] == pytest.approx(-10.0) and out[2]["direction"] == "DECREASE"
    assert out[3]["direction"] == "ADJUSTMENT"


def test_tiers_on_thresholds(spark):
    df = spark.createDataFrame([(1, 700.0), (2, 700.01), (3, 400.0), (4, 400.5)],
                               "id long, current_price double")
    got = {r.id: r.price_tier for r in K.price_tier(df).collect()}
    assert got == {1: "COMPETITIVE", 2: "PREMIUM", 3: "OPPORTUNITY", 4: "COMPETITIVE"}


def test_signal_tiers_boundaries(spark):
    df = spark.createDataFrame(
        [(1, 0.7, 0.3, 0.6, 0.6, 4.0, 1.1), (2, 0.71, 0.29, 0.61, 0.2, 4.1, 1.0),
         (3, 0.4, 0.7, 0.3, 0.31, 3.5, 0.9)],
        "id long, demand double, inventory double, clicks double, search_volume double,"
        " ratings double, competitor_position double")
    got = {r.id: r for r in K.signal_tiers(df).collect()}
    assert got[1]["demand_level"] == "medium" and got[2]["demand_level"] == "high"
    assert got[1]["inventory_level"] == "medium" and got[2]["inventory_level"] == "high"
    assert got[3]["inventory_level"] == "low" and got[3]["demand_level"] == "low"
    assert got[1]["ratings_level"] == "medium" and got[2]["ratings_level"] == "high"
    assert got[1]["competitor_level"] == "medium" and got[2]["competitor_level"] == "high"
    assert got[3]["competitor_level"] == "medium"


def test_score_inventory_zero_and_levels(spark):
    df = spark.createDataFrame([(1, 0.5, 0.0, 0.5, 0.5, 5.0), (2, 0.1, 0.9, 0.0, 0.0, None)],
                               "id long, demand double, inventory double, clicks double,"
                               " search_volume double, ratings double")
    got = {r.id: r for r in K.pricing_score(df, holiday=0.0, weekend=0.0).collect()}
    assert got[1]["score"] == pytest.approx(0.5 / 0.01 * 0.3 + 1.0 * 0.25 + 0.25)
    assert got[1]["score_level"] == "ELITE"
    assert got[2]["score_level"] == "OPTIMAL"


def test_impact_damping(spark):
    df = spark.createDataFrame([(1, "x", 3.0, 0.1), (2, "x", 1.0, 0.1), (3, "x", 0.5, 0.1)],
                               "id long, signal string, value double, importance double")
    got = {r.id: r for r in K.feature_impact(df).collect()}
    import math
    assert got[1]["impact"] == pytest.approx((math.tanh(1.5) - 0.5) * 0.1 * 150)
    assert got[2]["impact"] == pytest.approx(0.5 * 0.1 * 150)
    assert got[3]["impact_type"] == "neutral"


def test_margins_and_bounds(spark):
    df = spark.createDataFrame([(1, 0.0, 5.0, 10.0), (2, 200.0, None, 3000.0)],
                               "id long, predicted_price double, ratings double, prediction double")
    m = {r.id: r for r in K.bounded_price(K.quality_margin(K.profit_margin(df))).collect()}
    assert m[1]["profit_margin"] is None and m[2]["profit_margin"] == pytest.approx(30.0)
    assert m[1]["gross_margin"] == pytest.approx(70.0) and m[2]["gross_margin"] is None  # 75 clamped
    assert (m[1]["floored_price"], m[1]["clamped_price"]) == (100.0, 50.0)
    assert m[2]["clamped_price"] == 2000.0


def test_regression_metrics_constant_predictor(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 2.0)], "optimal_price double, prediction double")
    r = K.regression_metrics(df).collect()[0]
    assert (r.mae, r.mse, r.rmse, r.r2, r.n_rows) == (1.0, 1.0, 1.0, 0.0, 2)  # the mean: R2 = 0


def test_seeded_sample_exact_and_stable(spark, clean_small):
    a = [r.id for r in K.seeded_sample(clean_small, 50).collect()]
    b = [r.id for r in K.seeded_sample(clean_small.repartition(5), 50).collect()]
    assert len(a) == 50 and a == b
    assert K.seeded_sample(clean_small, 10_000).count() == clean_small.count()


def test_sweep_positions(spark):
    df = spark.createDataFrame([(1, 0.5)], "id long, demand double")
    vals = [r.demand for r in J.sensitivity_sweep(df, "demand", 0.0, 1.0, 0.01).collect()]
    assert len(vals) == 101 and vals[7] == 0.07 and vals[-1] == 1.0
    p = [r.competitor_price_mean for r in
         J.sensitivity_sweep(spark.createDataFrame([(1, 1.0)], "id long, competitor_price_mean double"),
                             "competitor_price_mean", 200.0, 1000.0, 10.0).collect()]
    assert len(p) == 81 and p[0] == 200.0 and p[-1] == 1000.0


@pytest.fixture(scope="module")
def forest(spark, clean_small):
    return M.train_price_model(clean_small, num_trees=10, max_depth=4)


def test_forest_scores_every_row(spark, clean_small, forest):
    scored = M.score_catalog(forest, clean_small)
    assert scored.count() == clean_small.count()
    assert scored.where(F.col("prediction").isNull()).count() == 0


def test_forest_importances_and_determinism(spark, clean_small, forest):
    imp = M.feature_importance(forest).collect()
    assert sum(r.importance for r in imp) == pytest.approx(1.0)
    again = M.train_price_model(clean_small, num_trees=10, max_depth=4)
    assert [r.feature for r in imp if r.importance > 0][0] in M.model_features(forest)
    assert M.feature_importance(again).collect() == imp


def test_forest_beats_mean(spark, clean_small, forest):
    met = K.regression_metrics(M.score_catalog(forest, clean_small)).collect()[0]
    assert met.r2 > 0.0


def test_model_save_load_roundtrip(spark, clean_small, forest):
    from pyspark.ml import PipelineModel
    from pricelab.session import scratch_path
    path = scratch_path(spark, "model")
    forest.save(path)
    loaded = PipelineModel.load(path)
    assert M.model_features(loaded) == M.model_features(forest)
    a = sorted(M.score_catalog(forest, clean_small).collect())
    b = sorted(M.score_catalog(loaded, clean_small).collect())
    assert a == b


def test_wide_vocabulary(spark):
    """50,000 categories train and score; a missing or unseen one is a row of zeros."""
    df = spark.range(50_000).select(
        "id", (F.col("id") % 10 / 10).alias("demand"), F.concat(F.lit("c"), F.col("id")).alias("articleType"),
        (F.col("id") % 10 * 50.0 + 100).alias("optimal_price"))
    model = M.train_price_model(df, ["demand"], num_trees=1, max_depth=3)
    assert len(M.model_features(model)) == 50_001
    odd = df.limit(20).withColumn("articleType", F.when(F.col("id") % 2 == 0, F.lit("never seen")))
    for rows in (df, odd):
        scored = M.score_catalog(model, rows)
        assert scored.where("prediction BETWEEN 100 AND 550").count() == rows.count()


def test_impact_report_matches_python_formatting(spark, clean_small):
    """Every sentence against Python formatting (brute force)."""
    from pricelab.operators import scenarios as J
    from pricelab.plans import registry as R
    from pricelab.plans.params import FEATURES_FIXED
    long = J.signal_importance_join(J.shown_signals(R._playground(spark, "/root/testdata/sf0.001")),
                                    J.importance_table(spark), model_features=FEATURES_FIXED)
    rows = K.impact_text(K.feature_impact(long)).collect()
    assert {r.signal for r in rows} == set(K.IMPACT_TEMPLATES)
    for r in rows:
        want = None
        if r.shown is not None and r.impact is not None:
            tmpl = K.IMPACT_TEMPLATES[r.signal]
            places = K.SHOWN_PLACES.get(r.signal, 2)
            shown = ("yes" if r.shown > 0 else "no") if "%s" in tmpl else math.floor(r.shown * 10**places + 0.5) / 10**places
            want = tmpl % (shown, round(abs(r.impact)))
        assert r.explanation == want


def test_position_and_trend_edge_cases(spark):
    from pricelab.operators import profile as A
    df = spark.createDataFrame([(1, 0.0, 300.0), (2, -5.0, 300.0), (3, 600.0, 300.0)],
                               "id long, current_price double, competitor_price_mean double")
    got = {r.id: r.competitor_position for r in K.competitor_position(df).collect()}
    assert got == {1: 1.0, 2: 1.0, 3: 0.5}
    one = spark.createDataFrame([(0.5, 100.0)], "demand double, optimal_price double")
    t = A.demand_price_trend(one).collect()[0]
    assert t.slope is None and t.n_pairs == 1
    const = spark.createDataFrame([(0.5, 100.0), (0.5, 120.0)], "demand double, optimal_price double")
    assert A.demand_price_trend(const).collect()[0].slope is None
    assert A.demand_price_corr(const).collect()[0].correlation is None


def test_numeric_summary_approx_close_to_exact(spark, clean_small):
    from pricelab.operators import profile as A
    ex = {r.column: r for r in A.numeric_summary(clean_small, ["demand", "optimal_price"]).collect()}
    ap = {r.column: r for r in A.numeric_summary(clean_small, ["demand", "optimal_price"],
                                                 approx=True).collect()}
    for c in ex:
        span = ex[c]["max"] - ex[c]["min"]
        for q in ("q25", "q50", "q75"):
            assert abs(ex[c][q] - ap[c][q]) <= 0.02 * span


def test_forest_what_if_flows(spark, clean_small, forest):
    from pricelab import schema as S
    from pricelab.operators.cleaning import clean_flags_lenient
    from pricelab.plans.whatif import forest_optimizer_pricing, forest_playground_pricing
    opt = forest_optimizer_pricing(forest, clean_small).collect()
    assert len(opt) == clean_small.count()
    assert all(r.predicted_price >= 100.0 for r in opt)
    lenient = clean_flags_lenient(clean_small)
    play = forest_playground_pricing(forest, lenient, S.CALIBRATED_WEIGHTS).collect()
    assert len(play) == clean_small.count()
    assert all(50.0 <= r.predicted_price <= 2000.0 for r in play)
    assert {r.direction for r in play} <= {"INCREASE", "DECREASE", "ADJUSTMENT"}
