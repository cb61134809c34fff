"""Distributed statistics: exact quantiles, correlation, histogram (properties)."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from pricelab.functions.stats import exact_quantiles, histogram, safe_corr, unpivot_values
from pricelab.operators import profile as A


@pytest.mark.parametrize("slices", [1, 3, 8])
def test_exact_quantiles_match_numpy(spark, slices):
    rng = np.random.default_rng(7)
    a = rng.normal(size=997).round(2)
    b = np.concatenate([np.full(400, 3.0), rng.integers(0, 5, 300).astype(float)])  # hot value
    rows = [(float(x), None) for x in a] + [(None, float(y)) for y in b] + [(None, None)]
    df = spark.createDataFrame(rows, "a double, b double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = exact_quantiles(unpivot_values(df, ["a", "b"]), probs, slices=slices).collect()
    res = {(r["column"], r["p"]): r["quantile"] for r in got}
    for col, arr in (("a", a), ("b", b)):
        for p in probs:
            assert res[(col, p)] == pytest.approx(float(np.quantile(arr, p)), abs=1e-9)
    assert {r["n"] for r in got if r["column"] == "a"} == {997}


def test_exact_quantiles_matches_percentile(spark, clean_small):
    long = unpivot_values(clean_small, ["demand", "ratings", "optimal_price"])
    ours = {(r["column"], r["p"]): r["quantile"]
            for r in exact_quantiles(long, [0.25, 0.5, 0.75]).collect()}
    builtin = long.groupBy("column").agg(F.percentile("value", [0.25, 0.5, 0.75]).alias("q"))
    for r in builtin.collect():
        for p, v in zip([0.25, 0.5, 0.75], r["q"]):
            assert ours[(r["column"], p)] == pytest.approx(v, abs=1e-9)


def test_safe_corr_constant_and_symmetry(spark, clean_small):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.1, 5.0), (3.0, 5.9, 5.0)],
                               "x double, y double, c double")
    r = df.select(safe_corr("y", "x").alias("r"), safe_corr("c", "x").alias("rc"),
                  safe_corr("x", "y").alias("rs")).collect()[0]
    assert r["rc"] is None and -1.0 <= r["r"] <= 1.0 and r["r"] == pytest.approx(r["rs"])
    m = {(x["a"], x["b"]): x["r"] for x in A.correlation_matrix(clean_small).collect()}
    for (a, b), v in m.items():
        assert v is None or -1.0 <= v <= 1.0
        assert m[(b, a)] == v
    assert m[("demand", "demand")] == 1.0


def test_histogram_sums_to_non_null(spark, clean_small):
    for col, nb in (("optimal_price", 50), ("demand", 20), ("ratings", 7)):
        h = histogram(clean_small, col, nb).collect()
        assert len(h) == nb
        assert sum(r["count"] for r in h) == clean_small.where(F.col(col).isNotNull()).count()


def test_histogram_constant_column(spark):
    df = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    h = histogram(df, "x", 4).collect()
    assert [r["count"] for r in sorted(h, key=lambda r: r["bin"])] == [2, 0, 0, 0]


def test_reports_unchanged_by_repartitioning(spark, clean_small):
    a = sorted(A.numeric_summary(clean_small).collect())
    b = sorted(A.numeric_summary(clean_small.repartition(7)).collect())
    assert a == b
    c = sorted(A.categorical_summary(clean_small).collect())
    d = sorted(A.categorical_summary(clean_small.repartition(5)).collect())
    assert c == d


from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402


@settings(max_examples=12, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(-5, 5).map(float),
                          st.floats(-100, 100, allow_nan=False)), min_size=1, max_size=60),
       st.integers(1, 6))
def test_exact_quantiles_property(spark, values, slices):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = {r["p"]: r["quantile"] for r in
           exact_quantiles(unpivot_values(df, ["x"]), [0.0, 0.3, 0.5, 0.9, 1.0],
                           slices=slices).collect()}
    data = [v for v in values if v is not None]
    if not data:
        assert got == {}
        return
    for p, q in got.items():
        assert q == pytest.approx(float(np.quantile(np.array(data), p)), abs=1e-9)


def test_same_results_without_broadcast(spark, clean_small):
    """Lookups joined by a shuffle give the same answers."""
    import pricelab.operators.scenarios as SC
    long = unpivot_values(clean_small, ["demand", "optimal_price", "ratings"])
    small = sorted(exact_quantiles(long, [0.1, 0.5, 0.9]).collect())
    sig = spark.createDataFrame([(1, "demand", 0.5), (2, "ratings", 0.8), (3, "other", 0.1)],
                                "id long, signal string, value double")
    imp = sorted(SC.signal_importance_join(sig, SC.importance_table(spark)).collect())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(exact_quantiles(long, [0.1, 0.5, 0.9]).collect()) == small
        assert sorted(exact_quantiles(long, [0.1, 0.5, 0.9], slices=40).collect()) == small
        assert sorted(SC.signal_importance_join(sig, SC.importance_table(spark)).collect()) == imp
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
