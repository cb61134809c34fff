"""Cleaning edge cases (C1-C10) and the NULL/NaN rule."""
import pytest
from pyspark.sql import functions as F
from pyspark.errors import PySparkException

from pricelab.operators import cleaning as C
from pricelab.functions.prices import clip


def test_names_flags_price(spark):
    df = spark.createDataFrame(
        [(1, None, "1", "0", None, "10"), (2, "x", None, "2", "abc", "bad"),
         (3, "y", "1.7", "-1", "0", None)],
        "id long, productDisplayName string, holiday string, weekday string, weekend string,"
        " optimal_price string")
    out = {r["id"]: r for r in C.clean_flags_lenient(C.clean_price(C.clean_names(df))).collect()}
    assert out[1]["productDisplayName"] == "Generic Product"
    assert out[2]["weekend"] == 0.0 and out[2]["holiday"] == 0.0      # unparsable / NULL -> 0
    assert out[3]["holiday"] == 1.7 and out[3]["weekday"] == -1.0     # lenient: no clip
    assert out[1]["optimal_price"] == 10.0
    assert out[2]["optimal_price"] == 500.0 and out[3]["optimal_price"] == 500.0


def test_strict_flags_clip_and_fail(spark):
    df = spark.createDataFrame([(1, "1.7", "-1", None)], "id long, holiday string, weekday string,"
                               " weekend string")
    r = C.clean_flags_strict(df).collect()[0]
    assert (r["holiday"], r["weekday"], r["weekend"]) == (1, 0, 0)
    bad = spark.createDataFrame([(1, "abc", "0", "0")], "id long, holiday string, weekday string,"
                                " weekend string")
    with pytest.raises(Exception):
        C.clean_flags_strict(bad).collect()


def test_current_price_floor_and_absent_column(spark):
    df = spark.createDataFrame([(1, 10.0), (2, None), (3, 700.0)], "id long, optimal_price double")
    got = {r["id"]: r["current_price"] for r in C.current_price(df).collect()}
    assert got == {1: 50.0, 2: 500.0, 3: 700.0}
    no_col = spark.createDataFrame([(1,)], "id long")
    assert C.current_price(no_col).collect()[0]["current_price"] == 500.0


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(None,), (7.0,), (-9.0,), (1.0,)], "x double")
    got = [r[0] for r in df.select(clip(F.col("x"), -5.0, 5.0)).collect()]
    assert got == [None, 5.0, -5.0, 1.0]


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, 1.0)], "id long, demand double")
    got = {r["id"]: r["demand"] for r in C.nan_clean(df).collect()}
    assert got[1] is None and got[2] == 1.0


def test_median_imputation_all_empty_lists(spark):
    df = spark.createDataFrame([(1, "[]"), (2, "[]")], "id long, competitor_prices string")
    out = C.impute_competitor_mean(C.competitor_mean(df)).collect()
    assert all(r["competitor_price_mean"] is None for r in out)


def test_median_imputation_value(spark):
    df = spark.createDataFrame([(1, "[]"), (2, "[10]"), (3, "[20, 40]"), (4, "[100]")],
                               "id long, competitor_prices string")
    got = {r["id"]: r["competitor_price_mean"]
           for r in C.impute_competitor_mean(C.competitor_mean(df)).collect()}
    assert got == {1: 30.0, 2: 10.0, 3: 30.0, 4: 100.0}


def test_domain_violations(spark):
    df = spark.createDataFrame([(0.5, 150.0), (1.5, None), (-0.1, 250.0)],
                               "demand double, competitor_price_mean double")
    rows = {r["signal"]: r for r in C.domain_violations(
        df, [("demand", 0.0, 1.0), ("competitor_price_mean", 200.0, 1000.0)]).collect()}
    assert rows["demand"]["n_outside"] == 2 and rows["demand"]["n_rows"] == 3
    assert rows["competitor_price_mean"]["n_outside"] == 1
    assert rows["competitor_price_mean"]["n_null"] == 1


def test_empty_catalog_reports(spark, clean_small):
    from pricelab.operators import profile as A
    empty = clean_small.limit(0)
    m = A.missing_overall(empty).collect()[0]
    assert m["n_rows"] == 0 and m["missing_percent"] is None
    o = A.dataset_overview(empty).collect()[0]
    assert o["n_rows"] == 0 and o["mean_price"] is None
    assert A.correlation_matrix(empty).where("r IS NOT NULL").count() == 0
    assert A.value_histogram(empty, "optimal_price", 10).count() == 0
