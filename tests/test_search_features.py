"""Search ties and regex handling; feature engineering defaults (P, F)."""
from pyspark.sql import functions as F

from pricelab import schema as S
from pricelab.operators import features as Fe
from pricelab.operators import search as P


def _names(spark):
    rows = [(1, "Red Shirt"), (2, "blue ring"), (3, "Red Shirt"), (4, None), (5, "a+b (x)"),
            (6, "blue ring"), (7, "green")]
    return spark.createDataFrame(rows, "id long, productDisplayName string")


def test_regex_and_literal_search(spark):
    df = _names(spark)
    assert sorted(r.id for r in P.search_products(df, "RED").collect()) == [1, 3]
    assert sorted(r.id for r in P.search_products(df, "^b.*g$").collect()) == [2, 6]
    assert [r.id for r in P.search_products(df, "a+b (x)", literal=True).collect()] == [5]
    assert P.search_products(df, "a+b (x)").count() == 0  # regex by default


def test_first_names_and_popular_ties(spark):
    df = _names(spark)
    assert [r.productDisplayName for r in P.first_names(df, 3).collect()] == \
        ["Red Shirt", "blue ring", "a+b (x)"]
    pop = P.popular_products(df, 3).collect()
    assert [r.productDisplayName for r in pop] == ["Red Shirt", "blue ring", "a+b (x)"]
    assert [r.n_products for r in pop] == [2, 2, 1]


def test_fallback(spark):
    df = _names(spark)
    hit = P.search_with_fallback(df, "ring", 5).collect()
    assert [(r.productDisplayName, r.from_search) for r in hit] == [("blue ring", True)]
    miss = P.search_with_fallback(df, "zzz", 2).collect()
    assert [(r.productDisplayName, r.from_search) for r in miss] == \
        [("Red Shirt", False), ("blue ring", False)]


def test_first_row_per_name(spark):
    df = _names(spark).withColumn("v", F.col("id") * 10)
    got = {r.productDisplayName: (r.id, r.v) for r in P.first_row_per_name(df).collect()}
    assert got["Red Shirt"] == (1, 10) and got["blue ring"] == (2, 20)
    assert None not in got


def test_one_hot_unseen_and_null(spark):
    df = spark.createDataFrame([(1, "A", "Winter"), (2, None, "Summer")],
                               "id long, articleType string, season string")
    feats = ["articleType_A", "articleType_ZZZ", "season_Summer", "demand"]
    enc = {r.id: r for r in Fe.prepare_encoded(df, feats).collect()}
    assert (enc[1]["articleType_A"], enc[1]["articleType_ZZZ"], enc[1]["season_Summer"]) == (1, 0, 0)
    assert (enc[2]["articleType_A"], enc[2]["season_Summer"]) == (0, 1)
    assert enc[1]["demand"] == 0  # absent feature filled


def test_weighted_features_modes(spark):
    df = spark.createDataFrame([(1, 0.5, 400.0, None, 1.0, 1.0), (2, 0.2, 100.0, "Fall", 0.0, 1.0)],
                               "id long, demand double, competitor_price_mean double,"
                               " season string, holiday double, weekend double")
    feats = ["demand", "competitor_price_mean", "season_Summer", "season_Fall", "holiday",
             "weekend", "lag_price"]
    unit = {r.id: r for r in Fe.weighted_features(df, feats).collect()}
    assert unit[1]["demand"] == 0.5 and unit[1]["competitor_price_mean"] == 5.0   # clipped
    assert unit[1]["season_Summer"] == 1.0 and unit[1]["season_Fall"] == 0.0     # NULL -> Summer
    assert unit[1]["holiday"] == 1.0 and unit[1]["weekend"] == 1.0
    assert unit[1]["lag_price"] == 0.0
    cal = {r.id: r for r in Fe.weighted_features(df, feats, S.CALIBRATED_WEIGHTS).collect()}
    assert cal[1]["demand"] == 5.0                       # 0.5 * 15 clipped
    assert cal[2]["season_Fall"] == 3.0                  # season fallback weight
    assert cal[1]["holiday"] == 5.0 and cal[2]["holiday"] == 0.0


def test_weighted_features_bad_value_zero_row(spark):
    df = spark.createDataFrame([(1, "0.5", 0.3), (2, "oops", 0.3)],
                               "id long, demand string, inventory double")
    out = {r.id: r for r in Fe.weighted_features(df, ["demand", "inventory"]).collect()}
    assert (out[1]["demand"], out[1]["inventory"]) == (0.5, 0.3)
    assert (out[2]["demand"], out[2]["inventory"]) == (0.0, 0.0)
    nul = {r.id: r for r in Fe.weighted_features(df, ["demand", "inventory"], on_bad="null").collect()}
    assert nul[2]["demand"] is None and nul[2]["inventory"] == 0.3


def test_timing_grid_rows(spark, clean_small):
    g = Fe.timing_scenarios(clean_small)
    assert g.count() == 3 * clean_small.count()
    assert {r.timing for r in g.select("timing").distinct().collect()} == \
        {t[0] for t in S.TIMING_OPTIONS}
