"""Exact quantiles by narrowing: against numpy, over hard value ranges, and the shape of the plan."""
import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pricelab.functions.narrowing import column_quantiles
from pricelab.functions.stats import exact_median
from pricelab.operators import profile as A

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]


def test_hard_ranges(spark):
    rng = np.random.default_rng(3)
    n = 1500
    cols = {
        "normal": rng.normal(size=n), "wide": np.exp(rng.normal(size=n) * 50) * rng.choice([-1, 1], n),
        "hot": np.where(rng.random(n) < 0.4, 3.0, rng.integers(0, 5, n)), "close": 1 + rng.random(n) * 1e-13,
        "tiny": rng.random(n) * 5e-320, "two": [7.0 if i == 3 else -5.0 if i == 9 else math.nan for i in range(n)],
        "zero": np.zeros(n), "none": np.full(n, math.nan)}
    df = spark.createDataFrame([tuple(float(cols[c][i]) for c in cols) for i in range(n)], list(cols))
    got = {r["column"]: r for r in column_quantiles(df, list(cols), PROBS, moments=True).collect()}
    for i, (c, v) in enumerate(cols.items()):
        v, r = np.asarray(v, float), got[c]
        v = v[~np.isnan(v)]
        assert r["n"] == len(v) and r["ordinal"] == i
        if len(v):
            assert r["q"] == pytest.approx(list(np.quantile(v, PROBS)), rel=1e-12)
            assert (r["min"], r["max"]) == (v.min(), v.max()) and r["mean"] == pytest.approx(v.mean(), rel=1e-9)
        else:
            assert r["q"] == [None] * len(PROBS) and r["mean"] is None


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.one_of(st.none(), st.floats(allow_nan=True, allow_infinity=False, width=64)), min_size=0, max_size=30))
def test_any_values(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    r = column_quantiles(df, ["x"], [0.0, 0.3, 0.5, 1.0]).collect()[0]
    known = np.array([v for v in values if v is not None and not math.isnan(v)])
    if not len(known):
        assert r["n"] == 0 and r["q"] == [None] * 4
        return
    with np.errstate(over="ignore", invalid="ignore"):
        want = np.quantile(known, [0.0, 0.3, 0.5, 1.0])
    for g, w in zip(r["q"], want):
        assert g == pytest.approx(w, rel=1e-9, abs=1e-300) or not math.isfinite(w) or abs(w) > 1e307


def test_lazy_and_three_exchanges(spark, clean_small):
    """Nothing runs when the frame is made; each pass is one exchange of a row a task."""
    tracker = spark.sparkContext.statusTracker()
    before = set(tracker.getJobIdsForGroup(None))
    summary = A.numeric_summary(clean_small)
    median = clean_small.select(exact_median(clean_small, "demand").alias("m"))
    assert set(tracker.getJobIdsForGroup(None)) == before
    plan = summary._jdf.queryExecution().executedPlan().toString()
    initial = plan[plan.index("Initial Plan"):] if "Initial Plan" in plan else plan
    assert "Sort" not in plan.replace("SortAggregate", "") and "rangepartitioning" not in plan and "Window" not in plan
    assert initial.count("Exchange SinglePartition") <= 3 + 2      # a reused subquery may be printed where it is used
    assert median.first()["m"] == pytest.approx(clean_small.selectExpr("percentile(demand, 0.5) AS m").first()["m"], rel=1e-12)


def test_median_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert df.select(exact_median(df, "x").alias("m")).first()["m"] is None
    assert df.limit(0).select(exact_median(df.limit(0), "x").alias("m")).count() == 0
