"""The forest as tables scores and ranks like the model object, also without categories and on odd rows."""
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from pricelab.operators import model as M
from pricelab.operators.model_tables import (importance_from_tables, load_forest, read_forest, save_forest, score_from_tables)
from pricelab.session import scratch_path


@pytest.mark.parametrize("categories", [("articleType", "baseColour", "season"), ()])
def test_tables_equal_the_model(spark, clean_small, categories):
    model = M.train_price_model(clean_small, categoricals=categories, num_trees=6, max_depth=5)
    path = scratch_path(spark, "t-model")
    model.save(path)
    tables = load_forest(spark, save_forest(read_forest(spark, path), scratch_path(spark, "t-tables")))
    assert tables.signals == M.numeric_inputs(model) and tables.columns == M.categorical_inputs(model)
    assert [r.name for r in tables.features.orderBy("feature").collect()] == M.model_features(model)
    odd = clean_small.withColumn("articleType", F.when(F.col("id") % 3 == 0, "never seen").when(F.col("id") % 3 == 1, F.col("articleType"))) \
        .withColumn("demand", F.when(F.col("id") % 5 > 0, F.col("demand")))
    for rows in (clean_small, odd, clean_small.limit(0)):
        ours = {r.id: r.prediction for r in score_from_tables(tables, rows).collect()}
        theirs = {r.id: r.prediction for r in M.score_catalog(PipelineModel.load(path), rows).collect()}
        assert ours == theirs
    want = {r.feature: r.importance for r in M.feature_importance(model).collect()}
    got = {r.feature: r.importance for r in importance_from_tables(tables).collect()}
    assert got == pytest.approx(want, abs=1e-9)


def test_scoring_needs_no_python_and_no_join(spark, clean_small):
    model = M.train_price_model(clean_small, num_trees=3, max_depth=3)
    path = scratch_path(spark, "t-model")
    model.save(path)
    plan = score_from_tables(read_forest(spark, path), clean_small)._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_interval_sweep_equals_the_swept_model(spark, clean_small):
    from pricelab.operators.model_tables import interval_sweep, sweep_intervals
    from pricelab.operators.scenarios import sensitivity_sweep
    model = M.train_price_model(clean_small, num_trees=6, max_depth=4)
    path = scratch_path(spark, "t-model")
    model.save(path)
    tables = read_forest(spark, path)
    few = clean_small.where("id < 40")
    for signal, lo, hi, step in (("demand", 0.0, 1.0, 0.01), ("inventory", 0.2, 0.7, 0.05), ("ratings", 1.0, 5.0, 2.0)):
        rows = M.design_matrix(few, M.numeric_inputs(model), M.categorical_inputs(model))
        swept = sensitivity_sweep(rows, signal, lo, hi, step)
        want = {(r.id, r.step): r.prediction for r in M.predict_features(model, swept, keep=("id", "step")).collect()}
        rows = interval_sweep(tables, few, signal, lo, hi, step).collect()
        assert {(r.id, r.step): r.prediction for r in rows} == want and len(rows) == 40 * (round((hi - lo) / step) + 1)
        assert {(r.step, r[signal]) for r in rows} == {(r.step, r[signal]) for r in swept.select("step", signal).distinct().collect()}
    parts = spark.range(1).select(sweep_intervals(tables, "demand", 0.0, 1.0, 0.01).alias("p")).first()["p"]
    assert len(parts) < 101 and sum(len(p["steps"]) for p in parts) == 101      # fewer scores than positions
