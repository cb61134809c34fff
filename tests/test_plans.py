"""Plan-shape checks: no unbounded windows or cartesian products, pushdown, pruning."""
from pricelab.operators import profile as A
from pricelab.operators import search as P
from pricelab.operators import scenarios as J
from pricelab.plans.catalog import raw_catalog


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_first_row_and_mode_use_partial_aggregation(clean_small):
    for df in (P.first_row_per_name(clean_small), A.categorical_summary(clean_small),
               P.popular_products(clean_small)):
        plan = _plan(df)
        assert "Window" not in plan
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_scenario_grid_is_a_generator(clean_small):
    plan = _plan(J.scenario_grid(clean_small))
    assert "Generate" in plan and "Join" not in plan


def test_catalog_scan_pushes_filters_and_prunes(spark, clean_small):
    df = clean_small.where("demand > 0.8").select("id", "demand")
    plan = _plan(df)
    assert "PushedFilters: [IsNotNull(demand), GreaterThan(demand,0.8)]" in plan
    assert "ReadSchema: struct<id:bigint,demand:double>" in plan


def test_no_cartesian_in_reports(clean_small):
    for df in (A.missing_by_column(clean_small), A.numeric_summary(clean_small),
               A.correlation_matrix(clean_small), A.category_distribution(clean_small)):
        plan = _plan(df)
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


# Keys whose callable writes or trains (their final plan is a plain read or an ML
# transform); they are covered by their own tests.
_SKIP = {"catalog_scan", "catalog_scan_parquet", "report_sink", "model_roundtrip",
         "stream_pricing_kpis", "score_catalog", "model_metrics", "feature_importance",
         "top_drivers", "forest_pricing"}


def test_no_global_windows_or_cartesian_anywhere(spark):
    """Scale guard over every registered query's final plan."""
    import re

    from paths import SF_SMALL
    from pricelab.plans.registry import REGISTRY
    bad = []
    for key, fn in REGISTRY.items():
        if key in _SKIP:
            continue
        df = fn(spark, SF_SMALL)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        if "CartesianProduct" in plan or "BroadcastNestedLoopJoin" in plan:
            bad.append((key, "cartesian/nested-loop join"))
        for line in plan.splitlines():
            line = line.strip()
            if "Window [" not in line:
                continue
            # "Window [exprs], [partition spec]" or "..., [partition spec], [order spec]"
            m = re.search(r"\], \[([^\[\]]*)\](?:, \[([^\[\]]*)\])?$", line)
            if m is None or m.group(1).strip() == "":
                bad.append((key, "window without partitioning"))
    assert not bad, bad


def _without_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")


def test_no_shuffle_in_forest_flows_and_lookup(spark, clean_small):
    """The product travels through the model: no self join, no exchange."""
    from pricelab.operators import model as M
    from pricelab.operators.cleaning import clean_flags_lenient
    from pricelab.plans.params import ENCODED_LOOKUP_COLUMNS, FEATURES_FIXED
    from pricelab.plans.whatif import forest_optimizer_pricing, forest_playground_pricing
    model = M.train_price_model(clean_small, num_trees=3, max_depth=2)
    _without_broadcast(spark)
    try:
        for df in (forest_optimizer_pricing(model, clean_small),
                   forest_playground_pricing(model, clean_flags_lenient(clean_small), {"demand": 2.0}),
                   J.encoded_lookup(clean_small, FEATURES_FIXED, ENCODED_LOOKUP_COLUMNS)):
            plan = _plan(df)
            assert "Exchange" not in plan and "Join" not in plan
            assert df.count() == clean_small.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_correlation_matrix_reads_once(spark, clean_small):
    plan = _plan(A.correlation_matrix(clean_small)).split("== Initial Plan ==")[0]
    assert plan.count("Scan parquet") == 1 and "Union" not in plan


def test_importance_lookup_runs_no_job(spark, clean_small):
    tracker, group = spark.sparkContext.statusTracker(), "importance-plan"
    spark.sparkContext.setJobGroup(group, "plan only")
    try:
        J.signal_importance_join(J.signal_values(clean_small.withColumn("current_price", clean_small.optimal_price)),
                                 J.importance_table(spark))
        assert list(tracker.getJobIdsForGroup(group)) == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
