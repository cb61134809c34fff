"""The catalog is built with one exchange of the lines, in bounded splits, and its price lists are parsed once."""
import pytest
from pyspark.sql import functions as F

from pricelab.functions.prices import round_to_long
from pricelab.plans import catalog
from pricelab.session import bounded_splits
from pricelab.sources import catalog as source
from pricelab.sources.catalog import catalog_base

from paths import SF_SMALL

LINES = ("l_partkey bigint, l_suppkey bigint, l_quantity double, l_extendedprice double, l_discount double, "
         "l_tax double, l_returnflag string, l_shipdate timestamp")


def test_round_to_long_is_round(spark):
    values = [0.0, -0.0, 0.5, -0.5, 0.49999999999999994, -0.49999999999999994, 1.5, 2.5, -2.5, 1e15 + 0.5, 4503599627370497.5,
              9007199254740993.0, -3.4999999999999996, 123456.5, None]
    rows = spark.createDataFrame([(v,) for v in values], "x double")
    got = rows.select(round_to_long("x").alias("a"), F.round("x", 0).cast("long").alias("b")).collect()
    assert [r.a for r in got] == [r.b for r in got]


def test_lines_are_exchanged_once_and_nothing_wide_is_broadcast(spark):
    plan = catalog_base(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(l_partkey") == 1
    assert plan.count("SortMergeJoin") >= 2 and "BroadcastHashJoin [p_partkey" not in plan


def test_per_part_sums_are_exact(spark, tmp_path):
    """Repeated prices once, in text order; null cells and parts without lines; sums above 2^32 cents x cents."""
    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).withColumns({
            c: F.col(c).cast("timestamp") for c in ("l_shipdate",) if c in schema}).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")

    put("part", [(k, "a b", "brand", "type", 1, 900.0) for k in (1, 2, 3, 3, None)],
        "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double")
    line = [(1, 9, 2.0, 2000.0, 0.05, 0.08, "R", "2024-03-01"), (1, 8, 1.0, 1000.0, 0.01, 0.0, "N", "2024-01-31"),
            (1, 8, 1.0, 20.0, None, 0.01, None, None), (1, None, 0.0, 10.0, 0.0, 0.5, "R", "2024-02-01"),
            (3, 7, 1.0, 900000000.0, 0.0, 0.99, "N", "2024-05-01"), (3, 7, None, 900000000.0, 0.0, 0.99, "N", "2024-05-01")]
    put("lineitem", line, LINES.replace("timestamp", "string"))
    put("events", [(4, "click"), (9, "click"), (3, "view")], "event_id bigint, event_type string")
    put("supplier", [(8, 1), (8, 1)], "s_suppkey bigint, s_nationkey int")
    put("nation", [(1, 1)], "n_nationkey int, n_regionkey int")
    put("region", [(1, "EUROPE")], "r_regionkey int, r_name string")
    rows = {r.p_partkey: r for r in catalog_base(spark, str(tmp_path)).collect()}
    assert catalog_base(spark, str(tmp_path)).count() == 6          # a supplier and a part come twice
    one, three = rows[1], rows[3]
    assert (one.n_lines, one.qty, one.n_ret, one.mm, one.r_name, one.units) == (4, 4.0, 2, 6, "EUROPE", ["100", "2"])
    assert one.freight == pytest.approx((200000 * 8 + 2000 * 1 + 1000 * 50) / 10000 / 4 / 100)
    assert three.freight == 2 * 90_000_000_000 * 99 / 10000 / 2 / 100 and three.units == ["90000000"]
    assert rows[2].n_lines is None and rows[2].units is None and rows[None].c is None


SPLIT = "spark.sql.files.maxPartitionBytes"


def test_lines_are_combined_in_bounded_splits(spark, monkeypatch):
    """However many lines there are, a task that sorts them by part gets one bounded split of them."""
    seen, own = [], spark.conf.get(SPLIT)
    real = source.materialize
    monkeypatch.setattr(source, "materialize", lambda df, name: (seen.append(spark.conf.get(SPLIT)), real(df, name))[1])
    rows = source.catalog_from_tables(spark, SF_SMALL)
    assert seen == [str(source.LINE_SPLIT)] and spark.conf.get(SPLIT) == own
    assert rows.count() == source.read_table(spark, SF_SMALL, "part").count()


def test_bounded_splits_are_for_the_scans_inside(spark, tmp_path):
    spark.range(200_000).coalesce(1).write.parquet(f"{tmp_path}/t")
    own = spark.conf.get(SPLIT)

    def tasks():
        return spark.read.parquet(f"{tmp_path}/t").rdd.getNumPartitions()

    outside = tasks()
    with pytest.raises(RuntimeError, match="lost"):
        with bounded_splits(spark, 1 << 15):
            inside = tasks()
            raise RuntimeError("lost")
    assert inside > outside == tasks() and spark.conf.get(SPLIT) == own
    try:
        spark.conf.set(SPLIT, "16KB")                               # a session's own lower bound stays
        with bounded_splits(spark, 1 << 15):
            assert spark.conf.get(SPLIT) == "16384"
        assert spark.conf.get(SPLIT) == "16KB"
    finally:
        spark.conf.set(SPLIT, own)


def test_price_lists_are_parsed_once(spark, monkeypatch):
    seen = []
    real = catalog.column_quantiles
    monkeypatch.setattr(catalog, "column_quantiles", lambda df, *a: (seen.append(df), real(df, *a))[1])
    monkeypatch.setattr(catalog, "_MEDIANS", {})
    filled = catalog.cleaned_catalog(spark, SF_SMALL)
    for df in (*seen, filled):
        assert "RLIKE" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert len(seen) == 1 and filled.where("competitor_price_mean IS NULL").count() == 0


def test_sweep_rows_carry_no_forest(spark, clean_small):
    """The trees are a condition over the columns: no row holds them and no lambda walks them."""
    from pricelab.operators import model as M
    from pricelab.operators.model_tables import interval_sweep, read_forest
    from pricelab.session import scratch_path
    path = scratch_path(spark, "t-model")
    M.train_price_model(clean_small, num_trees=3, max_depth=3).save(path)
    swept = interval_sweep(read_forest(spark, path), clean_small, "demand")
    plan = swept._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(trees" not in plan and "level_left" not in plan
    assert swept.count() == 101 * clean_small.count()
