"""Streaming KPIs equal the batch ones; catalog build scans lineitem once."""
from pyspark.sql import functions as F

from pricelab.operators import cleaning as C
from pricelab.operators import kpi as K
from pricelab.plans.catalog import cleaned_catalog, raw_catalog_path
from pricelab.plans.whatif import playground_frame
from pricelab.session import scratch_path
from pricelab.sources.catalog import catalog_base
from pricelab.streaming import catalog_stream, pricing_kpi_stream, run_available

from pricelab.operators.scenarios import fit_price_line_values

from paths import SF_SMALL

LINE = (400.0, 300.0)  # an arbitrary fixed price line for the stream plumbing tests


def test_stream_equals_batch(spark):
    clean = cleaned_catalog(spark, SF_SMALL, flags="lenient")
    med = C.competitor_mean(spark.read.parquet(raw_catalog_path(spark, SF_SMALL))) \
        .select(F.median("competitor_price_mean")).first()[0]
    sink, ckpt = scratch_path(spark, "t-sink"), scratch_path(spark, "t-ckpt")
    line = fit_price_line_values(clean)
    run_available(pricing_kpi_stream(catalog_stream(spark, raw_catalog_path(spark, SF_SMALL),
                                                    max_files_per_trigger=1), med, line), sink, ckpt)
    streamed = spark.read.parquet(sink)
    batch = K.price_tier(K.price_direction(K.price_change(playground_frame(clean))))
    a = sorted((r.id, r.direction, r.price_tier) for r in streamed.collect())
    b = sorted((r.id, r.direction, r.price_tier) for r in batch.collect())
    assert a == b and len(a) == clean.count()


def test_stream_restart_processes_nothing_twice(spark):
    sink, ckpt = scratch_path(spark, "t-sink2"), scratch_path(spark, "t-ckpt2")
    src = raw_catalog_path(spark, SF_SMALL)
    run_available(pricing_kpi_stream(catalog_stream(spark, src), 0.0, LINE), sink, ckpt)
    n1 = spark.read.parquet(sink).count()
    run_available(pricing_kpi_stream(catalog_stream(spark, src), 0.0, LINE), sink, ckpt)
    assert spark.read.parquet(sink).count() == n1


def test_catalog_base_scans_lineitem_once(spark):
    base = catalog_base(spark, SF_SMALL)
    plan = base._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem.parquet") == 1
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    # the per-line phase is a plain (code-generated) hash aggregate
    assert "HashAggregate(keys=[l_partkey" in plan


def test_report_bundles_write_and_read(spark, clean_small):
    from pricelab.operators import model as M
    from pricelab.operators.cleaning import clean_flags_lenient
    from pricelab.plans.reports import (model_reports, pricing_reports, profile_reports,
                                        write_reports)
    model = M.train_price_model(clean_small, num_trees=5, max_depth=3)
    bundle = {**profile_reports(clean_small), **model_reports(clean_small, model),
              **pricing_reports(clean_small, clean_flags_lenient(clean_small), model)}
    paths = write_reports(bundle, scratch_path(spark, "reports"))
    assert set(paths) == set(bundle)
    assert spark.read.parquet(paths["overview"]).first()["n_rows"] == clean_small.count()
    assert spark.read.parquet(paths["playground"]).count() == clean_small.count()
    assert spark.read.parquet(paths["residuals"]).count() == clean_small.count()
    assert spark.read.parquet(paths["residual_sample"]).count() == min(500, clean_small.count())


def test_csv_stream_matches_parquet_stream(spark):
    from pricelab.plans.catalog import raw_catalog
    from pricelab.sources.catalog import write_catalog_csv
    src = scratch_path(spark, "t-csv-src")
    write_catalog_csv(raw_catalog(spark, SF_SMALL), src)
    sink_c, ck_c = scratch_path(spark, "t-csv-sink"), scratch_path(spark, "t-csv-ck")
    run_available(pricing_kpi_stream(catalog_stream(spark, src, fmt="csv"), 0.0, LINE), sink_c, ck_c)
    sink_p, ck_p = scratch_path(spark, "t-pq-sink"), scratch_path(spark, "t-pq-ck")
    run_available(pricing_kpi_stream(catalog_stream(spark, raw_catalog_path(spark, SF_SMALL)), 0.0, LINE),
                  sink_p, ck_p)
    a = sorted(tuple(r) for r in spark.read.parquet(sink_c).collect())
    b = sorted(tuple(r) for r in spark.read.parquet(sink_p).collect())
    assert a == b and len(a) > 0


def test_catalog_lazy_and_materialized_paths_agree(spark):
    from pricelab.sources.catalog import catalog_from_tables
    a = sorted(tuple(r) for r in catalog_from_tables(spark, SF_SMALL).collect())
    b = sorted(tuple(r) for r in catalog_from_tables(spark, SF_SMALL, materialize_base=False).collect())
    assert a == b and len(a) > 0
