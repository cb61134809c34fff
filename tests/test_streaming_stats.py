"""Statistics kept by streams with state: late, repeated and lost files, restarts, replayed batches, sketches."""
import pytest
from pyspark.sql import functions as F

from pricelab import streaming as T
from pricelab.operators import profile as A
from pricelab.plans.catalog import cleaned_catalog, raw_catalog
from pricelab.session import scratch_path

from paths import SF_SMALL


def arrive(raw, source, loaded, cond="true"):
    (raw.where(cond).withColumn("loaded_at", F.lit(loaded).cast("timestamp")).coalesce(2)
     .write.mode("append").parquet(source))


def places(spark, *names):
    return [scratch_path(spark, f"t-{n}") for n in names]


def step(spark, source, table, ckpt, delay="6 hours"):
    T.run_to_table(T.cells(T.arrivals(spark, source), delay), table, ckpt)
    return T.newest_cells(spark, table)


def test_late_and_repeated_files_and_restarts(spark):
    raw = raw_catalog(spark, SF_SMALL)
    source, table, ckpt = places(spark, "source", "table", "ckpt")
    arrive(raw, source, "2024-05-01 10:00:00", "id % 4 = 0")
    assert step(spark, source, table, ckpt).agg(F.sum("n_rows")).first()[0] == raw.where("id % 4 = 0").count()
    arrive(raw, source, "2024-05-01 14:00:00", "id % 4 = 1")
    step(spark, source, table, ckpt)
    arrive(raw, source, "2024-05-01 09:30:00", "id % 4 >= 2")       # late, within the delay
    arrive(raw, source, "2024-05-01 10:00:00", "id % 4 = 0")        # a file that comes twice
    cells = step(spark, source, table, ckpt)
    batches = {r.batch for r in spark.read.parquet(table).select("batch").distinct().collect()}
    assert step(spark, source, table, ckpt).count() == cells.count()  # nothing new: nothing changes
    assert {r.batch for r in spark.read.parquet(table).select("batch").distinct().collect()} >= batches
    whole = cleaned_catalog(spark, SF_SMALL, label="null")
    for ours, theirs in ((T.category_stats(cells), A.price_stats_by_category(whole)), (T.overview(cells), A.dataset_overview(whole)),
                         (T.season_means(cells), A.season_summary(whole)), (T.category_shares(cells), A.category_distribution(whole))):
        assert sorted(map(str, ours.collect())) == sorted(map(str, theirs.select(*ours.columns).collect()))
    [packed] = places(spark, "packed")
    T.compact(spark, table, packed)
    assert sorted(map(str, T.newest_cells(spark, packed).collect())) == sorted(map(str, cells.collect()))


def test_rows_older_than_the_delay_are_dropped(spark):
    raw = raw_catalog(spark, SF_SMALL)
    source, table, ckpt = places(spark, "source", "table", "ckpt")
    arrive(raw, source, "2024-05-01 10:00:00", "id % 2 = 0")
    step(spark, source, table, ckpt, "1 hour")
    arrive(raw, source, "2024-05-01 06:00:00", "id % 2 = 1")
    cells = step(spark, source, table, ckpt, "1 hour")
    assert cells.agg(F.sum("n_rows")).first()[0] == raw.where("id % 2 = 0").count()


def test_replayed_batch_replaces_its_rows(spark):
    """A batch that failed while it was written runs again under its number and counts once."""
    raw = raw_catalog(spark, SF_SMALL)
    source, table, ckpt = places(spark, "source", "table", "ckpt")
    arrive(raw, source, "2024-05-01 10:00:00")

    def broken(rows, batch):
        rows.limit(1).write.mode("overwrite").parquet(f"{table}/batch={batch}")
        raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        T.run_to_table(T.cells(T.arrivals(spark, source)), table, ckpt, write=broken)
    cells = step(spark, source, table, ckpt)
    assert cells.agg(F.sum("n_rows")).first()[0] == raw.count()


def test_median_by_sketches(spark):
    raw = raw_catalog(spark, SF_SMALL)
    source, table, sketches, ckpt = places(spark, "source", "table", "sketches", "ckpt")
    for k in range(3):
        arrive(raw, source, "2024-05-01 10:00:00", f"id % 3 = {k}")
        T.median_fill_stream(T.arrivals(spark, source), table, sketches, ckpt)
    rows = spark.read.parquet(table)
    assert rows.count() == raw.count() and rows.where("competitor_price_mean is null").count() == 0
    known = sorted(r[0] for r in rows.where("not filled").select("competitor_price_mean").collect())
    m = spark.range(1).select(T.sketch_quantile(spark, sketches).alias("m")).first()["m"]
    below, upto = (sum(v < m for v in known) / len(known), sum(v <= m for v in known) / len(known))
    assert below <= 0.5 + T.RANK_ERROR and upto >= 0.5 - T.RANK_ERROR
    last = max(r.batch for r in rows.select("batch").distinct().collect())
    assert {r[0] for r in rows.where(f"filled and batch = {last}").select("competitor_price_mean").collect()} <= {m}


def test_sketch_error_bound(spark):
    """Ranks of merged sketches over 300,000 values in 30 batches stay within the stated error."""
    [sketches] = places(spark, "sketches")
    for k in range(6):
        T.add_sketch(spark.range(50_000).selectExpr(f"cast(hash(id, {k}) as double) as x"), "x", sketches, k)
    values = spark.range(50_000).selectExpr(*[f"cast(hash(id, {k}) as double) as x{k}" for k in range(6)])
    for p in (0.05, 0.25, 0.5, 0.9):
        m = spark.range(1).select(T.sketch_quantile(spark, sketches, p).alias("m")).first()["m"]
        below = sum(values.select(*[F.count_if(F.col(f"x{k}") <= m) for k in range(6)]).first()) / 300_000
        assert abs(below - p) <= T.RANK_ERROR
    assert spark.range(1).select(T.sketch_quantile(spark, sketches, 0.5, upto=0).alias("m")).first()["m"] is not None


def test_nothing_known_gives_no_median(spark):
    [sketches] = places(spark, "sketches")
    T.add_sketch(spark.range(3).selectExpr("cast(null as double) as x"), "x", sketches, 0)
    assert spark.range(1).select(T.sketch_quantile(spark, sketches).alias("m")).first()["m"] is None
