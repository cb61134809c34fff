"""Stateful streaming: catalog statistics kept up to date while files arrive.

Arriving rows carry the time at which they were loaded.  A watermark on it
bounds how long a product id is remembered, so a file that comes twice counts
once and a late file counts as long as it is within the delay.  The running
aggregate is one cell for each (category, season, location): counts, sums and
variances that merge, so every profile report is a small roll-up of the
same state.  The state lives in Spark's state store and its checkpoint; each
micro-batch gives only the cells that changed (update mode), and they are
written to the cell table under the batch's number: a batch that runs again
after a failure replaces its own rows.

``median_fill_stream`` fills missing competitor means from mergeable quantile
sketches, one a micro-batch, so no batch pass over the catalog is needed.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.prices import round6, round_to
from ..operators.cleaning import clean_catalog

LOADED = "loaded_at"
ARRIVAL_SCHEMA = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in S.CATALOG_SCHEMA)}, {LOADED} timestamp"
CELL = ["articleType", "season", "location"]
MEASURES = ["optimal_price", "demand", "inventory", "ratings"]
#: Keeps large state out of the JVM heap; a session setting that a stream reads when it starts.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def arrivals(spark: SparkSession, source_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming scan of catalog files that carry ``loaded_at`` (parquet, in any folder below)."""
    reader = spark.readStream.schema(ARRIVAL_SCHEMA).option("recursiveFileLookup", True)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(source_dir)


def cells(rows: DataFrame, delay: str = "6 hours") -> DataFrame:
    """Running cell statistics of an arriving (or whole) catalog.

    Each product id counts once while it is remembered (``delay`` behind the
    newest ``loaded_at``); rows older than that are dropped and show in the
    query's progress.  A null id is a product of its own value like others.
    """
    clean = clean_catalog(rows, flags=None, label="null", impute=False)
    once = clean.withWatermark(LOADED, delay).dropDuplicatesWithinWatermark(["id"])
    aggs = [F.count(F.lit(1)).alias("n_rows"), F.min("id").alias("first_id"), F.max(LOADED).alias("newest")]
    for m in MEASURES:
        v = F.col(m).cast("double")
        aggs += [F.count(v).alias(f"n_{m}"), F.sum(v).alias(f"sum_{m}"), F.var_pop(v).alias(f"var_{m}")]
    return once.groupBy(*CELL).agg(*aggs)


def run_to_table(updates: DataFrame, table_dir: str, checkpoint_dir: str,
                 write: Callable[[DataFrame, int], None] | None = None) -> str:
    """Process what is available in update mode; each micro-batch's rows go to ``table_dir/batch=<n>``."""
    def upsert(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{table_dir}/batch={batch}")

    query = (updates.writeStream.outputMode("update").foreachBatch(write or upsert)
             .option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start())
    query.awaitTermination()
    return table_dir


def newest_cells(spark: SparkSession, table_dir: str) -> DataFrame:
    """The cell table as it stands: of each cell the row of the last batch that changed it."""
    rows = spark.read.parquet(table_dir)
    values = [c for c in rows.columns if c not in (*CELL, "batch")]
    return (rows.groupBy(*CELL).agg(F.max_by(F.struct(*values), "batch").alias("v"))
            .select(*CELL, "v.*"))


def compact(spark: SparkSession, table_dir: str, into: str) -> str:
    """Write the newest cells as the one batch of a new table, for a stream that has run long."""
    newest_cells(spark, table_dir).write.mode("overwrite").parquet(f"{into}/batch=-1")
    return into


# ---------------------------------------------------------------- reports from the cells

def _mean(m: str) -> Column:
    return F.try_divide(F.sum(f"sum_{m}"), F.sum(f"n_{m}"))


def _merged(cells_: DataFrame, by: list[str], m: str) -> DataFrame:
    """Count, mean and sample std of ``m`` from cells: squares around the common mean add up."""
    n, mean = F.col(f"n_{m}"), F.try_divide(F.col(f"sum_{m}"), F.col(f"n_{m}"))
    parts = cells_.groupBy(*by).agg(
        F.sum(n).alias("n"), _mean(m).alias("mean"),
        F.collect_list(F.struct(n.alias("n"), mean.alias("m"), F.col(f"var_{m}").alias("v"))).alias("parts"))
    squares = F.aggregate("parts", F.lit(0.0), lambda s, p: s + F.coalesce(
        p["n"] * (p["v"] + (p["m"] - F.col("mean")) * (p["m"] - F.col("mean"))), F.lit(0.0)))
    std = F.when(F.col("n") > 1, F.sqrt(squares / (F.col("n") - 1)))
    return parts.select(*by, "n", "mean", std.alias("std"))


def overview(cells_: DataFrame) -> DataFrame:
    """A1, A2: rows, mean price, distinct categories, mean rating."""
    return cells_.select(F.sum("n_rows").alias("n_rows"), round6(_mean("optimal_price")).alias("mean_price"),
                         F.count_distinct("articleType").alias("n_categories"), round6(_mean("ratings")).alias("mean_rating"))


def category_stats(cells_: DataFrame) -> DataFrame:
    """Mean, count and sample std of the price per category."""
    merged = _merged(cells_.where("articleType is not null"), ["articleType"], "optimal_price")
    return merged.select("articleType", round6("mean").alias("mean_price"), F.col("n").alias("n_products"),
                         round6("std").alias("std_price"))


def season_means(cells_: DataFrame) -> DataFrame:
    """Season means of price, demand and inventory (2 decimals)."""
    measures = ["optimal_price", "demand", "inventory"]
    return (cells_.where("season is not null").groupBy("season")
            .agg(*[round_to(_mean(m), 2).alias(f"mean_{m}") for m in measures]))


def category_shares(cells_: DataFrame, k: int = S.TOP_CATEGORIES) -> DataFrame:
    """Top ``k`` categories by count with their share of all rows (ties to the first seen)."""
    total = cells_.select(F.sum("n_rows")).scalar()
    top = (cells_.where("articleType is not null").groupBy("articleType")
           .agg(F.sum("n_rows").alias("n_products"), F.min("first_id").alias("first_seen"))
           .orderBy(F.desc("n_products"), "first_seen").limit(k))
    share = F.col("n_products").cast("double") / total.cast("double") * F.lit(100.0)
    return top.select("articleType", "n_products", round6(share).alias("share_percent"))


# ---------------------------------------------------------------- medians by sketches

#: KLL sketch size: a normalised rank error of about 0.35 % (one-sided, 99 % confidence) for k = 800.
SKETCH_K, RANK_ERROR = 800, 0.0035


def add_sketch(rows: DataFrame, column: str, sketch_dir: str, batch: int) -> None:
    """One row: the KLL sketch of ``column`` over the rows of a micro-batch (replaced if the batch runs again)."""
    value = F.col(column).cast("double")
    (rows.where(value.isNotNull() & ~F.isnan(value)).agg(F.kll_sketch_agg_double(value, SKETCH_K).alias("sketch"))
     .where(F.col("sketch").isNotNull()).write.mode("overwrite").parquet(f"{sketch_dir}/batch={batch}"))


def sketch_quantile(spark: SparkSession, sketch_dir: str, p: float = 0.5, upto: int | None = None) -> Column:
    """Scalar: quantile ``p`` of all values sketched so far (batches up to ``upto``), by merging the sketches."""
    parts = spark.read.schema("sketch binary, batch int").parquet(sketch_dir)
    if upto is not None:
        parts = parts.where(F.col("batch") <= upto)
    merged = parts.agg(F.kll_merge_agg_double("sketch", SKETCH_K).alias("s"))
    return merged.select(F.when(F.kll_sketch_get_n_double("s") > 0, F.kll_sketch_get_quantile_double("s", F.lit(p)))).scalar()


def median_fill_stream(rows: DataFrame, table_dir: str, sketch_dir: str, checkpoint_dir: str) -> str:
    """Clean an arriving catalog, missing competitor means filled with the median of all that has come
    so far: each micro-batch first adds its sketch, then reads the merged one.  Rows go to ``table_dir/batch=<n>``."""
    clean = clean_catalog(rows, flags="lenient", impute=False)

    def write(batch_rows: DataFrame, batch: int) -> None:
        spark = batch_rows.sparkSession
        add_sketch(batch_rows, "competitor_price_mean", sketch_dir, batch)
        median = sketch_quantile(spark, sketch_dir, upto=batch)
        filled = batch_rows.withColumn("filled", F.col("competitor_price_mean").isNull()).withColumn(
            "competitor_price_mean", F.coalesce(F.col("competitor_price_mean"), median))
        filled.write.mode("overwrite").parquet(f"{table_dir}/batch={batch}")

    query = (clean.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint_dir)
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return table_dir
