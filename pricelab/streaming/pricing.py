"""Structured Streaming: the stateless pricing operators over arriving catalog files.

Cleaning, features and KPIs are per-row projections, so the batch operators
apply unchanged to a streaming DataFrame.  The catalog-wide constants (the
competitor-mean median used for imputation and the fitted price line) are
computed in batch and passed in as literals; nothing
here keeps state, so there is no watermark and each micro-batch is
independent.  Progress lives in the checkpoint location (shared folder), so a
restarted query resumes where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.prices import round6
from ..operators import cleaning as C
from ..operators import kpi as K
from ..operators.scenarios import linear_price
from ..plans.whatif import playground_frame


def catalog_stream(spark: SparkSession, source_dir: str, max_files_per_trigger: int | None = None,
                   fmt: str = "parquet") -> DataFrame:
    """Streaming scan of catalog files with the declared schema (no inference)."""
    reader = spark.readStream.schema(S.CATALOG_SCHEMA).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if fmt == "csv":
        reader = reader.option("header", True).option("escape", '"')
    return reader.load(source_dir)


def clean_stream(raw: DataFrame, competitor_median: float | None) -> DataFrame:
    """Load-time cleaning of a stream (lenient flags); the median is a given constant."""
    df = C.nan_clean(raw)
    df = C.clean_names(df)
    df = C.competitor_mean(df)
    df = df.withColumn("competitor_price_mean",
                       F.coalesce(F.col("competitor_price_mean"),
                                  F.lit(competitor_median).cast("double")))
    df = C.clean_flags_lenient(df)
    return C.clean_price(df)


def pricing_kpi_stream(raw: DataFrame, competitor_median: float | None,
                       price_line: tuple[float | None, float | None]) -> DataFrame:
    """Per-product pricing KPIs (playground edition) for every arriving product.

    ``price_line`` is the (intercept, slope) of the linear price model fitted
    in batch (``scenarios.fit_price_line_values``).
    """
    df = playground_frame(clean_stream(raw, competitor_median),
                          predictor=linear_price(*price_line))
    df = K.price_tier(K.price_direction(K.price_change(df)))
    df = K.pricing_score(K.competitor_position(df))
    return df.select("id", "current_price", round6("predicted_price").alias("predicted_price"),
                     round6("price_change").alias("price_change"),
                     round6("change_percent").alias("change_percent"), "direction",
                     "price_tier", round6("score").alias("score"), "score_level",
                     round6("competitor_position").alias("competitor_position"))


def run_available(stream_df: DataFrame, sink_dir: str, checkpoint_dir: str) -> str:
    """Process everything available now into parquet files, then stop."""
    q = (stream_df.writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", checkpoint_dir)
         .trigger(availableNow=True).start(sink_dir))
    q.awaitTermination()
    return sink_dir
