"""Distinct counts that grow with the files: HLL sketches kept by file, merged for every report.

A catalog that is loaded again and again is mostly old files.  Each load sketches
only the files that are newer than the last load (the scan is pruned by the
files' modification time) and adds one row of sketches a file; a report merges
all rows, which are a few KB each.  The estimate's relative standard error is
``1.04 / sqrt(2^lg_k)``; the exact path (``count_distinct``) stays beside it.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

LG_K = 12


def error_bound(lg_k: int = LG_K, sigmas: float = 3.0) -> float:
    """Relative error that an estimate stays within, for ``sigmas`` standard errors."""
    return sigmas * 1.04 / 2 ** (lg_k / 2)


def _sketches(spark: SparkSession, table_dir: str) -> DataFrame | None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table_dir)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return spark.read.parquet(table_dir) if fs.exists(path) else None


def add_files(spark: SparkSession, source_dir: str, schema: StructType, table_dir: str, columns: Sequence[str],
              lg_k: int = LG_K) -> int:
    """Sketch the parquet files of ``source_dir`` that came after the last load; returns how many.

    A file that is written anew counts with its newest row (see distinct_counts).
    """
    known = _sketches(spark, table_dir)
    since = known.agg(F.max("modified")).first()[0] if known is not None else None
    rows = spark.read.schema(schema).parquet(source_dir)
    rows = rows.select(*columns, F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("modified"))
    if since is not None:
        rows = rows.where(F.col("modified") > F.lit(since))
    sketched = rows.groupBy("file", "modified").agg(
        F.count("*").alias("n_rows"), *[F.hll_sketch_agg(F.col(c).cast("string"), lg_k).alias(c) for c in columns])
    before = known.count() if known is not None else 0
    sketched.write.mode("append").parquet(table_dir)
    return spark.read.parquet(table_dir).count() - before


def distinct_counts(spark: SparkSession, table_dir: str, columns: Sequence[str]) -> DataFrame:
    """``(column, estimate, n_rows)`` over all loaded files, by merging their sketches."""
    rows = spark.read.parquet(table_dir)
    newest = rows.groupBy("file").agg(F.max_by(F.struct("n_rows", *columns), "modified").alias("s")).select("s.*")
    merged = newest.agg(F.sum("n_rows").alias("n_rows"),
                        *[F.hll_sketch_estimate(F.hll_union_agg(c, F.lit(True))).alias(c) for c in columns])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("estimate")) for c in columns])
    return merged.select(F.explode(cells).alias("x"), "n_rows").select("x.*", "n_rows")
