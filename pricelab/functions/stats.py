"""Distributed statistics: safe correlation, exact quantiles, histograms.

Scale notes
-----------
* ``safe_corr`` is a plain aggregate (``regr_sxy``/``regr_sxx``/``regr_syy``):
  partial aggregation, one row of state per group.
* ``exact_quantiles`` never sends all values of a column to one task (which
  is what the exact ``percentile`` aggregate does for its final merge).
  Values are first deduplicated to ``(key, value, count)`` with a map-side
  combine (a value held by a third of all rows becomes one row), then
  range-partitioned by ``(key, value)`` and written to the shared folder, so
  the slice assignment is fixed and survives the loss of an executor.  Slice
  totals give offsets, and only the slices that hold a wanted rank (at most
  two per key and probability) are ranked by running counts.
* ``histogram`` uses one scalar subquery for the bounds and a zero-filled
  ``range(nbins)`` for the bin list.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .narrowing import column_quantiles
from .prices import clip, round_to


def safe_corr(y, x) -> Column:
    """Pearson correlation over pairwise-complete rows.

    NULL when either side is constant or there is fewer than two pairs (where
    ``corr`` would raise under ANSI); clamped to [-1, 1] with NULL kept NULL.
    """
    y = F.col(y) if isinstance(y, str) else y
    x = F.col(x) if isinstance(x, str) else x
    r = F.try_divide(F.regr_sxy(y, x), F.sqrt(F.regr_sxx(y, x) * F.regr_syy(y, x)))
    return clip(r, -1.0, 1.0)


def unpivot_values(df: DataFrame, columns: Sequence[str], key: str = "column",
                   value: str = "value", ids: Sequence[str] = ()) -> DataFrame:
    """Long form ``(ids..., key, value)`` with every value cast to double."""
    casted = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in columns])
    return casted.unpivot(list(ids), list(columns), key, value)


def exact_quantiles(long: DataFrame, probs: Sequence[float], key: str = "column",
                    value: str = "value", slices: int | None = None) -> DataFrame:
    """Exact linearly interpolated quantiles per key: ``(key, p, quantile, n)``.

    Matches ``percentile``/``median`` (pandas ``quantile``, DuckDB
    ``quantile_cont``).  NULL and NaN values are skipped; a key with no value
    yields no rows.  Runs the distinct-value aggregate when called.
    """
    vals = long.select(F.col(key).alias("k"), F.col(value).cast("double").alias("v"))
    vals = vals.where(F.col("v").isNotNull() & ~F.isnan("v"))
    distinct = vals.groupBy("k", "v").agg(F.count(F.lit(1)).alias("cnt"))
    ranged = materialize((distinct.repartitionByRange(slices, "k", "v") if slices
                          else distinct.repartitionByRange("k", "v"))
                         .withColumn("slice", F.spark_partition_id()), "quantile-slices")

    totals = ranged.groupBy("k", "slice").agg(F.sum("cnt").alias("slice_n"))   # keys x slices rows
    w_before = (Window.partitionBy("k").orderBy("slice")
                .rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select(
        "k", "slice", "slice_n",
        F.coalesce(F.sum("slice_n").over(w_before), F.lit(0)).alias("offset"),
        F.sum("slice_n").over(Window.partitionBy("k")).alias("n"),
    )
    pos = (F.col("n") - 1).cast("double") * F.col("p")
    targets = (offsets.select("k", "slice", "offset", "slice_n", "n",
                              F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("p"))
               .withColumns({"lo": F.floor(pos).cast("long"), "hi": F.ceil(pos).cast("long"),
                             "frac": pos - F.floor(pos)}))
    end = F.col("offset") + F.col("slice_n")
    # at most two slices per key and probability hold a wanted rank; only these are ranked
    targets = targets.where(((F.col("lo") >= F.col("offset")) & (F.col("lo") < end))
                            | ((F.col("hi") >= F.col("offset")) & (F.col("hi") < end)))
    wanted = targets.select("k", "slice").distinct()
    w_local = (Window.partitionBy("k", "slice").orderBy("v")
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranks = (ranged.join(wanted, ["k", "slice"], "left_semi")
             .withColumn("run", F.sum("cnt").over(w_local)))
    r, t = ranks.alias("r"), targets.alias("t")
    first = F.col("t.offset") + F.col("r.run") - F.col("r.cnt")
    last = F.col("t.offset") + F.col("r.run") - 1
    lo_hit = (F.col("t.lo") >= first) & (F.col("t.lo") <= last)
    hi_hit = (F.col("t.hi") >= first) & (F.col("t.hi") <= last)
    hits = r.join(t, (F.col("r.k") == F.col("t.k")) & (F.col("r.slice") == F.col("t.slice"))
                  & (lo_hit | hi_hit))
    per = hits.groupBy(F.col("t.k").alias("k"), F.col("t.p").alias("p")).agg(
        F.max(F.when(lo_hit, F.col("r.v"))).alias("v_lo"),
        F.max(F.when(hi_hit, F.col("r.v"))).alias("v_hi"),
        F.first("t.frac").alias("frac"),
        F.first("t.n").alias("n"),
    )
    q = F.col("v_lo") + F.col("frac") * (F.col("v_hi") - F.col("v_lo"))
    return per.select(F.col("k").alias(key), "p", q.alias("quantile"), "n")


def exact_median(df: DataFrame, column: str) -> Column:
    """Scalar-subquery column holding the exact median of ``column`` (NULL if none)."""
    return column_quantiles(df, [column], [0.5]).select(F.col("q")[0]).scalar()


def histogram(df: DataFrame, column: str, nbins: int) -> DataFrame:
    """Equal-width histogram over [min, max], zero-filled: ``(bin, bin_lo, bin_hi, count)``.

    The maximum falls in the last bin; a constant column puts every value in
    bin 0.  Bin counts sum to the non-null count.
    """
    x = F.col(column).cast("double")
    vals = df.select(x.alias("x")).where(F.col("x").isNotNull())
    bounds = vals.select(F.struct(F.min("x").alias("lo"), F.max("x").alias("hi"))).scalar()
    lo, hi = bounds.getField("lo"), bounds.getField("hi")  # one subquery, reused
    width = hi - lo
    raw_bin = F.floor(F.try_divide(F.col("x") - lo, width) * F.lit(float(nbins)))
    b = F.least(F.lit(nbins - 1), F.coalesce(raw_bin, F.lit(0))).cast("int")
    # bin in a projection, then group by the column: the bounds subquery may be
    # non-deterministic (e.g. over model scores), which a grouping expression forbids
    counts = vals.select(b.alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("count"))
    spark = df.sparkSession
    bins = spark.range(nbins).select(F.col("id").cast("int").alias("bin"))
    edges = bins.select(
        "bin",
        (lo + width * F.col("bin") / F.lit(float(nbins))).alias("bin_lo"),
        (lo + width * (F.col("bin") + 1) / F.lit(float(nbins))).alias("bin_hi"),
    ).where(lo.isNotNull())
    return (edges.join(counts, "bin", "left")
            .select("bin", round_to(F.col("bin_lo"), 6).alias("bin_lo"),
                    round_to(F.col("bin_hi"), 6).alias("bin_hi"),
                    F.coalesce(F.col("count"), F.lit(0)).alias("count")))
