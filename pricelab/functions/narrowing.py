"""Exact quantiles of columns by repeated narrowing.

A monotone scale maps every double to a real number (sixteen units a power of
two).  The first pass counts values by whole units, the second by 4096ths of
the one unit that holds a wanted rank, the third by value within that 4096th.
Each pass is one aggregate without grouping whose state is a mergeable histogram,
combined in the tasks: whatever lies outside the wanted bucket counts as one
value below or above it, so ranks stay what they are and the state stays small.
Nothing is sorted, written, or sent by range, and nothing runs when the frame is
made: each pass is a scalar subquery of the next one, so a quantile costs three
exchanges of one row a task.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Units a power of two; parts of a unit; shift that keeps the scale of a positive number above 0.
UNITS, PARTS, SHIFT = 16.0, 4096.0, 1076.0
BELOW, ABOVE = -1e15, 1e15


def scale(x: Column) -> Column:
    """A real number for each double, in the same order (0 for 0, about +-34,000 at the ends)."""
    size = F.least(F.greatest(F.log2(F.abs(x)), F.lit(1 - SHIFT)), F.lit(SHIFT)) + F.lit(SHIFT)
    return F.when(x == 0, F.lit(0.0)).otherwise(F.signum(x) * size * F.lit(UNITS))


def column_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float],
                     moments: bool = False) -> DataFrame:
    """``(column, ordinal, n, q)``: the exact interpolated quantiles ``q`` of each column, lazily.

    Matches ``percentile`` (pandas ``quantile``, DuckDB ``quantile_cont``).  NULL
    and NaN are skipped; a column without values has n = 0 and NULL quantiles.
    ``moments`` adds mean, std (sample), min and max, from the first pass.
    """
    n_cols, probs = len(columns), [float(p) for p in probs]
    raw = [F.col(c).cast("double") for c in columns]
    rows = df.select(*[F.when(~F.isnan(x), x).alias(f"v{i}") for i, x in enumerate(raw)])
    rows = rows.select("*", *[scale(F.col(f"v{i}")).alias(f"t{i}") for i in range(n_cols)])
    rows = rows.select("*", *[F.floor(f"t{i}").alias(f"a{i}") for i in range(n_cols)],
                       *[F.floor(F.col(f"t{i}") * F.lit(PARTS)).alias(f"b{i}") for i in range(n_cols)])

    def of(i: int) -> list[Column]:
        v = F.col(f"v{i}")
        return [F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
                F.min(v).alias("min"), F.max(v).alias("max")] if moments else [F.count(v).alias("n")]

    # a pass's one row stands beside every row of the next pass: named once, so planned once
    first = rows.select(F.struct(*[F.struct(F.percentile(f"a{i}", probs).alias("at"), *of(i)).alias(f"c{i}")
                                   for i in range(n_cols)])).scalar()
    pairs = [(i, j) for i in range(n_cols) for j in range(len(probs))]

    def clamped(bucket: Column, wanted: Column, inside: Column) -> Column:
        return (F.when(bucket < wanted, F.lit(BELOW)).when(bucket > wanted, F.lit(ABOVE))
                .otherwise(inside.cast("double")))

    # second pass: the 4096th; where no value has the unit, the two ranks lie on both sides of it
    def unit(i: int, j: int) -> Column:
        return F.col(f"first.c{i}.at")[j]

    second = rows.withColumn("first", first).select(F.struct(*[
        F.when(F.count_if(F.col(f"a{i}") == unit(i, j)) > 0,
               F.percentile(clamped(F.col(f"a{i}"), unit(i, j), F.col(f"b{i}")), probs[j]))
        .otherwise(F.ceil(F.max(unit(i, j))) * F.lit(PARTS) - F.lit(0.5)).alias(f"p{i}_{j}") for i, j in pairs])).scalar()

    # third pass: the values themselves, or the two neighbours of an empty place
    rows = rows.withColumn("second", second)
    aggs = []
    for i, j in pairs:
        b, w, v = F.col(f"b{i}"), F.col(f"second.p{i}_{j}"), F.col(f"v{i}")
        inside = F.when(b < w, F.lit(float("-inf"))).when(b > w, F.lit(float("inf"))).otherwise(v)
        aggs += [F.count_if(b == w).alias(f"in{i}_{j}"), F.max(F.when(b < w, v)).alias(f"lo{i}_{j}"),
                 F.min(F.when(b > w, v)).alias(f"hi{i}_{j}"), F.percentile(inside, probs[j]).alias(f"q{i}_{j}")]
    last = rows.agg(*aggs).withColumn("first", first)

    out = []
    for i, c in enumerate(columns):
        n = F.col(f"first.c{i}.n")
        q = []
        for j, p in enumerate(probs):
            at = (n - 1).cast("double") * F.lit(p)
            lo, hi = F.col(f"lo{i}_{j}"), F.col(f"hi{i}_{j}")
            q.append(F.when(F.col(f"in{i}_{j}") > 0, F.col(f"q{i}_{j}")).otherwise(lo + (at - F.floor(at)) * (hi - lo)))
        more = [F.col(f"first.c{i}.{m}").alias(m) for m in ("mean", "std", "min", "max")] if moments else []
        out.append(F.struct(F.lit(c).alias("column"), F.lit(i).alias("ordinal"), n.alias("n"), F.array(*q).alias("q"), *more))
    return last.select(F.explode(F.array(*out)).alias("x")).select("x.*")
