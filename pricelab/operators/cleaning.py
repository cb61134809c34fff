"""Cleaning operators (C1-C10): per-row projections plus one median scalar.

The operators are lazy ``DataFrame -> DataFrame`` projections.  The catalog-wide
median that fills missing competitor means is a scalar subquery, an exact
quantile by three narrowing aggregates (``functions.narrowing``).
"""

from __future__ import annotations

from typing import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.prices import (clip, flag_lenient, flag_strict, nan_to_null,
                                price_coerce, price_list_mean)
from ..functions.stats import exact_median


def clean_names(df: DataFrame, default: str = S.DEFAULT_PRODUCT_NAME) -> DataFrame:
    """A missing product name becomes a generic label."""
    return df.withColumn("productDisplayName",
                         F.coalesce(F.col("productDisplayName"), F.lit(default)))


def competitor_mean(df: DataFrame, invalid: float = S.INVALID_PRICE_LIST_MEAN) -> DataFrame:
    """Mean of the competitor price list; invalid text gives ``invalid``, ``[]`` NULL."""
    return df.withColumn("competitor_price_mean",
                         price_list_mean(F.col("competitor_prices"), invalid))


def impute_competitor_mean(df: DataFrame, column: str = "competitor_price_mean",
                           median: float | None = None) -> DataFrame:
    """Fill missing competitor means with the exact catalog median, or with ``median`` if it is known."""
    med = exact_median(df, column) if median is None else F.lit(median)
    return df.withColumn(column, F.coalesce(F.col(column), med))


def clean_flags_strict(df: DataFrame, columns: Sequence[str] = S.FLAG_COLUMNS) -> DataFrame:
    """C4: NULL to 0, int, clipped to [0, 1]; unparsable text fails the query."""
    return df.withColumns({c: flag_strict(F.col(c)) for c in columns})


def clean_flags_lenient(df: DataFrame, columns: Sequence[str] = S.FLAG_COLUMNS) -> DataFrame:
    """Unparsable or NULL to 0.0, kept as double, not clipped."""
    return df.withColumns({c: flag_lenient(F.col(c)) for c in columns})


def clean_price(df: DataFrame, column: str = "optimal_price",
                missing: float = S.MISSING_PRICE) -> DataFrame:
    """The label as double; unparsable or missing becomes ``missing``."""
    return df.withColumn(column, price_coerce(F.col(column), missing))


def current_price(df: DataFrame, column: str = "optimal_price",
                  floor: float | None = S.CURRENT_PRICE_FLOOR,
                  missing: float = S.MISSING_PRICE, out: str = "current_price") -> DataFrame:
    """The current price, ``missing`` if the column is absent, floored at ``floor``."""
    if column in df.columns:
        p = F.coalesce(F.col(column).cast("double"), F.lit(missing))
    else:
        p = F.lit(float(missing))
    if floor is not None:
        p = F.greatest(F.lit(float(floor)), p)
    return df.withColumn(out, p)


def model_matrix_fill(df: DataFrame, features: Sequence[str], label: str = "optimal_price",
                      feature_fill: float = S.FEATURE_FILL,
                      label_fill: float = S.LABEL_FILL,
                      keep: Sequence[str] = ("id",)) -> DataFrame:
    """Feature NULLs to 0, label NULL to 500; one projection."""
    cols = [F.col(k) for k in keep if k in df.columns]
    cols += [F.coalesce(nan_to_null(F.col(f).try_cast("double")), F.lit(feature_fill)).alias(f)
             for f in features]
    cols.append(F.coalesce(nan_to_null(F.col(label).try_cast("double")),
                           F.lit(label_fill)).alias(label))
    return df.select(*cols)


def with_reviews_default(df: DataFrame, default: float = S.REVIEWS_DEFAULT) -> DataFrame:
    """``reviews_count`` defaults to 0.5 when the column is absent."""
    if "reviews_count" in df.columns:
        return df
    return df.withColumn("reviews_count", F.lit(float(default)))


def domain_violations(df: DataFrame,
                      rules: Iterable[tuple[str, float, float]] = S.DOMAINS_OPTIMIZER) -> DataFrame:
    """Per rule ``(signal, lo, hi)``: rows checked, values outside, NULLs.

    One pass: unpivot the ruled signals, attach bounds from a literal map (no
    join), aggregate per signal.
    """
    rules = list(rules)
    signals = [r[0] for r in rules]
    lo_map = F.create_map(*[x for r in rules for x in (F.lit(r[0]), F.lit(float(r[1])))])
    hi_map = F.create_map(*[x for r in rules for x in (F.lit(r[0]), F.lit(float(r[2])))])
    long = df.select(*[F.col(c).cast("double").alias(c) for c in signals]) \
        .unpivot([], signals, "signal", "value")
    lo = F.element_at(lo_map, F.col("signal"))
    hi = F.element_at(hi_map, F.col("signal"))
    out = long.groupBy("signal").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if((F.col("value") < lo) | (F.col("value") > hi)).alias("n_outside"),
        F.count_if(F.col("value").isNull()).alias("n_null"),
    )
    return out.select("signal", F.element_at(lo_map, F.col("signal")).alias("lo"),
                      F.element_at(hi_map, F.col("signal")).alias("hi"),
                      "n_rows", "n_outside", "n_null")


def nan_clean(df: DataFrame) -> DataFrame:
    """Convert NaN to NULL in every double column (one missing marker)."""
    cols = []
    for f in df.schema.fields:
        if f.dataType.typeName() in ("double", "float"):
            cols.append(nan_to_null(F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def clean_label(df: DataFrame, label: str | None, column: str = "optimal_price") -> DataFrame:
    """The label as double: unparsable or missing is the fill value (``fill``), missing
    (``null``), or the column is left as it is (None)."""
    if label is None:
        return df
    if label == "fill":
        return clean_price(df, column)
    if label == "null":
        return df.withColumn(column, nan_to_null(F.col(column).cast("string").try_cast("double")))
    raise ValueError(f"unknown label rule {label!r}")


def clean_catalog(raw: DataFrame, flags: str | None = "strict", label: str | None = "fill",
                  impute: bool = True, median: float | None = None) -> DataFrame:
    """Load-time cleaning: names, competitor mean (+median fill, see C3), flags, price.

    ``flags="strict"`` is the optimizer application's rule (int, clipped),
    ``flags="lenient"`` the playground's (double, unparsable to 0), ``None``
    leaves the flag text as is (see ``clean_flags``).
    """
    df = nan_clean(raw)
    df = clean_names(df)
    df = competitor_mean(df)
    if impute:
        df = impute_competitor_mean(df, median=median)
    return clean_flags(clean_label(df, label), flags)


def clean_flags(df: DataFrame, flags: str | None) -> DataFrame:
    """Apply one edition's flag rule (``strict``, ``lenient`` or ``None``)."""
    if flags is None:
        return df
    if flags == "strict":
        return clean_flags_strict(df)
    if flags == "lenient":
        return clean_flags_lenient(df)
    raise ValueError(f"unknown flag rule {flags!r}")


def clip_columns(df: DataFrame, columns: Sequence[str], lo: float = S.CLIP_LOW,
                 hi: float = S.CLIP_HIGH) -> DataFrame:
    return df.withColumns({c: clip(F.col(c), lo, hi) for c in columns})
