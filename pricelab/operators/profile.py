"""Profiling reports.

Plan shape: each report is a single aggregation job over the catalog (per
column reports unpivot once and group once instead of one job per column).
Top-k reports are ``orderBy().limit()`` (TakeOrderedAndProject: each task
keeps k rows).  Reported doubles are rounded to ``digits`` places
(``round_to``) so that the last bits of order-dependent floating sums do not
leak out.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..functions.narrowing import column_quantiles
from ..functions.prices import round_to, tiers
from ..functions.stats import histogram, safe_corr, unpivot_values

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
                 T.DoubleType, T.DecimalType)


def _r(c: Column, digits: int | None) -> Column:
    return c if digits is None else round_to(c, digits)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC_TYPES)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def _column_list(df: DataFrame, columns: Sequence[str], name: str = "column") -> DataFrame:
    """(column, ordinal) for the given column names, as a tiny derived frame."""
    spark = df.sparkSession
    pairs = [F.struct(F.lit(c).alias(name), F.lit(i).alias("ordinal"))
             for i, c in enumerate(columns)]
    return spark.range(1).select(F.explode(F.array(*pairs)).alias("x")).select("x.*")


def dataset_shape(df: DataFrame) -> DataFrame:
    """A1: rows and columns."""
    return df.select(F.count(F.lit(1)).alias("n_rows"),
                     F.lit(len(df.columns)).alias("n_columns"))


def dataset_overview(df: DataFrame, price: str = "optimal_price", category: str = "articleType",
                     rating: str = "ratings", digits: int | None = 6) -> DataFrame:
    """A2: rows, mean price, distinct categories, mean rating in one aggregate."""
    return df.select(
        F.count(F.lit(1)).alias("n_rows"),
        _r(F.avg(price), digits).alias("mean_price"),
        F.count_distinct(F.col(category)).alias("n_categories"),
        _r(F.avg(rating), digits).alias("mean_rating"),
    )


def missing_by_column(df: DataFrame, only_missing: bool = True,
                      digits: int | None = 6) -> DataFrame:
    """A3: NULL count and percent per column (column order kept as ``ordinal``).

    One pass: all NULL counts in a single one-row aggregate, then unpivot.
    """
    cols = df.columns
    one = df.select(F.count(F.lit(1)).alias("__n"),
                    *[F.count_if(F.col(c).isNull()).alias(f"m{i}") for i, c in enumerate(cols)])
    stacked = one.select("__n", F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(i).alias("ordinal"),
                 F.col(f"m{i}").alias("missing_count"))
        for i, c in enumerate(cols)])).alias("x")).select("__n", "x.*")
    out = stacked.select(
        "column", "ordinal", "missing_count",
        _r(F.try_divide(F.col("missing_count").cast("double"), F.col("__n").cast("double"))
           * F.lit(100.0), digits).alias("missing_percent"))
    if only_missing:
        out = out.where(F.col("missing_count") > 0)
    return out


def missing_in_column_order(df: DataFrame, k: int = S.MISSING_SHOWN) -> DataFrame:
    """The first ``k`` columns with missing data, in column order."""
    return missing_by_column(df).orderBy("ordinal").limit(k)


def missing_top(df: DataFrame, k: int = S.MISSING_TOP) -> DataFrame:
    """T4: the ``k`` columns with most missing data (ties by column order)."""
    return missing_by_column(df, only_missing=False) \
        .orderBy(F.desc("missing_percent"), "ordinal").limit(k)


def missing_overall(df: DataFrame, digits: int | None = 6) -> DataFrame:
    """A4: percent of NULL cells over all cells, one pass."""
    cols = df.columns
    n_null = sum((F.col(c).isNull().cast("long") for c in cols), F.lit(0).cast("long"))
    agg = df.select(F.count(F.lit(1)).alias("n_rows"), F.sum(n_null).alias("n_null"))
    total = F.col("n_rows") * F.lit(len(cols))
    return agg.select(
        "n_rows",
        F.lit(len(cols)).alias("n_columns"),
        F.coalesce(F.col("n_null"), F.lit(0)).alias("n_null_cells"),
        _r(F.try_divide(F.col("n_null").cast("double"), total.cast("double")) * F.lit(100.0),
           digits).alias("missing_percent"),
    )


def quality_verdict(df: DataFrame, levels=S.QUALITY_LEVELS,
                    otherwise: str = S.QUALITY_ELSE) -> DataFrame:
    """Completeness verdict from the overall missing percent (< 5, < 15, else)."""
    m = missing_overall(df)
    pct = F.col("missing_percent")
    verdict = None
    for thr, label in levels:
        verdict = (F.when(pct < thr, F.lit(label)) if verdict is None
                   else verdict.when(pct < thr, F.lit(label)))
    return m.select("missing_percent", verdict.otherwise(F.lit(otherwise)).alias("verdict"))


def numeric_summary(df: DataFrame, columns: Sequence[str] | None = None,
                    approx: bool = False, digits: int | None = 6) -> DataFrame:
    """A5: count, mean, sample std, min, quartiles, max per numeric column.

    Quartiles are exact and interpolated (``approx=True`` switches to
    ``percentile_approx`` sketches).  The exact ones come from
    ``column_quantiles``, whose first pass also takes the moments: three
    aggregates over the rows, no unpivot, no sort, nothing run or written when called.
    """
    columns = list(columns) if columns is not None else numeric_columns(df)
    probs, names = [0.25, 0.5, 0.75], ["q25", "q50", "q75"]
    if approx:
        long = unpivot_values(df, columns)
        found = long.groupBy("column").agg(
            F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
            F.min("value").alias("min"), F.max("value").alias("max"),
            F.percentile_approx("value", probs, 10000).alias("q"))
        found = _column_list(df, columns).join(found, "column", "left")
    else:
        found = column_quantiles(df, columns, probs, moments=True)
    found = found.select("*", *[F.col("q")[i].alias(n) for i, n in enumerate(names)])
    return found.select(
        "column", "ordinal", F.coalesce(F.col("n"), F.lit(0)).alias("count"),
        *[_r(F.col(c), digits).alias(c) for c in ["mean", "std", "min", *names, "max"]])


def categorical_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Distinct count and most common value per text column.

    Pre-aggregated on (column, value); the mode is ``min(struct(-count, value))``
    (most frequent, ties to the smallest value) - a partial aggregate, so a
    column with millions of distinct values is never ranked in one task.
    An all-NULL column keeps 0 and ``N/A``.
    """
    columns = list(columns) if columns is not None else text_columns(df)
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]) \
        .unpivot([], columns, "column", "value").where(F.col("value").isNotNull())
    counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("cnt"))
    per = counts.groupBy("column").agg(
        F.count(F.lit(1)).alias("unique_values"),
        F.min(F.struct((-F.col("cnt")).alias("neg"), F.col("value").alias("value")))
         .getField("value").alias("most_common"))
    out = _column_list(df, columns).join(per, "column", "left")
    return out.select("column", "ordinal",
                      F.coalesce(F.col("unique_values"), F.lit(0)).alias("unique_values"),
                      F.coalesce(F.col("most_common"), F.lit("N/A")).alias("most_common"))


def price_by_category_top(df: DataFrame, k: int = S.TOP_CATEGORIES, price: str = "optimal_price",
                          category: str = "articleType", digits: int | None = 6) -> DataFrame:
    """Mean price per category, top ``k`` by mean (ties by name)."""
    g = df.where(F.col(category).isNotNull()).groupBy(category).agg(
        F.avg(price).alias("mean_price"))
    return g.select(category, _r(F.col("mean_price"), digits).alias("mean_price")) \
        .orderBy(F.desc("mean_price"), category).limit(k)


def price_stats_by_category(df: DataFrame, price: str = "optimal_price",
                            category: str = "articleType", digits: int | None = 6) -> DataFrame:
    """Mean, count and sample std of the price per category."""
    g = df.where(F.col(category).isNotNull()).groupBy(category).agg(
        F.avg(price).alias("mean_price"), F.count(price).alias("n_products"),
        F.stddev_samp(price).alias("std_price"))
    return g.select(category, _r(F.col("mean_price"), digits).alias("mean_price"),
                    "n_products", _r(F.col("std_price"), digits).alias("std_price"))


def price_range(df: DataFrame, price: str = "optimal_price") -> DataFrame:
    """Min, max and range of the price."""
    return df.select(F.min(price).alias("min_price"), F.max(price).alias("max_price"),
                     (F.max(price) - F.min(price)).alias("price_span"))


def correlation_matrix(df: DataFrame, columns: Sequence[str] = S.CORRELATION_COLUMNS,
                       min_columns: int = S.CORRELATION_MIN_COLUMNS,
                       digits: int | None = 6) -> DataFrame:
    """A10: pairwise-complete Pearson matrix as (a, b, r); empty below ``min_columns``.

    Every row is expanded into one ``(pair, x, y)`` row per column pair
    (diagonal included) and grouped by pair: a narrow, code-generated partial
    aggregate with one group per pair, instead of one very wide aggregate that
    falls out of whole-stage codegen.  The result is mirrored.
    """
    cols = [c for c in columns if c in df.columns]
    spark = df.sparkSession
    if len(cols) < min_columns:
        return spark.range(0).select(F.lit("").alias("a"), F.lit("").alias("b"),
                                     F.lit(0.0).alias("r"))
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    cells = F.array(*[F.struct(F.lit(k).alias("pair"), F.col(cols[i]).cast("double").alias("x"),
                               F.col(cols[j]).cast("double").alias("y"))
                      for k, (i, j) in enumerate(pairs)])
    long = df.select(F.explode(cells).alias("c")).select("c.*")
    per = long.groupBy("pair").agg(safe_corr(F.col("y"), F.col("x")).alias("r"))
    a_names = F.array(*[F.lit(cols[i]) for i, _ in pairs])
    b_names = F.array(*[F.lit(cols[j]) for _, j in pairs])
    idx = (F.col("pair") + 1).cast("int")
    named = per.select(F.element_at(a_names, idx).alias("a"), F.element_at(b_names, idx).alias("b"),
                       _r(F.col("r"), digits).alias("r"))
    # mirror the few result rows, not the input
    a, b, r = F.col("a"), F.col("b"), F.col("r")
    both = F.when(a == b, F.array(F.struct(a, b, r))).otherwise(
        F.array(F.struct(a, b, r), F.struct(b.alias("a"), a.alias("b"), r)))
    return named.select(F.inline(both))


def demand_price_corr(df: DataFrame, x: str = "demand", y: str = "optimal_price",
                      bands=S.CORR_BANDS, otherwise: str = S.CORR_ELSE,
                      digits: int | None = 6) -> DataFrame:
    """Demand-price correlation and its band (> 0.3, > 0, else)."""
    one = df.select(_r(safe_corr(F.col(y).cast("double"), F.col(x).cast("double")),
                       digits).alias("correlation"))
    return one.select("correlation", tiers(F.col("correlation"), bands, otherwise).alias("band"))


def demand_price_trend(df: DataFrame, x: str = "demand", y: str = "optimal_price",
                       digits: int | None = 6) -> DataFrame:
    """OLS trend line of ``y`` on ``x``: slope, intercept, R2, pairs."""
    xc, yc = F.col(x).cast("double"), F.col(y).cast("double")
    return df.select(_r(F.regr_slope(yc, xc), digits).alias("slope"),
                     _r(F.regr_intercept(yc, xc), digits).alias("intercept"),
                     _r(F.regr_r2(yc, xc), digits).alias("r2"),
                     F.regr_count(yc, xc).alias("n_pairs"))


def value_histogram(df: DataFrame, column: str, nbins: int) -> DataFrame:
    """Equal-width histogram with ``nbins`` bins over [min, max]."""
    return histogram(df, column, nbins)


def group_means(df: DataFrame, key: str, columns: Sequence[str], digits: int = 2) -> DataFrame:
    """Per-group means rounded to ``digits`` places."""
    g = df.where(F.col(key).isNotNull()).groupBy(key).agg(
        *[F.avg(c).alias(f"mean_{c}") for c in columns])
    return g.select(key, *[round_to(F.col(f"mean_{c}"), digits).alias(f"mean_{c}")
                           for c in columns])


def season_summary(df: DataFrame) -> DataFrame:
    """Season means of price, demand and inventory (2 decimals)."""
    return group_means(df, "season", ["optimal_price", "demand", "inventory"])


def location_summary(df: DataFrame) -> DataFrame:
    """Location means of price and demand (2 decimals)."""
    return group_means(df, "location", ["optimal_price", "demand"])


def top_season(df: DataFrame, price: str = "optimal_price", digits: int | None = 6) -> DataFrame:
    """The season with the highest mean price (ties to the first name)."""
    g = df.where(F.col("season").isNotNull()).groupBy("season").agg(
        F.avg(price).alias("mean_price"))
    return g.orderBy(F.desc("mean_price"), "season").limit(1) \
        .select("season", _r(F.col("mean_price"), digits).alias("mean_price"))


def category_distribution(df: DataFrame, k: int = S.TOP_CATEGORIES,
                          category: str = "articleType", order: str = "id",
                          digits: int | None = 6) -> DataFrame:
    """Top ``k`` categories by count with their share of all rows.

    Ties go to the category seen first (smallest ``order`` key).  The total is
    a scalar subquery.
    """
    total = df.select(F.count(F.lit(1))).scalar()
    g = df.where(F.col(category).isNotNull()).groupBy(category).agg(
        F.count(F.lit(1)).alias("n_products"), F.min(order).alias("first_seen"))
    top = g.orderBy(F.desc("n_products"), "first_seen").limit(k)
    return top.select(category, "n_products",
                      _r(F.try_divide(F.col("n_products").cast("double"), total.cast("double"))
                         * F.lit(100.0), digits).alias("share_percent"))


def dtype_counts(df: DataFrame) -> DataFrame:
    """Numeric against text columns, with the cells each kind holds.

    The kinds come from the schema (no scan); the cell counts are one pass.
    """
    kinds: dict[str, list[str]] = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, NUMERIC_TYPES):
            kind = "numeric"
        elif isinstance(f.dataType, T.StringType):
            kind = "text"
        else:
            kind = f.dataType.simpleString()
        kinds.setdefault(kind, []).append(f.name)
    aggs = []
    for i, (kind, cols) in enumerate(kinds.items()):
        nn = sum((F.col(c).isNotNull().cast("long") for c in cols), F.lit(0).cast("long"))
        aggs.append(F.coalesce(F.sum(nn), F.lit(0)).alias(f"k{i}"))
    one = df.select(F.count(F.lit(1)).alias("__n"), *aggs)
    rows = [F.struct(F.lit(kind).alias("kind"), F.lit(len(cols)).alias("n_columns"),
                     (F.col("__n") * F.lit(len(cols))).alias("n_cells"),
                     F.col(f"k{i}").alias("n_non_null"))
            for i, (kind, cols) in enumerate(kinds.items())]
    return one.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


_FIXED_WIDTH = {"long": 8, "double": 8, "integer": 4, "float": 4, "short": 2, "byte": 1,
                "boolean": 1, "date": 4, "timestamp": 8, "timestamp_ntz": 8}


def column_bytes(df: DataFrame) -> DataFrame:
    """Bytes held per column: UTF-8 length for text, fixed width x non-null otherwise."""
    aggs = []
    for i, f in enumerate(df.schema.fields):
        if isinstance(f.dataType, T.StringType):
            aggs.append(F.coalesce(F.sum(F.octet_length(F.col(f.name))), F.lit(0))
                        .cast("long").alias(f"b{i}"))
        else:
            w = _FIXED_WIDTH.get(f.dataType.typeName(), 8)
            aggs.append((F.count(F.col(f.name)) * F.lit(w)).cast("long").alias(f"b{i}"))
    one = df.select(*aggs)
    rows = [F.struct(F.lit(f.name).alias("column"), F.lit(i).alias("ordinal"),
                     F.col(f"b{i}").alias("bytes"))
            for i, f in enumerate(df.schema.fields)]
    return one.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def threshold_counts(df: DataFrame, high_demand: float = S.HIGH_DEMAND,
                     low_inventory: float = S.LOW_INVENTORY, high_rating: float = S.HIGH_RATING,
                     digits: int | None = 6) -> DataFrame:
    """Counts and shares of high demand, low inventory and high rating, one pass."""
    n = F.count(F.lit(1))

    def share(c):
        return _r(F.try_divide(c.cast("double"), n.cast("double")) * F.lit(100.0), digits)

    hd = F.count_if(F.col("demand") > high_demand)
    li = F.count_if(F.col("inventory") < low_inventory)
    hr = F.count_if(F.col("ratings") >= high_rating)
    return df.select(n.alias("n_rows"),
                     hd.alias("high_demand"), share(hd).alias("high_demand_percent"),
                     li.alias("low_inventory"), share(li).alias("low_inventory_percent"),
                     hr.alias("high_rating"), share(hr).alias("high_rating_percent"),
                     F.count_distinct("articleType").alias("n_categories"))
