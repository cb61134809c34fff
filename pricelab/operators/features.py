"""Feature engineering (F1-F7): one-hot, alignment, serving rows, weights, clip.

All operators are single projections over the whole catalog; the feature list
is a model artifact (an ordered list of names) given by the caller.  The only
driver-side work is list arithmetic on column names.
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.prices import clip


def split_feature(name: str, categoricals: Sequence[str] = S.CATEGORICAL_COLUMNS):
    """``"season_Summer"`` -> ``("season", "Summer")``; numeric names -> ``(None, name)``."""
    for c in categoricals:
        if name.startswith(c + "_"):
            return c, name[len(c) + 1:]
    return None, name


def indicator(column: str, value: str) -> Column:
    """1 when ``column`` equals ``value``, else 0 (a NULL category gives 0)."""
    return F.coalesce((F.col(column) == F.lit(value)).cast("int"), F.lit(0))


def one_hot_encode(df: DataFrame, features: Sequence[str],
                   categoricals: Sequence[str] = S.CATEGORICAL_COLUMNS) -> DataFrame:
    """replace the categorical columns by 0/1 indicators for the listed features.

    A category not named in ``features`` gets no column; a feature naming a
    category absent from the data is all zeros.
    """
    keep = [F.col(c) for c in df.columns if c not in categoricals]
    ind = []
    for f in features:
        col, value = split_feature(f, categoricals)
        if col is not None and col in df.columns:
            ind.append(indicator(col, value).alias(f))
    return df.select(*keep, *ind)


def align_features(df: DataFrame, features: Sequence[str],
                   keep: Sequence[str] = ("id", "productDisplayName", "optimal_price"),
                   fill: float = 0) -> DataFrame:
    """exactly ``features`` in order (absent ones are ``fill``), then ``keep``."""
    present = set(df.columns)
    cols = [F.col(f) if f in present else F.lit(fill).alias(f) for f in features]
    cols += [F.col(k) if k in present else F.lit(fill).alias(k) for k in keep]
    return df.select(*cols)


def prepare_encoded(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """F1 + F2: the encoded, aligned design matrix of the optimizer application."""
    return align_features(one_hot_encode(df, features), features)


# Signals the optimizer's serving row takes from the (weighted) product values.
SERVING_WEIGHTED = ["demand", "inventory", "clicks", "search_volume", "competitor_price_mean",
                    "discount_percentage", "freight_price"]
SERVING_FLAGS = ["holiday", "weekday", "weekend"]


def scenario_features(df: DataFrame, features: Sequence[str],
                      weights: Mapping[str, float] | None = None,
                      categoricals: Sequence[str] = S.CATEGORICAL_COLUMNS,
                      keep: Sequence[Column | str] = ("id",)) -> DataFrame:
    """the optimizer's serving row for every product, as ``keep`` + ``features``.

    Weighted signals, the product's own flags, segment forced to 0, the
    product's rating, its own category indicators; everything else 0
    (including reviews and lag price, which the serving row leaves out).
    """
    weights = dict(weights or {})
    cols = list(keep)
    for f in features:
        col, value = split_feature(f, categoricals)
        if col is not None:
            e = indicator(col, value).cast("double") if col in df.columns else F.lit(0.0)
        elif f in SERVING_WEIGHTED and f in df.columns:
            e = F.col(f).cast("double") * F.lit(float(weights.get(f, 1.0)))
        elif f in SERVING_FLAGS and f in df.columns:
            e = F.col(f).cast("int").cast("double")
        elif f == "ratings" and f in df.columns:
            e = F.col(f).cast("double")
        else:
            e = F.lit(0.0)
        cols.append(e.alias(f))
    return df.select(*cols)


def weighted_features(df: DataFrame, features: Sequence[str],
                      weights: Mapping[str, float] | None = None,
                      clip_range: tuple[float, float] = (S.CLIP_LOW, S.CLIP_HIGH),
                      on_bad: str = "zero_row",
                      default_season: str = S.DEFAULT_SEASON,
                      categoricals: Sequence[str] = S.CATEGORICAL_COLUMNS,
                      keep: Sequence[Column | str] = ("id",)) -> DataFrame:
    """the playground's weighted, clipped feature vector for every row.

    * a feature that is a column of the row: ``value * weight`` (weight 1.0
      when absent from ``weights``);
    * ``season_<S>`` for the row's own season: the weight of that feature,
      3.0 when custom weights do not name it (a missing season counts as
      Summer);
    * ``holiday``/``weekend``: flag times weight (9.0 / 6.0 when absent);
    * any other feature (other one-hot columns included): 0;
    * then each value is clipped to ``clip_range`` (NULL stays NULL).

    With ``weights=None`` every feature weighs 1.0, so the fallbacks never
    apply.  A value that is present but not numeric makes the whole row zero
    (``on_bad="zero_row"``) or that feature NULL (``on_bad="null"``).
    """
    if weights is None:
        weights = {f: 1.0 for f in features}
        season_fallback = S.SEASON_WEIGHT_FALLBACK
    else:
        weights = dict(weights)
        season_fallback = S.SEASON_WEIGHT_FALLBACK
    present = set(df.columns)
    lo, hi = clip_range
    raw: dict[str, Column] = {}
    bad_checks = []
    season = F.coalesce(F.col("season"), F.lit(default_season)) if "season" in present \
        else F.lit(default_season)
    for f in features:
        col, value = split_feature(f, categoricals)
        if f in ("holiday", "weekend"):
            fallback = S.HOLIDAY_WEIGHT_FALLBACK if f == "holiday" else S.WEEKEND_WEIGHT_FALLBACK
            w = float(weights.get(f, fallback))
            v = F.coalesce(F.col(f).cast("string").try_cast("double"), F.lit(0.0)) \
                if f in present else F.lit(0.0)
            raw[f] = v * F.lit(w)
        elif f in present:
            v = F.col(f).cast("string").try_cast("double") \
                if dict(df.dtypes)[f] == "string" else F.col(f).cast("double")
            if dict(df.dtypes)[f] == "string":
                bad_checks.append(F.col(f).isNotNull() & v.isNull())
            raw[f] = v * F.lit(float(weights.get(f, 1.0)))
        elif col == "season":
            w = float(weights.get(f, season_fallback))
            raw[f] = F.when(season == F.lit(value), F.lit(w)).otherwise(F.lit(0.0))
        else:
            raw[f] = F.lit(0.0)
    bad = None
    for b in bad_checks:
        bad = b if bad is None else (bad | b)
    cols = list(keep)
    for f in features:
        e = clip(raw[f], lo, hi)
        if bad is not None:
            e = (F.when(bad, F.lit(0.0)).otherwise(e) if on_bad == "zero_row" else e)
        cols.append(e.alias(f))
    return df.select(*cols)


def clip_features(df: DataFrame, columns: Sequence[str], lo: float = S.CLIP_LOW,
                  hi: float = S.CLIP_HIGH) -> DataFrame:
    """clip each listed column to [lo, hi]; NULL stays NULL."""
    return df.withColumns({c: clip(F.col(c).cast("double"), lo, hi) for c in columns})


def apply_weights(df: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """multiply each weighted column by its weight (literal map, no join)."""
    return df.withColumns({c: F.col(c).cast("double") * F.lit(float(w))
                           for c, w in weights.items() if c in df.columns})


def timing_scenarios(df: DataFrame, options=S.TIMING_OPTIONS,
                     keep: Sequence[str] = ("id",)) -> DataFrame:
    """every product under each timing context ``(label, holiday, weekend)``.

    A generator over a literal array of structs: rows grow by the number of
    options, no join.
    """
    opts = F.array(*[F.struct(F.lit(l).alias("timing"), F.lit(float(h)).alias("holiday"),
                              F.lit(float(w)).alias("weekend")) for l, h, w in options])
    return df.select(*keep, F.explode(opts).alias("t")).select(*keep, "t.*")
