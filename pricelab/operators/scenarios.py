"""What-if scenarios and lookups.

The application changes one product's signals through widgets; here every
product is evaluated under every scenario at once.  Scenario and sweep grids
are generators over literal arrays (``explode``), so rows grow by the grid
size with no join and no shuffle.  The importance lookup is a join against
the model's importance table, whose size is bounded by the feature list.
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.prices import round_to
from .features import prepare_encoded

OVERRIDABLE = ["demand", "inventory", "clicks", "search_volume", "competitor_price_mean",
               "ratings", "holiday", "weekend"]

# Scenarios of our own (the application has one set of widget values at a time).
# A NULL keeps the product's own value.
DEFAULT_SCENARIOS = [
    {"scenario": "unchanged"},
    {"scenario": "demand_up", "demand": 0.9},
    {"scenario": "stock_low", "inventory": 0.1},
    {"scenario": "competitor_cut", "competitor_price_mean": 300.0},
]


def scenario_grid(df: DataFrame, scenarios: Sequence[Mapping] = DEFAULT_SCENARIOS,
                  keep: Sequence[str] = ("id",)) -> DataFrame:
    """Every product under every scenario; scenario values override product values."""
    structs = []
    for s in scenarios:
        fields = [F.lit(s["scenario"]).alias("scenario")]
        fields += [F.lit(s.get(c)).cast("double").alias(f"s_{c}") for c in OVERRIDABLE]
        structs.append(F.struct(*fields))
    present = [c for c in OVERRIDABLE if c in df.columns]
    g = df.select(*keep, *[F.col(c).cast("double").alias(c) for c in present],
                  F.explode(F.array(*structs)).alias("s"))
    return g.select(*keep, F.col("s.scenario").alias("scenario"),
                    *[F.coalesce(F.col(f"s.s_{c}"), F.col(c)).alias(c) for c in present])


def signal_values(df: DataFrame, current_price: str = "current_price") -> DataFrame:
    """Long form of the explained signals: ``(id, signal, value)``.

    The values the playground explains: demand, scarcity (1 - inventory),
    clicks, search volume, competitor position (competitor / current price,
    1.0 when the price is not positive), rating / 5, timing (holiday + weekend).
    """
    pos = F.when(F.col(current_price) > 0,
                 F.col("competitor_price_mean") / F.col(current_price)).otherwise(F.lit(1.0))
    wide = df.select(
        "id",
        F.col("demand").cast("double").alias("demand"),
        (F.lit(1.0) - F.col("inventory")).alias("inventory"),
        F.col("clicks").cast("double").alias("clicks"),
        F.col("search_volume").cast("double").alias("search_volume"),
        pos.alias("competitor_price_mean"),
        (F.col("ratings") / F.lit(5.0)).alias("ratings"),
        (F.col("holiday").cast("double") + F.col("weekend").cast("double")).alias("holiday"),
    )
    sig = ["demand", "inventory", "clicks", "search_volume", "competitor_price_mean",
           "ratings", "holiday"]
    return wide.unpivot(["id"], sig, "signal", "value")


# Signals of the explanation report: (signal, value the impact is computed from, value shown).
SHOWN_SIGNALS = ["demand", "inventory", "clicks", "search_volume", "competitor_price_mean",
                 "ratings", "reviews_count", "holiday", "weekend"]


def shown_signals(df: DataFrame, current_price: str = "current_price") -> DataFrame:
    """``(id, signal, value, shown)``: the explained signals with the raw value that the
    explanation shows (price in money, rating out of 5, inventory itself)."""
    pos = F.when(F.col(current_price) > 0,
                 F.col("competitor_price_mean") / F.col(current_price)).otherwise(F.lit(1.0))
    value = {"inventory": F.lit(1.0) - F.col("inventory"), "competitor_price_mean": pos,
             "ratings": F.col("ratings") / F.lit(5.0)}
    cells = F.array(*[F.struct(F.lit(s).alias("signal"),
                               value.get(s, F.col(s)).cast("double").alias("value"),
                               F.col(s).cast("double").alias("shown")) for s in SHOWN_SIGNALS])
    return df.select("id", F.inline(cells))


def fitted_importances(df: DataFrame, signals: Sequence[str], label: str = "optimal_price",
                       digits: int = 6) -> DataFrame:
    """T1 of the linear models: ``(signal, importance)``, each signal's share of the
    explained variances (R2 of the label on the signal alone) of all signals.

    One aggregate over the catalog; a signal that explains nothing has 0.
    """
    y = F.col(label).cast("double")
    one = df.select(*[F.coalesce(F.regr_r2(y, F.col(s).cast("double")), F.lit(0.0)).alias(s)
                      for s in signals])
    total = sum((F.col(s) for s in signals), F.lit(0.0))
    cells = F.array(*[F.struct(F.lit(s).alias("signal"),
                               round_to(F.try_divide(F.col(s), total), digits).alias("importance"))
                      for s in signals])
    return one.select(F.inline(cells))


def importance_table(spark, importances: Mapping[str, float] = S.SIGNAL_IMPORTANCE) -> DataFrame:
    """The importance lookup ``(signal, importance)`` as a tiny derived frame."""
    rows = [F.struct(F.lit(k).alias("signal"), F.lit(float(v)).alias("importance"))
            for k, v in importances.items()]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def signal_importance_join(long: DataFrame, importances: DataFrame,
                           model_features: Sequence[str] | None = None,
                           fallback: float = S.IMPORTANCE_FALLBACK) -> DataFrame:
    """Attach each signal's importance; ``fallback`` when the model lacks it.

    ``importances`` is a per-feature table; Spark broadcasts it if it is small.
    """
    imp = importances
    if model_features is not None:
        imp = imp.where(F.col("signal").isin(list(model_features)))
    j = long.join(imp, "signal", "left")
    return j.select(*[c for c in long.columns],
                    F.coalesce(F.col("importance"), F.lit(float(fallback))).alias("importance"))


def encoded_lookup(df: DataFrame, features: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Every product with the ``columns`` of its encoded row, in one projection."""
    return prepare_encoded(df, features).select("id", "productDisplayName", *columns)


def sensitivity_sweep(df: DataFrame, signal: str, lo: float, hi: float, step: float,
                      keep: Sequence[str] = ("id",)) -> DataFrame:
    """Every product at every slider position of ``signal`` in [lo, hi] by ``step``.

    Positions are integer steps (``sequence``) scaled afterwards, so there is
    no floating accumulation; rows grow by the number of positions.
    """
    n = int(round((hi - lo) / step))
    scale = int(round(1.0 / step)) if step < 1 else None
    i = F.col("step")
    if scale is not None and abs(scale * step - 1.0) < 1e-12:
        value = F.lit(float(lo)) + i.cast("double") / F.lit(float(scale))
    else:
        value = F.lit(float(lo)) + i.cast("double") * F.lit(float(step))
    g = df.select(*keep, *[c for c in df.columns if c not in keep],
                  F.explode(F.sequence(F.lit(0), F.lit(n))).alias("step"))
    return g.withColumn(signal, value).withColumn("swept_signal", F.lit(signal))


def apply_overrides(df: DataFrame, overrides: Mapping[str, float | None]) -> DataFrame:
    """Set signals to fixed values (NULL keeps the product's own value)."""
    return df.withColumns({c: F.coalesce(F.lit(v).cast("double"), F.col(c))
                           for c, v in overrides.items()})


def fit_price_line(df: DataFrame, x: str = "demand", y: str = "optimal_price",
                   digits: int = 6) -> tuple[Column, Column]:
    """OLS line of ``y`` on ``x`` fitted over the whole frame: ``(intercept, slope)``.

    A linear stand-in for the forest that an SQL engine can reproduce.  One
    scalar subquery (a single row of partial-aggregated moments); the
    coefficients are rounded to ``digits`` places like a stored model artifact.
    """
    xc, yc = F.col(x).cast("double"), F.col(y).cast("double")
    fit = df.select(F.struct(round_to(F.regr_intercept(yc, xc), digits).alias("a"),
                             round_to(F.regr_slope(yc, xc), digits).alias("b"))).scalar()
    return fit.getField("a"), fit.getField("b")


def fit_price_line_values(df: DataFrame, x: str = "demand", y: str = "optimal_price",
                          digits: int = 6) -> tuple[float | None, float | None]:
    """The fitted coefficients as two numbers (one collected row), for streams."""
    xc, yc = F.col(x).cast("double"), F.col(y).cast("double")
    r = df.select(round_to(F.regr_intercept(yc, xc), digits).alias("a"),
                  round_to(F.regr_slope(yc, xc), digits).alias("b")).first()
    return r["a"], r["b"]


def linear_price(intercept, slope, x: Column | None = None) -> Column:
    """``intercept + slope * x`` (x defaults to ``demand``); coefficients may be columns."""
    a = intercept if isinstance(intercept, Column) else F.lit(intercept).cast("double")
    b = slope if isinstance(slope, Column) else F.lit(slope).cast("double")
    return a + b * (F.col("demand") if x is None else x)
