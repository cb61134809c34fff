"""What-if pricing frames: the catalog with current and predicted prices.

Two editions, as in the reproduced applications:

* optimizer: strict flags, current price = the label as is, prediction
  floored at 100;
* playground: lenient flags, timing context applied to every product
  (default Normal Day), reviews default 0.5, current price floored at 50,
  prediction clamped to [50, 2000].

The predicted price comes from ``predictor`` (a Column over the frame); the
default is a linear model fitted in Spark on the same catalog (OLS of price on
demand) so the KPIs can be checked in SQL.  The forest flows below score the
serving vectors with the trained model instead.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..operators import kpi as K
from ..operators.cleaning import current_price, with_reviews_default
from ..operators.features import scenario_features, weighted_features
from ..operators.model import categorical_inputs, numeric_inputs, predict_features
from ..operators.scenarios import fit_price_line, linear_price


def optimizer_frame(clean: DataFrame, predictor: Column | None = None) -> DataFrame:
    if predictor is None:
        predictor = linear_price(*fit_price_line(clean))
    df = current_price(clean, floor=None)
    df = df.withColumn("prediction", predictor)
    df = K.bounded_price(df)
    return df.withColumn("predicted_price", F.col("floored_price"))


def playground_frame(clean: DataFrame, predictor: Column | None = None,
                     timing: tuple[str, float, float] = S.TIMING_OPTIONS[0]) -> DataFrame:
    _, holiday, weekend = timing
    if predictor is None:
        predictor = linear_price(*fit_price_line(clean))
    df = clean.withColumns({"holiday": F.lit(float(holiday)), "weekend": F.lit(float(weekend))})
    df = with_reviews_default(df)
    df = current_price(df)
    df = df.withColumn("prediction", predictor)
    df = K.bounded_price(df)
    return df.withColumn("predicted_price", F.col("clamped_price"))


def _row(df: DataFrame) -> Column:
    """All columns of ``df`` as one struct that travels beside the feature columns."""
    return F.struct(*[F.col(c) for c in df.columns]).alias("product_row")


def _with_prediction(model: PipelineModel, vectors: DataFrame) -> DataFrame:
    scored = predict_features(model, vectors, keep=("product_row",))
    return scored.select("product_row.*", "prediction")


def _season_on(weights: dict | None) -> Column:
    """The season whose indicator the weighted vector (F4) sets: the product's own, Summer if
    missing.  The forest was trained on 0 / 1 indicators, so it splits them at one half: a
    weight above that counts as set, a lower one as not set."""
    season = F.coalesce(F.col("season"), F.lit(S.DEFAULT_SEASON))
    low = [f[len("season_"):] for f, w in (weights or {}).items() if f.startswith("season_") and w <= 0.5]
    return F.when(~season.isin(low), season) if low else season


def forest_optimizer_pricing(model: PipelineModel, clean: DataFrame,
                             weights: dict | None = None) -> DataFrame:
    """Optimizer flow for every product: serving row (F3) -> forest -> floor 100 -> KPIs."""
    serving = scenario_features(clean, numeric_inputs(model), weights,
                                keep=(_row(clean), *categorical_inputs(model)))
    df = optimizer_frame(_with_prediction(model, serving), predictor=F.col("prediction"))
    df = K.profit_margin(K.revenue_impact_linear(K.price_change(df)))
    return K.recommendation(df)


def forest_playground_pricing(model: PipelineModel, clean_lenient: DataFrame,
                              weights: dict | None = None,
                              timing: tuple[str, float, float] = S.TIMING_OPTIONS[0]) -> DataFrame:
    """Playground flow: timing applied, weighted clipped vector (F4) -> forest ->
    clamp [50, 2000] -> KPIs, for every product."""
    base = playground_frame(clean_lenient, predictor=F.lit(0.0), timing=timing).drop(
        "prediction", "floored_price", "clamped_price", "predicted_price")
    cats = [_season_on(weights).alias(c) if c == "season" else F.lit(None).cast("string").alias(c)
            for c in categorical_inputs(model)]
    vectors = weighted_features(base, numeric_inputs(model), weights, keep=(_row(clean_lenient), *cats))
    df = playground_frame(_with_prediction(model, vectors), predictor=F.col("prediction"),
                          timing=timing)
    df = K.price_tier(K.price_direction(K.price_change(df)))
    return K.pricing_score(K.revenue_impact_clamped(df))
