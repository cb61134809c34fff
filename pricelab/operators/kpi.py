"""Pricing KPIs (K1-K13) and model-output checks (M3-M7).

Everything here is a projection or a single aggregate over the whole catalog;
the predicted price is any column (forest score or the fitted linear stand-in).
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.prices import clip, round_to, sign_label, tiers

PRED, CUR = "predicted_price", "current_price"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def price_change(df: DataFrame, predicted: str = PRED, current: str = CUR) -> DataFrame:
    """K1: change and percent change (0 when the current price is not positive)."""
    change = _c(predicted) - _c(current)
    pct = F.when(_c(current) > 0, change / _c(current) * F.lit(100.0)).otherwise(F.lit(0.0))
    return df.withColumns({"price_change": change, "change_percent": pct})


def price_direction(df: DataFrame, change: str = "price_change",
                    labels: Sequence[str] = S.DIRECTION_LABELS) -> DataFrame:
    """K2: INCREASE / DECREASE / ADJUSTMENT by the sign of the change."""
    return df.withColumn("direction", sign_label(_c(change), *labels))


def revenue_impact_linear(df: DataFrame, change: str = "price_change",
                          demand_weight: float = 1.0) -> DataFrame:
    """Change x demand x 100 x demand weight (per-100-units form)."""
    return df.withColumn("revenue_impact",
                         _c(change) * F.col("demand") * F.lit(100.0) * F.lit(float(demand_weight)))


def revenue_impact_clamped(df: DataFrame, change: str = "price_change",
                           factor: float = S.VOLUME_FACTOR,
                           clamp=S.VOLUME_CLAMP) -> DataFrame:
    """Change x clamp(6000 x demand, 1000, 5000)."""
    volume = clip(F.col("demand") * F.lit(factor), clamp[0], clamp[1])
    return df.withColumns({"volume_estimate": volume,
                           "revenue_impact": _c(change) * volume})


def profit_margin(df: DataFrame, predicted: str = PRED, cost_rate: float = S.COST_RATE) -> DataFrame:
    """K4: (p - p x cost_rate) / p x 100; NULL for a zero price."""
    p = _c(predicted)
    return df.withColumn("profit_margin",
                         F.try_divide(p - p * F.lit(cost_rate), p) * F.lit(100.0))


def quality_margin(df: DataFrame, rating: str = "ratings") -> DataFrame:
    """q = min(1, 1.2 r / 5); cost = 0.4 - 0.15 q; clamp(100 (1 - cost), 20, 70)."""
    q = clip(_c(rating) / F.lit(5.0) * F.lit(1.2), None, 1.0)
    cost = F.lit(0.4) - q * F.lit(0.15)
    return df.withColumn("gross_margin", clip((F.lit(1.0) - cost) * F.lit(100.0), 20.0, 70.0))


def price_tier(df: DataFrame, current: str = CUR) -> DataFrame:
    """K5: PREMIUM (> 700), COMPETITIVE (> 400), OPPORTUNITY."""
    return df.withColumn("price_tier", tiers(_c(current), S.PRICE_TIERS, S.PRICE_TIER_ELSE))


def pricing_score(df: DataFrame, holiday: str | float = "holiday", weekend: str | float = "weekend",
                  missing_rating: float | None = None) -> DataFrame:
    """K6: scarcity, engagement, timing and quality mixed into one score and level.

    A missing signal makes the score missing (and the level the lowest one);
    ``missing_rating`` puts a value in the place of a missing rating.
    """
    h = F.lit(float(holiday)) if isinstance(holiday, (int, float)) else F.col(holiday).cast("double")
    w = F.lit(float(weekend)) if isinstance(weekend, (int, float)) else F.col(weekend).cast("double")
    r = F.col("ratings") if missing_rating is None else F.coalesce(F.col("ratings"),
                                                                   F.lit(float(missing_rating)))
    scarcity = F.col("demand") / clip(F.col("inventory"), S.SCARCITY_FLOOR, None)
    engagement = F.col("clicks") + F.col("search_volume")
    timing = h * F.lit(S.HOLIDAY_TIMING) + w * F.lit(S.WEEKEND_TIMING)
    quality = r / F.lit(5.0)
    sw = S.SCORE_WEIGHTS
    score = (scarcity * F.lit(sw["scarcity"]) + engagement * F.lit(sw["engagement"])
             + timing * F.lit(sw["timing"]) + quality * F.lit(sw["quality"]))
    return df.withColumns({"score": score,
                           "score_level": tiers(score, S.SCORE_LEVELS, S.SCORE_LEVEL_ELSE)})


def competitor_position(df: DataFrame, current: str = CUR,
                        competitor: str = "competitor_price_mean") -> DataFrame:
    """Competitor / current price; 1.0 when the current price is not positive."""
    return df.withColumn("competitor_position",
                         F.when(_c(current) > 0, _c(competitor) / _c(current)).otherwise(F.lit(1.0)))


def _level(value: Column, high: float, medium: float, inverted: bool) -> Column:
    if inverted:
        return (F.when(value < high, F.lit("high")).when(value < medium, F.lit("medium"))
                .otherwise(F.lit("low")))
    return (F.when(value > high, F.lit("high")).when(value > medium, F.lit("medium"))
            .otherwise(F.lit("low")))


def signal_tiers(df: DataFrame, rules=S.SIGNAL_RULES, band=S.COMPETITOR_BAND,
                 legacy: bool = False, position: str = "competitor_position") -> DataFrame:
    """K7: high / medium / low per signal; the competitor band has two levels.

    ``legacy=True`` divides the position by 500 again, as the application does.
    """
    cols = {}
    for signal, high, medium, inverted in rules:
        cols[f"{signal}_level"] = F.when(F.col(signal).isNotNull(),
                                         _level(F.col(signal), high, medium, inverted))
    ratio = F.col(position) / F.lit(S.LEGACY_COMPETITOR_DIVISOR) if legacy else F.col(position)
    cols["competitor_level"] = F.when(ratio.isNotNull(), F.when(
        (ratio > band[0]) & (ratio < band[1]), F.lit("high")).otherwise(F.lit("medium")))
    return df.withColumns(cols)


def damped_impact(value: Column, importance: Column) -> Column:
    """K8 kernel: v' = tanh(v/2) when |v| > 2 else v; (v' - 0.5) x importance x 150."""
    v = F.when(F.abs(value) > S.IMPACT_DAMPING_LIMIT, F.tanh(value / F.lit(2.0))).otherwise(value)
    return (v - F.lit(S.IMPACT_BASE)) * importance * F.lit(S.IMPACT_SCALE)


def feature_impact(long: DataFrame, value: str = "value", importance: str = "importance") -> DataFrame:
    """K8: impact and its sign for every (product, signal) row."""
    imp = damped_impact(F.col(value), F.col(importance))
    return long.withColumns({"impact": imp, "impact_type": sign_label(imp)})


def feature_impact_linear(long: DataFrame, value: str = "value",
                          importance: str = "importance") -> DataFrame:
    """(v - 0.5) x importance x 100; competitor price: (p - 500) x importance x 0.8."""
    v, imp = F.col(value), F.col(importance)
    is_comp = F.col("signal") == "competitor_price_mean"
    base = F.when(is_comp, F.lit(S.LINEAR_COMPETITOR_BASE)).otherwise(F.lit(S.IMPACT_BASE))
    scale = F.when(is_comp, F.lit(S.LINEAR_COMPETITOR_SCALE)).otherwise(F.lit(S.LINEAR_IMPACT_SCALE))
    out = long.withColumn("impact", (v - base) * imp * scale)
    return out.withColumn("impact_type", sign_label(F.col("impact")))


def impact_share(long: DataFrame, change: str = "price_change",
                 weights: Mapping[str, float] | None = None) -> DataFrame:
    """Weighted impact and its share of the absolute price change (NULL on zero change)."""
    weights = dict(weights or {})
    w = F.lit(1.0)
    if weights:
        m = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))])
        w = F.coalesce(F.element_at(m, F.col("signal")), F.lit(1.0))
    weighted = F.col("impact") * w
    return long.withColumns({
        "weighted_impact": weighted,
        "share_percent": F.try_divide(F.abs(weighted), F.abs(F.col(change))) * F.lit(100.0)})


def recommendation(df: DataFrame, change: str = "price_change", pct: str = "change_percent",
                   competitor: str = "competitor_price_mean") -> DataFrame:
    """Recommendation class, confidence (|%| < 20, < 50) and strategy."""
    inc, dec, stable = S.RECOMMENDATION_LABELS
    cls = F.when(F.col(change) > 0, F.lit(inc)).when(F.col(change) < 0, F.lit(dec)) \
        .otherwise(F.lit(stable))
    a = F.abs(F.col(pct))
    conf = None
    for thr, label in S.CONFIDENCE_LEVELS:
        conf = F.when(a < thr, F.lit(label)) if conf is None else conf.when(a < thr, F.lit(label))
    conf = conf.otherwise(F.lit(S.CONFIDENCE_ELSE))
    prem, d_thr, r_thr = S.STRATEGY_PREMIUM
    comp_label, c_thr = S.STRATEGY_COMPETITIVE
    strategy = (F.when((F.col("demand") > d_thr) & (F.col("ratings") > r_thr), F.lit(prem))
                .when(F.col(competitor) < c_thr, F.lit(comp_label))
                .otherwise(F.lit(S.STRATEGY_ELSE)))
    return df.withColumns({"recommendation": cls, "confidence": conf, "strategy": strategy})


def bounded_price(df: DataFrame, prediction: str = "prediction") -> DataFrame:
    """M4: prediction floored at 100 (optimizer) and clamped to [50, 2000] (playground)."""
    p = F.col(prediction)
    lo, hi = S.PREDICTION_CLAMP
    return df.withColumns({
        "floored_price": clip(p, S.PREDICTION_FLOOR, None),
        "clamped_price": clip(p, lo, hi)})


def regression_metrics(df: DataFrame, label: str = "optimal_price",
                       prediction: str = "prediction", digits: int | None = 6) -> DataFrame:
    """M3: MAE, MSE, RMSE, R2 and row count in one aggregate."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    e = y - p
    agg = df.select(F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"),
                    F.sum(e * e).alias("sse"), F.regr_syy(y, p).alias("sst"),
                    F.count(F.lit(1)).alias("n_rows"))
    r2 = F.lit(1.0) - F.try_divide(F.col("sse"), F.col("sst"))

    def rd(c):
        return c if digits is None else round_to(c, digits)
    return agg.select(rd(F.col("mae")).alias("mae"), rd(F.col("mse")).alias("mse"),
                      rd(F.sqrt("mse")).alias("rmse"), rd(r2).alias("r2"), "n_rows")


def model_verdict(metrics: DataFrame) -> DataFrame:
    """M7: fit verdict from R2 (> 0.7, > 0.5) and accuracy verdict from MAE (< 100)."""
    fit = tiers(F.coalesce(F.col("r2"), F.lit(0.0)), S.MODEL_FIT_LEVELS, S.MODEL_FIT_ELSE)
    hi, mod = S.MODEL_ACCURACY_LABELS
    acc = F.when(F.coalesce(F.col("mae"), F.lit(0.0)) < S.MODEL_ACCURACY_MAE, F.lit(hi)) \
        .otherwise(F.lit(mod))
    return metrics.select("r2", "mae", fit.alias("fit_verdict"), acc.alias("accuracy_verdict"))


def seeded_sample(df: DataFrame, n: int = S.SAMPLE_SIZE, seed: int = S.SAMPLE_SEED,
                  key: str = "id") -> DataFrame:
    """T5: exactly min(n, rows) rows chosen by a seeded hash of the key.

    ``orderBy(md5(key:seed)).limit(n)`` is a TakeOrdered (each task keeps n
    rows); it is partition-independent and reproducible, unlike ``sample``.
    """
    h = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))
    return df.withColumn("_h", h).orderBy("_h", key).limit(n).drop("_h")


def residuals(df: DataFrame, label: str = "optimal_price", prediction: str = "prediction",
              keep: Sequence[str] = ("id",)) -> DataFrame:
    """M5: actual, predicted and residual (actual - predicted)."""
    y = F.coalesce(F.col(label).cast("double"), F.lit(S.LABEL_FILL))
    return df.select(*keep, y.alias("actual"), F.col(prediction).alias("predicted"),
                     (y - F.col(prediction)).alias("residual"))


# Explanation sentence per signal (our own wording): the shown value as a plain number,
# as money, out of five or as yes / no, then the size of the impact.
IMPACT_TEMPLATES = {
    "demand": "Demand level %.2f moves the recommended price by %+.0f",
    "inventory": "Stock level %.2f moves the recommended price by %+.0f",
    "clicks": "Click engagement %.2f moves the recommended price by %+.0f",
    "search_volume": "Search momentum %.2f moves the recommended price by %+.0f",
    "competitor_price_mean": "Competitor price $%.0f moves the recommended price by %+.0f",
    "ratings": "Rating %.1f out of 5 moves the recommended price by %+.0f",
    "reviews_count": "Review volume %.2f moves the recommended price by %+.0f",
    "holiday": "Holiday timing (%s) moves the recommended price by %+.0f",
    "weekend": "Weekend timing (%s) moves the recommended price by %+.0f",
}
IMPACT_TEMPLATE_OTHER = "Signal level %.2f moves the recommended price by %+.0f"
SHOWN_PLACES = {"competitor_price_mean": 0, "ratings": 1}


def impact_text(long: DataFrame, templates: Mapping[str, str] = IMPACT_TEMPLATES) -> DataFrame:
    """One explanation sentence per (product, signal): the raw ``shown`` value and the
    size of the impact, rounded before they are formatted; NULL if either is missing."""
    size = F.bround(F.abs(F.col("impact")), 0)
    text = F.printf(F.lit(IMPACT_TEMPLATE_OTHER), round_to(F.col("shown"), 2), size)
    for signal, template in templates.items():
        if "%s" in template:
            shown = F.when(F.col("shown") > 0, F.lit("yes")).otherwise(F.lit("no"))
        else:
            shown = round_to(F.col("shown"), SHOWN_PLACES.get(signal, 2))
        text = F.when(F.col("signal") == signal, F.printf(F.lit(template), shown, size)).otherwise(text)
    present = F.col("shown").isNotNull() & F.col("impact").isNotNull()
    return long.withColumn("explanation", F.when(present, text))
