"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator.

Each query reads the driver's tables (through the derived catalog) and runs
the library operator over the whole catalog.  Keys match ``pricelab.oracle``.
"""

from __future__ import annotations

from functools import reduce
from typing import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from .. import streaming
from ..functions.distinct import add_files, distinct_counts, error_bound
from ..functions.prices import round6, round_to
from ..functions.stats import histogram
from ..operators import cleaning as C
from ..operators import features as Fe
from ..operators import kpi as K
from ..operators import profile as A
from ..operators import scenarios as J
from ..operators import search as P
from ..operators.model import (categorical_inputs, design_matrix, feature_importance, model_summary, numeric_inputs,
                               predict_features, score_catalog, top_drivers, train_linear_model, train_price_model)
from ..operators.model_tables import (importance_from_tables, interval_sweep, load_forest, read_forest, save_forest,
                                      score_from_tables)
from ..operators.name_index import build_index, search_by_index
from ..session import materialize, scratch_path
from ..sources.catalog import (load_catalog_csv, read_catalog_csv, read_catalog_parquet, read_report_parts,
                               write_catalog_csv, write_report, write_report_parts)
from ..streaming.pricing import catalog_stream, pricing_kpi_stream, run_available
from .catalog import catalog_key, cleaned_catalog, competitor_median, raw_catalog, raw_catalog_path
from .params import (ENCODED_LOOKUP_COLUMNS, FEATURES_FIXED, INDEX_TERMS, LINEAR_SIGNALS, NA_CELLS, NO_MATCH_TERM,
                     SEARCH_LITERAL, SEARCH_REGEX, SEARCH_TERM, SIGNAL_WEIGHTS, WEIGHTED_SIGNALS)
from .whatif import (forest_optimizer_pricing, forest_playground_pricing, optimizer_frame,
                     playground_frame)

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        REGISTRY[name] = fn
        return fn
    return deco


# ---------------------------------------------------------------- sources
@register("catalog_scan")
def q_catalog_scan(spark, sf):
    """Write the catalog as CSV to the shared folder, scan it back with the schema."""
    path = scratch_path(spark, "catalog-csv")
    write_catalog_csv(raw_catalog(spark, sf), path)
    return read_catalog_csv(spark, path)


@register("catalog_scan_parquet")
def q_catalog_scan_parquet(spark, sf):
    """S1 (parquet): write the catalog as parquet to the shared folder, scan it with the schema."""
    path = scratch_path(spark, "catalog-parquet")
    raw_catalog(spark, sf).write.mode("overwrite").parquet(path)
    return read_catalog_parquet(spark, path)


# ---------------------------------------------------------------- cleaning
@register("clean_names")
def q_clean_names(spark, sf):
    return C.clean_names(raw_catalog(spark, sf)).select("id", "productDisplayName")


@register("competitor_mean")
def q_competitor_mean(spark, sf):
    return C.competitor_mean(raw_catalog(spark, sf)).select(
        "id", "competitor_prices", "competitor_price_mean")


@register("competitor_mean_imputed")
def q_competitor_mean_imputed(spark, sf):
    df = C.impute_competitor_mean(C.competitor_mean(raw_catalog(spark, sf)))
    return df.select("id", round6("competitor_price_mean").alias("competitor_price_mean"))


@register("clean_flags_clipped")
def q_flags_strict(spark, sf):
    return C.clean_flags_strict(raw_catalog(spark, sf)).select("id", *S.FLAG_COLUMNS)


@register("clean_flags_lenient")
def q_flags_lenient(spark, sf):
    return C.clean_flags_lenient(raw_catalog(spark, sf)).select("id", *S.FLAG_COLUMNS)


@register("clean_price")
def q_clean_price(spark, sf):
    return C.clean_price(raw_catalog(spark, sf)).select("id", "optimal_price")


@register("current_price")
def q_current_price(spark, sf):
    return C.current_price(C.clean_price(raw_catalog(spark, sf))).select("id", "current_price")


MATRIX_FEATURES = ["demand", "inventory", "clicks", "search_volume", "reviews_count",
                   "ratings", "discount_percentage", "freight_price",
                   "competitor_price_mean", "holiday", "weekday", "weekend"]


@register("model_matrix_fill")
def q_matrix_fill(spark, sf):
    df = C.competitor_mean(raw_catalog(spark, sf))
    df = C.clean_flags_lenient(df)
    return C.model_matrix_fill(df, MATRIX_FEATURES)


@register("domain_violations")
def q_domain_violations(spark, sf):
    return C.domain_violations(cleaned_catalog(spark, sf), S.DOMAINS_OPTIMIZER)


@register("domain_violations_playground")
def q_domain_violations_playground(spark, sf):
    return C.domain_violations(cleaned_catalog(spark, sf), S.DOMAINS_PLAYGROUND)


@register("reviews_default_absent")
def q_reviews_default(spark, sf):
    """C9 on a catalog without the column."""
    df = cleaned_catalog(spark, sf).drop("reviews_count")
    return C.with_reviews_default(df).select("id", "reviews_count")


@register("catalog_scan_na")
def q_catalog_scan_na(spark, sf):
    """A CSV whose cells carry missing-value markers; they are missing after the scan."""
    raw = raw_catalog(spark, sf)
    marked = raw.select(*[F.col(c).cast("string").alias(c) for c in raw.columns]).withColumns({
        c: F.coalesce(F.col(c), F.lit(m)) for c, m in NA_CELLS.items()})
    marked = marked.withColumn("season", F.when(F.col("id") % 31 == 5, F.lit("nan")).otherwise(F.col("season")))
    path = scratch_path(spark, "catalog-csv-na")
    write_catalog_csv(marked, path)
    return read_catalog_csv(spark, path)


# ---------------------------------------------------------------- profile
def _profile(fn):
    """Profile reports see the label as loaded: unparsable is missing, not filled."""
    return lambda spark, sf: fn(cleaned_catalog(spark, sf, label="null"))


for _name, _fn in {
    "dataset_shape": A.dataset_shape,
    "dataset_overview": A.dataset_overview,
    "missing_by_column": A.missing_by_column,
    "missing_overall": A.missing_overall,
    "missing_top20_in_order": A.missing_in_column_order,
    "missing_top10": A.missing_top,
    "quality_verdict": A.quality_verdict,
    "numeric_summary": A.numeric_summary,
    "categorical_summary": A.categorical_summary,
    "price_by_category_top10": A.price_by_category_top,
    "price_stats_by_category": A.price_stats_by_category,
    "price_range": A.price_range,
    "correlation_matrix": A.correlation_matrix,
    "demand_price_corr": A.demand_price_corr,
    "demand_price_trend": A.demand_price_trend,
    "season_summary": A.season_summary,
    "location_summary": A.location_summary,
    "top_season": A.top_season,
    "category_distribution": A.category_distribution,
    "dtype_counts": A.dtype_counts,
    "column_bytes": A.column_bytes,
    "threshold_counts": A.threshold_counts,
}.items():
    REGISTRY[_name] = _profile(_fn)


@register("price_histogram")
def q_price_hist(spark, sf):
    return A.value_histogram(cleaned_catalog(spark, sf, label="null"), "optimal_price", S.PRICE_BINS)


@register("demand_histogram")
def q_demand_hist(spark, sf):
    return A.value_histogram(cleaned_catalog(spark, sf), "demand", S.SIGNAL_BINS)


@register("inventory_histogram")
def q_inventory_hist(spark, sf):
    return A.value_histogram(cleaned_catalog(spark, sf), "inventory", S.SIGNAL_BINS)


# ---------------------------------------------------------------- search (P)


@register("search_products")
def q_search(spark, sf):
    return P.search_products(cleaned_catalog(spark, sf), SEARCH_TERM).select(
        "id", "productDisplayName")


@register("search_products_regex")
def q_search_regex(spark, sf):
    return P.search_products(cleaned_catalog(spark, sf), SEARCH_REGEX).select(
        "id", "productDisplayName")


@register("search_products_literal")
def q_search_literal(spark, sf):
    """P1 with a literal term: its signs are no pattern."""
    df = cleaned_catalog(spark, sf)
    df = df.withColumn("productDisplayName", F.concat("productDisplayName", F.lit(" (v1.5)")))
    return P.search_products(df, SEARCH_LITERAL, literal=True).select("id", "productDisplayName")


@register("search_by_trigrams")
def q_search_by_trigrams(spark, sf):
    """P1 over trigram posting lists: every test term, also one that has no trigram."""
    df = cleaned_catalog(spark, sf)
    index = build_index(df, scratch_path(spark, "name-index"))
    terms = [(SEARCH_TERM, False), (SEARCH_REGEX, False), (SEARCH_LITERAL, True), (NO_MATCH_TERM, False), *((t, False) for t in INDEX_TERMS)]
    parts = [search_by_index(df, index, t, lit).select(F.lit(t).alias("term"), "id", "productDisplayName") for t, lit in terms]
    return reduce(DataFrame.unionByName, parts)


@register("distinct_names_first_n")
def q_first_names(spark, sf):
    return P.first_names(cleaned_catalog(spark, sf), S.NAME_LIST_SIZE)


@register("search_with_fallback")
def q_search_fallback(spark, sf):
    return P.search_with_fallback(cleaned_catalog(spark, sf), SEARCH_TERM, S.NAME_LIST_SIZE)


@register("search_fallback_first")
def q_search_fallback_first(spark, sf):
    return P.search_with_fallback(cleaned_catalog(spark, sf), NO_MATCH_TERM, S.NAME_LIST_SIZE)


@register("search_fallback_popular")
def q_search_fallback_popular(spark, sf):
    return P.search_with_fallback(cleaned_catalog(spark, sf), NO_MATCH_TERM,
                                  S.POPULAR_LIST_SIZE, fallback="popular")


@register("popular_products")
def q_popular(spark, sf):
    return P.popular_products(cleaned_catalog(spark, sf), S.POPULAR_LIST_SIZE)


@register("first_row_per_name")
def q_first_row(spark, sf):
    return P.first_row_per_name(cleaned_catalog(spark, sf))


@register("product_card")
def q_card(spark, sf):
    return P.product_card(cleaned_catalog(spark, sf))


@register("opportunity_products")
def q_opportunity(spark, sf):
    return P.opportunity_products(cleaned_catalog(spark, sf))


@register("discount_candidates")
def q_discount(spark, sf):
    return P.discount_candidates(cleaned_catalog(spark, sf))


@register("premium_candidates")
def q_premium(spark, sf):
    return P.premium_candidates(cleaned_catalog(spark, sf))


# ---------------------------------------------------------------- features (F)
INDICATORS_FIXED = [f for f in FEATURES_FIXED if Fe.split_feature(f)[0] is not None]


@register("one_hot_encode")
def q_one_hot(spark, sf):
    return Fe.one_hot_encode(cleaned_catalog(spark, sf), FEATURES_FIXED).select(
        "id", *INDICATORS_FIXED)


@register("align_features")
def q_align(spark, sf):
    return Fe.prepare_encoded(cleaned_catalog(spark, sf), FEATURES_FIXED)


@register("scenario_features")
def q_scenario_features(spark, sf):
    return Fe.scenario_features(cleaned_catalog(spark, sf), FEATURES_FIXED)


def _playground(spark, sf):
    return playground_frame(cleaned_catalog(spark, sf, flags="lenient"))


def _optimizer(spark, sf):
    return optimizer_frame(cleaned_catalog(spark, sf))


@register("weighted_features")
def q_weighted(spark, sf):
    return Fe.weighted_features(_playground(spark, sf), FEATURES_FIXED)


@register("weighted_features_calibrated")
def q_weighted_cal(spark, sf):
    return Fe.weighted_features(_playground(spark, sf), FEATURES_FIXED, S.CALIBRATED_WEIGHTS)


@register("weighted_features_bad_value")
def q_weighted_bad(spark, sf):
    """a row with a feature that is no number is all zero."""
    df = _playground(spark, sf)
    text = F.when(F.col("id") % 7 == 0, F.lit("bad")).otherwise(F.col("ratings").cast("string"))
    return Fe.weighted_features(df.withColumn("ratings", text), FEATURES_FIXED, S.CALIBRATED_WEIGHTS)


@register("scenario_features_weighted")
def q_scenario_features_weighted(spark, sf):
    """F3 with per-signal weights."""
    return Fe.scenario_features(cleaned_catalog(spark, sf), FEATURES_FIXED, SIGNAL_WEIGHTS)


@register("apply_weights")
def q_apply_weights(spark, sf):
    df = Fe.apply_weights(_playground(spark, sf), S.CALIBRATED_WEIGHTS)
    return df.select("id", *[round6(c).alias(c) for c in WEIGHTED_SIGNALS])


@register("clip_features")
def q_clip(spark, sf):
    df = Fe.apply_weights(_playground(spark, sf), S.CALIBRATED_WEIGHTS)
    return Fe.clip_features(df, WEIGHTED_SIGNALS).select(
        "id", *[round6(c).alias(c) for c in WEIGHTED_SIGNALS])


@register("timing_scenarios")
def q_timing(spark, sf):
    df = _playground(spark, sf).drop("holiday", "weekend")
    grid = Fe.timing_scenarios(df, keep=("id", "demand", "inventory", "clicks",
                                         "search_volume", "ratings"))
    scored = K.pricing_score(grid)
    return scored.select("id", "timing", "holiday", "weekend",
                         round6("score").alias("score"), "score_level")


# ---------------------------------------------------------------- scenarios (J)
@register("scenario_grid")
def q_scenario_grid(spark, sf):
    pg = _playground(spark, sf)
    a, b = J.fit_price_line(pg)
    g = J.scenario_grid(pg)
    return g.select("*", round6(J.linear_price(a, b)).alias("prediction"))


@register("sensitivity_sweep")
def q_sweep(spark, sf):
    clean = cleaned_catalog(spark, sf)
    a, b = J.fit_price_line(clean)
    g = J.sensitivity_sweep(clean.select("id", "demand", "inventory"), "demand", 0.0, 1.0, 0.01)
    return g.select("id", "step", "demand", round6(J.linear_price(a, b)).alias("prediction"))


def _importances(spark):
    imp = J.importance_table(spark)
    return imp


@register("signal_importance_join")
def q_importance_join(spark, sf):
    long = J.signal_values(_playground(spark, sf))
    j = J.signal_importance_join(long, _importances(spark), model_features=FEATURES_FIXED)
    return j.select("id", "signal", round6("value").alias("value"), "importance")


@register("encoded_lookup")
def q_encoded_lookup(spark, sf):
    return J.encoded_lookup(cleaned_catalog(spark, sf), FEATURES_FIXED, ENCODED_LOOKUP_COLUMNS)


# ---------------------------------------------------------------- KPIs (K, M)
def _r6(*cols):
    return [round6(c).alias(c) for c in cols]


@register("price_change")
def q_price_change(spark, sf):
    df = K.price_change(_playground(spark, sf))
    return df.select("id", "current_price", *_r6("predicted_price", "price_change",
                                                  "change_percent"))


@register("price_direction")
def q_direction(spark, sf):
    return K.price_direction(K.price_change(_playground(spark, sf))).select("id", "direction")


@register("revenue_impact_linear")
def q_rev_linear(spark, sf):
    df = K.revenue_impact_linear(K.price_change(_optimizer(spark, sf)))
    return df.select("id", *_r6("revenue_impact"))


@register("revenue_impact_weighted")
def q_rev_weighted(spark, sf):
    """K3a with a demand weight."""
    df = K.revenue_impact_linear(K.price_change(_optimizer(spark, sf)),
                                 demand_weight=SIGNAL_WEIGHTS["demand"])
    return df.select("id", *_r6("revenue_impact"))


@register("revenue_impact_clamped")
def q_rev_clamped(spark, sf):
    df = K.revenue_impact_clamped(K.price_change(_playground(spark, sf)))
    return df.select("id", *_r6("volume_estimate", "revenue_impact"))


@register("profit_margin")
def q_margin(spark, sf):
    return K.profit_margin(_optimizer(spark, sf)).select("id", *_r6("profit_margin"))


@register("quality_margin")
def q_quality_margin(spark, sf):
    return K.quality_margin(_playground(spark, sf)).select("id", *_r6("gross_margin"))


@register("price_tier")
def q_tier(spark, sf):
    return K.price_tier(_playground(spark, sf)).select("id", "current_price", "price_tier")


@register("pricing_score")
def q_score(spark, sf):
    df = K.pricing_score(_playground(spark, sf))
    return df.select("id", *_r6("score"), "score_level")


@register("competitor_position")
def q_position(spark, sf):
    return K.competitor_position(_playground(spark, sf)).select("id", *_r6("competitor_position"))


@register("signal_tiers")
def q_signal_tiers(spark, sf):
    df = K.signal_tiers(K.competitor_position(_playground(spark, sf)))
    return df.select("id", "demand_level", "inventory_level", "clicks_level",
                     "search_volume_level", "ratings_level", "competitor_level")


@register("signal_tiers_legacy")
def q_signal_tiers_legacy(spark, sf):
    df = K.signal_tiers(K.competitor_position(_playground(spark, sf)), legacy=True)
    return df.select("id", "competitor_level")


def _impacts(spark, sf):
    long = J.signal_values(_playground(spark, sf))
    j = J.signal_importance_join(long, _importances(spark), model_features=FEATURES_FIXED)
    return K.feature_impact(j)


@register("feature_impact")
def q_feature_impact(spark, sf):
    df = _impacts(spark, sf)
    return df.select("id", "signal", *_r6("value", "impact"), "importance", "impact_type")


@register("impact_report")
def q_impact_report(spark, sf):
    """Explanation text per product and signal (wording of our own)."""
    long = J.shown_signals(_playground(spark, sf))
    j = J.signal_importance_join(long, _importances(spark), model_features=FEATURES_FIXED)
    return K.impact_text(K.feature_impact(j)).select("id", "signal", "explanation")


def _linear_impacts(spark, sf):
    df = K.price_change(_optimizer(spark, sf))
    long = df.select("id", "price_change",
                     *[F.col(c).cast("double").alias(c) for c in LINEAR_SIGNALS]) \
        .unpivot(["id", "price_change"], LINEAR_SIGNALS, "signal", "value")
    j = J.signal_importance_join(long, _importances(spark))
    return K.feature_impact_linear(j)


@register("feature_impact_linear")
def q_impact_linear(spark, sf):
    df = _linear_impacts(spark, sf)
    return df.select("id", "signal", "value", "importance", *_r6("impact"), "impact_type")


@register("impact_share")
def q_impact_share(spark, sf):
    df = K.impact_share(_linear_impacts(spark, sf))
    return df.select("id", "signal", *_r6("weighted_impact", "share_percent"))


def _fitted(spark, sf):
    return J.fitted_importances(cleaned_catalog(spark, sf), LINEAR_SIGNALS)


@register("fitted_importance")
def q_fitted_importance(spark, sf):
    """T1 of the linear models fitted on the catalog."""
    return _fitted(spark, sf).withColumnRenamed("signal", "feature")


@register("fitted_top_drivers")
def q_fitted_drivers(spark, sf):
    """T2 of the linear models fitted on the catalog."""
    return top_drivers(_fitted(spark, sf).withColumnRenamed("signal", "feature"), k=5)


@register("impact_share_fitted")
def q_impact_share_fitted(spark, sf):
    """J1, K8b and K13 with importances taken from the fitted models and per-signal weights."""
    df = K.price_change(_optimizer(spark, sf))
    long = df.select("id", "price_change",
                     *[F.col(c).cast("double").alias(c) for c in LINEAR_SIGNALS]) \
        .unpivot(["id", "price_change"], LINEAR_SIGNALS, "signal", "value")
    j = K.feature_impact_linear(J.signal_importance_join(long, _fitted(spark, sf)))
    share = K.impact_share(j, weights=SIGNAL_WEIGHTS)
    return share.select("id", "signal", "importance", *_r6("weighted_impact", "share_percent"))


@register("recommendation")
def q_recommendation(spark, sf):
    df = K.recommendation(K.price_change(_optimizer(spark, sf)))
    return df.select("id", "recommendation", "confidence", "strategy")


@register("bounded_price")
def q_bounded(spark, sf):
    clean = cleaned_catalog(spark, sf)
    df = K.bounded_price(clean.withColumn("prediction", J.linear_price(*J.fit_price_line(clean))))
    return df.select("id", *_r6("prediction", "floored_price", "clamped_price"))


def _metrics(spark, sf):
    clean = cleaned_catalog(spark, sf)
    df = clean.withColumn("prediction", J.linear_price(*J.fit_price_line(clean)))
    return K.regression_metrics(df)


@register("regression_metrics")
def q_metrics(spark, sf):
    return _metrics(spark, sf)


@register("model_verdict")
def q_verdict(spark, sf):
    return K.model_verdict(_metrics(spark, sf))


@register("seeded_sample")
def q_sample(spark, sf):
    return K.seeded_sample(cleaned_catalog(spark, sf)).select(
        "id", "productDisplayName", "optimal_price")


def _residuals(spark, sf):
    clean = cleaned_catalog(spark, sf)
    a, b = J.fit_price_line(clean)
    return K.residuals(clean.withColumn("prediction", J.linear_price(a, b)))


@register("residuals")
def q_residuals(spark, sf):
    return _residuals(spark, sf).select("id", "actual", *_r6("predicted", "residual"))


@register("residual_histogram")
def q_residual_hist(spark, sf):
    return histogram(_residuals(spark, sf), "residual", S.RESIDUAL_BINS)


@register("prediction_trend")
def q_prediction_trend(spark, sf):
    """A13 (live form): OLS line of predicted on actual over all products."""
    return A.demand_price_trend(_residuals(spark, sf), x="actual", y="predicted")


# ---------------------------------------------------------------- linear pipeline
def _linear(spark, sf):
    """One-signal linear pipeline, trained, saved and loaded."""
    clean = cleaned_catalog(spark, sf)
    path = scratch_path(spark, "linear-model")
    train_linear_model(clean, ["demand"]).save(path)
    return clean, PipelineModel.load(path)


@register("linear_model_score")
def q_linear_score(spark, sf):
    """M1, S2, M2 end to end with an estimator that SQL can reproduce."""
    clean, model = _linear(spark, sf)
    return score_catalog(model, clean).select("id", "optimal_price", round_to("prediction", 3).alias("prediction"))


@register("linear_model_metrics")
def q_linear_metrics(spark, sf):
    """M3 of the saved and loaded linear pipeline."""
    clean, model = _linear(spark, sf)
    metrics = K.regression_metrics(score_catalog(model, clean))
    return model_summary(model, metrics.select("n_rows", *[round_to(c, 4).alias(c) for c in ("mae", "rmse", "r2")]))


# ---------------------------------------------------------------- forest
_MODELS: dict[tuple, str] = {}


def _forest(spark, sf, flags: str = "strict"):
    """The catalog and the forest trained on it: trained once per application and input,
    saved to the shared folder, loaded by every query."""
    clean = cleaned_catalog(spark, sf, flags=flags)
    key = catalog_key(spark, sf, f"forest-{flags}")
    if key not in _MODELS:
        path = scratch_path(spark, "price-model")
        train_price_model(clean).save(path)
        _MODELS[key] = path
    return clean, PipelineModel.load(_MODELS[key])


@register("forest_invariants")
def q_forest_invariants(spark, sf):
    """M1, M2, S2, T1 of the forest, as facts with a fixed answer: every product is scored
    once, no prediction leaves the label's range, the importances sum to 1, and the model
    predicts the same after it was saved and loaded again."""
    clean, model = _forest(spark, sf)
    path = scratch_path(spark, "price-model-copy")
    model.save(path)
    again = score_catalog(PipelineModel.load(path), clean).select("id", F.col("prediction").alias("again"))
    scored = materialize(score_catalog(model, clean).join(again, "id"), "forest-scores")
    label = scored.select(F.struct(F.min("optimal_price").alias("lo"), F.max("optimal_price").alias("hi"))).scalar()
    p, near = F.col("prediction"), F.lit(1e-9)
    outside = (p < label.getField("lo") - near) | (p > label.getField("hi") + near)
    total = feature_importance(model).select(F.sum("importance")).scalar()
    return scored.select(
        F.count(F.lit(1)).alias("n_scored"), F.count_distinct("id").alias("n_products"),
        F.count_if(outside | p.isNull()).alias("n_outside"),
        F.count_if(p != F.col("again")).alias("n_changed"),
        F.max(round6(total)).alias("importance_sum"))


@register("score_catalog")
def q_score_catalog(spark, sf):
    clean, model = _forest(spark, sf)
    return score_catalog(model, clean)


@register("model_metrics")
def q_model_metrics(spark, sf):
    clean, model = _forest(spark, sf)
    return model_summary(model, K.regression_metrics(score_catalog(model, clean)))


@register("feature_importance")
def q_feature_importance(spark, sf):
    _, model = _forest(spark, sf)
    return feature_importance(model)


@register("top_drivers")
def q_top_drivers(spark, sf):
    _, model = _forest(spark, sf)
    return top_drivers(feature_importance(model))


# ---------------------------------------------------------------- sinks, model i/o, streaming


@register("report_sink")
def q_report_sink(spark, sf):
    """S3: a report written to the shared folder as parquet and read back."""
    path = scratch_path(spark, "report-price-stats")
    write_report(A.price_stats_by_category(cleaned_catalog(spark, sf, label="null")), path)
    return spark.read.parquet(path)


@register("model_roundtrip")
def q_model_roundtrip(spark, sf):
    """Save the trained pipeline (feature list inside), load it, score the catalog."""
    clean, model = _forest(spark, sf)
    path = scratch_path(spark, "price-model-copy")
    model.save(path)
    return score_catalog(PipelineModel.load(path), clean)


@register("forest_tables")
def q_forest_tables(spark, sf):
    """S2, M2, T1 with the forest as tables, held against the model object: products scored, products and
    features whose number differs, trees, and nodes that no walk can reach."""
    clean, model = _forest(spark, sf)
    path = _MODELS[catalog_key(spark, sf, "forest-strict")]
    tables = load_forest(spark, save_forest(read_forest(spark, path), scratch_path(spark, "forest-tables")))
    theirs = score_catalog(model, clean).select("id", F.col("prediction").alias("p"))
    scored = score_from_tables(tables, clean).join(theirs, "id", "full")
    ours = importance_from_tables(tables).join(feature_importance(model).withColumnRenamed("importance", "i"), "feature", "full")
    n_features = ours.select(F.count_if(F.coalesce(F.abs(F.col("importance") - F.col("i")) > 1e-9, F.lit(True)))).scalar()
    children = tables.nodes.where("left >= 0").select("tree", F.explode(F.array("left", "right")).alias("node"))
    lost = tables.nodes.where("node > 0").join(children, ["tree", "node"], "left_anti").select(F.count("*")).scalar()
    n_trees = tables.nodes.select(F.count_distinct("tree")).scalar()
    return scored.select(F.count("prediction").alias("n_products"),
                         F.count_if(~F.col("prediction").eqNullSafe(F.col("p"))).alias("n_products_differ"),
                         F.max(n_features).alias("n_features_differ"), F.max(n_trees).alias("n_trees"),
                         F.max(lost).alias("n_nodes_lost"))


@register("forest_interval_sweep")
def q_forest_interval_sweep(spark, sf):
    """J4 of the forest by intervals between split points, held against the model object swept position by position."""
    clean, model = _forest(spark, sf)
    tables = read_forest(spark, _MODELS[catalog_key(spark, sf, "forest-strict")])
    ours = interval_sweep(tables, clean, "demand", 0.0, 1.0, 0.01).select("id", "step", F.col("prediction").alias("p"))
    swept = J.sensitivity_sweep(design_matrix(clean, numeric_inputs(model), categorical_inputs(model)), "demand", 0.0, 1.0, 0.01)
    theirs = predict_features(model, swept, keep=("id", "step"))
    both = theirs.join(ours, ["id", "step"], "full")
    return both.select(F.count("p").alias("n_rows"), F.count_distinct("id").alias("n_products"),
                       F.count_if(~F.col("p").eqNullSafe(F.col("prediction"))).alias("n_differ"))


@register("forest_pricing")
def q_forest_pricing(spark, sf):
    """Playground flow with the trained forest: weighted vector (F4, calibrated
    weights) scored by the model, clamped, then the pricing KPIs."""
    clean, model = _forest(spark, sf, flags="lenient")
    df = forest_playground_pricing(model, clean, S.CALIBRATED_WEIGHTS)
    return df.select("id", "current_price", "predicted_price", "price_change", "change_percent",
                     "direction", "price_tier", "revenue_impact", "score", "score_level")


@register("forest_optimizer_pricing")
def q_forest_optimizer_pricing(spark, sf):
    """Optimizer flow with the trained forest: serving rows (F3) scored by the
    model, floored at 100, then change, revenue impact, margin, recommendation."""
    clean, model = _forest(spark, sf)
    df = forest_optimizer_pricing(model, clean)
    return df.select("id", "current_price", "predicted_price", "price_change", "change_percent",
                     "revenue_impact", "profit_margin", "recommendation", "confidence", "strategy")


def _broken_lines(raw):
    """Three broken CSV rows made of the catalog's first products: cut short, too long, a signal that is no number."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("id", "articleType", "season")]
    n = len(S.CATALOG_SCHEMA.fields)
    lines = F.array(F.concat_ws(",", *cells), F.concat(F.concat_ws(",", *cells), F.lit("," * n)),
                    F.concat_ws(",", cells[0], *[F.lit("many" if f.name == "demand" else "") for f in S.CATALOG_SCHEMA.fields[1:]]))
    first = raw.orderBy("id").limit(1).select(F.posexplode(lines).alias("k", "value"))
    header = raw.sparkSession.range(1).select(F.lit(-1).alias("k"), F.lit(",".join(S.CATALOG_SCHEMA.names)).alias("value"))
    return header.unionByName(first).coalesce(1).sortWithinPartitions("k").select("value")


@register("catalog_quarantine")
def q_catalog_quarantine(spark, sf):
    """S1, tolerant: the catalog's CSV files and one with three broken rows; the good rows are all
    there, and the broken ones are in the quarantine table with their problems."""
    raw = raw_catalog(spark, sf)
    path = scratch_path(spark, "catalog-csv-dirty")
    write_catalog_csv(raw, path)
    _broken_lines(raw).write.mode("append").text(path)
    load = load_catalog_csv(spark, path, scratch_path(spark, "catalog-loaded"), max_bad_share=0.5)
    problems = load.quarantine.select(F.count("*").alias("n"), F.array_sort(F.collect_set(
        F.regexp_extract(F.col("problems")[0], "^[^:]*", 0))).alias("kinds"))
    n, kinds = problems.select("n").scalar(), problems.select(F.array_join("kinds", "; ")).scalar()
    return load.good.select("*", n.alias("n_quarantined"), kinds.alias("problems"), F.lit(load.n_good).alias("n_good"))


@register("distinct_sketches")
def q_distinct_sketches(spark, sf):
    """A2, A6 by sketches kept by file: the catalog comes in two loads, of which the second sketches only the new
    files; the exact count of every text column and whether the estimate is within its error."""
    raw, source, table = raw_catalog(spark, sf), scratch_path(spark, "sketch-source"), scratch_path(spark, "sketches")
    columns = A.text_columns(raw)
    n_files = []
    for part in (0, 1):
        raw.where(F.pmod("id", F.lit(2)) == part).write.mode("append").parquet(source)
        n_files.append(add_files(spark, source, raw.schema, table, columns))
    exact = A.categorical_summary(raw, columns).select("column", "unique_values")
    both = exact.join(distinct_counts(spark, table, columns), "column")
    off = F.abs(F.col("estimate") - F.col("unique_values"))
    return both.select("column", "unique_values", F.col("n_rows"),
                       (off <= F.greatest(F.lit(1.0), F.col("unique_values") * F.lit(error_bound()))).alias("within_bound"),
                       F.lit(min(n_files) > 0).alias("both_loads_new"))


@register("report_sink_parts")
def q_report_sink_parts(spark, sf):
    """S3 by partition: a report by season written whole, then the run of one season again with other
    numbers; the other seasons are as they were."""
    rows = A.season_summary(cleaned_catalog(spark, sf, label="null")).withColumn("edition", F.lit(1))
    path = scratch_path(spark, "report-parts")
    write_report_parts(rows, path, ["season"], "all")
    again = rows.where("season = 'Winter'").withColumn("edition", F.lit(2))
    for _ in range(2):                                    # a run that is repeated changes nothing more
        write_report_parts(again, path, ["season"], "winter")
    return read_report_parts(spark, path).select(*rows.columns)


# ---------------------------------------------------------------- streams with state
_STREAMS: dict[tuple, str] = {}
#: Load times of the three arrivals: the last one is late, but within the delay.
_LOADED = ["2024-01-01 10:00:00", "2024-01-01 12:00:00", "2024-01-01 09:00:00"]


def _arrive(raw, source, part):
    """Write a third of the catalog (by id) as files that arrive now."""
    rows = raw.where(F.pmod("id", F.lit(3)) == part).withColumn("loaded_at", F.lit(_LOADED[part]).cast("timestamp"))
    rows.write.mode("append").parquet(source)


def _stream_cells(spark, sf):
    """The cell table after four micro-batches over the catalog's files: two arrivals, a late
    one, and the first one a second time; each batch is a query of its own that restarts
    from the checkpoint.  Built once per application and input."""
    raw = raw_catalog(spark, sf)
    key = catalog_key(spark, sf, "stream-cells")
    if key not in _STREAMS:
        source, table, ckpt = (scratch_path(spark, f"stream-cells-{x}") for x in ("source", "table", "checkpoint"))
        for part in (0, 1, 2, 0):
            _arrive(raw, source, part)
            streaming.run_to_table(streaming.cells(streaming.arrivals(spark, source)), table, ckpt)
        _STREAMS[key] = table
    return streaming.newest_cells(spark, _STREAMS[key])


@register("stream_category_stats")
def q_stream_category_stats(spark, sf):
    """A8 kept up to date by a stream with state."""
    return streaming.category_stats(_stream_cells(spark, sf))


@register("stream_overview")
def q_stream_overview(spark, sf):
    """A1, A2 kept up to date by the same stream."""
    return streaming.overview(_stream_cells(spark, sf))


@register("stream_season_summary")
def q_stream_season_summary(spark, sf):
    """A14 kept up to date by the same stream."""
    return streaming.season_means(_stream_cells(spark, sf))


@register("stream_category_distribution")
def q_stream_category_distribution(spark, sf):
    """A17 kept up to date by the same stream."""
    return streaming.category_shares(_stream_cells(spark, sf))


@register("stream_median_rank")
def q_stream_median_rank(spark, sf):
    """C3 in a stream: the median of merged sketches, held against the exact ranks of all values.

    n_values and n_sketched: known competitor means, in the catalog and in the sketches;
    within_bound: the sketch's median has a rank within its stated error of one half.
    """
    raw = raw_catalog(spark, sf)
    source, table, sketches, ckpt = (scratch_path(spark, f"stream-median-{x}") for x in ("source", "table", "sketches", "checkpoint"))
    for part in range(3):
        _arrive(raw, source, part)
        streaming.median_fill_stream(streaming.arrivals(spark, source), table, sketches, ckpt)
    median = streaming.sketch_quantile(spark, sketches)
    n = spark.read.parquet(sketches).select(F.sum(F.kll_sketch_get_n_double("sketch"))).scalar()
    values = C.competitor_mean(raw).where("competitor_price_mean is not null").select("competitor_price_mean").withColumn("m", median)
    v, m, error = F.col("competitor_price_mean"), F.col("m"), F.lit(streaming.RANK_ERROR)
    below, upto = F.count_if(v < m) / F.count("*"), F.count_if(v <= m) / F.count("*")
    return values.select(F.count("*").alias("n_values"), F.max(n).alias("n_sketched"),
                         ((below <= 0.5 + error) & (upto >= 0.5 - error)).alias("within_bound"))


@register("stream_pricing_kpis")
def q_stream_kpis(spark, sf):
    """Streaming: the raw catalog files as a stream -> cleaning -> KPIs -> parquet sink."""
    source = raw_catalog_path(spark, sf)
    sink = scratch_path(spark, "stream-kpis")
    ckpt = scratch_path(spark, "stream-kpis-checkpoint")
    line = J.fit_price_line_values(cleaned_catalog(spark, sf, flags="lenient"))  # one row
    run_available(pricing_kpi_stream(catalog_stream(spark, source),
                                     competitor_median(spark, sf), line), sink, ckpt)
    return spark.read.parquet(sink)
