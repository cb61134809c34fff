"""Report bundles mirroring the application's tabs, built from one cleaned catalog.

Each function returns ``{name: DataFrame}``; nothing runs until a report is
written or collected.  ``write_reports`` is the sink: every report becomes a
parquet (or CSV) folder under one base path.  Build the cleaned catalog once
(``plans.catalog.cleaned_catalog`` writes it to the shared folder) and pass it
to every bundle so the tables are scanned, not recomputed.
"""

from __future__ import annotations

import os

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame

from .. import schema as S
from ..functions.stats import histogram
from ..operators import kpi as K
from ..operators import profile as A
from ..operators import search as P
from ..operators.model import feature_importance, model_summary, score_catalog, top_drivers
from ..sources.catalog import write_report
from .whatif import forest_optimizer_pricing, forest_playground_pricing


def profile_reports(clean: DataFrame) -> dict[str, DataFrame]:
    """Dataset profiling tab: shape, quality, column summaries, price structure."""
    return {
        "shape": A.dataset_shape(clean),
        "overview": A.dataset_overview(clean),
        "missing_by_column": A.missing_in_column_order(clean),
        "missing_overall": A.missing_overall(clean),
        "quality_verdict": A.quality_verdict(clean),
        "numeric_summary": A.numeric_summary(clean),
        "categorical_summary": A.categorical_summary(clean),
        "price_histogram": A.value_histogram(clean, "optimal_price", S.PRICE_BINS),
        "price_by_category": A.price_by_category_top(clean),
        "correlation": A.correlation_matrix(clean),
        "price_range": A.price_range(clean),
        "threshold_counts": A.threshold_counts(clean),
        "opportunities": P.opportunity_products(clean),
        "discount_candidates": P.discount_candidates(clean),
        "premium_candidates": P.premium_candidates(clean),
        "season_summary": A.season_summary(clean),
        "location_summary": A.location_summary(clean),
    }


def model_reports(clean: DataFrame, model: PipelineModel) -> dict[str, DataFrame]:
    """Model analytics tab: metrics, verdict, drivers, residuals of every product and their
    trend; the seeded sample is a table of its own, for a scatter chart."""
    scored = score_catalog(model, clean)
    metrics = K.regression_metrics(scored)
    res = K.residuals(scored)
    importances = feature_importance(model)
    return {
        "metrics": model_summary(model, metrics),
        "verdict": K.model_verdict(metrics),
        "feature_importance": importances,
        "top_drivers": top_drivers(importances),
        "residuals": res,
        "residual_sample": K.seeded_sample(res),
        "residual_histogram": histogram(res, "residual", S.RESIDUAL_BINS),
        "prediction_trend": A.demand_price_trend(res, x="actual", y="predicted"),
    }


def pricing_reports(clean: DataFrame, clean_lenient: DataFrame, model: PipelineModel,
                    weights: dict | None = None) -> dict[str, DataFrame]:
    """Price optimizer tabs for every product: both what-if flows with the forest."""
    return {
        "optimizer": forest_optimizer_pricing(model, clean),
        "playground": forest_playground_pricing(model, clean_lenient, weights),
    }


def write_reports(reports: dict[str, DataFrame], base_path: str,
                  fmt: str = "parquet") -> dict[str, str]:
    """Write every report to ``base_path/<name>``; returns the paths written."""
    out = {}
    for name, df in reports.items():
        path = os.path.join(base_path, name)
        write_report(df, path, fmt)
        out[name] = path
    return out
