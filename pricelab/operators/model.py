"""Price model (M1, M2, S2, T1, T2) on ``pyspark.ml``.

Training is a distributed random forest over the encoded catalog; scoring is
``PipelineModel.transform`` (tree evaluation inside JVM tasks, no Python).
The feature list travels with the saved pipeline.

The category vocabulary is a stage of the pipeline (index, then sparse one-hot),
so no expression or column per category is ever built.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from .cleaning import model_matrix_fill

DEFAULT_NUMERIC = ["demand", "inventory", "clicks", "search_volume", "reviews_count",
                   "ratings", "discount_percentage", "freight_price",
                   "competitor_price_mean", "holiday", "weekday", "weekend"]


ONE_HOT = "_onehot"


def numeric_features(df: DataFrame, numeric: Sequence[str] = DEFAULT_NUMERIC) -> list[str]:
    """The numeric signals of the training feature list that ``df`` has, in order."""
    return [c for c in numeric if c in df.columns]


def design_matrix(df: DataFrame, numeric: Sequence[str], categoricals: Sequence[str] = (),
                  label: str = "optimal_price") -> DataFrame:
    """Training rows: filled numeric signals and label (C8) and the categories as they are."""
    return model_matrix_fill(df, numeric, label, keep=("id", *categoricals))


def train_price_model(df: DataFrame, numeric: Sequence[str] | None = None,
                      categoricals: Sequence[str] = S.CATEGORICAL_COLUMNS,
                      label: str = "optimal_price", num_trees: int = S.FOREST_TREES,
                      max_depth: int = 6, seed: int = S.SAMPLE_SEED) -> PipelineModel:
    """M1: fit the forest on filled signals and one-hot categories.

    The vocabulary is a stage of the pipeline: categories are indexed and become
    sparse one-hot vectors, however many levels there are; a missing or unseen
    category is a row of zeros.
    """
    numeric = list(numeric) if numeric is not None else numeric_features(df)
    cats = [c for c in categoricals if c in df.columns]
    stages = []
    if cats:
        index = [f"{c}_index" for c in cats]
        stages = [StringIndexer(inputCols=cats, outputCols=index, handleInvalid="keep",
                                stringOrderType="alphabetAsc"),
                  OneHotEncoder(inputCols=index, outputCols=[c + ONE_HOT for c in cats])]
    pipe = Pipeline(stages=[
        *stages,
        VectorAssembler(inputCols=[*numeric, *[c + ONE_HOT for c in cats]], outputCol="features"),
        RandomForestRegressor(featuresCol="features", labelCol=label, numTrees=num_trees,
                              maxDepth=max_depth, seed=seed),
    ])
    return pipe.fit(design_matrix(df, numeric, cats, label))


def train_linear_model(df: DataFrame, features: Sequence[str],
                       label: str = "optimal_price") -> PipelineModel:
    """M1 with ``VectorAssembler + LinearRegression`` (closed form): a second estimator
    whose scores SQL can reproduce."""
    pipe = Pipeline(stages=[
        VectorAssembler(inputCols=list(features), outputCol="features"),
        LinearRegression(featuresCol="features", labelCol=label, solver="normal"),
    ])
    return pipe.fit(design_matrix(df, features, label=label))


def numeric_inputs(model: PipelineModel) -> list[str]:
    """The numeric signals stored inside the pipeline."""
    return [c for c in model.stages[-2].getInputCols() if not c.endswith(ONE_HOT)]


def categorical_inputs(model: PipelineModel) -> list[str]:
    """The category columns stored inside the pipeline."""
    return list(model.stages[0].getInputCols()) if len(model.stages) > 2 else []


def model_features(model: PipelineModel) -> list[str]:
    """The feature list stored inside the pipeline: signals, then ``<column>_<category>``."""
    labels = dict(zip(categorical_inputs(model), model.stages[0].labelsArray if len(model.stages) > 2 else []))
    return numeric_inputs(model) + [f"{c}_{v}" for c, values in labels.items() for v in values]


def score_catalog(model: PipelineModel, df: DataFrame, label: str = "optimal_price") -> DataFrame:
    """M2: batch score every product: ``(id, <label>, prediction)``."""
    rows = design_matrix(df, numeric_inputs(model), categorical_inputs(model), label)
    return model.transform(rows).select("id", label, "prediction")


def predict_features(model: PipelineModel, features_df: DataFrame,
                     keep: Sequence[str] = ("id",)) -> DataFrame:
    """Score a prepared feature frame (the model's signals and category columns).

    Used for the serving rows of the what-if flows (F3/F4), which differ from
    the training design matrix; a missing signal is 0, the same fill rule as
    the training matrix (C8).  Returns the ``keep`` columns, which travel
    through the model, and ``prediction``.
    """
    filled = features_df.select(
        *keep, *categorical_inputs(model),
        *[F.coalesce(F.col(f).cast("double"), F.lit(S.FEATURE_FILL)).alias(f) for f in numeric_inputs(model)])
    return model.transform(filled).select(*keep, "prediction")


def feature_importance(model: PipelineModel) -> DataFrame:
    """``(feature, importance)`` from the forest, descending (bounded by the feature list)."""
    imp = model.stages[-1].featureImportances.toArray().tolist()
    rows = list(zip(model_features(model), map(float, imp)))
    return (_session().createDataFrame(rows, "feature string, importance double")
            .orderBy(F.desc("importance"), "feature"))


def top_drivers(importances: DataFrame, k: int = S.TOP_DRIVERS) -> DataFrame:
    """Top ``k`` drivers with percent and a readable name."""
    return importances.orderBy(F.desc("importance"), "feature").limit(k).select(
        "feature",
        F.initcap(F.regexp_replace("feature", "_", " ")).alias("label"),
        F.bround(F.col("importance") * F.lit(100.0), 1).alias("importance_percent"))


def model_summary(model: PipelineModel, metrics: DataFrame) -> DataFrame:
    """M3 (with the forest): metrics plus model type and feature count."""
    return metrics.withColumns({
        "model_type": F.lit(type(model.stages[-1]).__name__),
        "n_features": F.lit(len(model_features(model)))})


def _session():
    from pyspark.sql import SparkSession
    return SparkSession.getActiveSession()
