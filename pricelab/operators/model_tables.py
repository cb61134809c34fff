"""The price forest as tables: nodes and features instead of a model object.

A saved pipeline is read as the plain files it consists of.  ``features`` is one
row for each place of the model's vector (a signal, or a column and one of its
levels), ``nodes`` one row for each node of each tree.  Products are scored from
these two tables alone by array functions: the trees, whose size is bounded by
their number and depth, are one value beside every product, and each tree is
walked down level by level.  No model object is loaded and no list as long as
the vocabulary goes through the driver.
"""

from __future__ import annotations

import json
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .model import ONE_HOT, design_matrix


class ForestTables(NamedTuple):
    nodes: DataFrame        # tree, node, left, right, value, gain, weight, feature, signal, column_no, level, threshold, ...
    features: DataFrame     # feature (place in the vector), name, signal (its number) or column_no and level
    signals: list[str]
    columns: list[str]
    depth: int


def _metadata(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/metadata").first()[0])


def read_forest(spark: SparkSession, model_path: str) -> ForestTables:
    """The tables of a forest pipeline that was saved at ``model_path``."""
    uids = _metadata(spark, model_path)["paramMap"]["stageUids"]
    width = len(str(len(uids)))
    stages = [f"{model_path}/stages/{i:0{width}d}_{uid}" for i, uid in enumerate(uids)]
    inputs = _metadata(spark, stages[-2])["paramMap"]["inputCols"]
    forest = _metadata(spark, stages[-1])
    signals = [c for c in inputs if not c.endswith(ONE_HOT)]
    columns = [c[:-len(ONE_HOT)] for c in inputs if c.endswith(ONE_HOT)]

    numeric = [F.struct(F.lit(i).alias("feature"), F.lit(c).alias("name"), F.lit(i).alias("signal")) for i, c in enumerate(signals)]
    features = spark.range(1).select(F.explode(F.array(*numeric)).alias("x")).select(
        "x.*", F.lit(None).cast("int").alias("column_no"), F.lit(None).cast("string").alias("level"))
    if columns:
        names = F.array(*map(F.lit, columns))
        levels = spark.read.parquet(f"{stages[0]}/data").select("labelsArray", F.posexplode("labelsArray").alias("column_no", "labels"))
        before = F.aggregate(F.slice("labelsArray", F.lit(1), F.col("column_no")), F.lit(len(signals)), lambda n, x: n + F.size(x))
        levels = levels.select("column_no", before.alias("before"), F.posexplode("labels").alias("k", "level"))
        features = features.unionByName(levels.select(
            (F.col("before") + F.col("k")).alias("feature"), F.concat_ws("_", names[F.col("column_no")], "level").alias("name"),
            F.lit(None).cast("int").alias("signal"), "column_no", "level"))

    raw = spark.read.parquet(f"{stages[-1]}/data").select("treeID", "nodeData.*")
    cut, of = F.col("split.leftCategoriesOrThreshold"), F.col("split.numCategories")
    # a one-hot place holds 1 for its level and 0 for all others: where do the two go?
    nodes = raw.select(
        F.col("treeID").alias("tree"), F.col("id").alias("node"), F.col("leftChild").alias("left"), F.col("rightChild").alias("right"),
        F.col("prediction").alias("value"), "gain", F.col("impurityStats")[0].alias("weight"),
        F.col("split.featureIndex").alias("feature"), F.when(of < 0, F.get(cut, F.lit(0))).alias("threshold"),
        F.when(of < 0, F.lit(1.0) <= F.get(cut, F.lit(0))).otherwise(F.array_contains(cut, 1.0)).alias("level_left"),
        F.when(of < 0, F.lit(0.0) <= F.get(cut, F.lit(0))).otherwise(F.array_contains(cut, 0.0)).alias("other_left"))
    nodes = nodes.join(features.drop("name"), "feature", "left")
    return ForestTables(nodes, features, signals, columns, int(forest["paramMap"].get("maxDepth", forest["defaultParamMap"]["maxDepth"])))


def save_forest(tables: ForestTables, path: str) -> str:
    """Write the tables as parquet."""
    tables.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    tables.features.write.mode("overwrite").parquet(f"{path}/features")
    spark = tables.nodes.sparkSession
    about = json.dumps({"signals": tables.signals, "columns": tables.columns, "depth": tables.depth})
    spark.range(1).select(F.lit(about).alias("value")).write.mode("overwrite").text(f"{path}/about")
    return path


def load_forest(spark: SparkSession, path: str) -> ForestTables:
    about = json.loads(spark.read.text(f"{path}/about").first()[0])
    return ForestTables(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/features"),
                        about["signals"], about["columns"], about["depth"])


def _trees(nodes: DataFrame) -> Column:
    """All trees as one value: array of arrays of nodes, each at its number."""
    node = F.struct("node", "left", "right", "value", "signal", "column_no", "level", "threshold", "level_left", "other_left")
    trees = nodes.groupBy("tree").agg(F.sort_array(F.collect_list(node)).alias("nodes"))
    return trees.select(F.transform(F.sort_array(F.collect_list(F.struct("tree", "nodes"))), lambda t: t["nodes"])).scalar()


def forest_prediction(signals: Column, levels: Column, trees: Column, depth: int) -> Column:
    """Mean of the trees' leaves for a product's signals (array<double>) and levels (array<string>)."""
    def leaf(nodes: Column) -> Column:
        def down(at: Column, _) -> Column:
            n = nodes[at]
            by_level = F.when(levels[n["column_no"]] == n["level"], n["level_left"]).otherwise(n["other_left"])
            left = F.when(n["signal"].isNotNull(), signals[n["signal"]] <= n["threshold"]).otherwise(by_level)
            return F.when(n["left"] < 0, at).when(left, n["left"]).otherwise(n["right"])

        return nodes[F.aggregate(F.sequence(F.lit(1), F.lit(max(depth, 1))), F.lit(0), down)]["value"]

    return F.aggregate(trees, F.lit(0.0), lambda s, t: s + leaf(t)) / F.size(trees)


def score_from_tables(tables: ForestTables, df: DataFrame, label: str = "optimal_price") -> DataFrame:
    """M2 without a model object: ``(id, <label>, prediction)`` of every product."""
    rows = design_matrix(df, tables.signals, tables.columns, label)
    rows = rows.select("id", label, F.array(*tables.signals).alias("signals"),
                       (F.array(*tables.columns) if tables.columns else F.array().cast("array<string>")).alias("levels"))
    rows = rows.withColumn("trees", _trees(tables.nodes))        # named once: one subquery
    return rows.select("id", label, forest_prediction(F.col("signals"), F.col("levels"), F.col("trees"), tables.depth).alias("prediction"))


def importance_from_tables(tables: ForestTables) -> DataFrame:
    """T1 from the node table: ``(feature, importance)``, each tree's gains weighted by the rows they
    split and normalised, then the trees' mean normalised; one row for every feature."""
    inner = tables.nodes.where("left >= 0").withColumn("g", F.col("gain") * F.col("weight"))
    per_tree = inner.groupBy("tree").agg(F.sum("g").alias("total")).where("total > 0")
    shares = inner.groupBy("tree", "feature").agg(F.sum("g").alias("g")).join(per_tree, "tree")
    sums = shares.groupBy("feature").agg(F.sum(F.col("g") / F.col("total")).alias("s"))
    all_sum = sums.select(F.sum("s")).scalar()
    return (tables.features.join(sums, "feature", "left")
            .select(F.col("name").alias("feature"), F.coalesce(F.try_divide("s", all_sum), F.lit(0.0)).alias("importance")))


# ---------------------------------------------------------------- J4: a sweep by intervals

def sweep_intervals(tables: ForestTables, signal: str, lo: float, hi: float, step: float) -> Column:
    """Slider positions by the intervals between the forest's split points along ``signal``: a value (array of
    ``(value, steps)``) for all products.  Between two split points every tree goes the same way, so one
    position stands for all of its interval."""
    spark = tables.nodes.sparkSession
    n, scale = int(round((hi - lo) / step)), int(round(1.0 / step)) if step < 1 else None
    exact = scale is not None and abs(scale * step - 1.0) < 1e-12
    i = F.col("step").cast("double")
    value = F.lit(float(lo)) + (i / F.lit(float(scale)) if exact else i * F.lit(float(step)))
    points = (tables.nodes.where((F.col("signal") == tables.signals.index(signal)) & (F.col("left") >= 0))
              .select(F.sort_array(F.collect_set("threshold"))).scalar())
    positions = (spark.range(n + 1).select(F.col("id").cast("int").alias("step")).withColumn("value", value)
                 .withColumn("points", points).withColumn("interval", F.size(F.filter("points", lambda t: t < F.col("value")))))
    steps = F.sort_array(F.collect_list(F.struct("step", "value")))
    parts = positions.groupBy("interval").agg(F.min("value").alias("value"), steps.alias("steps"))
    return parts.select(F.sort_array(F.collect_list(F.struct("value", "steps")))).scalar()


def forest_expression(tables: ForestTables) -> Column:
    """Mean of the trees' leaves as one nested condition over the signal and category columns: compiled, where
    an array of trees beside each row is walked by interpreted functions.  Its size is that of the forest
    (trees x 2^depth, whatever the number of levels or products), and so is what the driver reads for it."""
    trees: dict[int, dict[int, Row]] = {}
    for n in tables.nodes.collect():
        trees.setdefault(n.tree, {})[n.node] = n

    def goes_left(n: Row) -> Column:
        if n.signal is not None:
            return F.col(tables.signals[n.signal]) <= F.lit(n.threshold)
        at_level = F.col(tables.columns[n.column_no]).eqNullSafe(F.lit(n.level))
        return F.when(at_level, F.lit(n.level_left)).otherwise(F.lit(n.other_left))

    def walk(nodes: dict[int, Row], at: int) -> Column:
        n = nodes[at]
        if n.left < 0:
            return F.lit(n.value)
        return F.when(goes_left(n), walk(nodes, n.left)).otherwise(walk(nodes, n.right))

    return reduce(lambda s, t: s + walk(trees[t], 0), sorted(trees), F.lit(0.0)) / F.lit(len(trees))


def interval_sweep(tables: ForestTables, df: DataFrame, signal: str, lo: float = 0.0, hi: float = 1.0,
                   step: float = 0.01) -> DataFrame:
    """J4 with the forest: ``(id, step, <signal>, prediction)`` of every product at every slider position.

    A product is scored once for each interval between split points that holds a position, not once
    a position; the scores are then dealt out to the positions.  No join, no shuffle of the products,
    and nothing as large as the forest in a row.
    """
    rows = design_matrix(df, tables.signals, tables.columns)
    parts = rows.withColumn("parts", sweep_intervals(tables, signal, lo, hi, step)).select("*", F.explode("parts").alias("part"))
    at = parts.select("id", "part.steps", *[F.col("part.value").alias(s) if s == signal else F.col(s) for s in tables.signals], *tables.columns)
    scored = at.select("id", "steps", forest_expression(tables).alias("prediction"))
    return scored.select("id", F.explode("steps").alias("s"), "prediction").select("id", "s.step", F.col("s.value").alias(signal), "prediction")
