"""Connected components of a link table, on Spark, in logarithmically many rounds."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def connected_components(links: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Rows (node, root) for every node of ``links`` (a, b: long); root is the
    smallest node reachable.

    Each round takes the smallest label among a node's neighbours (a partial
    aggregate, so a hub is combined before the shuffle) and then jumps from
    each label to that label's own label, which halves the remaining depth.
    Every round's labels are written to the shared folder, which cuts lineage.
    Self-links and repeated links are allowed; an empty table gives no rows.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = materialize(both.where("a <> b").distinct(), "cc-links")
    labels = materialize(both.groupBy(F.col("a").alias("node"))
                         .agg(F.least(F.min("b"), F.col("node")).alias("root")), "cc-labels")
    for _ in range(max_rounds):
        near = (both.join(labels, both.b == labels.node)
                .groupBy(both.a.alias("node")).agg(F.min("root").alias("near")))
        low = (labels.join(near, "node")
               .select("node", "root", F.least("root", "near").alias("low")))
        up = labels.select(F.col("node").alias("low"), F.col("root").alias("up"))
        moved = materialize(low.join(up, "low", "left")
                            .select("node", F.least("low", F.coalesce("up", "low")).alias("new"),
                                    "root"), "cc-labels")
        labels = moved.select("node", F.col("new").alias("root"))
        if moved.where("new <> root").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
