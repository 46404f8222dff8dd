"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewren.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """node and component (the least node that it reaches) for every node of edges (columns a, b; two nodes each).

    Every round each node takes the least label among its own and its neighbours', and then that label's own label,
    so a path shortens at least twofold a round. Labels are tables; only whether something changed comes back.
    """
    both = cut(edges.select("a", "b").where("a <> b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a <> b")).distinct(), "edges")
    labels = cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("l")), "b").groupBy(F.col("a").alias("node")).agg(F.min("l").alias("near"))
        hop = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("low"))
        jump = hop.join(labels.select(F.col("node").alias("low"), F.col("label").alias("jump")), "low", "left")
        moved = cut(jump.select("node", F.least("low", F.coalesce("jump", "low")).alias("label"), (F.least("low", F.coalesce("jump", "low")) < F.col("label")).alias("moved")), "labels")
        labels = moved.select("node", "label")
        if moved.where("moved").isEmpty():
            return labels.withColumnRenamed("label", "component")
