"""The rule "split only nodes of at least n rows" for fitted forests, as a job over their table of nodes."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch

# Spark stops at a least number of rows in a child; splitting depends on the node's own rows in the published setup.
MIN_SPLIT = 5


def closed_nodes(nodes: DataFrame, min_split: int) -> DataFrame:
    """nodes(treeID, nodeData) of a saved forest with every node below `min_split` rows answering as a leaf.

    Rows are counted as often as a tree's sample drew them. A node that is too small gives its class counts to all that
    hangs below it, so each path ends in the answer of its first small node; the splits below keep their places, but add
    nothing to the importances. Growing never looks at a node's children, so the answers are those of a forest grown under
    the rule. Numbers go down a tree in preorder: what follows a small node and has a small parent hangs below it.
    A window holds the nodes of one tree, at most 2 ** (depth + 1).
    """
    node = F.col("nodeData")
    children = nodes.where("nodeData.leftChild >= 0").select(
        "treeID", (node["rawCount"] < min_split).alias("_below"), F.explode(F.array(node["leftChild"], node["rightChild"])).alias("_id")
    )
    placed = nodes.withColumn("_id", node["id"]).join(children, ["treeID", "_id"], "left")
    below = F.coalesce("_below", F.lit(False))
    answer = F.when((node["rawCount"] < min_split) & ~below, F.struct(node["prediction"].alias("p"), node["impurityStats"].alias("s")))
    so_far = Window.partitionBy("treeID").orderBy("_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    top = F.last(answer, ignorenulls=True).over(so_far)
    closed = node.withField("prediction", F.col("_top.p")).withField("impurityStats", F.col("_top.s"))
    small = node["rawCount"] < min_split
    data = F.when(small, closed.withField("gain", F.least(node["gain"], F.lit(0.0)))).otherwise(node)
    return placed.withColumn("_top", top).select("treeID", data.alias("nodeData"))


def with_least_split(model: RandomForestClassificationModel, min_split: int = MIN_SPLIT) -> RandomForestClassificationModel:
    """The forest as if nodes of fewer than `min_split` rows had not been split. It is saved, closed and loaded in the shared folder."""
    if min_split <= 2:  # a node of one row has nothing to split
        return model
    spark = SparkSession.active()
    grown, closed = scratch(spark, "forest"), scratch(spark, "forest-closed")
    model.save(grown)
    nodes = spark.read.parquet(f"{grown}/data")
    closed_nodes(nodes, min_split).write.parquet(f"{closed}/data")
    spark.read.parquet(f"{grown}/treesMetadata").write.parquet(f"{closed}/treesMetadata")
    spark.read.text(f"{grown}/metadata").coalesce(1).write.text(f"{closed}/metadata")
    return RandomForestClassificationModel.load(closed)
