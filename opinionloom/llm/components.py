"""Connected components of an edge table: union-find inside each partition, stars across partitions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def find(parent: dict[int, int], x: int) -> int:
    root = x
    while (up := parent.get(root, root)) != root:
        root = up
    while parent.get(x, x) != root:
        parent[x], x = root, parent[x]
    return root


def union(parent: dict[int, int], a: int, b: int) -> bool:
    """Join the classes of a and b under the smaller root; False if they were one already."""
    a, b = find(parent, a), find(parent, b)
    if a == b:
        return False
    parent[max(a, b)] = min(a, b)
    return True


def _local_forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            union(parent, a, b)
    nodes = np.fromiter(parent, np.int64, len(parent))
    roots = np.fromiter((find(parent, int(x)) for x in nodes), np.int64, len(nodes))
    apart = nodes != roots
    yield pa.RecordBatch.from_arrays([pa.array(nodes[apart]), pa.array(roots[apart])], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge in `edges` (a, b long), root the smallest node it reaches.

    Each round builds a spanning forest in every partition (so at most one edge per node and
    partition leaves it), then points the larger neighbours of every node at its smallest neighbour.
    A partition's forest holds as many nodes as the partition has edges. It ends when every node
    hangs on a root that hangs on nothing.
    """
    edges = edges.select(F.col("a").cast("bigint"), F.col("b").cast("bigint")).where("a != b")
    nodes = stored(edges.mapInArrow(_local_forests, "a long, b long"), "forest")
    while True:
        both = nodes.union(nodes.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        moved = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        stars = stored(moved.repartition("a").mapInArrow(_local_forests, "a long, b long").distinct(), "stars")
        unfinished = stars.select("b").distinct().join(stars.select(F.col("a").alias("b")), "b", "left_semi")
        repeated = stars.groupBy("a").count().where("count > 1")
        if not unfinished.take(1) and not repeated.take(1):
            return stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
        nodes = stars
