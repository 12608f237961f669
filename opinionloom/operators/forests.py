"""A random forest of classes, grown level by level over rows of one byte per feature.

Spark's own fit keeps a number per tree and row and visits all trees row by row. Here the rows are coded once: a value
becomes the number of its range, a block of rows one array. A level of all trees is one job. Its tasks walk their blocks
down each tree, count (node, feature, range, class), and the counts of a node are added before its split is chosen, so
what a task holds follows the trees and not the rows. How often a tree's sample draws a row is a Poisson number made of
the seed, the tree and the block, so nothing of it is stored and a repeated task draws the same.

The rules are those of Spark's classifier: Gini gain over weighted rows, square root of the features tried at each node,
no split without a gain, and a child of one class is a leaf. A value splits at halves between neighbours when there are
few of them, otherwise at quantiles of all rows; NaN and infinite values are an error. The answer is a model of Spark's own kind.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.base import Estimator
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch

#: Rows of one block; a task reads block after block.
BLOCK_ROWS = 1 << 16
#: Values that stand for a feature in a block when quantiles are found: a share of rows is at most half of 1/POINTS off.
POINTS = 1 << 9
#: Coded rows that one task reads, for as many trees as leave no core idle.
TASK_ROWS = 1 << 21
#: Rows times trees that are worth a task of their own.
TASK_VISITS = 1 << 22
#: Counts that one task holds, 4 bytes each.
MAX_COUNTS = 1 << 25
#: Counts whose gains are computed at once.
_COUNTS_AT_ONCE = 1 << 19

_BLOCK = "part int, seq int, n int, codes binary, classes binary"
_COUNTED = "tree int, low int, counts binary"
_CHOSEN = "tree int, node int, place int, cut int, gain double, left array<long>, right array<long>"
_SPLIT = pa.struct([("featureIndex", pa.int32()), ("leftCategoriesOrThreshold", pa.list_(pa.float64())), ("numCategories", pa.int32())])
_NODE = [pa.field(name, kind) for name, kind in (
    ("id", pa.int32()), ("prediction", pa.float64()), ("impurity", pa.float64()), ("impurityStats", pa.list_(pa.float64())), ("rawCount", pa.int64()),
    ("gain", pa.float64()), ("leftChild", pa.int32()), ("rightChild", pa.int32()), ("split", _SPLIT))]


def _poisson() -> np.ndarray:
    """How often a row is drawn, for each of 65,536 equally likely numbers."""
    below = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
    return np.searchsorted(below, (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint8)


@dataclass
class _Tree:
    """Nodes in the order they were made, and for each level what a row needs to go on from its open nodes."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [-1])
    gain: list[float] = field(default_factory=lambda: [-1.0])
    left: list[int] = field(default_factory=lambda: [-1])
    counts: list[np.ndarray | None] = field(default_factory=lambda: [None])
    #: Numbers of the open nodes; of each finished level (feature, cut, place of the children among the next open nodes or -1).
    open: list[int] = field(default_factory=lambda: [0])
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def add(self, counts: np.ndarray) -> int:
        for values, x in ((self.feature, -1), (self.cut, -1), (self.gain, -1.0), (self.left, -1), (self.counts, counts)):
            values.append(x)
        return len(self.counts) - 1

    def grow(self, chosen: dict[int, tuple], may_split: bool, may_go_on: bool) -> None:
        """Split the open nodes as chosen: (feature, cut, gain, left counts, right counts), feature -1 for none."""
        features, cuts = (np.zeros(len(self.open), np.int64) for _ in range(2))
        children, following = np.full(2 * len(self.open), -1, np.int64), []
        for place, node in enumerate(self.open):
            feature, cut, gain, left, right = chosen[place]
            self.counts[node] = left + right
            if feature < 0 or not may_split:
                continue
            features[place], cuts[place] = feature, cut
            self.feature[node], self.cut[node], self.gain[node] = feature, cut, gain
            self.left[node] = self.add(left)
            for side, child, counts in ((0, self.left[node], left), (1, self.add(right), right)):
                if may_go_on and np.count_nonzero(counts) > 1:
                    children[2 * place + side] = len(following)
                    following.append(child)
        self.levels.append((features, cuts, children))
        self.open = following


@dataclass(frozen=True)
class _Part:
    """Open nodes low..high-1 of a tree with so many, and the features tried at each."""

    tree: int
    low: int
    high: int
    open: int
    tried: np.ndarray
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]


def _points(x: np.ndarray, bins: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """The values of x and their numbers; with more than `bins` values, some in equal steps through the sorted rows, and True."""
    x = np.sort(x)
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    first = np.flatnonzero(new)
    if len(first) <= bins:
        return x[first], np.diff(first, append=len(x)), False
    ends = np.linspace(0, len(x), POINTS + 1).astype(np.int64)
    sizes = np.diff(ends)
    return x[((ends[:-1] + ends[1:]) // 2)[sizes > 0]], sizes[sizes > 0], True


def _cuts(rows: DataFrame, n_features: int, bins: int) -> list[np.ndarray]:
    """Ascending cuts of each feature, fewer than `bins`; a value belongs left of a cut that is not below it."""

    def points(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, n = [], 0

        def block() -> pa.RecordBatch:
            x = np.concatenate(waiting)
            if not np.isfinite(x).all():
                raise ValueError("features must not be NaN or infinite")
            found = [_points(x[:, i], bins) for i in range(n_features)]
            sizes = [len(v) for v, _, _ in found]
            columns = [np.repeat(np.arange(n_features, dtype=np.int32), sizes), *(np.concatenate([f[k] for f in found]) for k in range(2))]
            columns.append(np.repeat([many for _, _, many in found], sizes))
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["feature", "value", "n", "many"])

        for b in batches:
            waiting.append(_matrix(b, n_features))
            n += b.num_rows
            if n >= BLOCK_ROWS:
                yield block()
                waiting, n = [], 0
        if n:
            yield block()

    def cut(of_feature: pa.Table) -> pa.Table:
        feature = of_feature.column("feature")[0].as_py()
        value, n = (of_feature.column(c).to_numpy() for c in ("value", "n"))
        order = np.argsort(value, kind="stable")
        value, n = value[order], n[order]
        v = np.unique(value)
        if len(v) >= bins or of_feature.column("many").to_numpy().any():
            cuts = np.unique(value[np.searchsorted(np.cumsum(n), np.arange(1, bins - 1) / (bins - 1) * n.sum())])
        else:
            half = v[:-1] / 2 + v[1:] / 2
            cuts = np.where((half >= v[:-1]) & (half < v[1:]), half, v[:-1])
        return pa.table({"feature": pa.array(np.full(len(cuts), feature, np.int32)), "cut": pa.array(cuts, pa.float64())})

    seen = rows.select("x").mapInArrow(points, "feature int, value double, n long, many boolean")
    found = seen.groupBy("feature").applyInArrow(cut, "feature int, cut double").toArrow()
    feature, cuts = found.column("feature").to_numpy(), found.column("cut").to_numpy()
    return [np.sort(cuts[feature == i]) for i in range(n_features)]


def _matrix(batch: pa.RecordBatch, n_features: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, n_features)


def _write_blocks(rows: DataFrame, cuts: list[np.ndarray], path: str) -> None:
    """The coded rows of rows(x, y), in blocks."""

    def coded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, waiting, n = TaskContext.get().partitionId(), 0, [], 0

        def block() -> pa.RecordBatch:
            codes, classes = (np.concatenate(c, axis=-1) for c in zip(*waiting))
            arrays = [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([n], pa.int32()), pa.array([codes.tobytes()]), pa.array([classes.tobytes()])]
            return pa.RecordBatch.from_arrays(arrays, ["part", "seq", "n", "codes", "classes"])

        for b in batches:
            for at in range(0, b.num_rows, BLOCK_ROWS):
                piece = b.slice(at, BLOCK_ROWS)
                x = _matrix(piece, len(cuts))
                codes = np.stack([np.searchsorted(c, x[:, i], side="left") for i, c in enumerate(cuts)]).astype(np.uint8)
                waiting.append((codes, piece.column("y").to_numpy(zero_copy_only=False).astype(np.uint16)))
                n += piece.num_rows
                if n >= BLOCK_ROWS:
                    yield block()
                    seq, waiting, n = seq + 1, [], 0
        if n:
            yield block()

    rows.select("x", "y").mapInArrow(coded, _BLOCK).write.parquet(path)


def _best(counts: np.ndarray, tried: np.ndarray, cuts: np.ndarray, weight: np.ndarray, low: int, tree: int) -> pa.RecordBatch:
    """The split of each node by its counts(node, feature tried, range, class); of equal ones the first."""
    columns: list[list] = [[] for _ in range(7)]
    step = max(1, _COUNTS_AT_ONCE // max(1, counts[0].size))
    for at in range(0, len(counts), step):
        some, features = counts[at : at + step].astype(np.int64), tried[at : at + step]
        left = some.cumsum(axis=2)
        total = left[:, :1, -1:]
        left = left[:, :, :-1]
        right = total - left
        sides = [side * weight for side in (left, right, total)]
        w = [side.sum(axis=-1) for side in sides]
        # Weight times impurity of a side is its weight less the sum of its squares by its weight.
        rest = [n - np.divide((side * side).sum(axis=-1), n, out=np.zeros_like(n), where=n > 0) for side, n in zip(sides, w)]
        gain = np.divide(rest[2] - rest[0] - rest[1], w[2], out=np.zeros_like(w[0]), where=w[2] > 0)
        fair = (left.sum(axis=-1) > 0) & (right.sum(axis=-1) > 0) & (np.arange(left.shape[2]) < cuts[features][:, :, None])
        gain = np.where(fair, gain, -1.0).reshape(len(some), -1)
        top = gain.argmax(axis=1)
        node = np.arange(len(some))
        best, split = gain[node, top], np.divmod(top, left.shape[2])
        none = best <= 1e-15
        lefts, rights = left[node, split[0], split[1]], right[node, split[0], split[1]]
        lefts[none], rights[none] = total[none, 0, 0], 0
        for c, x in zip(columns, ([tree] * len(some), low + at + node, np.where(none, -1, split[0]), split[1], best, list(lefts), list(rights))):
            c.extend(x)
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["tree", "node", "place", "cut", "gain", "left", "right"])


def _count(blocks: Iterable[pa.RecordBatch], parts: list[_Part], shape: tuple[int, int, int], seed: int) -> list[np.ndarray]:
    """counts(node, feature tried, range, class) of each part over the rows of the blocks, as often as its tree drew them."""
    n_features, bins, n_classes = shape
    found = [np.zeros((p.tried.shape[1], (p.high - p.low) * bins * n_classes), np.int32) for p in parts]
    draws = _poisson()
    for batch in blocks:
        for r in batch.to_pylist():
            n = r["n"]
            codes, classes = np.frombuffer(r["codes"], np.uint8), np.frombuffer(r["classes"], np.uint16).astype(np.int64)
            for p, counts in zip(parts, found):
                drawn = np.random.Generator(np.random.SFC64([seed & 0xFFFFFFFF, p.tree, r["part"], r["seq"]])).integers(0, 1 << 16, n, dtype=np.uint16)
                times = draws[drawn]
                row = np.flatnonzero(times)
                node = np.zeros(len(row), np.int64)
                for feature, cut, children in p.levels:
                    right = codes.take((feature * n).take(node) + row) > cut.take(node)
                    node = children.take(2 * node + right)
                    kept = node >= 0
                    if not kept.all():
                        row, node = row[kept], node[kept]
                if p.high - p.low < p.open:
                    kept = (node >= p.low) & (node < p.high)
                    row, node = row[kept], node[kept] - p.low
                times, start = times.take(row).astype(np.float64), node * (bins * n_classes) + classes.take(row)
                for k, into in enumerate(counts):
                    code = codes.take((p.tried[:, k] * n).take(node) + row)
                    hits = np.bincount(start + np.multiply(code, n_classes, dtype=np.int64), weights=times, minlength=len(into))
                    np.add(into, hits, out=into, casting="unsafe")
    return [c.reshape(c.shape[0], -1, bins, n_classes).swapaxes(0, 1) for c in found]


def _small(counts: np.ndarray) -> bytes:
    """The counts in as few bytes as they need, which the first byte tells."""
    most = counts.max(initial=0)
    kind = next(k for k in ("u1", "u2", "i4") if most <= np.iinfo(k).max)
    return kind[1].encode() + counts.astype(kind).tobytes()


def _large(held: bytes) -> np.ndarray:
    return np.frombuffer(held, {b"1": "u1", b"2": "u2", b"4": "i4"}[held[:1]], offset=1).astype(np.int64)


def _chosen(spark: SparkSession, blocks: DataFrame, parts: list[_Part], seed: int, cuts: list[int], weight: np.ndarray, n_rows: int, shares: int) -> pa.Table:
    """The splits of all parts. The blocks lie in so many shares; for each share several tasks count some of the parts."""
    shape = (len(cuts), max(1, *cuts) + 1, len(weight))
    sizes = [p.tried.size * shape[1] * shape[2] for p in parts]
    cores = spark.sparkContext.defaultParallelism
    busy = min(-(-2 * cores // shares), -(-n_rows * len(parts) // TASK_VISITS))
    groups = min(len(parts), max(busy, -(-sum(sizes) // MAX_COUNTS)))
    limits, tried = np.array(cuts), {(p.tree, p.low): p.tried for p in parts}
    held = spark.sparkContext.broadcast((parts, tried))

    def job(group: int):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            mine = held.value[0][group::groups]
            for p, counts in zip(mine, _count(batches, mine, shape, seed)):
                values = [pa.array([p.tree], pa.int32()), pa.array([p.low], pa.int32()), pa.array([_small(counts)])]
                yield pa.RecordBatch.from_arrays(values, ["tree", "low", "counts"])

        return blocks.mapInArrow(run, _COUNTED)

    def added(given: pa.Table) -> pa.Table:
        tree, low = given.column("tree")[0].as_py(), given.column("low")[0].as_py()
        of = held.value[1][tree, low]
        total = np.zeros(of.size * shape[1] * shape[2], np.int64)
        for c in given.column("counts"):
            total += _large(c.as_py())
        return pa.Table.from_batches([_best(total.reshape(*of.shape, *shape[1:]), of, limits, weight, low, tree)])

    found = job(0)
    for group in range(1, groups):
        found = found.unionAll(job(group))
    # A row per open node. The parts are dealt out by their counts, as bytes don't tell their work.
    dealt = found.repartition(min(cores, len(parts), -(-sum(sizes) // _COUNTS_AT_ONCE)), "tree", "low")
    out = dealt.groupBy("tree", "low").applyInArrow(added, _CHOSEN).toArrow()
    held.unpersist()
    return out


def _parts(trees: list[_Tree], n_features: int, n_tried: int, counts_a_node: int, seed: int) -> list[_Part]:
    """The open nodes of all trees; those of one tree in several parts when a task can't hold their counts."""
    out = []
    most = max(1, MAX_COUNTS // counts_a_node)
    for k, t in enumerate(trees):
        rng = np.random.Generator(np.random.PCG64([seed & 0xFFFFFFFF, k, len(t.levels)]))
        tried = np.sort(rng.random((len(t.open), n_features)).argsort(axis=1)[:, :n_tried], axis=1)
        out += [_Part(k, a, min(a + most, len(t.open)), len(t.open), tried[a : a + most], t.levels) for a in range(0, len(t.open), most)]
    return out


def _node_table(trees: list[_Tree], cuts: list[np.ndarray], weight: np.ndarray) -> pa.Table:
    """(treeID, nodeData) as Spark stores them; the nodes of a tree are numbered in preorder."""
    names = [f.name for f in _NODE]
    columns: dict[str, list] = {name: [] for name in ["treeID", *names]}
    for number, tree in enumerate(trees):
        counts = np.stack(tree.counts)
        stats = counts * weight
        total = stats.sum(axis=1)
        impurity = 1.0 - np.divide((stats * stats).sum(axis=1), total**2, out=np.ones_like(total), where=total > 0)
        order, place, waiting = [], np.zeros(len(counts), np.int64), [0]
        while waiting:
            node = waiting.pop()
            place[node] = len(order)
            order.append(node)
            if tree.left[node] >= 0:
                waiting += [tree.left[node] + 1, tree.left[node]]
        left, feature = np.array(tree.left)[order], np.array(tree.feature)[order]
        inner = left >= 0
        split = [{"featureIndex": int(f), "leftCategoriesOrThreshold": [cuts[f][tree.cut[n]]] if f >= 0 else [], "numCategories": -1} for f, n in zip(feature, order)]
        of_tree = [np.arange(len(order)), stats.argmax(axis=1)[order].astype(float), impurity[order], list(stats[order]), counts.sum(axis=1)[order],
                   np.array(tree.gain)[order], np.where(inner, place[left], -1), np.where(inner, place[left + inner], -1), split]
        columns["treeID"].extend([number] * len(order))
        for name, values in zip(names, of_tree):
            columns[name].extend(values)
    data = pa.StructArray.from_arrays([pa.array(columns[f.name], f.type) for f in _NODE], fields=_NODE)
    return pa.table({"treeID": pa.array(columns["treeID"], pa.int32()), "nodeData": data})


class Forest(Estimator):
    """Fits what `classifier` describes (trees, depth, bins, seed, columns) to rows whose weights, if any, follow their labels."""

    def __init__(self, classifier: RandomForestClassifier):
        super().__init__()
        self.classifier = classifier

    def _fit(self, dataset: DataFrame) -> RandomForestClassificationModel:
        spark, spec = dataset.sparkSession, self.classifier
        # One row is enough for Spark to say how many features and classes there are, and how its model is stored.
        like = spec.fit(dataset.limit(1))
        n_features, n_classes, bins, seed = like.numFeatures, like.numClasses, spec.getMaxBins(), spec.getSeed()
        label = F.col(spec.getLabelCol()).cast("int")
        weighted = F.col(spec.getWeightCol()) if spec.isSet("weightCol") else F.lit(1.0)
        rows = dataset.select(vector_to_array(spec.getFeaturesCol()).alias("x"), label.alias("y"), weighted.cast("double").alias("w"))
        of_class = {r.y: r for r in rows.groupBy("y").agg(F.count("*").alias("n"), F.min("w").alias("w"), F.max("w").alias("top")).collect()}
        if any(r.w != r.top for r in of_class.values()):
            raise ValueError("rows of one label have different weights")
        weight = np.array([of_class[y].w if y in of_class else 1.0 for y in range(n_classes)])
        cuts = _cuts(rows, n_features, bins)
        folder = scratch(spark, "forest-rows")
        _write_blocks(rows, cuts, folder)
        n_rows = sum(r.n for r in of_class.values())
        shares = max(2, -(-n_rows // TASK_ROWS))  # tables of one partition each would be united in one task
        blocks = spark.read.schema(_BLOCK).parquet(folder).coalesce(shares)
        sizes = [len(c) for c in cuts]
        n_tried = math.ceil(math.sqrt(n_features))
        trees = [_Tree() for _ in range(spec.getNumTrees())]
        depth = spec.getMaxDepth()
        for level in range(max(depth, 1)):
            parts = _parts(trees, n_features, n_tried, n_tried * (max(1, *sizes) + 1) * n_classes, seed)
            if not parts:
                break
            found = _chosen(spark, blocks, parts, seed, sizes, weight, n_rows, shares)
            tried = {(p.tree, p.low + k): features for p in parts for k, features in enumerate(p.tried)}
            chosen: list[dict[int, tuple]] = [{} for _ in trees]
            for r in found.to_pylist():
                feature = int(tried[r["tree"], r["node"]][r["place"]]) if r["place"] >= 0 else -1
                chosen[r["tree"]][r["node"]] = (feature, r["cut"], r["gain"], np.array(r["left"], np.int64), np.array(r["right"], np.int64))
            for t, c in zip(trees, chosen):
                t.grow(c, level < depth, level + 1 < depth)
        return self._loaded(like, trees, cuts, weight)

    def _loaded(self, like: RandomForestClassificationModel, trees: list[_Tree], cuts: list[np.ndarray], weight: np.ndarray) -> RandomForestClassificationModel:
        """The model that is `like` this one but has these trees; it is saved and loaded in the shared folder."""
        spark = SparkSession.active()
        small, grown = scratch(spark, "forest-like"), scratch(spark, "forest-grown")
        like.save(small)
        spark.createDataFrame(_node_table(trees, cuts, weight)).coalesce(1).write.parquet(f"{grown}/data")
        spark.read.parquet(f"{small}/treesMetadata").write.parquet(f"{grown}/treesMetadata")
        spark.read.text(f"{small}/metadata").coalesce(1).write.text(f"{grown}/metadata")
        return RandomForestClassificationModel.load(grown)
