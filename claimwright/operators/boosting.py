"""Boosted trees and forests of squared error, grown from histograms, many models side by side.

Features are binned once into bytes by quantile cuts and kept in blocks of rows. A tree grows by
levels: every task adds up gradients and weights of its rows by (model, node, feature, bin), the
sums of all tasks meet, and each open node takes the split of highest second-order gain, with
the better side for missing values and leaf weights ``-G / (H + l2)``. One pass over the
blocks serves all models that grow together: the folds left out, the combinations of a grid, the
bases of a stack and, since the segment is part of the node, the trees of all segments. So the
number of Spark jobs follows trees times depth and neither models, folds nor segments.

Growing is iterative per-partition work on numpy blocks, which is why it runs on an RDD of blocks;
fitted models are scored by a vectorised expression on DataFrames, also on streams. A block
carries each model's predictions; they are written to the checkpoint folder every
``CHECKPOINT`` trees, so a lost executor costs at most that many trees of its blocks. Samples are
drawn by hash of key and tree, so a retried task draws the same rows.

A booster waits for all tasks at every level of every tree. Where all rows of a segment that a
model sees fit one task (``WHOLE`` times ``LOCAL_ROWS``), they go to one and all its trees grow
there; segments and models are spread over the tasks. Boosters that differ in the least weight of
a child alone share their trees up to the first that is not the same. Trees of a forest do not wait for each other: one whose rows
fit one task grows in a few tasks that take some trees each. In a larger one, once a node has at
most ``LOCAL_ROWS`` rows, these go to one task, which finishes the tree below it; no group of rows
is ever larger, and no histogram of a deep level is sent.

Counting is most of the work. Features are counted a few at a time, as one number of their joint
bins, and a task that has all rows of a node counts its smaller child alone.

The sums of one level go straight to the driver while they and their number are small
(``DIRECT_BYTES``); larger ones are added up by (model, range of nodes) on the executors, which
then send the chosen splits alone.

A forest that may have more than ``HELD_NODES`` nodes is never whole in one place (``StoredForest``):
finished trees go to a written table, one row each, and rows to be scored meet them there in blocks.
"""

from __future__ import annotations

import json
import math
import pickle
from collections.abc import Iterator, Mapping, Sequence
from copy import copy
from dataclasses import asdict, dataclass, field, replace
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from claimwright.session import settle, shared_dir, shared_path

BINS = 64
MISSING = BINS  # the bin of missing values
WIDTH = BINS + 1
BLOCK_ROWS = 1 << 18
#: Rows that one task takes to grow a model's segment, or a forest's tree below a node, to the end,
#: and bytes of rows that are sent for that at once.
LOCAL_ROWS, SENT_BYTES = 1 << 20, 1 << 30
#: Times ``LOCAL_ROWS`` that one task takes to grow a whole model's segment: on eight cores that many
#: rows grow as fast there as by levels, where each level sends all blocks to Python. And rows
#: from which on a task that needs a good part of the rows reads the blocks itself.
WHOLE, READ_ROWS = 8, 1 << 18
#: Rows that are counted or parted at once, so that what a step makes stays near the processor.
STEP_ROWS = 1 << 15
#: Values of the joint bins of features that are counted in one pass, and rows that a node needs
#: on the average to be worth steps of its own.
PAIRED, FEW_ROWS = WIDTH * WIDTH, 512
#: Levels after which the rows of a node are put side by side again.
MOVED = 3
#: Rows times models that are worth a task.
TASK_ROWS = 1 << 15
CHECKPOINT = 25
DIRECT_BYTES = 1 << 20
#: Entries of the histograms of one task at once; models beyond wait for the next pass.
TASK_ENTRIES = 8 << 20
#: Nodes of a range whose sums meet in one place.
RANGE = 64
#: Nodes of a forest that the driver may hold, and rows of a block that meets the trees of a larger one.
HELD_NODES, SCORED_ROWS = 1 << 20, 1 << 16


@dataclass(frozen=True)
class Growth:
    """How the trees of one model grow. A ``forest`` draws rows with replacement for every tree,
    fits the target itself and predicts the mean."""

    trees: int = 100
    rate: float = 0.3
    depth: int = 6
    min_child: float = 1.0
    l2: float = 1.0
    min_gain: float = 0.0
    subsample: float = 1.0
    column_share: float = 1.0
    forest: bool = False
    seed: int = 42

    def fit(self, df: DataFrame, features: Sequence[str], target: str = "y", key: str | None = None) -> TreeModel | StoredForest:
        if self.forest and self.trees << (self.depth + 1) > HELD_NODES:
            return fit_stored(df, features, self, target, key)
        return fit_many(df, features, {"one": Lane(self)}, target, key=key)["one"]

    def copy(self) -> Growth:
        return self


@dataclass(frozen=True)
class Lane:
    """One model: its growth, and the fold it must not see."""

    growth: Growth
    left_out: int | None = None


class Tree:
    """Nodes of the trees of all segments: roots first, children in pairs as they grow."""

    def __init__(self, roots: int) -> None:
        self.feature = np.full(roots, -1, np.int16)
        self.cut = np.zeros(roots, np.uint8)
        self.missing_left = np.zeros(roots, bool)
        self.left = np.zeros(roots, np.int32)
        self.segment = np.arange(roots, dtype=np.int32)
        self.g, self.h, self.gain = np.zeros(roots), np.zeros(roots), np.zeros(roots)

    def split(self, nodes: np.ndarray, found: dict[str, np.ndarray]) -> np.ndarray:
        """Split ``nodes`` as found; the numbers of their children."""
        first = len(self.feature) + 2 * np.arange(len(nodes))
        self.feature[nodes], self.cut[nodes], self.missing_left[nodes] = found["feature"], found["cut"], found["missing_left"]
        self.left[nodes], self.gain[nodes] = first, found["gain"]
        n = 2 * len(nodes)

        def both(left: np.ndarray, right: np.ndarray) -> np.ndarray:
            return np.stack([left, right], 1).reshape(-1)

        self.feature = np.concatenate([self.feature, np.full(n, -1, np.int16)])
        self.cut, self.missing_left = np.concatenate([self.cut, np.zeros(n, np.uint8)]), np.concatenate([self.missing_left, np.zeros(n, bool)])
        self.left, self.segment = np.concatenate([self.left, np.zeros(n, np.int32)]), np.concatenate([self.segment, np.repeat(self.segment[nodes], 2)])
        self.g = np.concatenate([self.g, both(found["g_left"], self.g[nodes] - found["g_left"])])
        self.h = np.concatenate([self.h, both(found["h_left"], self.h[nodes] - found["h_left"])])
        self.gain = np.concatenate([self.gain, np.zeros(n)])
        return both(first, first + 1)

    def graft(self, node: int, own: Tree) -> None:
        """Put a tree over the rows of ``node`` in its place."""
        base = len(self.feature) - 1  # the root's children and all below are added
        for name in ("feature", "cut", "missing_left", "g", "h", "gain"):
            mine, theirs = getattr(self, name), getattr(own, name)
            mine[node] = theirs[0]
            setattr(self, name, np.concatenate([mine, theirs[1:]]))
        self.left[node] = own.left[0] + base
        self.left = np.concatenate([self.left, own.left[1:] + np.int32(base)])
        self.segment = np.concatenate([self.segment, np.full(len(own.feature) - 1, self.segment[node], np.int32)])

    def place(self, bins: np.ndarray, segment: np.ndarray, depth: int) -> np.ndarray:
        """The node that each row has reached; ``bins`` has a line for each feature."""
        node = segment.astype(np.int64)
        flat, row, n = np.ascontiguousarray(bins).reshape(-1), np.arange(len(node)), bins.shape[1]
        # Nodes without a split lead to themselves, so that no row is told apart.
        inner = self.feature >= 0
        first = np.where(inner, self.feature, 0).astype(np.int64) * n
        left, cut = np.where(inner, self.left, np.arange(len(inner))), np.where(inner, self.cut, 255)
        missing_right = inner & ~self.missing_left
        any_missing = bool((flat == MISSING).any())
        for _ in range(depth if inner.any() else 0):
            b = flat.take(first.take(node) + row)
            right = b > cut.take(node)
            if any_missing:
                right = np.where(b == MISSING, missing_right.take(node), right)
            node = left.take(node) + right
        return node

    def values(self, growth: Growth) -> np.ndarray:
        return -self.g / np.maximum(self.h + growth.l2, 1e-300) * (1.0 / growth.trees if growth.forest else growth.rate)


def best_splits(sums: np.ndarray, growth: Growth, allowed: np.ndarray) -> dict[str, np.ndarray]:
    """The best split of each node. ``sums`` has gradient and weight by (node, feature, bin),
    ``allowed`` tells which features a node may use; ties go to the first feature and cut."""
    g, h = sums[..., 0], sums[..., 1]
    total_g, total_h = g[:, :1].sum(2), h[:, :1].sum(2)

    def score(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out, weight = a * a, b + growth.l2
        out /= np.maximum(weight, 1e-300, out=weight)
        return out

    # Missing values to the right, or, where there are any, to the left.
    sides = 2 if h[..., MISSING].any() else 1
    g_left = np.repeat(np.cumsum(g[..., : BINS - 1], 2)[:, :, None], sides, 2)
    h_left = np.repeat(np.cumsum(h[..., : BINS - 1], 2)[:, :, None], sides, 2)
    if sides == 2:
        g_left[:, :, 1] += g[..., MISSING, None]
        h_left[:, :, 1] += h[..., MISSING, None]
    g_right, h_right = total_g[:, :, None, None] - g_left, total_h[:, :, None, None] - h_left
    gain = score(g_left, h_left)
    gain += score(g_right, h_right)
    gain -= score(total_g, total_h)[:, :, None, None]
    gain *= 0.5
    gain -= growth.min_gain
    least = max(growth.min_child, 1e-9)
    gain[~((h_left >= least) & (h_right >= least) & allowed[:, :, None, None])] = -np.inf
    gain = gain.reshape(len(g), -1)
    # Gains that differ by rounding alone are ties.
    most = gain.max(1, keepdims=True)
    at = (gain >= most - 1e-9 * np.where(np.isfinite(most), np.abs(most), 0)).argmax(1)
    row = np.arange(len(at))
    feature, rest = np.divmod(at, sides * (BINS - 1))
    best = {"gain": gain[row, at], "feature": feature, "cut": rest % (BINS - 1), "missing_left": rest >= BINS - 1,
            "g_left": g_left.reshape(len(at), -1)[row, at], "h_left": h_left.reshape(len(at), -1)[row, at]}
    return best | {"g": total_g[:, 0], "h": total_h[:, 0]}


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """Uniform numbers in [0, 1) from hashed keys."""
    x = x.view(np.uint64) ^ np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x ^ (x >> np.uint64(31))) / 2.0**64


#: Chances of at most 0, 1, 2, … draws of a row, when as many rows are drawn as there are.
_DRAWS = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])


def row_weights(block: dict, lane: Lane, number: int) -> np.ndarray:
    """Weight of each row of a block in a tree; 0 leaves it out."""
    growth = lane.growth
    weight = np.ones(len(block["y"])) if lane.left_out is None else (block["fold"] != lane.left_out).astype(float)
    if growth.forest:
        weight *= np.searchsorted(_DRAWS, _mixed(block["hash"], growth.seed * 1_000_003 + number))
    elif growth.subsample < 1:
        weight *= _mixed(block["hash"], growth.seed * 1_000_003 + number) < growth.subsample
    return weight


@dataclass
class _Open:
    """What a task needs to know about a tree that grows: its open nodes and their numbers."""

    lane: int
    number: int
    tree: Tree
    depth: int
    nodes: np.ndarray
    columns: np.ndarray
    slot: int  # where blocks carry its predictions
    index: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.index = np.full(len(self.tree.feature), -1, np.int64)
        self.index[self.nodes] = np.arange(len(self.nodes))


def _block_sums(block: dict, lane: Lane, grown: _Open, features: int, paired: list) -> np.ndarray:
    """Gradient and weight by (open node, feature, bin) in one block."""
    weight = row_weights(block, lane, grown.number)
    used = np.flatnonzero(weight)
    whole = len(used) == len(weight)
    at = grown.index[grown.tree.place(block["bins"] if whole else block["bins"][:, used], block["segment"][used], grown.depth)]
    kept = np.flatnonzero(at >= 0)
    if len(kept) < len(used):
        used, at, whole = used[kept], at[kept], False
    fitted = np.zeros(len(used)) if lane.growth.forest else block["predicted"][grown.slot][used]
    gradient, h = fitted - block["y"][used], None  # the weights of a booster's rows are one
    if lane.growth.forest:
        h = weight[used]
        gradient = gradient * h
    n = len(grown.nodes)
    if len(used) >= PAIRED * n:
        return _paired_sums(paired, at if n > 1 else None, n, gradient, h, features, grown.columns, None if whole else used)
    out = np.zeros((features, n * WIDTH, 2))
    place = at * WIDTH
    for f in np.unique(np.append(0, np.flatnonzero(grown.columns))):  # totals are those of the first
        key = place + (block["bins"][f] if whole else block["bins"][f].take(used))
        out[f, :, 0], out[f, :, 1] = np.bincount(key, gradient, n * WIDTH), np.bincount(key, h, n * WIDTH)
    return out.reshape(features, n, WIDTH, 2).transpose(1, 0, 2, 3)


def _packer(features: int, cuts: list[np.ndarray], base: np.ndarray):
    def emit(columns: list[np.ndarray]) -> pa.RecordBatch:
        hashes, y, fold, segment, *x = columns
        bins = np.empty((features, len(y)), np.uint8)
        for f in range(features):
            bins[f] = np.where(np.isnan(x[f]), MISSING, np.searchsorted(cuts[f], x[f], "left"))
        segment = segment.astype(np.int32)
        predicted = base[:, segment].copy()
        block = {"hash": hashes.astype(np.int64), "y": y.astype(float), "fold": fold.astype(np.int32), "segment": segment, "bins": bins, "predicted": predicted}
        return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(block, 5)], pa.binary())], names=["block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
                size += batch.num_rows
            if size >= BLOCK_ROWS:
                yield emit([np.concatenate(c) for c in zip(*held, strict=True)])
                held, size = [], 0
        if held:
            yield emit([np.concatenate(c) for c in zip(*held, strict=True)])

    return run


def fit_cuts(df: DataFrame, features: Sequence[str], bins: int = BINS) -> list[np.ndarray]:
    """At most ``bins - 1`` ascending cuts for each feature, at its quantiles, in one pass; a
    value falls into the bin of the first cut that is not below it."""
    shares = [k / bins for k in range(1, bins)]
    clean = [F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in features]
    # A feature of few values is cut between them; its quantiles say nothing else.
    row = df.agg(*[F.percentile_approx(c, shares, 20_000).alias(f"q{k}") for k, c in enumerate(clean)], *[F.max(c).alias(f"m{k}") for k, c in enumerate(clean)]).first()
    out = []
    for k in range(len(features)):
        values = np.unique(np.array(row[f"q{k}"] or [], float))
        out.append(values[values < row[f"m{k}"]] if len(values) else values)
    return out


def _training_rows(df: DataFrame, features: Sequence[str], target: str, fold: str | None, key: str | None) -> DataFrame:
    numbers = [F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate(features)]
    hashed = F.xxhash64(key) if key is not None else F.xxhash64(*features, target)
    fold_number = F.lit(-1) if fold is None else F.col(fold).cast("int")
    return df.where(F.col("segment_number").isNotNull()).select(hashed.alias("hash"), F.col(target).cast("double").alias("y"), F.coalesce(fold_number, F.lit(-1)).alias("fold"), "segment_number", *numbers)


def fit_many(
    df: DataFrame,
    features: Sequence[str],
    lanes: Mapping[str, Lane],
    target: str = "y",
    fold: str | None = None,
    segment: str | None = None,
    key: str | None = None,
    segments: Sequence[str] | None = None,
    chosen: np.ndarray | None = None,
    marks: Sequence[int] = (),
) -> dict[str, TreeModel]:
    """Fit all ``lanes`` side by side on the rows of ``df``. After as many trees as each of
    ``marks`` says, a model's ``left_out_r2`` gets the R² on the fold it must not see.

    ``segment`` names a column; each of ``segments`` (all that occur, by default) has trees of its
    own in every model, and ``chosen`` (segment, feature) limits what those may split on. ``key``
    tells rows apart for sampling, by default all features do.
    """
    spark = df.sparkSession
    if segment is not None:
        if segments is None:
            segments = [r[0] for r in df.select(segment).distinct().sort(segment).collect()]
        df = with_segment_number(df, segment, segments)
    else:
        segments, df = [None], df.withColumn("segment_number", F.lit(0))
    names, models = list(lanes), list(lanes.values())
    cuts, rows = fit_cuts(df, features), _training_rows(df, features, target, fold, key)
    # Means to start from: those of the rows a model sees, by fold and segment in one pass.
    sums = rows.groupBy("fold", "segment_number").agg(F.sum("y").alias("s"), F.count("*").alias("n")).collect()
    base = np.zeros((len(models), len(segments)))
    empty = np.zeros((len(models), len(segments)), bool)
    for m, lane in enumerate(models):
        s, n = np.zeros(len(segments)), np.zeros(len(segments))
        for r in sums:
            if lane.left_out is None or r["fold"] != lane.left_out:
                s[r["segment_number"]] += r["s"]
                n[r["segment_number"]] += r["n"]
        empty[m] = n == 0
        mean = s.sum() / max(n.sum(), 1)
        base[m] = 0.0 if lane.growth.forest else np.where(n > 0, s / np.maximum(n, 1), mean)
    # Boosting goes on from tree to tree: where all rows of a model's segment fit one task, it
    # goes on there, and only larger ones wait for all tasks at every level.
    sizes: dict[tuple[int, int], int] = {}
    for m, lane in enumerate(models):
        for r in sums:
            if lane.left_out is None or r["fold"] != lane.left_out:
                sizes[m, r["segment_number"]] = sizes.get((m, r["segment_number"]), 0) + r["n"]
    boosters = [m for m, lane in enumerate(models) if not lane.growth.forest]
    large = {m: np.array([s for s in range(len(segments)) if sizes.get((m, s), 0) > WHOLE * LOCAL_ROWS], np.int64) for m in range(len(models))}
    # Blocks carry the predictions of those that wait.
    slots = {m: k for k, m in enumerate(m for m in boosters if len(large[m]))}
    blocks = rows.mapInArrow(_packer(len(features), cuts, base[list(slots)]), "block binary").rdd.map(lambda r: pickle.loads(r["block"]))
    # Blocks that memory does not hold are read again, not packed again. A job waits for each of its tasks to start: no more tasks than there is work for.
    tasks = max(1, -(-sum(r["n"] for r in sums) * len(models) // TASK_ROWS))
    blocks = (blocks.coalesce(tasks) if tasks < blocks.getNumPartitions() else blocks).persist(StorageLevel.MEMORY_AND_DISK)
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(spark))
    grown: list[list[Tree]] = [[] for _ in models]
    allowed = np.ones((len(segments), len(features)), bool) if chosen is None else chosen
    # A forest goes this way as a whole, or its nodes do as soon as they are small.
    apart = sorted((m, s) for m, s in sizes if not len(large[m]) or (m in boosters and s not in large[m]))
    alone = _alone(blocks, models, apart, base, allowed, sizes, len(features))
    for number in range(max((models[m].growth.trees for m in boosters), default=0)):
        own = [m for m in boosters if models[m].growth.trees > number]
        trees = [Tree(len(segments)) for _ in own]
        by_levels = [k for k, m in enumerate(own) if len(large[m])]
        if by_levels:
            found = _grow(blocks, models, [(own[k], number) for k in by_levels], len(segments), len(features), allowed, roots=[large[own[k]] for k in by_levels], slots=slots)
            for k, tree in zip(by_levels, found, strict=True):
                trees[k] = tree
        for k, m in enumerate(own):
            for s in range(len(segments)):
                if (m, s) in alone:
                    trees[k].graft(s, alone[m, s][number])
        for m, tree in zip(own, trees, strict=True):
            grown[m].append(tree)
        if not by_levels:
            continue
        after = blocks.map(_advance([(slots[own[k]], models[own[k]].growth.depth, trees[k], trees[k].values(models[own[k]].growth)) for k in by_levels])).persist()
        if (number + 1) % CHECKPOINT == 0:
            after.checkpoint()
            after.foreachPartition(lambda _: None)
            blocks.unpersist()
        else:
            _LATER.append(blocks)
        blocks = after
        while len(_LATER) > 1:
            _LATER.pop(0).unpersist()
    forests = [(m, k) for m, lane in enumerate(models) if lane.growth.forest and len(large[m]) for k in range(lane.growth.trees)]
    if forests:
        rows_in_all = sum(r["n"] for r in sums)
        for (m, _), tree in zip(forests, _grow(blocks, models, forests, len(segments), len(features), allowed, rows_in_all), strict=True):
            grown[m].append(tree)
    for m, lane in enumerate(models):
        if lane.growth.forest and not len(large[m]):
            for number in range(lane.growth.trees):
                tree = Tree(len(segments))
                for s in range(len(segments)):
                    if (m, s) in alone:
                        tree.graft(s, alone[m, s][number])
                grown[m].append(tree)
    marked = _left_out_r2(blocks, models, grown, base, marks)
    while _LATER:
        _LATER.pop().unpersist()
    blocks.unpersist()
    fitted = {name: TreeModel(list(features), asdict(models[m].growth), cuts, grown[m], base[m], segment, list(segments)) for m, name in enumerate(names)}
    for m, r2 in marked.items():
        fitted[names[m]].left_out_r2 = r2
    return fitted


def fit_stored(df: DataFrame, features: Sequence[str], growth: Growth, target: str = "y", key: str | None = None) -> StoredForest:
    """A forest whose finished trees are written where they grow."""
    spark, features = df.sparkSession, list(features)
    df = df.withColumn("segment_number", F.lit(0))
    cuts, rows = fit_cuts(df, features), _training_rows(df, features, target, None, key)
    size = rows.count()
    blocks = rows.mapInArrow(_packer(len(features), cuts, np.zeros((0, 1))), "block binary").rdd.map(lambda r: pickle.loads(r["block"])).persist()
    path, models, allowed = shared_path(spark, "forest"), [Lane(growth)], np.ones((1, len(features)), bool)

    def store(trees) -> None:
        spark.createDataFrame(trees.map(lambda t: _stored(t[0], t[1], growth)), StoredForest.TREES).write.mode("append").parquet(path)

    if not size:
        store(spark.sparkContext.parallelize([(k, Tree(1)) for k in range(growth.trees)], 1))
    elif size <= LOCAL_ROWS:
        _alone(blocks, models, [(0, 0)], np.zeros((1, 1)), allowed, {(0, 0): size}, len(features), store)
    else:
        _grow(blocks, models, [(0, k) for k in range(growth.trees)], 1, len(features), allowed, size, store=store)
    blocks.unpersist()
    return StoredForest(features, growth, cuts, spark.read.schema(StoredForest.TREES).parquet(path))


def _left_out_r2(blocks, models: list[Lane], grown: list[list[Tree]], base: np.ndarray, marks: Sequence[int]) -> dict[int, dict[int, float]]:
    """R² of the models on the folds they do not see after so many trees, from sums over blocks."""
    asked = [(m, lane.left_out) for m, lane in enumerate(models) if lane.left_out is not None]
    if not asked or not marks:
        return {}
    marks = sorted(marks)
    # Models of the same fold and the same trees are measured once.
    kinds: dict[tuple, int] = {}
    kind = [kinds.setdefault((fold, base[m].tobytes(), asdict(models[m].growth)["rate"], *(t.feature.tobytes() + t.cut.tobytes() + t.g.tobytes() for t in grown[m])), k) for k, (m, fold) in enumerate(asked)]
    needed, steps = sorted(set(kind)), {m: [(t, t.values(models[m].growth)) for t in grown[m][: marks[-1]]] for m, _ in (asked[k] for k in set(kind))}

    def run(part: Iterator[dict]) -> Iterator[np.ndarray]:
        out = np.zeros((len(asked), 3 + len(marks)))
        for block in part:
            for k in needed:
                m, fold = asked[k]
                own = np.flatnonzero(block["fold"] == fold)
                y, bins, segment = block["y"][own], block["bins"].take(own, 1), block["segment"][own]
                out[k, :3] += len(y), y.sum(), (y * y).sum()
                predicted = base[m, segment].astype(float)
                for number, (tree, values) in enumerate(steps[m], 1):
                    predicted += values.take(tree.place(bins, segment, models[m].growth.depth))
                    if number in marks:
                        out[k, 3 + marks.index(number)] += ((predicted - y) ** 2).sum()
        yield out

    sums = sum(blocks.mapPartitions(run).collect(), np.zeros((len(asked), 3 + len(marks))))[kind]
    spread = sums[:, 2] - sums[:, 1] ** 2 / np.maximum(sums[:, 0], 1)
    return {m: {n: float(1 - sums[k, 3 + i] / spread[k]) if spread[k] > 0 else math.nan for i, n in enumerate(marks)} for k, (m, _) in enumerate(asked)}


def _items(models: list[Lane], groups: list[tuple[int, int]], sizes: Mapping[tuple[int, int], int], parallel: int) -> list[tuple[int, int, int, int]]:
    """What a task grows of those (model, segment): model, segment, and the range of trees."""
    work = {(m, s): models[m].growth.trees * models[m].growth.depth * sizes[m, s] for m, s in groups}
    share, items = max(1, sum(work.values()) // (4 * parallel)), []
    for m, s in groups:
        trees, growth = models[m].growth.trees, models[m].growth
        # Parts of a forest that keep all tasks busy to the end, while a part is worth its rows.
        parts = min(trees, 2 * parallel, max(1, -(-work[m, s] // share))) if growth.forest and sizes[m, s] > TASK_ROWS else 1
        edges = [trees * k // parts for k in range(parts + 1)]
        items += [(m, s, low, high) for low, high in zip(edges[:-1], edges[1:], strict=True)]
    # The longest first.
    return sorted(items, key=lambda i: -(i[3] - i[2]) * models[i[0]].growth.depth * sizes[i[0], i[1]])


def _alone(blocks, models: list[Lane], groups: list[tuple[int, int]], base: np.ndarray, allowed: np.ndarray, sizes: dict[tuple[int, int], int], features: int, store=None) -> dict[tuple[int, int], list[Tree]]:
    """All trees of those (model, segment) whose rows fit one task: a booster's in one task, those
    of a forest, which do not wait for each other, in a few. ``store`` gets them, by number, in
    place of the driver, if given."""
    parallel = blocks.context.defaultParallelism
    # Boosters that differ in the least weight of a child alone are the same until a node has too little.
    twins: dict[int, list[int]] = {}
    alike: dict[tuple, list[int]] = {}
    for m, lane in enumerate(models):
        own = (m,) if lane.growth.forest else (replace(lane.growth, min_child=0.0), lane.left_out, tuple(sorted(s for k, s in groups if k == m)))
        alike.setdefault(own, []).append(m)
    for own in alike.values():
        twins[own[0]] = own
    items = _items(models, [g for g in groups if g[0] in twins], sizes, parallel)
    every = sum(max((n for (_, k), n in sizes.items() if k == s), default=0) for s in {s for _, s in sizes})
    out: dict[tuple[int, int], dict[int, list[Tree]]] = {}

    def rows_of(block: dict, fold: int | None, s: int) -> tuple | None:
        rows = np.flatnonzero((block["segment"] == s) & (block["fold"] != fold if fold is not None else True))
        return (block["bins"].take(rows, 1), block["y"].take(rows), block["hash"].take(rows)) if len(rows) else None

    def grown(item: tuple[int, int, int, int], pieces: Iterator[tuple]) -> list[tuple[int, list[Tree]]]:
        m, s, first, last = item
        bins, y, hashes = _in_order(pieces, sizes[m, s])
        growth, paired = models[m].growth, _paired(bins)
        all_rows = np.arange(len(y), dtype=np.int32)
        if growth.forest:
            trees = []
            for number in range(first, last):
                may, weight = _columns(growth, number, features) & allowed[s], row_weights({"hash": hashes, "y": y}, Lane(growth), number)
                trees.append(_grown_rows(bins, -y * weight, weight, growth, 0, may, paired, np.flatnonzero(weight).astype(np.int32))[0])
            return [(m, trees)]
        done: dict[int, list[Tree]] = {k: [] for k in twins[m]}
        waiting = [(twins[m], first, base[m, s] - y)]
        y, hashes = (y, hashes) if growth.subsample < 1 else (y[:0], hashes[:0])  # nothing else needs them
        while waiting:
            own, start, g = waiting.pop()
            for number in range(start, last):
                lead, *others = own
                growth, same = models[lead].growth, {k: models[k].growth for k in others}
                may = _columns(growth, number, features) & allowed[s]
                weight = row_weights({"hash": hashes, "y": y}, Lane(growth), number) if growth.subsample < 1 else None
                tree, leaves = _grown_rows(bins, g, None, growth, 0, may, paired, all_rows if weight is None else np.flatnonzero(weight).astype(np.int32), same)
                if len(same) < len(others):  # the others go on by themselves from here
                    waiting.append(([k for k in others if k not in same], number, g.copy()))
                    own = [lead, *same]
                for k in own:
                    done[k].append(tree)
                values = tree.values(growth)
                for leaf, rows in leaves:
                    for low in range(0, len(rows), STEP_ROWS):
                        part = rows[low : low + STEP_ROWS]
                        g[part] += values[leaf if isinstance(leaf, int) else leaf[low : low + STEP_ROWS]]
                rest = np.zeros(0, np.int64) if weight is None else np.flatnonzero(weight == 0)
                for low in range(0, len(rest), STEP_ROWS):
                    part = rest[low : low + STEP_ROWS]
                    g[part] += values[tree.place(bins.take(part, 1), np.zeros(len(part), np.int64), growth.depth)]
        return list(done.items())

    def taken(done, part: list) -> None:
        if store is not None:
            store(done.flatMap(lambda d: enumerate(d[1][0][1], part[d[0]][2])))
            return
        for i, found in done.collect():
            for m, trees in found:
                out.setdefault((m, part[i][1]), {})[part[i][2]] = trees

    # A task that needs a good part of the rows reads the blocks, which then go through no shuffle.
    parted = [max(READ_ROWS, every // 4) < sizes[i[:2]] for i in items]
    whole, items = [i for i, reads in zip(items, parted, strict=True) if reads], [i for i, reads in zip(items, parted, strict=True) if not reads]
    if whole:

        def read(number: int, own: Iterator[dict]) -> Iterator[tuple]:
            m, s, _, _ = whole[number]
            yield number, grown(whole[number], filter(None, (rows_of(block, models[m].left_out, s) for block in own)))

        # One partition with all blocks, which are there before, for each item, the longest first.
        blocks.foreachPartition(lambda own: [None for _ in own])
        all_blocks = blocks.coalesce(1)
        taken(blocks.context.union([all_blocks] * len(whole)).mapPartitionsWithIndex(read), whole)
    low = 0
    while low < len(items):
        # As many at once as their rows may be sent.
        high, size = low, 0
        while high < len(items) and (high == low or size + sizes[items[high][:2]] * (features + 24) <= SENT_BYTES):
            size, high = size + sizes[items[high][:2]] * (features + 24), high + 1
        part = items[low:high]
        by_rows: dict[tuple[int | None, int], list[int]] = {}  # those of the same rows
        for i, (m, s, _, _) in enumerate(part):
            by_rows.setdefault((models[m].left_out, s), []).append(i)

        def sent(own: Iterator[dict], by_rows: dict = by_rows) -> Iterator[tuple]:
            for block in own:
                for (fold, s), numbers in by_rows.items():
                    piece = rows_of(block, fold, s)
                    if piece is not None:
                        for i in numbers:
                            yield i, piece

        count = min(len(part), parallel * 4)
        # Items by number, so that tasks get equal shares and the longest start first.
        def received(own: Iterator[tuple], part: list = part) -> Iterator[tuple]:
            held: dict[int, list] = {}
            for i, piece in own:
                held.setdefault(i, []).append(piece)
            for i in sorted(held):
                yield i, grown(part[i], iter(held.pop(i)))

        taken(blocks.mapPartitions(sent).partitionBy(count, lambda i, n=count: i % n).mapPartitions(received), part)
        low = high
    return {g: [t for first in sorted(found) for t in found[first]] for g, found in out.items()}


def _in_order(pieces, rows: int | None = None) -> list[np.ndarray]:
    """Pieces of rows put together, bins first and hashes last, in the order of hashes: the same sums
    in whatever order rows come. With the number of ``rows``, pieces are put in place as they come."""
    if rows is None:
        pieces = list(pieces)
        rows = sum(len(p[-1]) for p in pieces)
    columns, at = [], 0
    for piece in pieces:
        columns = columns or [np.empty((*c.shape[:-1], rows), c.dtype) for c in piece]
        for whole, own in zip(columns, piece, strict=True):
            whole[..., at : at + len(piece[-1])] = own
        at += len(piece[-1])
    order = np.argsort(columns[-1], kind="stable")
    for whole in columns:
        for line in whole if whole.ndim == 2 else [whole]:
            line[:] = line.take(order)
    return columns


#: Blocks whose successors are not computed yet.
_LATER: list = []


def _advance(finished: list[tuple[int, int, Tree, np.ndarray]]):
    def run(block: dict) -> dict:
        predicted = block["predicted"].copy()
        for m, depth, tree, values in finished:
            predicted[m] += values[tree.place(block["bins"], block["segment"], depth)]
        return block | {"predicted": predicted}

    return run


def _columns(growth: Growth, number: int, features: int) -> np.ndarray:
    """Features that a tree may use."""
    n = max(1, round(growth.column_share * features))
    used = np.zeros(features, bool)
    used[np.random.default_rng([growth.seed, number]).permutation(features)[:n] if n < features else slice(None)] = True
    return used


def _grow(blocks, models: list[Lane], wanted: list[tuple[int, int]], segments: int, features: int, allowed: np.ndarray, rows: int | None = None, roots: list[np.ndarray] | None = None, slots: Mapping[int, int] | None = None, store=None) -> list[Tree]:
    """One tree for each wanted (model, number), level by level, side by side. With the number of
    ``rows``, nodes of few rows are finished in one task each; ``store``, if given, gets the trees
    with what is below those nodes, which the driver then never sees."""
    trees = [Tree(segments) for _ in wanted]
    nodes = [np.arange(segments) for _ in wanted] if roots is None else [r.copy() for r in roots]
    columns = [_columns(models[m].growth, k, features) for m, k in wanted]
    partitions = blocks.getNumPartitions()
    small: list[list[tuple[int, int]]] = [[] for _ in wanted]  # (node, depth) to be finished
    if rows is not None and rows <= LOCAL_ROWS:
        small, nodes = [[(k, 0) for k in range(segments)] for _ in wanted], [np.zeros(0, np.int64) for _ in wanted]
    for depth in range(max(models[m].growth.depth for m, _ in wanted)):
        todo = [w for w, (m, _) in enumerate(wanted) if len(nodes[w]) and depth < models[m].growth.depth]
        if not todo:
            break
        # Passes of models whose histograms a task can hold at once; a model of very many
        # nodes is a few passes by itself.
        entry = features * WIDTH * 2
        jobs: list[list[tuple[int, int, int]]] = [[]]
        size = 0
        for w in todo:
            step = max(RANGE, TASK_ENTRIES // entry)
            for low in range(0, len(nodes[w]), step):
                n = min(step, len(nodes[w]) - low) * entry
                if size and size + n > TASK_ENTRIES:
                    jobs.append([])
                    size = 0
                jobs[-1].append((w, low, min(low + step, len(nodes[w]))))
                size += n
        children: dict[int, list[np.ndarray]] = {w: [] for w in todo}
        for job in jobs:
            asked = [_Open(wanted[w][0], wanted[w][1], trees[w], depth, nodes[w][low:high], columns[w], (slots or {}).get(wanted[w][0], -1)) for w, low, high in job]
            total = sum(len(a.nodes) for a in asked) * entry * 8 * partitions
            for a, (w, _, _), found in zip(asked, job, _splits(blocks, models, asked, features, allowed, total <= DIRECT_BYTES), strict=True):
                tree = trees[w]
                tree.g[a.nodes], tree.h[a.nodes] = found["g"], found["h"]
                good = (found["gain"] > 1e-12) & np.isfinite(found["gain"])
                children[w].append(tree.split(a.nodes[good], {k: v[good] for k, v in found.items()}))
        for w in todo:
            nodes[w] = np.concatenate(children[w])
            if rows is not None and depth + 1 < models[wanted[w][0]].growth.depth:
                few = trees[w].h[nodes[w]] <= LOCAL_ROWS
                small[w] += [(int(k), depth + 1) for k in nodes[w][few]]
                nodes[w] = nodes[w][~few]
    # Rows that are sent: all features and three numbers each, for as many trees as fit at once.
    step = max(1, SENT_BYTES // max((rows or 1) * (features + 24), 1))
    for low in range(0, len(wanted), step):
        part = [w for w in range(low, min(low + step, len(wanted))) if small[w]]
        if part:
            _finish(blocks, models, wanted, trees, small, columns, allowed, part, store)
    ended = [(wanted[w][1], trees[w]) for w in range(len(wanted)) if not small[w]]
    if store is not None and ended:
        store(blocks.context.parallelize(ended, 1))
    return trees


def _finish(blocks, models: list[Lane], wanted: list[tuple[int, int]], trees: list[Tree], small: list[list[tuple[int, int]]], columns: list[np.ndarray], allowed: np.ndarray, part: list[int], store=None) -> None:
    """Grow the small nodes of some trees to the end, each in one task."""
    tasks = {w: (models[wanted[w][0]], wanted[w][1], trees[w], {node: depth for node, depth in small[w]}) for w in part}

    def sent(own: Iterator[dict]) -> Iterator[tuple]:
        for block in own:
            for w, (lane, number, tree, nodes) in tasks.items():
                weight = row_weights(block, lane, number)
                used = np.flatnonzero(weight)
                at = tree.place(block["bins"][:, used], block["segment"][used], lane.growth.depth)
                order = np.argsort(at, kind="stable")
                edges = np.append(np.flatnonzero(np.append(True, np.diff(at[order]) != 0)), len(order)) if len(order) else np.zeros(1, np.int64)
                for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    rows, node = used[order[a:b]], int(at[order[a]])
                    if node in nodes:
                        yield (w, node), (block["bins"].take(rows, 1), block["y"][rows], weight[rows], block["hash"][rows])

    def grown(item: tuple) -> tuple:
        (w, node), pieces = item
        lane, _, tree, nodes = tasks[w]
        bins, y, weight, _ = _in_order(pieces)
        return (w, node), _grown_rows(bins, -y * weight, weight, lane.growth, nodes[node], columns[w] & allowed[tree.segment[node]])[0]

    count = min(sum(len(small[w]) for w in part), max(blocks.getNumPartitions(), blocks.context.defaultParallelism))
    done = blocks.mapPartitions(sent).groupByKey(count).map(grown)
    if store is not None:

        def whole(item: tuple) -> tuple[int, Tree]:
            w, below = item
            tree = tasks[w][2]
            for node, own in sorted(below, key=lambda b: b[0]):
                tree.graft(node, own)
            return tasks[w][1], tree

        store(done.map(lambda d: (d[0][0], (d[0][1], d[1]))).groupByKey(len(part)).map(whole))
        return
    for (w, node), own in done.collect():
        trees[w].graft(node, own)


def _paired(bins: np.ndarray) -> list[tuple[list[int], list[int], np.ndarray]]:
    """Features in groups whose bins, taken together, are one number of at most ``PAIRED``
    values, so that one pass over the rows counts for all of a group: ``(features, widths, number)``."""
    widths = [int(b.max()) + 1 if len(b) else 1 for b in bins]
    open_groups: list[tuple[list[int], int]] = []
    for f in sorted(range(len(bins)), key=lambda f: -widths[f]):
        for i, (own, size) in enumerate(open_groups):
            if size * widths[f] <= PAIRED:
                open_groups[i] = ([*own, f], size * widths[f])
                break
        else:
            open_groups.append(([f], widths[f]))
    out = []
    for own, _ in open_groups:
        number = bins[own[0]].astype(np.uint16)
        for f in own[1:]:
            number = number * np.uint16(widths[f]) + bins[f]
        out.append((own, [widths[f] for f in own], number))
    return out


def _paired_sums(paired: list, at: np.ndarray | None, nodes: int, g: np.ndarray, h: np.ndarray | None, features: int, columns: np.ndarray, rows: np.ndarray | None = None, of_all: bool = False) -> np.ndarray:
    """Gradient and weight by (node, feature, bin) of ``rows`` (all, by default), which are at the
    nodes ``at`` (one node, by default); those of the first feature and of ``columns``. ``g`` and
    ``h`` are those of ``rows``, or ``of_all``. Some rows at a time."""
    out = np.zeros((nodes, features, WIDTH, 2))
    asked = [(own, widths, number, [i for i, f in enumerate(own) if f == 0 or columns[f]]) for own, widths, number in paired]
    asked = [(own, widths, number, wanted, math.prod(widths)) for own, widths, number, wanted in asked if wanted]
    sums = [(np.zeros(nodes * size), np.zeros(nodes * size, np.int64 if h is None else float)) for *_, size in asked]
    step = max(STEP_ROWS, 4 * nodes * PAIRED)
    for low in range(0, len(g) if rows is None else len(rows), step):
        part = slice(low, low + step)
        own = None if rows is None else rows[part].astype(np.intp)
        g_own, h_own = ((None if w is None else w.take(own)) if of_all and own is not None else (None if w is None else w[part]) for w in (g, h))
        node = None if at is None else at[part]
        for (_, _, number, _, size), (total_g, total_h) in zip(asked, sums, strict=True):
            key = (number[part] if own is None else number.take(own)).astype(np.intp)
            if node is not None:
                key += node * size
            total_g += np.bincount(key, g_own, nodes * size)
            total_h += np.bincount(key, h_own, nodes * size)
    for (own, widths, _, wanted, _), both in zip(asked, sums, strict=True):
        for k, total in enumerate(both):
            table = total.reshape(nodes, *widths)
            for i in wanted:
                out[:, own[i], : widths[i], k] = table.sum(tuple(j + 1 for j in range(len(own)) if j != i))
    return out


def _chosen(sums: np.ndarray, growth: Growth, allowed: np.ndarray, twins: dict[int, Growth] | None = None) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The best splits, and which of them are made; ``twins`` that split otherwise are taken out."""

    def best(growth: Growth) -> tuple[dict[str, np.ndarray], np.ndarray]:
        found = best_splits(sums, growth, allowed)
        return found, (found["gain"] > 1e-12) & np.isfinite(found["gain"])

    found, good = best(growth)
    for k in list(twins or ()):
        other, made = best(twins[k])
        if (made != good).any() or any((other[c][good] != found[c][good]).any() for c in ("feature", "cut", "missing_left")):
            del twins[k]
    return found, good


def _parted(values: np.ndarray, beyond: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows that stay and those whose value is ``beyond``, in their order, some at a time."""
    out, rest, a, b = np.empty_like(rows), np.empty_like(rows), 0, 0
    for low in range(0, len(rows), STEP_ROWS):
        own = rows[low : low + STEP_ROWS]
        right = beyond.take(values.take(own))
        there, here = np.flatnonzero(right), np.flatnonzero(~right)
        own.take(here, out=out[a : a + len(here)], mode="clip")
        own.take(there, out=rest[b : b + len(there)], mode="clip")
        a, b = a + len(here), b + len(there)
    out[a:] = rest[:b]
    return out[:a], out[a:]


def _grown_alone(bins: np.ndarray, g: np.ndarray, h: np.ndarray | None, growth: Growth, depth: int, may: np.ndarray, paired: list | None = None, rows: np.ndarray | None = None) -> tuple[Tree, np.ndarray]:
    """``_grown_rows`` and the leaf of each row."""
    tree, leaves = _grown_rows(bins, g, h, growth, depth, may, paired, rows)
    node = np.zeros(len(g), np.int64)
    for k, own in leaves:
        node[own] = k
    return tree, node if rows is None else node[rows]


def _grown_rows(bins: np.ndarray, g: np.ndarray, h: np.ndarray | None, growth: Growth, depth: int, may: np.ndarray, paired: list | None = None, rows: np.ndarray | None = None, twins: dict[int, Growth] | None = None) -> tuple[Tree, list[tuple[int | np.ndarray, np.ndarray]]]:
    """A tree over ``rows`` (all, by default), from a root that stands at ``depth``, and its leaves
    (one, or that of each row) with their rows. No ``h`` stands for weights of one. While nodes have
    many rows, only the smaller child of a node is counted; the other is what is left of the node.
    Every few levels the rows of each node are put side by side, as reading one here and one there
    takes longer than counting. ``twins`` that would not grow the same tree are taken out."""
    tree, features = Tree(1), len(bins)
    order = np.arange(len(g), dtype=np.int32) if rows is None else rows.astype(np.int32, copy=False)
    paired = _paired(bins) if paired is None else paired
    whole = len(order) == len(g)
    tree.g[0], tree.h[0] = g.sum() if whole else g[order].sum(), len(order) if h is None else h[order].sum()
    nodes, held = np.zeros(1, np.int64), [order]  # the open nodes and their rows
    sums = np.zeros((0, features, WIDTH, 2))
    leaves: list[tuple[int | np.ndarray, np.ndarray]] = []
    allowed = np.broadcast_to(may, (1, features))
    all_bins, all_g, all_h, moved = bins, g, h, depth + MOVED
    line: np.ndarray | None = None  # the rows as they stand side by side, if they were moved

    def counted(parts: list[np.ndarray]) -> np.ndarray:
        if paired and (len(parts) == 1 or sum(map(len, parts)) >= PAIRED * len(parts)):
            return np.concatenate([_paired_sums(paired, None, 1, g, h, features, may, None if len(r) == len(g) else r, True) for r in parts])
        own = np.concatenate(parts)
        place = np.repeat(np.arange(len(parts)) * WIDTH, [len(r) for r in parts])
        out, g_own, h_own = np.zeros((features, len(parts) * WIDTH, 2)), g[own], None if h is None else h[own]
        own = own if line is None or bins is not all_bins else line.take(own)  # bins stay where joint ones are moved
        for f in np.unique(np.append(0, np.flatnonzero(may))):
            key = place + bins[f].take(own)
            out[f, :, 0], out[f, :, 1] = np.bincount(key, g_own, out.shape[1]), np.bincount(key, h_own, out.shape[1])
        return out.reshape(features, len(parts), WIDTH, 2).transpose(1, 0, 2, 3)

    while depth < growth.depth and len(nodes) and len(nodes) * features * WIDTH * 2 <= TASK_ENTRIES and sum(map(len, held)) >= FEW_ROWS * len(nodes):
        if depth >= moved:
            alive, edges, moved = np.concatenate(held), np.cumsum([0, *map(len, held)]), depth + MOVED
            g, h = g.take(alive), None if h is None else h.take(alive)
            before, line = line, alive if line is None else line.take(alive)
            if paired and len(alive) >= PAIRED * len(nodes):
                paired = [(own, widths, number.take(alive)) for own, widths, number in paired]
            else:
                paired, bins = [], (all_bins.take(line, 1) if paired or before is None else bins.take(alive, 1))
            held = [np.arange(x, y, dtype=np.int32) for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
        if len(sums) == 0:
            sums = counted(held)
        else:  # ``sums`` are those of the parents
            sizes = np.array([len(r) for r in held]).reshape(-1, 2)
            smaller = 2 * np.arange(len(sizes)) + (sizes[:, 1] < sizes[:, 0])
            both = np.empty((len(nodes), features, WIDTH, 2))
            both[smaller] = counted([held[k] for k in smaller])
            rest = sums - both[smaller]
            rest[..., 0][rest[..., 1] < 0.5] = 0.0  # nothing is left in these, but for rounding
            both[smaller ^ 1] = rest
            sums = both
        found, good = _chosen(sums, growth, np.broadcast_to(allowed, (len(nodes), features)), twins)
        children, kept = tree.split(nodes[good], {k: v[good] for k, v in found.items()}), []
        for k, (node, own) in enumerate(zip(nodes.tolist(), held, strict=True)):
            if good[k]:
                f = int(tree.feature[node])
                beyond = np.arange(WIDTH) > tree.cut[node]
                beyond[MISSING] = not tree.missing_left[node]
                values = bins[f]
                for joint, widths, number in paired:
                    if f in joint:  # told by the joint bin, which stands side by side
                        i = joint.index(f)
                        beyond = np.tile(np.repeat(beyond[: widths[i]], math.prod(widths[i + 1 :])), math.prod(widths[:i]))
                        values = number
                kept += _parted(values, beyond, own)
            else:
                leaves.append((node, own if line is None else line.take(own)))
        nodes, held, sums = children, kept, sums[good]
        depth += 1
    bins, g, h = all_bins, all_g, all_h
    if line is not None:
        held = [line.take(own) for own in held]
    if depth == growth.depth or not len(nodes):
        return tree, [*leaves, *zip(nodes.tolist(), held, strict=True)]
    alive = np.concatenate(held)
    ended, node = [], np.zeros(len(g), np.int64)
    for k, own in zip(nodes.tolist(), held, strict=True):
        node[own] = k
    for _ in range(depth, growth.depth):
        if not len(nodes):
            break
        index = np.full(len(tree.feature), -1, np.int64)
        index[nodes] = np.arange(len(nodes))
        children = []
        step = max(1, TASK_ENTRIES // (features * WIDTH * 2))
        at = index[node[alive]]
        by_node = np.argsort(at, kind="stable")
        for low in range(0, len(nodes), step):
            own = nodes[low : low + step]
            first, last = np.searchsorted(at[by_node], [low, low + len(own)])
            rows = alive[by_node[first:last]]
            place = (index[node[rows]] - low) * WIDTH
            part = np.empty((features, len(own) * WIDTH, 2))
            for f in range(features):
                key = place + bins[f, rows]
                part[f, :, 0] = np.bincount(key, g[rows], len(own) * WIDTH)
                part[f, :, 1] = np.bincount(key, None if h is None else h[rows], len(own) * WIDTH)
            found, good = _chosen(part.reshape(features, len(own), WIDTH, 2).transpose(1, 0, 2, 3), growth, np.broadcast_to(may, (len(own), features)), twins)
            children.append(tree.split(own[good], {k: v[good] for k, v in found.items()}))
        nodes = np.concatenate(children)
        # Rows move to the children; those of leaves are done.
        f = tree.feature[node[alive]]
        ended.append(alive[f < 0])
        alive, f = alive[f >= 0], f[f >= 0]
        here = node[alive]
        b = bins[f, alive]
        node[alive] = tree.left[here] + np.where(b == MISSING, ~tree.missing_left[here], b > tree.cut[here])
    own = np.concatenate([*ended, alive])
    return tree, [*leaves, (node[own], own)]


def _splits(blocks, models: list[Lane], asked: list[_Open], features: int, allowed: np.ndarray, direct: bool) -> list[dict[str, np.ndarray]]:
    """The best split of each open node of the trees that are asked about."""
    may = [allowed[a.tree.segment[a.nodes]] & a.columns for a in asked]
    growths = [models[a.lane].growth for a in asked]

    def sums(part: Iterator[dict]) -> Iterator[list[np.ndarray]]:
        total = None
        for block in part:
            paired = _paired(block["bins"])
            own = [_block_sums(block, models[a.lane], a, features, paired) for a in asked]
            total = own if total is None else [x + y for x, y in zip(total, own, strict=True)]
        if total is not None:
            yield total

    if direct:
        parts = blocks.mapPartitions(sums).collect()
        if not parts:
            return [_nothing(len(a.nodes)) for a in asked]
        return [best_splits(sum(p[k] for p in parts), g, m) for k, (g, m) in enumerate(zip(growths, may, strict=True))]

    def ranges(part: Iterator[dict]) -> Iterator[tuple[tuple[int, int], np.ndarray]]:
        for total in sums(part):
            for k, own in enumerate(total):
                for low in range(0, len(own), RANGE):
                    yield (k, low), own[low : low + RANGE]

    def chosen(item: tuple[tuple[int, int], np.ndarray]) -> tuple[tuple[int, int], dict[str, np.ndarray]]:
        (k, low), own = item
        return item[0], best_splits(own, growths[k], may[k][low : low + RANGE])

    found = dict(blocks.mapPartitions(ranges).reduceByKey(np.add).map(chosen).collect())
    out = []
    for k, a in enumerate(asked):
        parts = [found[k, low] for low in range(0, len(a.nodes), RANGE) if (k, low) in found]
        out.append({c: np.concatenate([p[c] for p in parts]) for c in parts[0]} if parts else _nothing(len(a.nodes)))
    return out


def _nothing(n: int) -> dict[str, np.ndarray]:
    return {c: np.zeros(n) for c in ("g", "h", "gain", "feature", "cut", "missing_left", "g_left", "h_left")}


def with_segment_number(df: DataFrame, segment: str, segments: Sequence[str]) -> DataFrame:
    """``segment_number`` by a join with the names; none for others. Also on streams."""
    table = df.sparkSession.createDataFrame([(s, k) for k, s in enumerate(segments)], "segment_name string, segment_number int")
    return df.join(table, F.col(segment) == F.col("segment_name"), "left").drop("segment_name")


def _reached(sets: list[tuple[int, np.ndarray]], bins: np.ndarray) -> np.ndarray:
    """Leaves that all features of a tree leave over."""
    left = sets[0][1].take(bins[sets[0][0]])
    for f, table in sets[1:]:
        left &= table.take(bins[f])
    return left


def _lowest(bits: np.ndarray) -> np.ndarray:
    """The number of the lowest bit."""
    return np.bitwise_count((bits & (~bits + np.uint64(1))) - np.uint64(1))


class TreeModel:
    """Fitted trees of one model: scoring, importances, node table, files."""

    def __init__(self, features: list[str], growth: dict, cuts: list[np.ndarray], trees: list[Tree], base: np.ndarray, segment: str | None, segments: list) -> None:
        self.features, self.growth, self.segment, self.segments, self.base = features, Growth(**growth), segment, segments, base
        self.cuts, self.left_out_r2 = cuts, {}
        # One flat table of nodes: a tree's nodes after those of the trees before.
        sizes = np.array([len(t.feature) for t in trees], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

        def joined(parts: list[np.ndarray], kind: type) -> np.ndarray:
            return np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)

        self.feature = joined([t.feature for t in trees], np.int64)
        self.left = joined([t.left + s for t, s in zip(trees, self.starts, strict=False)], np.int64)
        self.missing_left = joined([t.missing_left for t in trees], bool)
        cut = joined([t.cut for t in trees], np.int64)
        self._leaf_sets: dict[int, list] = {}
        self._leaf_tables: dict[int, tuple] = {}
        self._walk: np.ndarray | None = None
        self.threshold = np.full(len(cut), np.nan)
        for f, own in enumerate(cuts):
            at = np.flatnonzero(self.feature == f)
            # A cut beyond the last is one between the present values and the missing ones.
            self.threshold[at] = np.append(own, np.inf)[np.minimum(cut[at], len(own))]
        self.value = joined([t.values(self.growth) for t in trees], float)
        self.gain, self.weight = joined([t.gain for t in trees], float), joined([t.h for t in trees], float)
        self.node_segment = joined([t.segment for t in trees], np.int64)

    @property
    def n_trees(self) -> int:
        return len(self.starts) - 1

    def first(self, trees: int) -> TreeModel:
        """The model of the first trees, which a booster of so many trees is."""
        own, stop = copy(self), int(self.starts[trees])
        for name in ("feature", "left", "missing_left", "threshold", "value", "gain", "weight", "node_segment"):
            setattr(own, name, getattr(self, name)[:stop])
        own.starts, own.growth, own._leaf_sets, own._leaf_tables, own._walk, own.left_out_r2 = self.starts[: trees + 1], replace(self.growth, trees=trees), {}, {}, None, {}
        return own

    def leaves(self, x: np.ndarray, segment: np.ndarray, tree: int) -> np.ndarray:
        """The leaf (in the flat table) that each row reaches; ``x`` has a line for each feature."""
        node = self.starts[tree] + segment
        row = np.arange(len(node))
        for _ in range(self.growth.depth):
            f = self.feature[node]
            inner = f >= 0
            if not inner.any():
                break
            value = x[np.maximum(f, 0), row]
            right = np.where(np.isnan(value), ~self.missing_left[node], value > self.threshold[node])
            node = np.where(inner, self.left[node] + right, node)
        return node

    def path_leaves(self, trees: int) -> Column:
        """Number of the leaf, within its tree, that a row reaches in each of the first trees."""
        count = len(self.features)

        def reach(*columns: pd.Series) -> pd.Series:
            x, segment = np.stack([c.to_numpy(float) for c in columns[:count]]), columns[count].to_numpy(np.int64)
            found = [self.leaves(x, segment, t) - self.starts[t] for t in range(min(trees, self.n_trees))]
            return pd.Series(list(np.stack(found, 1).astype(np.int32)) if found else [[] for _ in segment])

        number = F.col("segment_number") if self.segment else F.lit(0)
        return F.pandas_udf(reach, "array<int>")(*[F.col(c).cast("double") for c in self.features], number.cast("long"))

    def predict(self, x: np.ndarray, segment: np.ndarray | None = None) -> np.ndarray:
        segment = np.zeros(x.shape[1], np.int64) if segment is None else segment
        out = self.base[segment].astype(float)
        for values in self.each_tree(x, segment):
            out += values
        return out

    def each_tree(self, x: np.ndarray, segment: np.ndarray) -> Iterator[np.ndarray]:
        """What each tree adds to the prediction of each row."""
        parts = self._parts(x, segment)
        if parts is not None and len(parts) > 1:
            yield from self._of_few(parts, len(segment))
            return
        if parts is None:
            yield from self._of_walks(x, segment)
            return
        for t in range(self.n_trees):
            out = np.empty(len(segment))
            for s, rows, bins in parts:
                sets, values = self._sets(s)[t]
                out[rows] = values.take(_lowest(_reached(sets, bins))) if sets else values[0]
            yield out

    def _of_walks(self, x: np.ndarray, segment: np.ndarray) -> Iterator[np.ndarray]:
        """The same for trees of many leaves: rows are binned once and go down by their bins."""
        bins = np.stack([self._binned(c, f) for f, c in enumerate(x)]).astype(np.uint8) if len(x) else np.zeros((0, len(segment)), np.uint8)
        if self._walk is None:
            cut = np.zeros(len(self.feature), np.uint8)
            for f, own in enumerate(self.cuts):
                at = np.flatnonzero(self.feature == f)
                cut[at] = np.searchsorted(own, self.threshold[at], "left")
            self._walk = cut
        for t in range(self.n_trees):
            tree, own = Tree(1), slice(int(self.starts[t]), int(self.starts[t + 1]))
            tree.feature, tree.cut, tree.missing_left, tree.left = self.feature[own], self._walk[own], self.missing_left[own], self.left[own] - self.starts[t]
            yield self.value[own].take(tree.place(bins, segment, self.growth.depth))

    def _of_few(self, parts: list[tuple[int, np.ndarray, np.ndarray]], size: int) -> Iterator[np.ndarray]:
        """The same for rows of many segments, of which each has few: a step serves several trees
        of a segment."""
        held = {s: (*self._held_tables(s), rows, bins) for s, rows, bins in parts}
        step = max(1, TASK_ENTRIES // 8 // max(size, 1))
        for low in range(0, self.n_trees, step):
            out = np.empty((min(step, self.n_trees - low), size))
            for tables, values, used, rows, bins in held.values():
                left = np.full((len(out), len(rows)), 2**64 - 1, np.uint64)
                for f in np.flatnonzero(used[low : low + step].any(0)):
                    left &= tables[low : low + step, f].take(bins[f], 1)
                out[:, rows] = np.take_along_axis(values[low : low + step], _lowest(left).astype(np.intp), 1)
            yield from out

    def _held_tables(self, segment: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if segment not in self._leaf_tables:
            self._leaf_tables[segment] = self._tables(segment)
        return self._leaf_tables[segment]

    def _sets(self, segment: int = 0) -> list[tuple[list[tuple[int, np.ndarray]], np.ndarray]] | None:
        """For each tree of a segment ``(sets, values)``. ``sets`` has for each feature that the tree
        splits on, by bin, the leaves that its tests leave over, as bits in the order of the leaves;
        the first leaf that all features leave over is the one that a row reaches. Trees with
        more than 64 leaves have none."""
        if self.growth.depth > 6:
            return None
        if segment not in self._leaf_sets:
            tables, values, used = self._tables(segment)
            self._leaf_sets[segment] = [([(int(f), tables[t, f]) for f in np.flatnonzero(used[t])], values[t]) for t in range(self.n_trees)]
        return self._leaf_sets[segment]

    def _tables(self, segment: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The leaf sets by (tree, feature, bin), the values of the leaves by (tree, leaf), and which
        features a tree splits on. All trees of the segment go down together, level by level."""
        trees, features = self.n_trees, len(self.features)
        nodes, of = self.starts[:-1] + segment, np.arange(trees)
        levels = []
        while len(nodes):
            inner = self.feature[nodes] >= 0
            levels.append((nodes, of, inner))
            nodes, of = (self.left[nodes[inner]][:, None] + np.arange(2)).reshape(-1), np.repeat(of[inner], 2)
        # Leaves below each node, and the number of the first of them.
        below = [np.ones(len(nodes), np.int64) for nodes, _, _ in levels]
        for k in range(len(levels) - 2, -1, -1):
            below[k][levels[k][2]] = below[k + 1].reshape(-1, 2).sum(1)
        first, values = np.zeros(trees, np.int64), np.zeros((trees, 64))
        tables, missing = np.full((trees * features, WIDTH), 2**64 - 1, np.uint64), np.full(trees * features, 2**64 - 1, np.uint64)
        used = np.zeros(trees * features, bool)
        for k, (nodes, of, inner) in enumerate(levels):
            values[of[~inner], first[~inner]] = self.value[nodes[~inner]]
            nodes, start = nodes[inner], first[inner]
            if not len(nodes):
                break
            f, left = self.feature[nodes], below[k + 1][::2]
            # Bins beyond a cut leave over all but the leaves on its left.
            without = ~(((np.uint64(1) << left.astype(np.uint64)) - np.uint64(1)) << start.astype(np.uint64))
            at, beyond = of[inner] * features + f, np.empty(len(nodes), np.int64)
            for own in np.unique(f):
                mine = f == own
                beyond[mine] = np.searchsorted(self.cuts[own], self.threshold[nodes[mine]], "left") + 1
            used[at] = True
            np.bitwise_and.at(tables.reshape(-1), at * WIDTH + beyond, without)
            right = ~self.missing_left[nodes]
            np.bitwise_and.at(missing, at[right], without[right])
            first = np.stack([start, start + left], 1).reshape(-1)
        tables = np.bitwise_and.accumulate(tables, axis=1)
        tables[:, MISSING] = missing
        return tables.reshape(trees, features, WIDTH), values, used.reshape(trees, features)

    def _binned(self, x: np.ndarray, feature: int) -> np.ndarray:
        return np.where(np.isnan(x), MISSING, np.searchsorted(self.cuts[feature], x, "left"))

    def _parts(self, x: np.ndarray, segment: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]] | None:
        """The rows of each segment and their bins; none without leaf sets."""
        if self._sets() is None:
            return None
        bins = np.stack([self._binned(c, f) for f, c in enumerate(x)])
        if len(self.base) == 1:
            return [(0, np.arange(len(segment)), bins)]
        return [(int(s), rows, np.ascontiguousarray(bins[:, rows])) for s in np.unique(segment) for rows in [np.flatnonzero(segment == s)]]

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_leaf_sets": {}, "_leaf_tables": {}, "_walk": None}

    def prediction(self) -> Column:
        """The prediction as an expression of the features (and ``segment_number``)."""
        count = len(self.features)

        def score(*columns: pd.Series) -> pd.Series:
            x = np.stack([c.to_numpy(float) for c in columns[:count]])
            segment = columns[count].to_numpy(float)
            known = ~np.isnan(segment)
            out = self.predict(x, np.where(known, segment, 0).astype(np.int64))
            return pd.Series(np.where(known, out, np.nan))

        number = F.col("segment_number") if self.segment else F.lit(0)
        return F.pandas_udf(score, "double")(*[F.col(c).cast("double") for c in self.features], number.cast("double"))

    def transform(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        """Add the prediction; rows of an unknown segment get none."""
        if self.segment is None:
            return df.withColumn(output, self.prediction())
        found = with_segment_number(df, self.segment, self.segments).withColumn(output, F.nanvl(self.prediction(), F.lit(None).cast("double")))
        return found.drop("segment_number")

    def rescored(self, x: np.ndarray, segment: np.ndarray, row: np.ndarray, feature: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Predictions of ``row`` (of ``x``) with one ``feature`` at another ``value``, for as many
        triples. Only trees that split on the feature are walked again."""
        if self._sets() is not None:
            return self._rescored_by_sets(x, segment, row, feature, value)
        tree = np.repeat(np.arange(self.n_trees), np.diff(self.starts))
        inner = self.feature >= 0
        used = np.zeros((len(self.features), self.n_trees, len(self.base)), bool)
        used[self.feature[inner], tree[inner], self.node_segment[inner]] = True
        before = np.stack([self.value[self.leaves(x, segment, t)] for t in range(self.n_trees)]) if self.n_trees else np.zeros((0, x.shape[1]))
        out = (self.base[segment] + before.sum(0))[row]
        for f in np.unique(feature):
            own = np.flatnonzero(feature == f)
            changed, at = x[:, row[own]], segment[row[own]]
            changed[f] = value[own]
            for t in range(self.n_trees):
                walked = np.flatnonzero(used[f, t, at])
                if len(walked):
                    out[own[walked]] += self.value[self.leaves(changed[:, walked], at[walked], t)] - before[t, row[own[walked]]]
        return out

    def _rescored_by_sets(self, x: np.ndarray, segment: np.ndarray, row: np.ndarray, feature: np.ndarray, value: np.ndarray) -> np.ndarray:
        """The same by leaf sets: what a tree's other features leave over is found once for all
        values of a feature."""
        out = np.empty(len(row))
        asked: dict[int, list[tuple[int, np.ndarray, np.ndarray]]] = {}
        for f in np.unique(feature):
            own = np.flatnonzero(feature == f)
            bins, of = self._binned(value[own], int(f)), segment[row[own]]
            for s in np.unique(of):
                at = np.flatnonzero(of == s)
                asked.setdefault(int(s), []).append((int(f), own[at], bins[at]))
        for s, rows, bins in self._parts(x, segment):
            place = np.zeros(x.shape[1], np.int64)
            place[rows] = np.arange(len(rows))
            base, changes = np.full(len(rows), float(self.base[s])), {f: (own, b, place[row[own]], np.zeros(len(own))) for f, own, b in asked.get(s, [])}
            for sets, values in self._sets(s):
                if not sets:
                    base += values[0]
                    continue
                taken = [table.take(bins[f]) for f, table in sets]
                # What the features before, and those after, leave over.
                before, after = [None], [None]
                for own in taken:
                    before.append(own if before[-1] is None else before[-1] & own)
                for own in taken[:0:-1]:
                    after.append(own if after[-1] is None else after[-1] & own)
                as_is = values.take(_lowest(before[-1]))
                base += as_is
                for k, (f, table) in enumerate(sets):
                    if f in changes:
                        _, changed, at, total = changes[f]
                        a, b = before[k], after[len(sets) - 1 - k]
                        others = b if a is None else a if b is None else a & b
                        reached = table.take(changed)
                        if others is not None:
                            reached &= others.take(at)
                        total += values.take(_lowest(reached)) - as_is.take(at)
            for own, _, at, total in changes.values():
                out[own] = base.take(at) + total
        return out

    def what_if(self, which: Column, values: Column) -> Column:
        """For each feature number in the array ``which`` and each of its test values in the
        array of arrays ``values``: the prediction with that feature at that value."""
        count = len(self.features)

        def score(*columns: pd.Series) -> pd.Series:
            x, segment = np.stack([c.to_numpy(float) for c in columns[:count]]), columns[count].to_numpy(float)
            known = ~np.isnan(segment)
            lists = columns[count + 2].tolist()
            sizes = np.array([len(v) for given in lists for v in given], np.int64)
            if not sizes.sum():
                return pd.Series([[[] for _ in given] for given in lists])
            row, feature = np.repeat(np.arange(len(lists)), [len(given) for given in lists]), np.concatenate([np.asarray(own, np.int64) for own in columns[count + 1]])
            value = np.concatenate([np.asarray(v, float) for given in lists for v in given])
            row, feature = np.repeat(row, sizes), np.repeat(feature, sizes)
            out, asked = np.full(len(row), np.nan), np.flatnonzero(known[row])
            out[asked] = self.rescored(x, np.where(known, segment, 0).astype(np.int64), row[asked], feature[asked], value[asked])
            edges = np.append(0, np.cumsum(sizes)).tolist()
            parts = iter([out[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)])
            return pd.Series([[next(parts) for _ in given] for given in lists])

        number = F.col("segment_number") if self.segment else F.lit(0)
        return F.pandas_udf(score, "array<array<double>>")(*[F.col(c).cast("double") for c in self.features], number.cast("double"), which, values)

    def importances(self, segment: int | None = None) -> np.ndarray:
        """Mean gain of the splits on each feature, scaled to sum 1."""
        inner = self.feature >= 0
        if segment is not None:
            inner &= self.node_segment == segment
        total = np.bincount(self.feature[inner], self.gain[inner], len(self.features))
        mean = total / np.maximum(np.bincount(self.feature[inner], minlength=len(self.features)), 1)
        return mean / mean.sum() if mean.sum() else mean

    def staged_metrics(self, df: DataFrame, target: str = "y") -> DataFrame:
        """``trees``, ``n``, ``mse``, ``rmse``, ``mae`` and ``r2`` of every prefix of the trees, by
        running sums in one pass over the rows."""
        rows = df if self.segment is None else with_segment_number(df, self.segment, self.segments)
        number = F.col("segment_number") if self.segment else F.lit(0)
        rows = rows.where(number.isNotNull()).select(F.col(target).cast("double").alias("y"), number.cast("int").alias("segment"), *[F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate(self.features)])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            squares, errors = np.zeros(self.n_trees + 1), np.zeros(self.n_trees + 1)
            for batch in batches:
                y, segment, *x = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
                x, segment = np.stack(x), segment.astype(np.int64)
                predicted = self.base[segment].astype(float)
                for t, values in enumerate(chain([0.0], self.each_tree(x, segment))):
                    predicted += values
                    error = predicted - y
                    squares[t] += error @ error
                    errors[t] += np.abs(error).sum()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(self.n_trees + 1, dtype=np.int32)), pa.array(squares), pa.array(errors)], names=["trees", "squares", "errors"])

        sums = rows.mapInArrow(run, "trees int, squares double, errors double").groupBy("trees").agg(F.sum("squares").alias("s"), F.sum("errors").alias("e"))
        size = rows.agg(F.count("*").alias("n"), F.var_pop("y").alias("v"))
        mse = F.try_divide(F.col("s"), F.col("n"))
        return sums.crossJoin(size).select("trees", "n", mse.alias("mse"), F.sqrt(mse).alias("rmse"), F.try_divide(F.col("e"), F.col("n")).alias("mae"), (1 - F.try_divide(mse, F.col("v"))).alias("r2")).orderBy("trees")

    def nodes(self, trees: int | None = None) -> list[tuple]:
        """``(tree, node, segment, feature, threshold, missing_left, left, right, value, gain, weight)``."""
        stop = int(self.starts[self.n_trees if trees is None else min(trees, self.n_trees)])
        tree = np.searchsorted(self.starts, np.arange(stop), "right") - 1
        inner = self.feature[:stop] >= 0
        own = np.arange(stop) - self.starts[tree]
        left = np.where(inner, self.left[:stop] - self.starts[tree], -1)
        return list(zip(
            tree.tolist(), own.tolist(), self.node_segment[:stop].tolist(), self.feature[:stop].tolist(), np.where(inner, self.threshold[:stop], 0.0).tolist(),
            self.missing_left[:stop].tolist(), left.tolist(), np.where(inner, left + 1, -1).tolist(), self.value[:stop].tolist(), self.gain[:stop].tolist(), self.weight[:stop].tolist(), strict=True,
        ))

    NODES = "tree int, node int, segment int, feature int, threshold double, missing_left boolean, left int, right int, value double, gain double, weight double"

    def save(self, spark: SparkSession, path: str) -> None:
        """Nodes as Parquet, all else as one line of text."""
        facts = {"features": self.features, "growth": asdict(self.growth), "segment": self.segment, "segments": self.segments, "base": self.base.tolist(), "starts": self.starts.tolist(), "cuts": [c.tolist() for c in self.cuts]}
        spark.createDataFrame(self.nodes(), self.NODES).write.mode("overwrite").parquet(f"{path}/nodes")
        spark.createDataFrame([(json.dumps(facts),)], "facts string").coalesce(1).write.mode("overwrite").text(f"{path}/facts")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TreeModel:
        facts = json.loads(spark.read.text(f"{path}/facts").first()[0])
        model = cls(facts["features"], facts["growth"], [np.array(c) for c in facts["cuts"]], [], np.array(facts["base"]), facts["segment"], facts["segments"])
        rows = spark.read.parquet(f"{path}/nodes").orderBy("tree", "node").toArrow()
        model.starts = np.array(facts["starts"], np.int64)
        shift = model.starts[rows["tree"].to_numpy()]
        for name in ("feature", "threshold", "missing_left", "value", "gain", "weight"):
            setattr(model, name, rows[name].to_numpy())
        model.feature = model.feature.astype(np.int64)
        model.left, model.node_segment = rows["left"].to_numpy() + shift, rows["segment"].to_numpy().astype(np.int64)
        return model


def _stored(number: int, tree: Tree, growth: Growth) -> tuple:
    """A row of the table of trees: one column for scoring, one for all else."""
    inner = tree.feature >= 0
    left = np.where(inner, tree.left, 0).astype(np.int32)
    score = [tree.values(growth), left, tree.feature.astype(np.int16), tree.cut, tree.missing_left.astype(np.uint8)]
    return number, len(inner), bytearray(b"".join(a.tobytes() for a in score)), bytearray(tree.gain.tobytes() + tree.h.tobytes())


def _restored(score, nodes: int) -> tuple[Tree, np.ndarray]:
    """A tree as far as rows need it to find their leaves, and the values of its nodes."""
    tree, at, parts = Tree(1), 0, []
    for kind in (np.float64, np.int32, np.int16, np.uint8, np.uint8):
        parts.append(np.frombuffer(score, kind, nodes, at))
        at += parts[-1].nbytes
    values, tree.left, tree.feature, tree.cut, missing = parts
    tree.missing_left = missing.astype(bool)
    return tree, values


class StoredForest:
    """A fitted forest as a written table of its trees. Rows to be scored are packed into blocks,
    each block meets each tree, and the sums that a task found for a block go back to its rows."""

    TREES = "number int, nodes int, score binary, facts binary"

    def __init__(self, features: list[str], growth: Growth, cuts: list[np.ndarray], trees: DataFrame) -> None:
        self.features, self.growth, self.cuts, self.trees = features, growth, cuts, trees

    def transform(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        """Add the prediction; all columns are kept."""
        features, cuts, depth = self.features, self.cuts, self.growth.depth
        numbers = [F.col(c).cast("double").alias(f"_x{k}") for k, c in enumerate(features)]

        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            first, held, size, count = (TaskContext.get().partitionId() << 32), [], 0, 0

            def emit() -> pa.RecordBatch:
                rows = pa.Table.from_batches(held).combine_chunks()
                own, x = rows.select(rows.column_names[: -len(features)]), rows.column_names[-len(features) :]
                bins = np.empty((len(features), len(rows)), np.uint8)
                for f, c in enumerate(x):
                    values = rows[c].to_numpy()
                    bins[f] = np.where(np.isnan(values), MISSING, np.searchsorted(cuts[f], values, "left"))
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, own.schema) as out:
                    out.write_table(own)
                return pa.RecordBatch.from_arrays([pa.array([first + count], pa.int64()), pa.array([bins.tobytes()], pa.binary()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "bins", "rows"])

            for batch in batches:
                for low in range(0, batch.num_rows, SCORED_ROWS):
                    held.append(batch.slice(low, SCORED_ROWS))
                    size += held[-1].num_rows
                    if size >= SCORED_ROWS:
                        yield emit()
                        held, size, count = [], 0, count + 1
            if held:
                yield emit()

        def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block, total = None, None

            def emit() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["block", "sums"])

            for batch in batches:
                for number, bins, score, nodes in zip(*(batch.column(c) for c in ("block", "bins", "score", "nodes")), strict=True):
                    if number.as_py() != block:
                        if block is not None:
                            yield emit()
                        block, own = number.as_py(), np.frombuffer(bins.as_buffer(), np.uint8).reshape(len(features), -1)
                        total = np.zeros(own.shape[1])
                    tree, values = _restored(score.as_buffer(), nodes.as_py())
                    total += values.take(tree.place(own, np.zeros(own.shape[1], np.int64), depth))
            if block is not None:
                yield emit()

        def back(rows: pa.Table, sums: pa.Table) -> pa.Table:
            own = pa.ipc.open_stream(rows["rows"][0].as_buffer()).read_all()
            return own.append_column(output, pa.array(sum(np.frombuffer(s.as_buffer()) for s in sums["sums"])))

        blocks = settle(df.select("*", *numbers).mapInArrow(packed, "block long, bins binary, rows binary"), "forest-rows")
        pairs = blocks.select("block", "bins").crossJoin(self.trees.select("score", "nodes"))
        sums = pairs.mapInArrow(met, "block long, sums binary")
        schema = StructType([*df.schema.fields, StructField(output, DoubleType())])
        return blocks.select("block", "rows").groupBy("block").cogroup(sums.groupBy("block")).applyInArrow(back, schema)


def out_of_fold_models(df: DataFrame, features: Sequence[str], growths: Mapping[str, Growth], fold: str, folds: int, target: str = "y", **more) -> dict[tuple[int, str], TreeModel]:
    """For each growth the models that leave out each fold, and, as fold ``folds``, that of all
    rows, all grown together."""
    lanes = {f"{k}|{name}": Lane(g, k if k < folds else None) for name, g in growths.items() for k in range(folds + 1)}
    fitted = fit_many(df, features, lanes, target, fold, **more)
    return {(int(n.split("|", 1)[0]), n.split("|", 1)[1]): model for n, model in fitted.items()}
