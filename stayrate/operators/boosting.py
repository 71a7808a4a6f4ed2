"""Gradient-boosted trees for a whole grid of parameters, grown from histograms.

Features are binned once. A level of all models then takes one aggregation: every block of rows adds
up gradients and curvatures per (model, node, feature, bin), blocks are summed, and the best split
of every node is read from the sums. Models of the grid grow side by side, so the number of steps
is that of the longest model, not the sum over the grid.

Rows lie in blocks of at most BLOCK_ROWS; up to BESIDE_BLOCKS of them are one block. With a single block its
sums are the sums of all rows, so each model grows next to the block without an exchange per level, the
models in parallel.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Mapping, Sequence
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, cloudpickle
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayrate.sources.checkpoints import shared_dir

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors have no copy of the package

BLOCK_ROWS = 250_000
#: A row takes a byte a feature and 16 more; while a tree grows also a byte a feature and about 60 more.
BESIDE_BLOCKS = 4
BINS = 64
#: Penalty on leaf values and least curvature of a leaf, the usual defaults.
LEAF_PENALTY, LEAST_CURVATURE = 1.0, 1.0
#: Margins of so many trees are recomputed at most when an executor is lost.
TREES_BETWEEN_CHECKPOINTS = 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Params(NamedTuple):
    """One model of the grid."""

    max_depth: int
    learning_rate: float
    n_trees: int
    positive_weight: float
    row_share: float
    feature_share: float


class Block(NamedTuple):
    """Binned rows, their labels, and a random number each."""

    bins: np.ndarray
    label: np.ndarray
    draw: np.ndarray


class Tree(NamedTuple):
    """A tree in heap order: node i has the children 2i + 1 and 2i + 2; feature -1 is a leaf."""

    feature: np.ndarray
    split: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    @classmethod
    def of_depth(cls, depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return cls(np.full(n, -1, np.int16), np.zeros(n, np.uint8), np.zeros(n, np.float32), np.zeros(n, np.float32))

    def step(self, bins: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Where rows at ``node`` are one level on; those at leaves stay."""
        feature = self.feature.take(node)
        at = np.arange(len(bins)) * bins.shape[1] + np.maximum(feature, 0)
        right = bins.reshape(-1).take(at) > self.split.take(node)
        return np.where(feature >= 0, 2 * node + 1 + right, node)

    def nodes(self, bins: np.ndarray, levels: int) -> np.ndarray:
        """Where rows are after ``levels`` steps."""
        node = np.zeros(len(bins), np.int64)
        for _ in range(levels):
            node = self.step(bins, node)
        return node


def tree_features(n_features: int, share: float, seed: int, tree: int) -> np.ndarray:
    """The features that a tree may split on."""
    n = max(1, round(share * n_features))
    return np.sort(np.random.default_rng([seed, tree]).permutation(n_features)[:n])


def tree_rows(draw: np.ndarray, share: float, seed: int, tree: int) -> np.ndarray:
    """The rows that a tree is grown from."""
    if share >= 1:
        return np.ones(len(draw), bool)
    x = (draw ^ np.uint64(seed * 1_000_003 + tree)) * _MIX
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(32)) < np.uint64(int(share * (1 << 32)))


def gradients(label: np.ndarray, margin: np.ndarray, positive_weight: float) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivative of the weighted log loss at ``margin``."""
    p = 1 / (1 + np.exp(-margin))
    weight = np.where(label > 0, positive_weight, 1.0)
    return weight * (p - label), weight * p * (1 - p)


class Sample(NamedTuple):
    """What a tree is grown from: rows, their bins for each feature, gradients and curvatures."""

    rows: np.ndarray
    bins: list[np.ndarray]
    both: tuple[np.ndarray, np.ndarray]


def sampled(block: Block, margin: np.ndarray, params: Params, number: int, seed: int) -> Sample:
    """The sample of tree ``number`` of a model."""
    features = tree_features(block.bins.shape[1], params.feature_share, seed, number)
    rows = np.flatnonzero(tree_rows(block.draw, params.row_share, seed, number))
    bins = [block.bins[:, feature][rows] for feature in features]
    return Sample(rows, bins, gradients(block.label[rows], margin[rows], params.positive_weight))


def level_sums(sample: Sample, node: np.ndarray, opened: np.ndarray) -> np.ndarray:
    """Gradients and curvatures of the ``opened`` nodes of a level, given each row's node: 2 x nodes x features x bins."""
    # One feature at a time, whose sums stay near the CPU; rows at other nodes share a place after the opened ones.
    place = np.full(max(int(opened.max()), int(node.max(initial=0))) + 1, len(opened), np.int64)
    place[opened] = np.arange(len(opened))
    at = place.take(node.take(sample.rows)) * BINS
    sums = np.empty((2, len(opened), len(sample.bins), BINS))
    for f, bins in enumerate(sample.bins):
        cell = at + bins
        for i, x in enumerate(sample.both):
            sums[i, :, f] = np.bincount(cell, x, (len(opened) + 1) * BINS).reshape(-1, BINS)[:-1]
    return sums


def best_splits(sums: np.ndarray) -> np.ndarray:
    """Per node: feature (its place among the tree's), bin, gain, and the leaf values left, right and of the node."""
    g, h = sums
    whole_g, whole_h = g[:, :1].sum(axis=2, keepdims=True), h[:, :1].sum(axis=2, keepdims=True)
    left_g, left_h = np.cumsum(g, axis=2), np.cumsum(h, axis=2)
    right_g, right_h = whole_g - left_g, whole_h - left_h
    quality = lambda a, b: a * a / (b + LEAF_PENALTY)
    gain = quality(left_g, left_h) + quality(right_g, right_h) - quality(whole_g, whole_h)
    gain[(left_h < LEAST_CURVATURE) | (right_h < LEAST_CURVATURE)] = -np.inf
    nodes = np.arange(len(gain))
    best = gain.reshape(len(gain), -1).argmax(axis=1)
    feature, split = best // gain.shape[2], best % gain.shape[2]
    leaf = lambda a, b: -a / (b + LEAF_PENALTY)
    values = [leaf(a[nodes, feature, split], b[nodes, feature, split]) for a, b in ((left_g, left_h), (right_g, right_h))]
    whole = leaf(whole_g[:, 0, 0], whole_h[:, 0, 0])
    return np.stack([feature, split, gain[nodes, feature, split], *values, whole], axis=1)


def split_nodes(tree: Tree, opened: np.ndarray, found: np.ndarray, features: np.ndarray, rate: float) -> np.ndarray:
    """Split ``opened`` where that gains; the nodes that this opens."""
    if len(opened) and opened[0] == 0:
        tree.value[0] = rate * found[0, 5]
    gains = found[:, 2] > 1e-9
    nodes, found = opened[gains], found[gains]
    tree.feature[nodes] = features[found[:, 0].astype(int)]
    tree.split[nodes], tree.gain[nodes] = found[:, 1], found[:, 2]
    tree.value[2 * nodes + 1], tree.value[2 * nodes + 2] = rate * found[:, 3], rate * found[:, 4]
    return np.sort(np.concatenate((2 * nodes + 1, 2 * nodes + 2)))


def grow_beside(block: Block, params: Params, seed: int) -> list[Tree]:
    """All trees of a model whose rows are one block."""
    margin, trees = np.zeros(len(block.label)), []
    for number in range(params.n_trees):
        tree, opened = Tree.of_depth(params.max_depth), np.zeros(1, np.int64)
        features = tree_features(block.bins.shape[1], params.feature_share, seed, number)
        sample, node = sampled(block, margin, params, number, seed), np.zeros(len(margin), np.int64)
        for _ in range(params.max_depth):
            opened = split_nodes(tree, opened, best_splits(level_sums(sample, node, opened)), features, params.learning_rate)
            if not len(opened):
                break
            node = tree.step(block.bins, node)
        margin += tree.value[node]
        trees.append(tree)
    return trees


def grow_together(blocks: RDD, n_features: int, grid: Sequence[Params], seed: int) -> list[list[Tree]]:
    """All trees of all models over many blocks, with one aggregation per level."""
    state = blocks.map(lambda b: (b, np.zeros((len(grid), len(b.label))))).persist(StorageLevel.MEMORY_AND_DISK)
    models: list[list[Tree]] = [[] for _ in grid]
    for number in range(max(p.n_trees for p in grid)):
        active = [i for i, p in enumerate(grid) if number < p.n_trees]
        trees = {i: Tree.of_depth(grid[i].max_depth) for i in active}
        opened = {i: np.zeros(1, np.int64) for i in active}
        for level in range(max(grid[i].max_depth for i in active)):
            live = {i: nodes for i, nodes in opened.items() if len(nodes) and level < grid[i].max_depth}
            if not live:
                break

            def sums(one, live=live, trees=trees, number=number, level=level):
                block, margins = one
                samples = {i: sampled(block, margins[i], grid[i], number, seed) for i in live}
                return [(i, level_sums(samples[i], trees[i].nodes(block.bins, level), live[i])) for i in live]

            found = state.flatMap(sums).reduceByKey(np.add).mapValues(best_splits).collect()
            for i, splits in found:
                features = tree_features(n_features, grid[i].feature_share, seed, number)
                opened[i] = split_nodes(trees[i], live[i], splits, features, grid[i].learning_rate)

        def moved(one, trees=trees):
            block, margins = one
            margins = margins.copy()
            for i, tree in trees.items():
                margins[i] += tree.value[tree.nodes(block.bins, grid[i].max_depth)]
            return block, margins

        before, state = state, state.map(moved).persist(StorageLevel.MEMORY_AND_DISK)
        if number % TREES_BETWEEN_CHECKPOINTS == TREES_BETWEEN_CHECKPOINTS - 1:
            state.checkpoint()
        state.count()
        before.unpersist()
        for i, tree in trees.items():
            models[i].append(tree)
    state.unpersist()
    return models


class BoostedTrees:
    """A fitted model: ``transform`` adds ``probability`` to frames of feature vectors."""

    def __init__(self, edges: list[np.ndarray], feature: np.ndarray, split: np.ndarray, value: np.ndarray, gain: np.ndarray):
        """``edges`` between the bins of each feature, and trees x nodes of what a ``Tree`` holds."""
        self.edges, self.n_trees = edges, len(feature)
        self.feature, self.split, self.value, self.gain = feature, split, value, gain

    def first_trees(self, n_trees: int) -> BoostedTrees:
        """The model of the first ``n_trees`` trees, as a fit of so many gives."""
        return BoostedTrees(self.edges, *(x[:n_trees] for x in (self.feature, self.split, self.value, self.gain)))

    def probabilities(self, values: np.ndarray, stages: Sequence[int]) -> np.ndarray:
        """Per number of trees in ``stages`` (ascending) and row the probability of label 1."""
        bins = binned(values, self.edges)
        margin, found = np.zeros(len(bins)), []
        depth = int(np.log2(self.feature.shape[1] + 1)) - 1
        for number in range(max(stages)):
            tree = Tree(self.feature[number], self.split[number], self.value[number], self.gain[number])
            margin += tree.value[tree.nodes(bins, depth)]
            found += [margin.copy()] * list(stages).count(number + 1)
        return 1 / (1 + np.exp(-np.array(found)))

    def transform(self, vectors: DataFrame) -> DataFrame:
        p = staged([(self, [self.n_trees])], vectors)[0]
        return vectors.withColumn("probability", array_to_vector(F.array(1 - p, p)))

    def gains(self) -> np.ndarray:
        """Per feature its mean gain per split, as shares of their sum; 0 where it is never split on."""
        used, n = self.feature >= 0, len(self.edges)
        times = np.bincount(self.feature[used], minlength=n)
        mean = np.bincount(self.feature[used], self.gain[used], n) / np.maximum(times, 1)
        return mean / (mean.sum() or 1.0)


def binned(values: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    """The bin of every value: how many edges lie below it."""
    columns = [np.searchsorted(e, values[:, f], "left").astype(np.uint8) for f, e in enumerate(edges)]
    return np.stack(columns, axis=1) if columns else np.zeros((len(values), 0), np.uint8)


def _matrix(vectors: pa.Array, width: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), width)


def staged(models: Sequence[tuple[BoostedTrees, Sequence[int]]], vectors: DataFrame) -> Column:
    """An array of probabilities of label 1: for each model, one per number of trees asked of it."""
    parts = [(model.edges, model.feature, model.split, model.value, model.gain, list(stages)) for model, stages in models]
    shipped = vectors.sparkSession.sparkContext.broadcast(parts)  # bounded by the grid

    @F.arrow_udf("array<double>")
    def scored(column: pa.Array) -> pa.Array:
        known = [(BoostedTrees(edges, *arrays), stages) for edges, *arrays, stages in shipped.value]
        values = _matrix(column, len(known[0][0].edges))
        found = np.concatenate([model.probabilities(values, stages) for model, stages in known])
        ends = np.arange(len(values) + 1, dtype=np.int32) * len(found)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(found.T.ravel()))

    return scored(vector_to_array("features"))


def bin_edges(train: DataFrame, n_features: int) -> list[np.ndarray]:
    """Per feature at most BINS - 1 edges between bins, at quantiles of the train rows."""
    values = train.select(vector_to_array("features").alias("v")).select(*(F.col("v")[i].alias(f"f{i}") for i in range(n_features)))
    shares = [i / BINS for i in range(1, BINS)]
    found = values.approxQuantile(values.columns, shares, 0.1 / BINS) if n_features else []
    return [np.unique(np.array(edges, float)) for edges in found]


def train_blocks(train: DataFrame, edges: list[np.ndarray], label: str = "lapsed") -> tuple[DataFrame, int]:
    """Binned rows in blocks of about BLOCK_ROWS, or one if that makes few, and the number of blocks."""
    n_blocks = -(-train.count() // BLOCK_ROWS)
    n_blocks = 1 if n_blocks <= BESIDE_BLOCKS else n_blocks
    shipped = train.sparkSession.sparkContext.broadcast(edges)
    ids = [c for c in ("customer_id", "snapshot") if c in train.columns]
    values = vector_to_array("features").alias("values")
    rows = train.select(F.xxhash64(*ids, vector_to_array("features")).alias("draw"), F.col(label).cast("double").alias("label"), values)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, parts = shipped.value, []
        for batch in batches:
            bins = binned(_matrix(batch.column("values"), len(known)), known)
            parts.append((batch.column("draw").to_numpy().view(np.uint64), batch.column("label").to_numpy(), bins))
        if parts:
            draw, label, bins = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((label, draw))  # sums do not depend on how rows arrived
            own = [x[order].tobytes() for x in (draw, label, bins)]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in own], ["draw", "label", "bins"])

    return rows.repartition(max(n_blocks, 1), "draw").mapInArrow(packed, "draw binary, label binary, bins binary"), n_blocks


def _unpacked(row: Any, n_features: int) -> Block:
    draw, label = np.frombuffer(row["draw"], np.uint64), np.frombuffer(row["label"], float)
    return Block(np.frombuffer(row["bins"], np.uint8).reshape(len(draw), n_features), label, draw)


def fit_grid(train: DataFrame, grid: Sequence[Params], seed: int) -> list[BoostedTrees]:
    """One model per entry of ``grid`` on the rows of ``train`` (``features``, ``lapsed``)."""
    context = train.sparkSession.sparkContext
    first = train.select(F.size(vector_to_array("features")).alias("n")).first()
    if first is None:
        raise ValueError("no rows to fit on")
    edges = bin_edges(train, first["n"])
    packed, n_blocks = train_blocks(train, edges)
    n_features = len(edges)
    if n_blocks == 1:
        shared = context.broadcast(tuple(_unpacked(packed.first(), n_features)))  # at most BESIDE_BLOCKS * BLOCK_ROWS rows
        order = sorted(range(len(grid)), key=lambda i: -grid[i].n_trees * 2 ** grid[i].max_depth)
        jobs = context.parallelize([(i, grid[i]) for i in order], len(order))
        found = dict(jobs.map(lambda job: (job[0], grow_beside(Block(*shared.value), job[1], seed))).collect())
        models = [found[i] for i in range(len(grid))]
    else:
        shared_dir(train.sparkSession)
        models = grow_together(packed.rdd.map(lambda row: _unpacked(row, n_features)), n_features, grid, seed)
    return [BoostedTrees(edges, *(np.stack(x) for x in zip(*trees, strict=True))) for trees in models]


def grid_params(entry: Mapping[str, Any]) -> Params:
    return Params(
        int(entry["max_depth"]),
        float(entry["learning_rate"]),
        int(entry["n_trees"]),
        float(entry["positive_weight"]),
        float(entry.get("row_share", 0.8)),
        float(entry.get("feature_share", 0.8)),
    )
