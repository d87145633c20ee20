"""Random forests whose trees are grown side by side, each by one task.

A pass over the rows for every group of nodes, as the library's estimator makes it, costs a job per group: deep
trees over many terms take hundreds.  Here every row is reduced to (term, bin) numbers of three bytes, all tasks get
those, and a task grows whole trees level by level.  The method is the library's: Poisson weights for every tree, the
same thresholds, ``sqrt`` of the features drawn for every node, Gini gain, equal siblings merged; only its random numbers
are drawn tree by tree, so a tree depends on neither memory limits nor the other trees.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

from textvane.functions.scores import argmax_index
from textvane.session import checkpointed

# performance only
FOREST_BYTES = 128 << 20  # of binned rows that go to every task; the library's estimator takes what is larger
TREES_PER_TASK = 4
FEATURE_BLOCKS = 48
STEP_ELEMENTS, STEP_NODES = 1 << 18, 24  # that a task deals with at once

SPLIT_SAMPLE = 10_000  # fixed value: rows from which the library takes its thresholds
ROUNDING = 1e-12  # a gain below it is none

TREE = "tree int, feature binary, threshold binary, after binary, votes binary"


def fit_forest(estimator: RandomForestClassifier, train: DataFrame, rows: int, limit: int = FOREST_BYTES):
    """The fitted forest of ``estimator`` over ``train`` of so many rows."""
    get = lambda name: estimator.getOrDefault(name)
    vectors = train.select(F.col(get("featuresCol")).alias("x"), F.col(get("labelCol")).cast("double").alias("y"))
    first = vectors.where("x is not null").first()
    if first is None:
        return estimator.fit(train)
    width, bins = first.x.size, min(get("maxBins"), rows)
    thresholds = _thresholds(vectors, rows, bins, width, get("seed"))
    binned = checkpointed(vectors.mapInArrow(_binned(thresholds), "lengths binary, feature binary, bin binary, label binary"))
    size = binned.agg(F.sum(F.length("feature") + F.length("bin") + F.length("lengths") + F.length("label"))).first()[0] or 0
    if size > limit:
        return estimator.fit(train)
    chunks = binned.collect()
    joined = lambda name, kind: np.frombuffer(b"".join(c[name] for c in chunks), kind)
    data = (joined("lengths", "<i4"), joined("feature", "<u4" if width > 1 << 16 else "<u2"), joined("bin", "u1"), joined("label", "<i4"))
    n_classes = int(data[3].max()) + 1
    spark = train.sparkSession
    held = spark.sparkContext.broadcast(data)
    trees = get("numTrees")
    tasks = spark.range(0, trees, 1, math.ceil(trees / TREES_PER_TASK))
    grown = tasks.mapInArrow(_grown(held, thresholds, n_classes, bins, get("seed"), get("maxDepth")), TREE)
    found = sorted(grown.collect(), key=lambda r: r.tree)
    held.destroy()
    del held, data, chunks
    kinds = (("feature", "<i4"), ("threshold", "<f8"), ("after", "<i4"))
    feature, threshold, after = ([np.frombuffer(r[c], kind) for r in found] for c, kind in kinds)
    votes = np.concatenate([np.frombuffer(r.votes, "<f8").reshape(-1, n_classes) for r in found])
    roots, lines = (np.cumsum(n) - n for n in (np.array([f.size for f in feature]), np.array([(f < 0).sum() for f in feature])))
    after = [np.where(f < 0, a + line, a + root).astype(np.int32) for f, a, root, line in zip(feature, after, roots, lines)]
    trees = Trees(width, roots, np.concatenate(feature), np.concatenate(threshold), np.concatenate(after), votes)
    return ForestModel(estimator, trees)


def _vectors(x: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features that each row lists, their numbers, their values) of sparse or dense vectors."""
    if x.null_count:
        raise ValueError("a row has no features")
    x = x.storage if isinstance(x, pa.ExtensionArray) else x
    kind, indices, values = (x.field(k) for k in (0, 2, 3))
    dense = kind.to_numpy() == 1
    lengths = np.diff(values.offsets.to_numpy()).astype(np.int64)
    value, number = values.flatten().to_numpy(), indices.flatten().to_numpy().astype(np.int64)
    if dense.any():
        owner = np.repeat(np.arange(lengths.size), lengths)
        place = np.arange(value.size) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        place[~dense[owner]] = number
        number = place
    return lengths, number, value


def _labels(x: pa.Array) -> np.ndarray:
    label = x.to_numpy(zero_copy_only=False)
    if not ((label >= 0) & (label == np.floor(label))).all():
        raise ValueError("labels are whole numbers from 0")
    return label.astype("<i4")


def _thresholds(vectors: DataFrame, rows: int, bins: int, width: int, seed: int) -> list[np.ndarray]:
    """Of each feature the values between its bins, by the library's rule."""
    wanted = max(bins * bins, SPLIT_SAMPLE)
    share = min(1.0, wanted / rows)
    sample = vectors if share == 1 else vectors.sample(False, share, seed)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, number, value = _vectors(batch.column(0))
            parts = [(b, at) for b in range(FEATURE_BLOCKS) if (at := np.flatnonzero(number % FEATURE_BLOCKS == b)).size]
            columns = [pa.array([b for b, _ in parts], pa.int32())]
            columns += [pa.array([x[at].tobytes() for _, at in parts], pa.binary()) for x in (number.astype("<u4"), value.astype("<f8"))]
            yield pa.RecordBatch.from_arrays(columns, ["block", "number", "value"])

    def split(table: pa.Table) -> pa.Table:
        number, value = (np.frombuffer(b"".join(table.column(c).to_pylist()), kind) for c, kind in (("number", "<u4"), ("value", "<f8")))
        order = np.lexsort((value, number))
        number, value = number[order], value[order]
        found, starts = np.unique(number, return_index=True)
        cuts = [_cuts(part, rows * share, bins) for part in np.split(value, starts[1:])]
        columns = [pa.array(found.tolist(), pa.int32()), pa.array([x.tolist() for x in cuts], pa.list_(pa.float64()))]
        return pa.Table.from_arrays(columns, ["feature", "cuts"])

    pieces = sample.mapInArrow(blocks, "block int, number binary, value binary")
    out = [np.empty(0)] * width
    for row in pieces.groupBy("block").applyInArrow(split, "feature int, cuts array<double>").collect():  # a row a feature
        out[row.feature] = np.array(row.cuts)
    return out


def _cuts(values: np.ndarray, rows: float, bins: int) -> np.ndarray:
    """Thresholds of a feature with these sorted values; all other rows have a zero."""
    distinct, counts = np.unique(values, return_counts=True)
    zeros = rows - values.size
    if zeros >= 0.5:
        at = int(np.searchsorted(distinct, 0.0))
        if at < distinct.size and distinct[at] == 0:
            counts = counts + np.where(np.arange(counts.size) == at, round(zeros), 0)
        else:
            distinct, counts = np.insert(distinct, at, 0.0), np.insert(counts, at, round(zeros))
    middles = (distinct[1:] + distinct[:-1]) / 2
    if middles.size < bins:
        return middles
    stride = rows / bins
    target, below, kept = stride, counts[0], []
    for i, count in enumerate(counts[1:].tolist()):
        if abs(below - target) < abs(below + count - target):
            kept.append(i)
            target += stride
        below += count
    return middles[kept[: bins - 1]]


def _table(thresholds: list[np.ndarray]) -> np.ndarray:
    """The thresholds as rows of one length, filled up with infinity."""
    table = np.full((len(thresholds), max(1, max(map(len, thresholds)))), np.inf)
    for row, cuts in zip(table, thresholds):
        row[: len(cuts)] = cuts
    return table


def _binned(thresholds: list[np.ndarray]):
    """For ``mapInArrow`` over (vector, label): the rows as numbers of features and bins."""
    table = _table(thresholds)
    kind = "<u4" if len(table) > 1 << 16 else "<u2"

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, number, value = _vectors(batch.column(0))
            bin_ = np.zeros(value.size, np.uint8)
            for k in range(table.shape[1]):
                bin_ += value > table[number, k]
            parts = (lengths.astype("<i4"), number.astype(kind), bin_, _labels(batch.column(1)))
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in parts], ["lengths", "feature", "bin", "label"])

    return binned


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all these ranges, one after the other."""
    return np.arange(lengths.sum()) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)


def _drawn(rng: np.random.Generator, nodes: int, width: int, wanted: int) -> np.ndarray:
    """Different features for each node, all sets alike."""
    if 2 * wanted > width:
        return rng.permuted(np.tile(np.arange(width), (nodes, 1)), axis=1)[:, :wanted]
    out = np.sort(rng.integers(0, width, (nodes, wanted)), axis=1)
    while True:
        again = np.zeros(out.shape, bool)
        again[:, 1:] = out[:, 1:] == out[:, :-1]
        if not again.any():
            return out
        out[again] = rng.integers(0, width, int(again.sum()))
        out.sort(axis=1)


class _Rows:
    """Binned rows, by row and by feature."""

    def __init__(self, data: tuple, thresholds: list[np.ndarray], n_classes: int, bins: int):
        lengths, self.feature, self.bin, self.label = data
        self.lengths = lengths.astype(np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.n, self.width, self.n_classes, self.bins = lengths.size, len(thresholds), n_classes, bins
        order = np.argsort(self.feature, kind="stable")
        self.row_of = np.repeat(np.arange(self.n, dtype=np.int32), lengths)[order]
        self.bin_of = self.bin[order]
        self.counts = np.bincount(self.feature, minlength=self.width)
        self.firsts = np.cumsum(self.counts) - self.counts
        self.zero_bin = np.array([np.searchsorted(x, 0.0) for x in thresholds])

    def grow(self, rng: np.random.Generator, depth: int) -> dict[str, np.ndarray]:
        """A tree's nodes in arrays; a node's children come after it, a leaf has -1."""
        weight = rng.poisson(1.0, self.n).astype(np.float64)
        rows = np.flatnonzero(weight)
        wanted = math.ceil(math.sqrt(self.width))
        stats = [np.bincount(self.label[rows], weight[rows], self.n_classes)[None, :]]
        parts, total = [], 1
        slot = np.full(self.n, -1, np.int64)  # which of the open nodes a row is in
        slot[rows] = 0
        open_ = np.zeros(1, np.int64) if stats[0].max() < stats[0].sum() else np.empty(0, np.int64)
        held = stats[0]
        for level in range(depth):
            if not open_.size:
                break
            drawn = _drawn(rng, open_.size, self.width, wanted)
            gain, feature, cut, left = self._best(drawn, slot, weight, held)
            split = np.flatnonzero(gain > ROUNDING)
            first = total + 2 * np.arange(split.size)
            parts.append((open_[split], feature[split], cut[split], gain[split], first))
            pair = np.stack([left[split], held[split] - left[split]], 1).reshape(-1, self.n_classes)
            stats.append(pair)
            ids = np.stack([first, first + 1], 1).ravel()
            total += ids.size
            going = np.flatnonzero((pair.max(1) < pair.sum(1)) & (level + 1 < depth))
            place = np.full(ids.size, -1)
            place[going] = np.arange(going.size)
            slot = self._moved(slot, split, feature, cut, place)
            open_, held = ids[going], pair[going]
        found = [np.concatenate(x) for x in zip(*parts)] if parts else [np.empty(0, np.int64)] * 5
        tree = {"stats": np.concatenate(stats)}
        for name, empty, values in zip(("feature", "cut", "gain", "left"), (-1, -1, -1.0, -1), found[1:]):
            tree[name] = np.full(total, empty, np.float64 if name == "gain" else np.int64)
            tree[name][found[0]] = values
        return tree

    def _best(self, drawn: np.ndarray, slot: np.ndarray, weight: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, ...]:
        """(gain, feature, last bin on the left, classes on the left) of each open node's best split."""
        nodes = len(drawn)
        rows = np.flatnonzero(slot >= 0)
        rows = rows[np.argsort(slot[rows], kind="stable")]
        count = np.bincount(slot[rows], minlength=nodes)
        ends = np.cumsum(count)
        by_row = np.bincount(slot[rows], self.lengths[rows], nodes).astype(np.int64)
        by_feature = self.counts[drawn].sum(1)
        cost = np.minimum(by_row, by_feature)
        out = [np.full(nodes, -1.0), np.zeros(nodes, np.int64), np.zeros(nodes, np.int64), np.zeros((nodes, self.n_classes))]
        seen, x = np.cumsum(cost), 0
        while x < nodes:
            y = int(np.searchsorted(seen, (seen[x - 1] if x else 0) + STEP_ELEMENTS, side="right"))
            y = min(max(y, x + 1), x + STEP_NODES, nodes)
            own = rows[ends[x] - count[x] : ends[y - 1]]
            fewer = by_row[x:y] <= by_feature[x:y]
            found = self._step(drawn[x:y], own, slot, x, weight, held[x:y], fewer)
            for whole, part in zip(out, found):
                whole[x:y] = part
            x = y
        return tuple(out)

    def _step(self, drawn, rows, slot, first, weight, held, fewer) -> tuple[np.ndarray, ...]:
        """``_best`` of some nodes; those with ``fewer`` values in their rows than in their features go through the rows."""
        nodes, wanted = drawn.shape
        pairs, owners, bins = [], [], []
        if fewer.any():
            place = np.full((nodes, self.width), -1, np.int16 if wanted < 1 << 15 else np.int32)
            np.put_along_axis(place, drawn, np.arange(wanted, dtype=place.dtype)[None, :], 1)
            own = rows[fewer[slot[rows] - first]]
            at = _ranges(self.starts[own], self.lengths[own])
            owner = np.repeat(own, self.lengths[own])
            node = slot[owner] - first
            nth = place[node, self.feature[at]]
            kept = np.flatnonzero(nth >= 0)
            pairs.append(node[kept] * wanted + nth[kept])
            owners.append(owner[kept])
            bins.append(self.bin[at[kept]])
        if not fewer.all():
            node = np.flatnonzero(~fewer)
            feature = drawn[node].ravel()
            at = _ranges(self.firsts[feature], self.counts[feature])
            pair = np.repeat((node[:, None] * wanted + np.arange(wanted)).ravel(), self.counts[feature])
            owner = self.row_of[at]
            kept = np.flatnonzero(slot[owner] == pair // wanted + first)
            pairs.append(pair[kept])
            owners.append(owner[kept])
            bins.append(self.bin_of[at[kept]])
        pair, owner, bin_ = (np.concatenate(x) for x in (pairs, owners, bins))
        none = np.full(nodes, -1.0), np.zeros(nodes, np.int64), np.zeros(nodes, np.int64), np.zeros((nodes, self.n_classes))
        met = np.flatnonzero(np.bincount(pair, minlength=nodes * wanted))  # a feature none of its rows has splits no node
        if not met.size:
            return none
        number = np.zeros(nodes * wanted, np.int64)
        number[met] = np.arange(met.size)
        cell = (self.label[owner].astype(np.int64) * met.size + number[pair]) * self.bins + bin_
        hist = np.bincount(cell, weight[owner], self.n_classes * met.size * self.bins).reshape(self.n_classes, met.size, self.bins)
        node, feature = met // wanted, drawn.ravel()[met]
        whole = held[node].T
        hist[:, np.arange(met.size), self.zero_bin[feature]] += whole - hist.sum(2)
        left = np.cumsum(hist, axis=2)[:, :, :-1]
        n = whole.sum(0)[:, None]
        n_left = left.sum(0)
        n_right = n - n_left
        right = whole[:, :, None] - left
        with np.errstate(divide="ignore", invalid="ignore"):
            within = np.einsum("cpb,cpb->pb", left, left) / n_left + np.einsum("cpb,cpb->pb", right, right) / n_right
        gain = np.where((n_left > 0) & (n_right > 0), (within - (whole * whole).sum(0)[:, None] / n) / n, -1.0)
        cut = gain.argmax(1)
        best = gain[np.arange(met.size), cut]
        starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        most = np.maximum.reduceat(best, starts)
        chosen = np.flatnonzero(best == np.repeat(most, np.diff(np.r_[starts, met.size])))
        chosen = chosen[np.r_[True, node[chosen][1:] != node[chosen][:-1]]]
        for out, part in zip(none, (best[chosen], feature[chosen], cut[chosen], left[:, chosen, cut[chosen]].T)):
            out[node[chosen]] = part
        return none

    def _moved(self, slot, split, feature, cut, place) -> np.ndarray:
        """The rows' open nodes after the splits; ``place`` has those of the children."""
        nth = np.full(int(slot.max()) + 1, -1)
        nth[split] = np.arange(split.size)
        of = np.where(slot >= 0, nth[slot], -1)
        rows = np.flatnonzero(of >= 0)
        side = np.zeros(self.n, np.int64)
        side[rows] = (self.zero_bin[feature[split]] > cut[split])[of[rows]]
        chosen = feature[split]
        at = _ranges(self.firsts[chosen], self.counts[chosen])
        owner, mine = self.row_of[at], np.repeat(np.arange(split.size), self.counts[chosen])
        kept = of[owner] == mine
        side[owner[kept]] = self.bin_of[at[kept]] > cut[split][mine[kept]]
        out = np.full(self.n, -1, np.int64)
        out[rows] = place[2 * of[rows] + side[rows]]
        return out


def _merged(tree: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Without sibling leaves of the same class, and the nodes that are left numbered anew."""
    left, best = tree["left"].copy(), tree["stats"].argmax(1)
    for node in np.flatnonzero(left >= 0)[::-1].tolist():
        x = left[node]
        if left[x] < 0 and left[x + 1] < 0 and best[x] == best[x + 1]:
            left[node] = -1
    kept = np.zeros(left.size, bool)
    kept[0] = True
    for node in np.flatnonzero(left >= 0).tolist():
        if kept[node]:
            kept[left[node] : left[node] + 2] = True
    left = np.where(kept, left, -1)
    number = np.cumsum(kept) - 1
    out = {k: v[kept] for k, v in tree.items()} | {"left": np.where(left >= 0, number[left], -1)[kept]}
    leaf = out["left"] < 0
    return out | {"feature": np.where(leaf, -1, out["feature"]), "gain": np.where(leaf, -1.0, out["gain"])}


def _grown(held, thresholds: list[np.ndarray], n_classes: int, bins: int, seed: int, depth: int):
    """For ``mapInArrow`` over tree numbers: a row of arrays for each tree."""
    table = _table(thresholds)

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = None
        for batch in batches:
            for tree in batch.column(0).to_pylist():
                rows = _Rows(held.value, thresholds, n_classes, bins) if rows is None else rows
                grown = _merged(rows.grow(np.random.default_rng([seed, tree]), depth))
                feature, left = grown["feature"], grown["left"]
                leaf = left < 0
                threshold = np.where(leaf, 0.0, table[feature, grown["cut"]])
                stats = grown["stats"][leaf]
                votes = stats / np.maximum(stats.sum(1), 1)[:, None]  # a tree that got no row has no vote
                after = np.where(leaf, np.cumsum(leaf) - 1, left)
                parts = (feature.astype("<i4"), threshold.astype("<f8"), after.astype("<i4"), votes.astype("<f8"))
                columns = [pa.array([tree], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in parts)]
                yield pa.RecordBatch.from_arrays(columns, ["tree", "feature", "threshold", "after", "votes"])

    return grow


@dataclass(frozen=True)
class Trees:
    """The nodes of all trees: a leaf has the feature -1, and its line of the votes instead of its left child."""

    width: int
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    after: np.ndarray
    votes: np.ndarray

    def sums(self, lengths: np.ndarray, number: np.ndarray, value: np.ndarray) -> np.ndarray:
        """The trees' votes for the classes of each row, added up."""
        out, ends = np.zeros((lengths.size, self.votes.shape[1])), np.cumsum(lengths)
        step = max(1, STEP_ELEMENTS // max(self.width, self.roots.size))
        for x in range(0, lengths.size, step):
            own = lengths[x : x + step]
            some = slice(ends[x] - own[0], ends[x + own.size - 1])
            wide = np.zeros((own.size, self.width))
            wide[np.repeat(np.arange(own.size), own), number[some]] = value[some]
            row, at = np.repeat(np.arange(own.size), self.roots.size), np.tile(self.roots, own.size)
            going = np.flatnonzero(self.feature[at] >= 0)
            while going.size:
                here = at[going]
                at[going] = self.after[here] + (wide[row[going], self.feature[here]] > self.threshold[here])
                going = going[self.feature[at[going]] >= 0]
            out[x : x + step] = self.votes[self.after[at]].reshape(own.size, self.roots.size, -1).sum(1)
        return out


class ForestModel:
    """A fitted forest, with the columns and the prediction of the library's model."""

    def __init__(self, estimator: RandomForestClassifier, trees: Trees):
        self.trees = trees
        self.names = [estimator.getOrDefault(f"{x}Col") for x in ("features", "rawPrediction", "probability", "prediction")]
        self.totalNumNodes = trees.feature.size
        self._held = None

    def transform(self, df: DataFrame) -> DataFrame:
        if self._held is None:
            self._held = df.sparkSession.sparkContext.broadcast(tuple(vars(self.trees).values()))
        held, (features, raw, probability, prediction) = self._held, self.names

        @F.arrow_udf("array<double>")
        def voted(x: pa.Array) -> pa.Array:
            return pa.array(Trees(*held.value).sums(*_vectors(x)).tolist(), pa.list_(pa.float64()))

        scored = df.withColumn("_votes", voted(features))
        total = F.aggregate("_votes", F.lit(0.0), lambda a, v: a + v)
        shares = F.transform("_votes", lambda v: F.when(total > 0, v / total).otherwise(v))
        return (
            scored.withColumn(raw, array_to_vector("_votes"))
            .withColumn(probability, array_to_vector(shares))
            .withColumn(prediction, argmax_index(F.col("_votes")).cast("double"))
            .drop("_votes")
        )

    def predict(self, features) -> float:
        """The class of one vector."""
        value = features.toArray()
        number = np.flatnonzero(value)
        return float(self.trees.sums(np.array([number.size]), number, value[number])[0].argmax())
