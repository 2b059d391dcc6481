"""Decision trees over binned features, grown best first for many settings and row splits at once.

A node of a tree is a box: a range of bins for each feature. One aggregation counts, for all boxes that any tree waits for,
the classes by feature, bin and row split; it serves every fold, criterion and setting, because a fold's training
counts are the whole less its own, and because trees that split alike ask for the same box. All trees then go on as far
as the counts carry them, so the number of aggregations is that of the splits of the largest tree, whatever the
number of settings and folds. Validation counts come with the same aggregation: no model is applied to score a setting.

The counted table has one row per distinct combination of bins, class and split membership. What the driver holds follows
the trees (boxes, features, bins, folds, classes) and not the rows.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.binning import count_above
from tabloom.operators.learn import class_values
from tabloom.session import staging_path
from tabloom.sources.inline import inline_table

MAX_BINS = 64
BOXES = 256
AHEAD = 2
_EPS = 1e-9

Box = tuple[tuple[int, int], ...]


@dataclass(frozen=True)
class Setting:
    """What bounds a tree; ``leaves`` is the largest number of leaves."""

    criterion: str
    depth: int
    min_split: int
    min_leaf: int
    leaves: int

    def __str__(self) -> str:
        return (f"criterion={self.criterion}, max_depth={self.depth}, min_split={self.min_split}, "
                f"min_leaf={self.min_leaf}, max_leaves={self.leaves}")


def settings(criteria: Iterable[str], depths: Iterable[int], min_splits: Iterable[int], min_leaves: Iterable[int],
             leaves: Iterable[int]) -> list[Setting]:
    """Every combination, in order."""
    return [Setting(*s) for s in itertools.product(criteria, depths, min_splits, min_leaves, leaves)]


@dataclass(frozen=True)
class Bins:
    """Upper edges of the bins of each feature: bin i holds values above edge i - 1 and not above edge i."""

    features: tuple[str, ...]
    edges: tuple[tuple[float, ...], ...]

    @property
    def whole(self) -> Box:
        return tuple((0, len(e)) for e in self.edges)

    def columns(self) -> list[Column]:
        return [count_above(F.col(f), [F.lit(x) for x in e]).cast("int").alias(f"x{i}")
                for i, (f, e) in enumerate(zip(self.features, self.edges))]


def bins(df: DataFrame, features: Sequence[str], most: int = MAX_BINS) -> Bins:
    """A bin per value of a feature that has ``most`` values or fewer, else bins between quantiles, all found in one pass."""
    marks = F.array(*[F.lit(i / most) for i in range(1, most)])
    cuts = df.agg(*[F.percentile_approx(F.col(f).cast("double"), marks, F.lit(100 * most)).alias(f"q{i}")
                    for i, f in enumerate(features)]).first()
    edges = []
    for f, own in zip(features, cuts):
        values = df.select(F.col(f).cast("double")).where(F.col(f).isNotNull()).distinct().limit(most + 1).collect()
        few = sorted(r[0] for r in values)
        edges.append(tuple(few[:-1] if len(few) <= most else sorted(set(own))))
    return Bins(tuple(features), tuple(edges))


def cells(df: DataFrame, binned: Bins, label: str, classes: Sequence, part: Column) -> DataFrame:
    """(x0…, y, part, n): how many rows share bins, class and ``part``; rows with a null feature or label are left out.

    ``part`` is a fold number, or a number whose bit s says whether the row is in the training part of split s.
    """
    known = df.dropna(subset=[*binned.features, label])
    y = (F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label)) - 1).cast("int")
    rows = known.select(*binned.columns(), y.alias("y"), part.cast("int").alias("part"))
    path = staging_path(df.sparkSession, "cells")
    rows.groupBy(*rows.columns).agg(F.count("*").alias("n")).write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _counted(boxes: np.ndarray, width: int, counters: int, classes: int, masks: bool):
    """Counts of a task: for each box a table by feature, bin, counter and class; only cells that are not zero go out."""
    n_boxes, n_features, _ = boxes.shape
    size = width * counters * classes

    def run(batches):
        total = np.zeros((n_boxes, n_features, size))
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            x, y, part, n = cols[:n_features], cols[-3], cols[-2], cols[-1]
            for b in range(n_boxes):
                inside = np.ones(len(y), bool)
                for f in range(n_features):
                    low, high = boxes[b, f]
                    if low > 0 or high < width - 1:
                        inside &= (x[f] >= low) & (x[f] <= high)
                at = np.flatnonzero(inside)
                if not len(at):
                    continue
                own, weight, member = y[at], n[at], part[at]
                for f in range(n_features):
                    code = x[f][at].astype(np.int64) * counters * classes + own
                    if not masks:
                        total[b, f] += np.bincount(code + member * classes, weight, size)
                        continue
                    total[b, f] += np.bincount(code + (counters - 1) * classes, weight, size)
                    for s in range(counters - 1):
                        on = member >> s & 1 == 1
                        total[b, f] += np.bincount(code[on] + s * classes, weight[on], size)
        at = np.flatnonzero(total)
        flat = total.reshape(-1)
        for a in range(0, len(at), 1 << 16):
            some = at[a:a + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(flat[some].astype(np.int64))], ["cell", "n"])

    return run


@dataclass
class _Node:
    """What all folds know of a box: class counts, and the best split per criterion and smallest leaf."""

    train: np.ndarray  # by fold and class
    valid: np.ndarray
    best: dict[tuple[str, int], tuple] = field(default_factory=dict)


def _impurity(counts: np.ndarray, criterion: str) -> np.ndarray:
    """Impurity times rows, over the last axis."""
    n = counts.sum(-1)
    safe = np.maximum(n, 1)
    if criterion == "gini":
        return n - (counts**2).sum(-1) / safe
    share = counts / safe[..., None]
    return -(counts * np.log2(np.where(share > 0, share, 1.0))).sum(-1)


def _node(train: np.ndarray, valid: np.ndarray, box: Box, kinds: set[tuple[str, int]]) -> _Node:
    """The best split of a box for each fold from counts by feature, bin, fold and class; first feature and bin on ties."""
    node = _Node(train[0].sum(0), valid[0].sum(0))
    left, left_valid = train.cumsum(1), valid.cumsum(1)
    right = node.train - left
    n_left, n_right = left.sum(-1), right.sum(-1)
    width = train.shape[1]
    inside = np.zeros(train.shape[:2], bool)
    for f, (low, high) in enumerate(box):
        inside[f, low:high] = True
    for criterion in {c for c, _ in kinds}:
        gain = _impurity(node.train, criterion) - _impurity(left, criterion) - _impurity(right, criterion)
        gain = np.round(gain, 9)  # equal splits tie whatever the order of sums
        for m in {m for c, m in kinds if c == criterion}:
            ok = inside[:, :, None] & (n_left >= m) & (n_right >= m)
            flat = np.where(ok, gain, -1.0).reshape(-1, gain.shape[-1])
            at = flat.argmax(0)
            k = np.arange(len(at))
            node.best[criterion, m] = (flat[at, k], at // width, at % width, left[at // width, at % width, k],
                                       left_valid[at // width, at % width, k])
    return node


class _Grower:
    """One tree on one split of the rows; it stops where counts are missing and goes on when they are there."""

    def __init__(self, fold: int, setting: Setting, stops: Sequence[int], whole: Box):
        self.fold, self.setting, self.stops = fold, setting, sorted(stops)
        self.heap: list[tuple] = []
        self.waiting: list[tuple[Box, int]] = [(whole, 0)]
        self.leaves, self.right = 1, None
        self.scores: dict[int, int] = {}
        self.splits: dict[Box, tuple] = {}
        self.shares: dict[Box, np.ndarray] = {}
        self.order = itertools.count()
        self.whole = whole

    def grow(self, nodes: dict[Box, _Node]) -> list[Box]:
        """Boxes that are waited for; none once the tree is done."""
        k, s = self.fold, self.setting
        kind = s.criterion, s.min_leaf
        while True:
            missing = [b for b, _ in self.waiting if b not in nodes]
            if missing:
                return missing + self._ahead(nodes)
            if self.right is None:
                root = nodes[self.whole]
                self._leaf(self.whole, root.train[k])
                self.right = int(root.valid[k][root.train[k].argmax()])
                self._note()
            for box, depth in self.waiting:
                gain = nodes[box].best[kind][0][k]
                if gain > _EPS:
                    heapq.heappush(self.heap, (-gain, next(self.order), box, depth))
            self.waiting = []
            if not self.heap or self.leaves >= self.stops[-1]:
                for stop in self.stops:
                    self.scores.setdefault(stop, self.right)
                return []
            _, _, box, depth = heapq.heappop(self.heap)
            self._split(nodes[box], box, depth, kind)
            self._note()

    def _note(self) -> None:
        if self.leaves in self.stops:
            self.scores[self.leaves] = self.right

    def _leaf(self, box: Box, train: np.ndarray) -> None:
        self.shares[box] = train / max(train.sum(), 1)

    def _children(self, node: _Node, box: Box, kind) -> list[tuple]:
        k = self.fold
        _, f, b, left, left_valid = (x[k] for x in node.best[kind])
        low, high = box[f]
        sides = ((low, int(b)), left, left_valid), ((int(b) + 1, high), node.train[k] - left, node.valid[k] - left_valid)
        return [(box[:f] + (edge,) + box[f + 1:], train, valid) for edge, train, valid in sides]

    def _may_split(self, train: np.ndarray, depth: int) -> bool:
        n = train.sum()
        return depth < self.setting.depth and n >= max(self.setting.min_split, 2 * self.setting.min_leaf) and train.max() < n

    def _split(self, node: _Node, box: Box, depth: int, kind) -> None:
        k = self.fold
        self.right -= int(node.valid[k][node.train[k].argmax()])
        self.splits[box] = (int(node.best[kind][1][k]), int(node.best[kind][2][k]), [])
        for child, train, valid in self._children(node, box, kind):
            self.splits[box][2].append(child)
            self._leaf(child, train)
            self.right += int(valid[train.argmax()])
            if self._may_split(train, depth + 1):
                self.waiting.append((child, depth + 1))
        self.leaves += 1
        if self.leaves >= self.stops[-1]:
            self.waiting = []

    def _ahead(self, nodes: dict[Box, _Node]) -> list[Box]:
        """Children of the leaves that are likely to be split next."""
        kind = self.setting.criterion, self.setting.min_leaf
        return [child for _, _, box, depth in heapq.nsmallest(AHEAD, self.heap)
                for child, train, _ in self._children(nodes[box], box, kind)
                if child not in nodes and self._may_split(train, depth + 1)]


def _grow(counted: DataFrame, binned: Bins, n_classes: int, folds: int, masks: bool, growers: list[_Grower]) -> dict[Box, _Node]:
    nodes: dict[Box, _Node] = {}
    kinds = {(g.setting.criterion, g.setting.min_leaf) for g in growers}
    width = max(len(e) for e in binned.edges) + 1
    counters = folds + masks
    columns = [f"x{i}" for i in range(len(binned.features))] + ["y", "part", "n"]
    counted = counted.select(*columns)
    while True:
        wanted = list(dict.fromkeys(b for g in growers for b in g.grow(nodes)))
        if not wanted:
            return nodes
        for a in range(0, len(wanted), BOXES):
            boxes = wanted[a:a + BOXES]
            count = counted.mapInArrow(_counted(np.array(boxes), width, counters, n_classes, masks), "cell bigint, n bigint")
            got = count.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
            table = np.zeros(len(boxes) * len(binned.features) * width * counters * n_classes)
            table[got["cell"].to_numpy()] = got["n"].to_numpy()
            table = table.reshape(len(boxes), len(binned.features), width, counters, n_classes)
            for box, own in zip(boxes, table):
                whole = own[:, :, -1:] if masks else own.sum(2, keepdims=True)
                train = own[:, :, :folds] if masks else whole - own
                nodes[box] = _node(train, whole - train, box, kinds)


def search(counted: DataFrame, binned: Bins, n_classes: int, grid: Sequence[Setting], folds: int, masks: bool = False) -> list[float]:
    """The mean accuracy of each setting on the validation rows of all folds, or with ``masks`` of all splits.

    Settings that differ in the number of leaves alone share their trees: a tree with fewer leaves is an earlier
    state of the larger one.
    """
    stops: dict[tuple, list[int]] = {}
    for s in grid:
        stops.setdefault((s.criterion, s.depth, s.min_split, s.min_leaf), []).append(s.leaves)
    growers = {(k, key): _Grower(k, Setting(*key, max(leaves)), leaves, binned.whole)
               for key, leaves in stops.items() for k in range(folds)}
    nodes = _grow(counted, binned, n_classes, folds, masks, list(growers.values()))
    size = nodes[binned.whole].valid.sum(1)
    return [float(np.mean([growers[k, (s.criterion, s.depth, s.min_split, s.min_leaf)].scores[s.leaves] / size[k]
                           for k in range(folds) if size[k]] or [0.0])) for s in grid]


@dataclass(frozen=True)
class Tree:
    """A grown tree: the split of each box that has one, and the class shares of every box."""

    binned: Bins
    classes: tuple
    splits: dict
    shares: dict

    def _walk(self, leaf, box: Box | None = None) -> Column:
        box = self.binned.whole if box is None else box
        if box not in self.splits:
            return F.lit(leaf(self.shares[box]))
        f, b, (left, right) = self.splits[box]
        low = F.col(self.binned.features[f]) <= F.lit(self.binned.edges[f][b])
        return F.when(low, self._walk(leaf, left)).otherwise(self._walk(leaf, right))

    def predicted(self) -> Column:
        return self._walk(lambda shares: self.classes[int(shares.argmax())])

    def score(self, positive) -> Column:
        """The share of class ``positive`` among the training rows of the leaf."""
        return self._walk(lambda shares: float(shares[self.classes.index(positive)]))

    @property
    def leaves(self) -> int:
        return len(self.splits) + 1


def fit(df: DataFrame, features: Sequence[str], label: str, setting: Setting, binned: Bins | None = None) -> Tree:
    """One tree on all rows of ``df``."""
    binned = binned or bins(df, features)
    classes = class_values(df, label)
    grower = _Grower(0, setting, [setting.leaves], binned.whole)
    _grow(cells(df, binned, label, classes, F.lit(1)), binned, len(classes), 1, True, [grower])
    return Tree(binned, tuple(classes), grower.splits, grower.shares)


def scores_table(df: DataFrame, grid: Sequence[Setting], scores: Sequence[float]) -> DataFrame:
    """(params, score, is_best): the first of the best settings is the best."""
    best = int(np.argmax(np.round(scores, 12)))
    rows = [(str(g), s, i == best) for i, (g, s) in enumerate(zip(grid, scores))]
    return inline_table(df.sparkSession, rows, "params string, score double, is_best boolean")


def grid_search(df: DataFrame, features: Sequence[str], label: str, grid: Sequence[Setting], part: Column, folds: int,
                masks: bool = False, binned: Bins | None = None) -> tuple[list[float], Setting]:
    """Mean accuracy of each setting, and the best of them. ``part``: see ``cells``."""
    binned = binned or bins(df, features)
    classes = class_values(df, label)
    scores = search(cells(df, binned, label, classes, part), binned, len(classes), grid, folds, masks)
    return scores, grid[int(np.argmax(np.round(scores, 12)))]


def mask(flags: Sequence[Column]) -> Column:
    """Split membership as one number: bit s is set where flag s is true."""
    bits = [F.when(f, F.lit(1 << s)).otherwise(F.lit(0)) for s, f in enumerate(flags)]
    out = bits[0]
    for b in bits[1:]:
        out = out + b
    return out
