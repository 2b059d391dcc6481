"""The tree grower against single fits by the plain definition."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.operators import sampling as sa
from tabloom.operators import trees as tr
from tabloom.plans import QUERIES

FEATURES = ["a", "b", "c"]


def _impurity(y, classes, criterion):
    n = len(y)
    if not n:
        return 0.0
    p = np.bincount(y, minlength=classes) / n
    return n * (1 - (p**2).sum()) if criterion == "gini" else -n * sum(x * np.log2(x) for x in p if x)


def _best(x, y, rows, classes, s, depth):
    """(gain, feature, value) of the best split of some rows, or nothing."""
    if depth >= s.depth or len(rows) < s.min_split or len(set(y[rows])) < 2:
        return None
    best = None
    for f in range(x.shape[1]):
        for v in sorted(set(x[:, f]))[:-1]:
            left, right = rows[x[rows, f] <= v], rows[x[rows, f] > v]
            if min(len(left), len(right)) < s.min_leaf:
                continue
            gain = round(_impurity(y[rows], classes, s.criterion) - _impurity(y[left], classes, s.criterion)
                         - _impurity(y[right], classes, s.criterion), 9)
            if gain > 1e-9 and (best is None or gain > best[0]):
                best = gain, f, v, left, right
    return best


def _fit(x, y, rows, classes, s):
    """Leaves of one tree, as (row test, class): best first, oldest leaf on ties."""
    counts = np.bincount(y[rows], minlength=classes)
    leaves = [(rows, 0, [], _best(x, y, rows, classes, s, 0), 0, counts)]
    order = itertools.count(1)
    while len(leaves) < s.leaves:
        open_leaves = [leaf for leaf in leaves if leaf[3]]
        if not open_leaves:
            break
        leaf = min(open_leaves, key=lambda t: (-t[3][0], t[4]))
        leaves = [other for other in leaves if other is not leaf]
        _, depth, tests, (_, f, v, left, right), _, _ = leaf
        for side, rows in ((True, left), (False, right)):
            leaves.append((rows, depth + 1, [*tests, (f, v, side)], _best(x, y, rows, classes, s, depth + 1), next(order),
                           np.bincount(y[rows], minlength=classes)))
    return [(tests, counts) for _, _, tests, _, _, counts in leaves]


def _predict(leaves, x):
    out = np.zeros(len(x), int)
    for tests, counts in leaves:
        inside = np.ones(len(x), bool)
        for f, v, side in tests:
            inside &= (x[:, f] <= v) == side
        out[inside] = counts.argmax()
    return out


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    n = 240
    x = np.stack([rng.integers(0, 6, n), rng.integers(0, 9, n), rng.integers(0, 3, n)], 1)
    y = ((x[:, 0] > 2) ^ (x[:, 1] > 4)).astype(int) + (x[:, 2] == 2) * (rng.random(n) < 0.5)
    rows = [(i, *map(float, r), int(k)) for i, (r, k) in enumerate(zip(x.tolist(), y))]
    rows += [(1000, None, 1.0, 1.0, 0), (1001, 1.0, 1.0, 1.0, None)]  # left out
    return x, y, spark.createDataFrame(rows, "id long, a double, b double, c double, y int").repartition(3)


GRID = tr.settings(["gini", "entropy"], [1, 2, 4, 9], [2, 40], [1, 7], [2, 3, 5, 12])


def test_folds_agree_with_single_fits(data):
    x, y, df = data
    fold = np.array([r.fold for r in sa.kfold(df.where("id < 1000"), "id", 4, 1).orderBy("id").collect()])
    scores, best = tr.grid_search(df, FEATURES, "y", GRID, sa.fold_of(F.col("id"), 4, 1), 4)
    for s, got in zip(GRID, scores):
        want = [np.mean(_predict(_fit(x, y, np.flatnonzero(fold != k), 3, s), x[fold == k]) == y[fold == k]) for k in range(4)]
        assert got == pytest.approx(np.mean(want), abs=1e-12), str(s)
    assert best == GRID[int(np.argmax(np.round(scores, 12)))]


def test_splits_agree_with_single_fits(data):
    x, y, df = data
    flags = sa.split_flags("id", splits=10)
    member = np.array([list(r) for r in df.where("id < 1000").orderBy("id").select(*flags).collect()])
    grid = GRID[::5]
    scores, _ = tr.grid_search(df, FEATURES, "y", grid, tr.mask(flags), 10, masks=True)
    for s, got in zip(grid, scores):
        want = [np.mean(_predict(_fit(x, y, np.flatnonzero(m), 3, s), x[~m]) == y[~m]) for m in member.T]
        assert got == pytest.approx(np.mean(want), abs=1e-12), str(s)


def test_fitted_tree_scores_rows_as_expressions(data):
    x, y, df = data
    s = tr.Setting("gini", 9, 2, 1, 12)
    tree = tr.fit(df, FEATURES, "y", s)
    rows = df.where("id < 1000").orderBy("id").select(tree.predicted().alias("p"), tree.score(1).alias("s")).collect()
    leaves = _fit(x, y, np.arange(len(y)), 3, s)
    assert tree.leaves == len(leaves) == 12
    assert [r.p for r in rows] == _predict(leaves, x).tolist()
    assert all(0 <= r.s <= 1 for r in rows) and sum(r.s for r in rows) == pytest.approx((y == 1).sum())


def test_few_classes_rows_and_values(spark):
    one = spark.createDataFrame([(1.0, 0), (1.0, 1)], "a double, y int")
    assert tr.grid_search(one, ["a"], "y", GRID[:1], F.lit(0), 2)[0] == [0.5]  # with nothing to learn from, the first class
    tree = tr.fit(one, ["a"], "y", GRID[-1])
    assert tree.leaves == 1 and one.select(tree.predicted().alias("p")).distinct().collect()[0].p == 0


def test_quantile_bins(spark):
    df = spark.range(10_000).select((F.col("id") * 0.5).alias("a"), (F.col("id") % 7).alias("b"))
    found = tr.bins(df, ["a", "b"], most=16)
    assert found.edges[1] == (0.0, 1.0, 2.0, 3.0, 4.0, 5.0)
    assert len(found.edges[0]) == 15 and all(abs(e - 312.5 * (i + 1)) < 5 for i, e in enumerate(found.edges[0]))
    sizes = [r["count"] for r in df.groupBy(found.columns()[0]).count().collect()]
    assert len(sizes) == 16 and max(sizes) < 1.1 * min(sizes)


def test_best_tree_of_the_grid(spark, sf_dir):
    points = QUERIES["grid_best_roc"](spark, sf_dir).orderBy("fpr", "tpr").collect()
    area = QUERIES["grid_best_auc"](spark, sf_dir).first()[0]
    assert (points[0].fpr, points[0].tpr) == (0.0, 0.0) and (points[-1].fpr, points[-1].tpr) == (1.0, 1.0)
    assert area == pytest.approx(sum((b.fpr - a.fpr) * (a.tpr + b.tpr) / 2 for a, b in zip(points, points[1:])), abs=1e-6)
