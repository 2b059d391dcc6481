"""Quantiles per group and polynomials of high degree."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.operators import encode as en
from tabloom.operators import ordered as od
from tabloom.operators import series as se

PROBS = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]


@pytest.mark.parametrize("small, block", [(10_000, 2_000_000), (200, 2_000_000), (200, 50)])
def test_group_quantiles(spark, small, block):
    rng = random.Random(small)
    sizes = {None: 3, "one": 1, "two": 2, "even": 400, "flat": 900, "hot": 6000, "ties": 3000}
    rows = [(g, 5.0 if g == "flat" else float(rng.randrange(9)) if g == "ties" else rng.gauss(0, 100)) for g, n in sizes.items() for _ in range(n)]
    rows += [("even", None), ("hot", float("nan")), ("nothing", None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    got = {r.g: list(r)[1:] for r in od.group_quantiles(df, ["g"], "v", PROBS, block, accuracy=1000, small=small).collect()}
    assert set(got) == set(sizes)
    for g in sizes:
        values = [v for k, v in rows if k == g and v is not None and v == v]
        assert got[g] == pytest.approx(np.quantile(values, PROBS).tolist(), abs=1e-9), g


def test_qcut_by_group(spark):
    rows = [("a", float(i)) for i in range(8)] + [("b", float(i * i)) for i in range(9)] + [("b", None), (None, 1.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = sorted(map(tuple, en.qcut_by(df, ["g"], "v", 4).collect()), key=str)
    import pandas as pd

    want = []
    for g in ("a", "b"):
        v = [x for k, x in rows if k == g and x is not None]
        want += [(g, x, int(c)) for x, c in zip(v, pd.qcut(v, 4, labels=False))]
    assert got == sorted([*want, ("b", None, None), (None, 1.0, 0)], key=str)


@pytest.mark.parametrize("degree", [7, 12, 20])
def test_polynomials_of_high_degree(spark, degree):
    rng = np.random.default_rng(degree)
    rows, series = [], {}
    for key, n in (("long", 4000), ("short", degree + 1), ("few", 3), (None, 300)):
        x = 1900 + 120 * np.sort(rng.random(n))
        y = np.cos((x - 1960) / 15) * 1e6 + x**2
        series[key] = x, y
        rows += [(key, float(a), float(b)) for a, b in zip(x, y)]
    df = spark.createDataFrame([*rows, ("long", None, 1.0), ("long", 1950.0, None)], "k string, x double, y double").repartition(6)
    at = F.lit(1975.0)
    fitted = se.poly_fit(df, ["k"], "x", "y", degree)
    got = {r.k: (r.n, r.v) for r in fitted.select("k", "n", se.poly_value(F.col("coefs"), F.col("mid"), F.col("half"), at).alias("v")).collect()}
    assert {k: n for k, (n, _) in got.items()} == {k: len(x) for k, (x, _) in series.items()}
    for key in ("long", None):
        x, y = series[key]
        mid, half = (x.min() + x.max()) / 2, (x.max() - x.min()) / 2
        dense = np.polynomial.chebyshev.chebfit((x - mid) / half, y, degree)
        assert got[key][1] == pytest.approx(np.polynomial.chebyshev.chebval((1975 - mid) / half, dense), rel=1e-8)
    with pytest.raises(ValueError, match="degree"):
        se.poly_fit(df, ["k"], "x", "y", 31)


def test_many_series_are_fitted_without_a_python_group_each(spark):
    rng = np.random.default_rng(5)
    long = [(0, float(a), float(np.sin(3 * a))) for a in rng.random(5000)]  # cut into blocks
    same = [(1, float(a % 40), float(a % 7)) for a in range(400)] * 3  # points that come again, also with another y
    short = [(k, float(a), float(a**2 + k)) for k in range(2, 400) for a in range(15)]
    df = spark.createDataFrame(long + same + short, "k int, x double, y double").repartition(7)
    fitted = se.poly_fit(df, ["k"], "x", "y", 12)
    plan = fitted._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" in plan and "FlatMapGroupsInPandas" not in plan
    got = {r.k: r for r in fitted.select("k", "n", *[se.poly_value(F.col("coefs"), F.col("mid"), F.col("half"), F.lit(v)).alias(c) for c, v in (("a", 0.5), ("b", 3.5))]).collect()}
    assert len(got) == 400 and [got[k].n for k in (0, 1, 2)] == [5000, 1200, 15]
    assert got[0].a == pytest.approx(np.sin(1.5), rel=1e-8)
    x, y = np.array([p[1:] for p in same]).T
    dense = np.polynomial.chebyshev.chebfit((x - 19.5) / 19.5, y, 12)
    assert got[1].b == pytest.approx(np.polynomial.chebyshev.chebval((3.5 - 19.5) / 19.5, dense), rel=1e-8)
    assert all(got[k].b == pytest.approx(3.5**2 + k, rel=1e-8) for k in range(2, 400))


def _lagrange(nodes, values, at):
    return sum(v * np.prod([(at - b) / (a - b) for b in nodes if b != a]) for a, v in zip(nodes, values))


@pytest.mark.parametrize("block", [2_000_000, 700])
def test_long_series_are_interpolated_around_the_probe(spark, block):
    rng = np.random.default_rng(1)
    x = np.cumsum(0.5 + rng.random(10_000))
    y = np.sin(x / 50) * 100
    short = [("few", 0.0, 1.0), ("few", 1.0, 3.0), ("one", 5.0, 7.0)]
    knots = spark.createDataFrame([("long", float(a), float(b)) for a, b in zip(x, y)] + short, "k string, x double, y double").repartition(5)
    at = [float(x[0]) - 1, float(x[0]), float(x[3]) + 0.1, *map(float, rng.uniform(x[0], x[-1], 200)), float(x[77]), float(x[-1]), float(x[-1]) + 1]
    probes = spark.createDataFrame([("long", a, i) for i, a in enumerate(at)] + [("few", 2.0, -1), ("one", 9.0, -2), ("none", 1.0, -3)], "k string, x double, id int")
    for points in (9, 4, 1):
        out = se.local_interp(knots, probes, ["k"], "x", "y", points, block)
        assert out.columns == ["k", "x", "id", "y"]
        got = {r.id: r.y for r in out.collect()}
        assert set(got) == {*range(len(at)), -1, -2}
        for i, a in enumerate(at):
            before = int(np.searchsorted(x, a, side="right")) - 1
            first = max(min(before - (points // 2 - 1), len(x) - points), 0)
            want = _lagrange(x[first:first + points], y[first:first + points], a)
            assert got[i] == pytest.approx(want, rel=1e-6, abs=1e-6)
        assert got[-2] == 7.0 and (points == 1 or got[-1] == pytest.approx(5.0))


def test_orders_beyond_one_pass(spark):
    rng = random.Random(2)
    x = sorted(rng.sample(range(100), 40))
    y = [rng.gauss(0, 1) for _ in x]
    df = spark.createDataFrame([("a", float(p), q) for p, q in zip(x, y)] + [("b", 1.0, 2.0)], "k string, x double, y double")
    got = {(r.k, r.x, r.ord): r.value for r in se.divided_diff(df, ["k"], "x", "y", 20, 15).collect()}
    level, want = list(y), {("b", 1.0, 0): 2.0}
    for j in range(21):
        want |= {("a", float(x[i]), j): v for i, v in enumerate(level)}
        level = [(level[i + 1] - level[i]) / (x[i + j + 1] - x[i]) for i in range(len(level) - 1)]
    assert set(got) == set(want)
    assert all(got[k] == pytest.approx(v, rel=1e-9, abs=1e-300) for k, v in want.items())
    cubic = spark.createDataFrame([("c", float(i), float(i**11)) for i in range(13)], "k string, x double, y double")
    dd = se.divided_diff(cubic, ["k"], "x", "y", 12)
    assert se.degree_by_dd(dd, ["k"], 0.5).first().degree == 11
    with pytest.raises(ValueError, match="order"):
        se.divided_diff(df, ["k"], "x", "y", 65)


def test_heavy_inner_index_is_cut(spark):
    from tabloom.operators import matrix as mx

    rng = np.random.default_rng(5)
    a, b = rng.random((300, 12)).round(3), rng.random((12, 200)).round(3)
    a[:, 1:][rng.random((300, 11)) < 0.9] = 0  # index 0 has most cells
    left = spark.createDataFrame([(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a))], "i long, j long, v double")
    right = spark.createDataFrame([(int(i), int(j), float(b[i, j])) for i, j in zip(*np.nonzero(b))], "i long, j long, v double")
    want = a @ b
    for tile in (20, 64, 10_000):
        got = {(r.i, r.j): r.v for r in mx.matmul_coo(left, right, tile).collect()}
        assert len(got) == np.count_nonzero(want) and all(v == pytest.approx(want[c]) for c, v in got.items())
    pieces = mx._tiles(left.select(F.col("j").alias("_k")), right.select(F.col("i").alias("_k")), 64)
    assert {(r._k, r._rows, r._cols) for r in pieces.where("_k = 0").collect()} == {(0, 5, 4)}
    assert {r._rows for r in pieces.where("_k > 0").collect()} == {1}
