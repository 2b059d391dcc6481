"""Cut and uncut series must give the same answers, however long the longest key is."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabloom.operators import ordered as od
from tabloom.operators import series as se
from tabloom.operators import stats as st
from tabloom.sources.writers import byte_budget_extract

BLOCKS = [3, 40, 10**6]


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds half of the rows; one key is null; two keys are short."""
    rng = np.random.default_rng(7)
    keys = ["hot"] * 300 + ["a"] * 120 + ["b"] * 2 + [None] * 60
    xs = np.concatenate([rng.permutation(n) for n in (300, 120, 2, 60)]).astype(float)
    xs = np.where(xs > 200, xs * 1000, xs / 7)
    pdf = pd.DataFrame({"k": keys, "x": xs, "y": np.round(rng.normal(size=len(xs)), 3)})
    return spark.createDataFrame(pdf.astype({"k": object}), "k string, x double, y double"), pdf


def by_key(pdf):
    for key, part in pdf.groupby("k", dropna=False):
        yield (None if pd.isna(key) else key), part.sort_values("x").reset_index(drop=True)


@pytest.mark.parametrize("block_rows", BLOCKS)
def test_running_sums(skewed, block_rows):
    df, pdf = skewed
    split = od.split_long(df, ["k"], "x", block_rows)
    got = {(r.k, r.x): (round(r.s, 6), r.n) for r in od.running_sums(split, {"s": F.col("y"), "n": F.lit(1)}).collect()}
    want = {}
    for key, part in by_key(pdf):
        for i, (x, s) in enumerate(zip(part.x, part.y.cumsum())):
            want[key, x] = (round(s, 6), i + 1)
    assert got == want


@pytest.mark.parametrize("block_rows", BLOCKS)
def test_blocks_are_bounded_and_ordered(skewed, block_rows):
    df, pdf = skewed
    split = od.split_long(df, ["k"], "x", block_rows)
    sizes = split.df.groupBy("k", od.BLOCK).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    for _, part in sizes.toPandas().groupby("k", dropna=False):
        part = part.sort_values(od.BLOCK)
        assert (part.lo.to_numpy()[1:] > part.hi.to_numpy()[:-1]).all()
        assert part.n.max() <= max(2 * block_rows + 1, 3)


@pytest.mark.parametrize("block_rows", BLOCKS)
@pytest.mark.parametrize("depth", [1, 4])
def test_following(skewed, block_rows, depth):
    df, pdf = skewed
    out = od.with_following(od.split_long(df, ["k"], "x", block_rows), ["x", "y"], depth)
    got = {(r.k, r.x): [r[f"y_{i}"] for i in range(1, depth + 1)] for r in out.collect()}
    want = {}
    for key, part in by_key(pdf):
        ys = list(part.y) + [None] * depth
        for i, x in enumerate(part.x):
            want[key, x] = ys[i + 1 : i + 1 + depth]
    assert got == want


@pytest.mark.parametrize("block_rows", BLOCKS)
def test_no_key_at_all(skewed, block_rows):
    df, pdf = skewed
    one = df.filter(F.col("k") == "hot").select("x", "y")
    got = {r.x: r.n for r in od.running_sums(od.split_long(one, [], "x", block_rows), {"n": F.lit(1)}).collect()}
    xs = sorted(pdf[pdf.k == "hot"].x)
    assert got == {x: i + 1 for i, x in enumerate(xs)}


@pytest.mark.parametrize("block_rows", BLOCKS)
@pytest.mark.parametrize("clamp", [True, False])
def test_interp_join(spark, skewed, block_rows, clamp):
    df, pdf = skewed
    knots = df.filter(F.abs("y") < 0.6)
    probes = df.filter(F.abs("y") >= 0.6).select("k", "x")
    got = {(r.k, r.x): r.y for r in se.interp_join(knots, probes, ["k"], clamp=clamp, block_rows=block_rows).collect()}
    for key, part in by_key(pdf):
        k = part[part.y.abs() < 0.6]
        for x in part[part.y.abs() >= 0.6].x:
            value = got.pop((key, x))
            if k.empty or (not clamp and not k.x.min() <= x <= k.x.max()):
                assert value is None
            else:
                assert value == pytest.approx(np.interp(x, k.x, k.y), abs=1e-9)
    assert not got


@pytest.mark.parametrize("block_rows", BLOCKS)
def test_exact_quantiles(skewed, block_rows):
    df, pdf = skewed
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = list(od.exact_quantiles(df, "y", probs, block_rows).first())
    assert got == pytest.approx(np.quantile(pdf.y, probs))


@pytest.mark.parametrize("block_rows", BLOCKS)
def test_series_operators_do_not_depend_on_blocks(skewed, block_rows):
    df, pdf = skewed
    area = {r.k: r.area for r in se.trapezoid(df, ["k"], "x", "y", block_rows).collect()}
    index = {(r.k, r.x): r.idx for r in se.reset_index(df, ["k"], "x", block_rows).collect()}
    dd = {(r.k, r.x): r.value for r in se.divided_diff(df, ["k"], "x", "y", 2, block_rows).collect() if r.ord == 2}
    change = {(r.k, r.x): r.rel_error for r in se.successive_rel_error(df, ["k"], "x", "y", block_rows).collect()}
    for key, part in by_key(pdf):
        x, y = part.x.to_numpy(), part.y.to_numpy()
        assert area[key] == pytest.approx(np.sum(np.diff(x) * (y[1:] + y[:-1]) / 2))
        assert [index[key, v] for v in x] == list(range(len(x)))
        first = np.diff(y) / np.diff(x)
        second = np.diff(first) / (x[2:] - x[:-2])
        assert [dd[key, v] for v in x[:-2]] == pytest.approx(list(second))
        assert change[key, x[0]] is None
        for i in range(1, len(x)):
            want = None if y[i] == 0 else abs((y[i] - y[i - 1]) / y[i])
            assert change[key, x[i]] == (want if want is None else pytest.approx(want))


@pytest.mark.parametrize("block_rows", [2, 10**6])
def test_roc_and_auc(spark, block_rows):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 400)
    s = np.round(rng.random(400), 2)
    df = spark.createDataFrame(pd.DataFrame({"y": y, "s": s}))
    points = st.roc_points(df, "y", "s", block_rows).toPandas().sort_values(["fpr", "tpr"])
    for t in np.unique(s):
        row = points[points.threshold == t].iloc[0]
        assert row.tpr == pytest.approx((s[y == 1] >= t).mean())
        assert row.fpr == pytest.approx((s[y == 0] >= t).mean())
    pairs = s[y == 1][:, None] - s[y == 0][None, :]
    want = ((pairs > 0) + 0.5 * (pairs == 0)).mean()
    assert st.auc(df, "y", "s", block_rows).first()[0] == pytest.approx(want)


@pytest.mark.parametrize("block_rows", [50, 10**6])
@pytest.mark.parametrize("budget, want", [(10, 0), (2000, 200), (10**6, 1050)])
def test_byte_budget(spark, block_rows, budget, want):
    rows = spark.range(1050).select("id", F.lit("abcd").alias("t"))
    kept = byte_budget_extract(rows, "id", ["id", "t"], budget, 100, block_rows=block_rows)
    assert sorted(r.id for r in kept.select("id").collect()) == list(range(want))


def test_extract_fits_as_written(spark, tmp_path):
    from tabloom.sources.writers import sink_csv

    rows = spark.range(500).select("id", F.when(F.col("id") % 3 == 0, 'a "b", c\nd').when(F.col("id") % 3 == 1, "").alias("t"))
    for budget in (1000, 3000):
        kept = byte_budget_extract(rows, "id", ["id", "t"], budget, 10)
        out = str(tmp_path / f"out{budget}")
        sink_csv(kept.select("id", "t").coalesce(1), out)
        size = sum(p.stat().st_size for p in (tmp_path / f"out{budget}").glob("part-*"))
        assert 0.75 * budget < size <= budget


def test_text_order_is_refused_at_any_size(skewed):
    df, _ = skewed
    for block_rows in (2, 10**6):
        with pytest.raises(TypeError, match="number"):
            od.split_long(df.withColumn("x", F.col("x").cast("string")), ["k"], "x", block_rows)


def test_only_cut_keys_carry(spark):
    """The broadcast table has a row per block of the one long key, not per key."""
    rows = spark.range(20_000).select(F.concat(F.lit("k"), (F.col("id") % 5000).cast("string")).alias("k"), F.col("id").alias("x"))
    rows = rows.unionByName(spark.range(3000).select(F.lit("hot").alias("k"), F.col("id").alias("x")))
    out = od.running_sums(od.split_long(rows, ["k"], "x", 500), {"n": F.lit(1)})
    assert out.filter("k = 'hot'").agg(F.max("n")).first()[0] == 3000
    assert "isnotnull(_block" in out._jdf.queryExecution().optimizedPlan().toString() or "> 0" in out._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("accuracy", [20, 100, 10_000])
def test_quantiles_sort_few_values(spark, accuracy):
    rng = np.random.default_rng(1)
    y = np.concatenate([np.round(rng.normal(size=20_000), 3), np.full(7000, 0.5)])
    df = spark.createDataFrame(pd.DataFrame({"y": y}))
    probs = [0.0, 0.01, 0.5, 0.61, 0.99, 1.0]
    got = list(od.exact_quantiles(df, "y", probs, 50, accuracy).first())
    assert got == pytest.approx(np.quantile(y, probs))
    assert list(od.exact_quantiles(df.limit(0), "y", [0.5]).first()) == [None]
