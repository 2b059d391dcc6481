"""The network fitted over Spark against one process."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.operators import network as nw
from tabloom.operators import sampling as sa

FEATURES = [f"f{i}" for i in range(18)]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1200, 18))
    y = (x[:, 0] * x[:, 1] + x[:, 2] + 0.5 * rng.normal(size=1200) > 0).astype(float)
    rows = [(i, *map(float, r), float(k)) for i, (r, k) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, f"id long, {', '.join(f'{f} double' for f in FEATURES)}, y double").repartition(4)
    return x, y, df


def _auc(score, y):
    rank = np.argsort(np.argsort(score)) + 1
    n = y.sum()
    return (rank[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


def _one_process(x, y, batch, epochs, batches, rate):
    """The same steps in numpy alone."""
    net, square, rng = nw.Network.start(18), None, np.random.default_rng(0)
    square = np.zeros_like(net.weights)
    for _ in range(epochs):
        for b in rng.permutation(batches):
            g = net.gradient(x[batch == b], y[batch == b]) / (batch == b).sum()
            square = nw.DECAY * square + (1 - nw.DECAY) * g**2
            net = nw.Network(net.layers, net.weights - rate * g / (np.sqrt(square) + nw.SMALL))
    return net


def test_gradient_by_finite_differences():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(30, 18)), (rng.random(30) < 0.5).astype(float)
    net = nw.Network.start(18, seed=3)
    assert net.layers == (18, 6, 6, 1) and len(net.weights) == 114 + 42 + 7

    def loss(w):
        h = x
        *hidden, last = nw.Network(net.layers, w).matrices()
        for m, b in hidden:
            h = np.maximum(h @ m + b, 0)
        z = (h @ last[0] + last[1])[:, 0]
        return (np.logaddexp(0, z) - y * z).sum()

    got = net.gradient(x, y)
    for i in range(0, len(got), 7):
        step = np.zeros_like(got)
        step[i] = 1e-6
        assert got[i] == pytest.approx((loss(net.weights + step) - loss(net.weights - step)) / 2e-6, abs=1e-4)


def test_fit_agrees_with_one_process(spark, data):
    x, y, df = data
    held = df.where("id % 4 = 0")
    more = df.where("id % 4 > 0").unionByName(spark.createDataFrame([(-1, *[None] * 18, 1.0)], df.schema))
    net = nw.fit(more, "id", FEATURES, "y", epochs=12, batches=3, rate=0.02)
    part = np.array([r[0] for r in df.orderBy("id").select(F.floor(sa.key_hash(F.col("id"), 1) * 3 / sa.MODULUS)).collect()])
    own = np.arange(1200) % 4 > 0
    alone = _one_process(x[own], y[own], part[own], 12, 3, 0.02)
    assert net.weights == pytest.approx(alone.weights, abs=1e-6)
    rows = held.orderBy("id").select(net.probability(FEATURES).alias("p")).collect()
    score = np.array([r.p for r in rows])
    h = x[~own]
    *hidden, last = alone.matrices()
    for w, b in hidden:
        h = np.maximum(h @ w + b, 0)
    assert score == pytest.approx(1 / (1 + np.exp(-(h @ last[0] + last[1])[:, 0])), abs=1e-5)
    assert _auc(score, y[~own]) > 0.85


def test_fit_goes_on_from_known_weights(data):
    x, y, df = data
    first = nw.fit(df, "id", FEATURES, "y", epochs=0)
    assert (first.weights == nw.Network.start(18).weights).all()
    again = nw.fit(df, "id", FEATURES, "y", epochs=1, batches=1, start=first)
    assert (again.weights != first.weights).any()
