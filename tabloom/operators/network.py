"""A small feed-forward network fitted by mini-batch gradient steps (relu, sigmoid output, rmsprop).

The standardised rows are written once, dealt out into mini-batches by a hash of their key. A step reads one of them, each
task sums the gradient of its rows, and the sums are added up per weight before they come to the driver, which holds the
weights: some hundred numbers, whatever the number of rows. The weights are written below the staging folder
after each epoch, so a fit can go on from the last one.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.operators.sampling import MODULUS, key_hash
from tabloom.session import staging_path

HIDDEN = (6, 6)
RATE, DECAY, SMALL = 0.001, 0.9, 1e-7


@dataclass(frozen=True)
class Network:
    """Weights in one row of numbers; ``layers`` are the widths from the inputs to the one output."""

    layers: tuple[int, ...]
    weights: np.ndarray

    @classmethod
    def start(cls, inputs: int, hidden: Sequence[int] = HIDDEN, seed: int = 0) -> Network:
        rng = np.random.default_rng(seed)
        layers = (inputs, *hidden, 1)
        parts = []
        for a, b in zip(layers, layers[1:]):
            edge = np.sqrt(6 / (a + b))
            parts += [rng.uniform(-edge, edge, a * b), np.zeros(b)]
        return cls(layers, np.concatenate(parts))

    def matrices(self) -> list[tuple[np.ndarray, np.ndarray]]:
        out, at = [], 0
        for a, b in zip(self.layers, self.layers[1:]):
            out.append((self.weights[at:at + a * b].reshape(a, b), self.weights[at + a * b:at + a * b + b]))
            at += a * b + b
        return out

    def gradient(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The gradient of the cross entropy, summed over the rows."""
        kept, h = [], x
        *hidden, last = self.matrices()
        for w, b in hidden:
            kept.append(h)
            h = np.maximum(h @ w + b, 0)
        kept.append(h)
        z = (h @ last[0] + last[1])[:, 0]
        back = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y)[:, None]
        parts = []
        for (w, _), h in zip(reversed(self.matrices()), reversed(kept)):
            parts = [(h.T @ back).ravel(), back.sum(0), *parts]
            back = back @ w.T * (h > 0)
        return np.concatenate(parts)

    def probability(self, features: Sequence[str]) -> Column:
        """The output for a row as an expression of its columns."""
        values = [F.col(f).cast("double") for f in features]
        for k, (w, b) in enumerate(self.matrices()):
            row = F.array(*values)
            sums = []
            for j in range(w.shape[1]):
                weights = F.array(*[F.lit(float(v)) for v in w[:, j]])
                products = F.zip_with(row, weights, lambda p, q: p * q)
                sums.append(F.aggregate(products, F.lit(float(b[j])), lambda s, p: s + p))
            values = sums if k == len(self.layers) - 2 else [F.greatest(s, F.lit(0.0)) for s in sums]
        return 1 / (1 + F.exp(-values[0]))


def _summed(network: Network, features: int):
    """(weight, g, n): a task's gradient and number of rows."""

    def run(batches):
        total, n = np.zeros(len(network.weights)), 0
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]
            if len(columns[0]):
                total += network.gradient(np.column_stack(columns[:features]), columns[features])
                n += len(columns[0])
        if n:
            size = len(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(size)), pa.array(total), pa.array(np.full(size, n))], ["weight", "g", "n"])

    return run


def fit(df: DataFrame, key: str, features: Sequence[str], label: str, epochs: int = 18, batches: int = 4,
        hidden: Sequence[int] = HIDDEN, rate: float = RATE, seed: int = 0, start: Network | None = None) -> Network:
    """A network on all rows with a label (0 or 1) and no missing feature; features come scaled.

    Each epoch takes ``batches`` steps, in an order drawn from ``seed``. ``start`` goes on from known weights.
    """
    spark = df.sparkSession
    known = df.dropna(subset=[*features, label])
    batch = F.floor(key_hash(F.col(key), seed + 1) * batches / MODULUS).cast("int")
    rows = known.select(*[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)],
                        F.col(label).cast("double").alias("y"), batch.alias("batch"))
    path, saved = staging_path(spark, "mini-batches"), staging_path(spark, "weights")
    rows.write.partitionBy("batch").parquet(path)
    parts = [spark.read.parquet(path).where(F.col("batch") == b).drop("batch") for b in range(batches)]
    network = start or Network.start(len(features), hidden, seed)
    mean_square = np.zeros_like(network.weights)
    rng = np.random.default_rng(seed)
    for epoch in range(epochs):
        for b in rng.permutation(batches):
            sums = parts[b].mapInArrow(_summed(network, len(features)), "weight long, g double, n long")
            got = sums.groupBy("weight").agg(F.sum("g").alias("g"), F.sum("n").alias("n")).toArrow()
            if not got.num_rows:
                continue
            gradient = np.zeros_like(network.weights)
            gradient[got["weight"].to_numpy()] = got["g"].to_numpy() / got["n"].to_numpy()
            mean_square = DECAY * mean_square + (1 - DECAY) * gradient**2
            network = Network(network.layers, network.weights - rate * gradient / (np.sqrt(mean_square) + SMALL))
        state = spark.createDataFrame([(epoch, network.weights.tolist())], "epoch int, weights array<double>")
        state.coalesce(1).write.mode("append").parquet(saved)
    return network
