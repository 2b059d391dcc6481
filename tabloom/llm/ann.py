"""Approximate nearest neighbours by learned partitions.

A bounded sample gives a neighbour graph, which is cut into balanced parts; a small network learns, for each
sampled vector, in which parts its neighbours lie. Every row is indexed under its likeliest part, and a query
goes to its several likeliest parts, where all rows are compared with it in double precision. How many
parts are asked is read off the sample: the least number that finds `RECALL` of the sample's own neighbours.

Rows are sorted into files of their parts once, and so are queries, each under the parts it asks. A task takes a file of
rows and a file of queries of the same part and reads both from the shared folder: nothing is copied to pair them up,
and a part that holds a third of all rows is many files and tasks. What a task gives back is k rows a query.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow.parquet import ParquetFile
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm import common
from tabloom.session import staging_path

SAMPLE = 8192
ROWS_PER_PART = 1000
MAX_PARTS = 128
NEIGHBOURS = 10
RECALL = 0.96
HIDDEN, EPOCHS = 128, 25
BLOCK_ROWS, BLOCK_QUERIES = 1 << 16, 1024
BATCH_ROWS, PAIRS = 4096, 1 << 16
MAX_TASKS = 20_000


@dataclass(frozen=True)
class Model:
    """A network with one hidden layer from a vector to its parts, and how many parts a query asks."""

    shift: np.ndarray
    scale: float
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int

    def odds(self, vectors: np.ndarray) -> np.ndarray:
        hidden = np.maximum((vectors - self.shift) * self.scale @ self.w1 + self.b1, 0)
        return hidden @ self.w2 + self.b2


def nearest_in(vectors: np.ndarray, k: int) -> np.ndarray:
    """The indices of each vector's ``k`` nearest others, by blocks."""
    square = (vectors**2).sum(1)
    out = np.zeros((len(vectors), k), np.int64)
    for a in range(0, len(vectors), 512):
        d = square - 2 * vectors[a : a + 512] @ vectors.T
        d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
        near = np.argpartition(d, k - 1, axis=1)[:, :k]
        out[a : a + 512] = np.take_along_axis(near, np.take_along_axis(d, near, 1).argsort(1), 1)
    return out


def balanced_parts(vectors: np.ndarray, near: np.ndarray, parts: int, sweeps: int = 12) -> np.ndarray:
    """Cut a neighbour graph into ``parts`` of about equal size with few edges between them.

    A first cut halves along principal directions; then vertices move to the part that most of their neighbours are
    in, those that gain most first, as long as no part grows above 1.1 times its share.
    """
    place = np.zeros(len(vectors), np.int64)

    def halve(rows: np.ndarray, low: int, n: int) -> None:
        if n == 1:
            place[rows] = low
            return
        x = vectors[rows] - vectors[rows].mean(0)
        way = np.ones(x.shape[1])
        for _ in range(8):
            way = x.T @ (x @ way)
            way /= np.linalg.norm(way) + 1e-30
        order = np.argsort(x @ way, kind="stable")
        cut = len(rows) * (n // 2) // n
        halve(rows[order[:cut]], low, n // 2)
        halve(rows[order[cut:]], low + n // 2, n - n // 2)

    halve(np.arange(len(vectors)), 0, parts)
    most = int(np.ceil(1.1 * len(vectors) / parts))
    both = np.concatenate([np.stack([np.repeat(np.arange(len(near)), near.shape[1]), near.ravel()], 1),
                           np.stack([near.ravel(), np.repeat(np.arange(len(near)), near.shape[1])], 1)])
    for _ in range(sweeps):
        pull = np.bincount(both[:, 0] * parts + place[both[:, 1]], minlength=len(vectors) * parts).reshape(-1, parts)
        best = pull.argmax(1)
        gain = pull[np.arange(len(place)), best] - pull[np.arange(len(place)), place]
        size = np.bincount(place, minlength=parts)
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if size[best[i]] < most:
                size[place[i]] -= 1
                size[best[i]] += 1
                place[i] = best[i]
                moved += 1
        if not moved:
            break
    return place


def fit(vectors: np.ndarray, parts: int, recall: float = RECALL, seed: int = 5) -> Model:
    """Cut the sample's neighbour graph, learn the routing and choose the number of parts to ask."""
    shift = vectors.mean(0)
    scale = 1 / (np.sqrt(((vectors - shift) ** 2).mean()) + 1e-30)
    x = (vectors - shift) * scale
    rng = np.random.default_rng(seed)
    k = min(NEIGHBOURS, len(x) - 1)
    if parts == 1 or k < 1:
        return Model(shift, scale, np.zeros((x.shape[1], 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1), 1)
    near = nearest_in(x, k)
    place = balanced_parts(x, near, parts)
    want = np.zeros((len(x), parts))
    for column in [np.arange(len(x)), *near.T]:
        want[np.arange(len(x)), place[column]] += 1 / (k + 1)
    weights = [rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN),
               rng.normal(0, np.sqrt(1 / HIDDEN), (HIDDEN, parts)), np.zeros(parts)]
    m, v = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for a in range(0, len(x), 256):
            rows = order[a : a + 256]
            hidden = np.maximum(x[rows] @ weights[0] + weights[1], 0)
            z = hidden @ weights[2] + weights[3]
            p = np.exp(z - z.max(1, keepdims=True))
            d = (p / p.sum(1, keepdims=True) - want[rows]) / len(rows)
            back = (d @ weights[2].T) * (hidden > 0)
            step += 1
            for i, g in enumerate([x[rows].T @ back, back.sum(0), hidden.T @ d, d.sum(0)]):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                weights[i] -= 3e-3 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    routed = Model(shift, scale, *weights, probes=parts)
    odds = routed.odds(vectors)
    home = odds.argmax(1)
    at = np.empty_like(odds, dtype=np.int64)  # the place of each part in each vector's own order
    np.put_along_axis(at, np.argsort(-odds, axis=1, kind="stable"), np.arange(parts)[None, :], axis=1)
    needed = at[np.arange(len(x))[:, None], home[near]]
    found = np.array([(needed < p).mean() for p in range(1, parts + 1)])
    return Model(shift, scale, *weights, probes=int(np.argmax(found >= min(recall, found[-1]))) + 1)


def _stack(column) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _fewer(ids: np.ndarray, vectors: np.ndarray, k: int) -> np.ndarray:
    """Of equal vectors the k + 1 smallest ids: no others can be among anybody's k nearest."""
    _, group = np.unique(vectors, axis=0, return_inverse=True)
    group = group.ravel()
    by = np.lexsort((ids, group))
    fresh = np.r_[True, (group[by][1:] != group[by][:-1]) | (ids[by][1:] != ids[by][:-1])]
    by = by[fresh]
    start = np.r_[True, group[by][1:] != group[by][:-1]]
    rank = np.arange(len(by)) - np.maximum.accumulate(np.where(start, np.arange(len(by)), 0))
    return by[rank <= k]


class Nearest:
    """The k nearest rows so far of some queries, over any number of batches of rows.

    A batch is compared by one matrix product. Pairs that this leaves within the k-th best distance are measured in double
    precision from the original vectors. An id counts once, at its nearest; ties go to the smaller id.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.square = (vectors**2).sum(1)
        self.owner, self.found, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.bound = np.full(len(ids), np.inf)

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        keep = _fewer(ids, vectors, self.k)
        ids, vectors = ids[keep], vectors[keep]
        square = (vectors**2).sum(1)
        rough = self.square[:, None] + square - 2 * self.vectors @ vectors.T
        slack = 1e-9 * (1 + self.square[:, None] + square)
        rough[self.ids[:, None] == ids] = np.inf
        unbound = np.flatnonzero(np.isinf(self.bound))
        if len(unbound):
            some = min(4 * self.k, len(ids))
            near = np.argpartition(rough[unbound], some - 1, axis=1)[:, :some]
            self._measure(np.repeat(unbound, some), near.ravel(), rough, ids, vectors)
        self._measure(*np.nonzero(rough - slack <= (self.bound**2)[:, None]), rough, ids, vectors)

    def _measure(self, query: np.ndarray, row: np.ndarray, rough: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        real = np.isfinite(rough[query, row])
        query, row = query[real], row[real]
        exact = [np.sqrt(((vectors[row[a:a + PAIRS]] - self.vectors[query[a:a + PAIRS]])**2).sum(1))
                 for a in range(0, len(row), PAIRS)]
        owner = np.concatenate([self.owner, query])
        found = np.concatenate([self.found, ids[row]])
        score = np.concatenate([self.score, *exact])
        order = np.lexsort((score, found, owner))
        owner, found, score = owner[order], found[order], score[order]
        first = np.r_[True, (owner[1:] != owner[:-1]) | (found[1:] != found[:-1])][:len(owner)]
        owner, found, score = owner[first], found[first], score[first]
        order = np.lexsort((found, score, owner))
        owner, found, score = owner[order], found[order], score[order]
        rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
        best = rank < self.k
        self.owner, self.found, self.score = owner[best], found[best], score[best]
        self.bound[owner[rank == self.k - 1]] = score[rank == self.k - 1]


def _read(path: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of a file, `BATCH_ROWS` at a time."""
    disk, name = common.file_system(unquote(path))
    with disk.open_input_file(name) as source:
        for batch in ParquetFile(source).iter_batches(BATCH_ROWS, columns=["vec_id", "embedding"]):
            if batch.num_rows:
                flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                yield batch.column(0).to_numpy(), flat.reshape(batch.num_rows, -1)


def _compare(k: int):
    """The k nearest of a file of rows for each query of a file of queries."""

    def run(batches):
        for batch in batches:
            for rows, asked in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parts = list(_read(asked))
                nearest = Nearest(*map(np.concatenate, zip(*parts)), k)
                for ids, vectors in _read(rows):
                    nearest.add(ids, vectors)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nearest.ids[nearest.owner]), pa.array(nearest.found), pa.array(nearest.score)],
                    ["query_id", "vec_id", "score"])

    return run


def _filed(df: DataFrame, block: int, label: str) -> DataFrame:
    """(part, file) of files that hold the rows of ``df`` (part, vec_id, embedding), at most ``block`` of one part in each.

    A part with more rows is cut by a hash, so its files are written by as many tasks as it has blocks.
    """
    spark = df.sparkSession
    sizes = df.groupBy("part").count()  # at most MAX_PARTS rows
    cut = df.join(F.broadcast(sizes), "part").withColumn(
        "block", F.pmod(F.xxhash64("vec_id", "embedding"), F.ceil(F.col("count") / block)))
    path = staging_path(spark, label)
    cut.repartition("part", "block").select("part", "vec_id", "embedding").write.option(
        "maxRecordsPerFile", block).partitionBy("part").parquet(path)
    kind = f"vec_id bigint, embedding {df.schema['embedding'].dataType.simpleString()}, part bigint"
    return spark.read.schema(kind).parquet(path).select("part", F.col("_metadata.file_path").alias("file")).distinct()


def usable(vectors: DataFrame) -> DataFrame:
    """Rows (vec_id, embedding) with an id and a finite, non-zero vector of the commonest length (ties: the least)."""
    x = F.col("embedding")
    fine = vectors.where(x.isNotNull() & (F.size(x) > 0) & F.col("vec_id").isNotNull())
    fine = fine.where(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
                      & F.exists(x, lambda c: c != 0)).select("vec_id", "embedding", F.size(x).alias("dim"))
    most = fine.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    return fine.where(F.col("dim") == (most["dim"] if most else -1)).select("vec_id", "embedding")


def search(vectors: DataFrame, queries, k: int = NEIGHBOURS, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id and score (Euclidean distance) of the ``k`` nearest found, over all rows of ``vectors``.

    ``queries`` is a condition on the rows of ``vectors`` (vec_id, embedding). Vectors that are null, empty, zero, hold a
    null or non-finite number or are not of the commonest length take no part. Rows with the query's id are not
    its candidates; an id with several vectors is one candidate, as near as its nearest, and one query, for its
    least vector. A query asks further parts until these hold more than ``k`` rows, so that it
    gets ``k`` results wherever the table has them. Ties go to the smaller id.
    """
    spark = vectors.sparkSession
    rows = common.staged(usable(vectors), "vectors")
    n = rows.count()
    draw = F.pmod(F.xxhash64("vec_id", "embedding", F.lit(3)), F.lit(1 << 30))
    drawn = rows.where(draw < int(min(1.0, sample / max(n, 1)) * (1 << 30))).select("embedding").toPandas()
    if not len(drawn):
        drawn = rows.select("embedding").limit(1).toPandas()
    got = np.unique(_stack(drawn["embedding"]), axis=0) if len(drawn) else np.zeros((0, 1))
    parts = int(min(MAX_PARTS, max(1, n // ROWS_PER_PART), max(1, len(got) // 32)))
    model = spark.sparkContext.broadcast(fit(got, parts) if len(got) else None)

    def place(frames):
        for frame in frames:
            odds = [model.value.odds(_stack(frame["embedding"].iloc[a : a + 4096])) for a in range(0, len(frame), 4096)]
            odds = np.concatenate(odds) if odds else np.zeros((0, parts))
            route = [np.argsort(-o, kind="stable") if ask else None for o, ask in zip(odds, frame["ask"])]
            yield frame.drop(columns="ask").assign(part=odds.argmax(1).astype(np.int64), route=route)

    kind = dict(rows.dtypes)["embedding"]
    asking = rows.withColumn("ask", F.coalesce(queries, F.lit(False)))
    placed = asking.mapInPandas(place, f"vec_id long, embedding {kind}, part long, route array<long>")
    placed = common.staged(placed, "placed")
    asks = placed.where("route is not null").groupBy("vec_id").agg(F.min(F.struct("embedding", "route")).alias("q"))
    asks = asks.select("vec_id", "q.embedding", "q.route")
    held = {r["part"]: r["count"] for r in placed.groupBy("part").count().collect()}  # at most MAX_PARTS rows
    sizes = np.array([held.get(p, 0) for p in range(parts)])
    least = model.value.probes if model.value else 1

    @F.pandas_udf("array<long>")
    def probes(route: pd.Series) -> pd.Series:
        out = []
        for r in route:
            enough = int(np.searchsorted(np.cumsum(sizes[r]), k + 1)) + 1
            out.append(list(r[: max(least, enough)]))
        return pd.Series(out)

    sent = asks.select("vec_id", "embedding", F.explode(probes("route")).alias("part"))
    row_files = _filed(placed.drop("route"), BLOCK_ROWS, "index")
    query_files = _filed(common.staged(sent, "sent"), BLOCK_QUERIES, "queries")
    pairs = row_files.withColumnRenamed("file", "rows").join(query_files.withColumnRenamed("file", "asked"), "part")
    pairs = common.staged(pairs.select("rows", "asked"), "pairs")
    found = pairs.repartition(max(1, min(pairs.count(), MAX_TASKS))).mapInArrow(
        _compare(k), "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
