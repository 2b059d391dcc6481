"""Mixing sources to target weights by balanced sampling with the cube method.

Each source has a target number of words and so a number of times, between 0 and 3, that each of its documents should
be taken. The whole part is given to all; the fraction is an inclusion probability. The flight phase moves the
probabilities of three documents at a time along the null space of the two balancing equations (words and
documents of the source) until one of them is 0 or 1, so both totals stay as they are. It runs in blocks of
bounded size: a block leaves at most two documents undecided, which go on to the next level; the last block of a source
lands: it drops the equation for documents, then the one for words, and lets small documents of the block make good
for the words by which the last, mostly large, document misses the total.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm import common

WEIGHTS = (1, 2, 3)
MOST = 3
BLOCK = 5000
CHUNK = 10_000
_EPS = 1e-9


def word_count(text: str):
    """Number of ``[^\\x20\\x09-\\x0D]+``; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def rank_sources(sources: DataFrame) -> DataFrame:
    """``rank`` from 1 by code point, null last: ranges are dealt out, ranked one by one and joined up by their counts."""
    order = F.col("source").asc_nulls_last()
    ranged = common.staged(sources.repartitionByRange(order).withColumn("part", F.spark_partition_id()), "sources")
    before = ranged.groupBy("part").count()
    before = before.withColumn("before", F.coalesce(  # one row per range: as many as shuffle partitions
        F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    local = F.row_number().over(Window.partitionBy("part").orderBy(order))
    ranked = ranged.withColumn("local", local).join(F.broadcast(before.select("part", "before")), "part")
    return ranked.withColumn("rank", F.col("before") + F.col("local")).drop("part", "before", "local")


def targets(sources: DataFrame) -> DataFrame:
    """``target`` for each row (source, source_size, n_units): shares by weight, none above `MOST` times its size.

    The excess of capped sources goes to the others by weight until no source is above; each pass is one aggregation.
    """
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), ((F.col("rank") - 1) % len(WEIGHTS) + 1).cast("int"))
    ranked = common.staged(rank_sources(sources).withColumn("w", weight), "weights")
    total = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    per, seen = 0.0, None
    while True:
        capped = MOST * F.col("source_size") < per * F.col("w")
        fixed, w = ranked.agg(F.sum(F.when(capped, MOST * F.col("source_size")).otherwise(0)),
                              F.sum(F.when(capped, 0).otherwise(F.col("w")))).first()
        if not w or w == seen:
            break
        per, seen = (total - fixed) / w, w
    target = F.least((MOST * F.col("source_size")).cast("double"), per * F.col("w"))
    return ranked.select("source", "source_size", "n_units", target.alias("target"))


def fly(size: np.ndarray, pi: np.ndarray, rng: np.random.Generator, land: bool) -> np.ndarray:
    """The probabilities after the flight phase; at most two, or with ``land`` none, lie between 0 and 1.

    Moves keep the sum of ``pi`` and of ``pi * size`` as they are until the landing, which misses the sum of
    ``pi * size`` by less than one small document can mend.
    """
    free = (pi > 0) & (pi < 1)
    want = float((pi * size)[free].sum())
    pi = pi.astype(float).tolist()
    size = size.astype(float).tolist()
    active: list[int] = []
    draws = iter(())

    def chance() -> float:
        nonlocal draws
        value = next(draws, None)
        if value is None:
            draws = iter(rng.random(1024).tolist())
            value = next(draws)
        return value

    def move(at: list[int], way: list[float]) -> None:
        up = min((1 - pi[i]) / u if u > 0 else pi[i] / -u for i, u in zip(at, way) if u)
        down = min(pi[i] / u if u > 0 else (1 - pi[i]) / -u for i, u in zip(at, way) if u)
        step = up if chance() * (up + down) < down else -down
        for i, u in zip(at, way):
            pi[i] += step * u
            if pi[i] < _EPS:
                pi[i] = 0.0
            elif pi[i] > 1 - _EPS:
                pi[i] = 1.0

    for i in range(len(pi)):
        if not 0 < pi[i] < 1:
            continue
        active.append(i)
        while len(active) == 3:
            a, b, c = (size[j] for j in active)
            way = [c - b, a - c, b - a] if not a == b == c else [1.0, -1.0, 0.0]
            scale = max(map(abs, way))
            move(active, [u / scale for u in way])
            active = [j for j in active if 0 < pi[j] < 1]
    while land and active:
        if len(active) == 2:
            a, b = (size[j] for j in active)
            scale = max(a, b)
            move(active, [b / scale, -a / scale] if a > 0 and b > 0 else [1.0, -1.0])
        else:
            move(active, [1.0])
        active = [j for j in active if 0 < pi[j] < 1]
    out = np.array(pi)
    if land:
        size = np.array(size)
        miss = float((out * size)[free].sum()) - want
        for i in np.flatnonzero(free)[np.argsort(-size[free], kind="stable")]:
            change = size[i] if out[i] == 0 else -size[i]
            if abs(miss + change) < abs(miss):
                out[i] = 1 - out[i]
                miss += change
    return out


def _flight(seed: int):
    def run(block: pa.Table) -> pa.Table:
        h, size, pi = (block.column(c).to_numpy() for c in ("h", "size", "pi"))
        order = np.lexsort((size, h))  # the hash of id and size; rows with both alike are one unit
        rng = np.random.default_rng([seed, len(h), int(h[order[0]]) & (2**63 - 1)])
        out = np.empty(len(pi))
        out[order] = fly(size[order], pi[order], rng, block.column("last")[0].as_py())
        return block.set_column(block.schema.get_field_index("pi"), "pi", pa.array(out))

    return run


def sample(units: DataFrame, seed: int = 17, block: int = BLOCK) -> DataFrame:
    """``pi`` of each row (source, doc_id, size, pi) brought to 0 or 1, balanced by source; deterministic."""
    h = F.xxhash64("doc_id", "size", F.lit(seed))
    done = None
    rest = common.staged(units.where("pi > 0 and pi < 1").withColumn("h", h), "undecided")
    while True:
        many = rest.groupBy("source").count().select(
            F.col("source").alias("s"), F.ceil(F.col("count") / block).alias("blocks"))
        most = many.agg(F.max("blocks")).first()[0]
        if most is None:
            break
        dealt = rest.join(many, F.col("source").eqNullSafe(F.col("s"))).drop("s")
        dealt = dealt.withColumn("block", F.pmod("h", "blocks")).withColumn("last", F.col("blocks") == 1)
        flown = dealt.groupBy("source", "block").applyInArrow(_flight(seed), dealt.schema)
        flown = common.staged(flown.select(*rest.columns), "flown")
        sure = flown.where("pi <= 0 or pi >= 1")
        done = sure if done is None else done.unionByName(sure)
        if most == 1:
            break
        rest = flown.where("pi > 0 and pi < 1")
    sure = units.where("pi <= 0 or pi >= 1")
    return sure if done is None else sure.unionByName(done.select(*units.columns))


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken for every row of ``docs`` (doc_id, text, source).

    Null and wordless texts have size 0 and are never taken. Sources without a word have target 0. Rows that repeat
    source, id and size are one unit of several copies: the copies it is to be taken are shared out
    evenly among them, so a repeated row cannot fill one block.
    """
    units = docs.select("doc_id", "source", word_count("text").alias("size"))
    units = common.staged(units.groupBy("source", "doc_id", "size").agg(F.count("*").alias("n")), "units")
    sources = units.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"),
                                          F.count("*").alias("n_units"))
    plan = common.staged(targets(sources), "targets").withColumnRenamed("source", "s")
    full = units.join(plan, F.col("source").eqNullSafe(F.col("s"))).drop("s", "n_units")
    times = F.when(F.col("source_size") > 0, F.col("n") * F.col("target") / F.col("source_size")).otherwise(0.0)
    full = full.withColumn("times", times).withColumn("base", F.floor("times"))
    full = full.withColumn("pi", F.when(F.col("size") > 0, F.col("times") - F.col("base")).otherwise(0.0))
    taken = sample(full)
    taken = taken.withColumn("copies", F.least(F.col("base") + F.when(F.col("pi") >= 1, 1).otherwise(0), MOST * F.col("n")))
    rows = taken.withColumn("c", F.explode(F.expr(f"sequence(0L, (n - 1) div {CHUNK})")))
    rows = rows.withColumn("i", F.explode(F.expr(f"sequence(c * {CHUNK}, least((c + 1) * {CHUNK}, n) - 1)")))
    each = F.expr("copies div n") + F.when(F.col("i") < F.col("copies") % F.col("n"), 1).otherwise(0)
    return rows.select("doc_id", "size", "source_size", "target", (each * F.col("size")).cast("long").alias("taken"))
