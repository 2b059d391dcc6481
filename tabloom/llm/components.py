"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm import common


def _with_least(edges: DataFrame) -> DataFrame:
    """Each edge (u, v) with the least of u and its neighbours in these edges.

    Both sides meet on ``~u``, not on ``u``: the aggregate is dealt out again, so that adaptive execution may
    split the edges of a node that a large part of all edges leave from.
    """
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select(F.bitwise_not("u").alias("k"), F.least("u", "m").alias("m"))
    return edges.withColumn("k", F.bitwise_not("u")).join(least, "k").select("u", "v", "m")


def _state(edges: DataFrame) -> tuple:
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``node`` and ``root`` for every node of a link (two long columns): the least node it is connected with.

    The number of rounds grows with the logarithm of the nodes; a node without a link to another is not in the
    result. Loops, repeated links and nulls change nothing.
    """
    links = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    edges = common.staged(links.distinct(), "edges")
    state = _state(edges)
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _with_least(large)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            small.select("u", F.col("m").alias("v")))
        edges = common.staged(small.where("u <> v").distinct(), "edges")
        new = _state(edges)
        if new == state:
            break
        state = new
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
