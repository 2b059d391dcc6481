"""Sparse matrices as tables (i, j, v)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TILE = 100_000
MAX_HEAVY = 4096


def check_sizes(left: DataFrame, right: DataFrame, inner: int) -> None:
    """Raise if an inner index lies outside 0..inner-1."""
    worst = left.agg(F.max("j").alias("m")).unionByName(right.agg(F.max("i").alias("m"))).agg(F.max("m"))
    top = worst.first()[0]
    if top is not None and top >= inner:
        raise ValueError(f"inner index {top} does not fit a size of {inner}")


def _tiles(cells: DataFrame, other: DataFrame, tile: int) -> DataFrame:
    """(_k, _rows, _cols): into how many pieces the cells of either side are cut, for inner indices with many cells.

    An index is listed if a side has more than the limit of it, which grows with the table, so there are at most
    ``2 * MAX_HEAVY`` of them.
    """
    counts = cells.groupBy("_k").agg(F.count("*").alias("_l")).join(other.groupBy("_k").agg(F.count("*").alias("_r")), "_k")
    totals = counts.agg(F.sum("_l"), F.sum("_r")).first()
    left, right = (max(tile, -(-(t or 0) // MAX_HEAVY)) for t in totals)
    heavy = counts.where((F.col("_l") > left) | (F.col("_r") > right))
    return heavy.select("_k", F.ceil(F.col("_l") / left).alias("_rows"), F.ceil(F.col("_r") / right).alias("_cols"))


def matmul_coo(left: DataFrame, right: DataFrame, tile: int = TILE) -> DataFrame:
    """Product (i, j, v) of two sparse matrices; cells that stay empty are absent.

    Each task adds up its own products per cell before they are shuffled. An inner index with more than ``tile`` cells on
    a side is cut into row tiles of the left and column tiles of the right matrix, found by counting: each pair
    of tiles meets once, so a cell is copied only as often as the other side has tiles, and no task gets more of an
    index than two tiles. All other indices are joined as they are.
    """
    a = left.select(F.col("i").alias("_i"), F.col("j").alias("_k"), F.col("v").alias("_a"))
    b = right.select(F.col("i").alias("_k"), F.col("j").alias("_j"), F.col("v").alias("_b"))
    heavy = F.broadcast(_tiles(a, b, tile))  # at most 2 * MAX_HEAVY rows
    one = F.lit(1).cast("bigint")
    rows, cols = F.coalesce("_rows", one), F.coalesce("_cols", one)
    first = F.lit(0).cast("bigint")
    a = a.join(heavy, "_k", "left").select(
        "_i", "_k", "_a", F.pmod(F.xxhash64("_i"), rows).alias("_tr"), F.explode(F.sequence(first, cols - 1)).alias("_tc"))
    b = b.join(heavy, "_k", "left").select(
        "_j", "_k", "_b", F.pmod(F.xxhash64("_j"), cols).alias("_tc"), F.explode(F.sequence(first, rows - 1)).alias("_tr"))
    return (
        a.join(b, ["_k", "_tr", "_tc"])
        .groupBy(F.col("_i").alias("i"), F.col("_j").alias("j"))
        .agg(F.sum(F.col("_a") * F.col("_b")).alias("v"))
    )
