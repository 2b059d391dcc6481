"""Repeatable samples, splits and folds by a mixing hash of seed and row key."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODULUS = 4294967296
COARSE_BITS = 12


def key_hash(key: Column, seed: int = 0) -> Column:
    """The first 32 bits of the MD5 of ``seed:key``, a number in [0, 2^32) that any SQL engine can repeat.

    Every bit of key and seed changes it, so samples, splits and folds with different seeds are independent.
    """
    text = F.concat(F.lit(f"{seed}:"), key.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def share_limit(share: float) -> int:
    """Hashes below this number are the given share of all hashes."""
    return math.floor(share * MODULUS)


def sample_fraction(df: DataFrame, key: str, share: float, seed: int = 0) -> DataFrame:
    """About the given share of rows, decided row by row; nothing is shuffled."""
    return df.filter(key_hash(F.col(key), seed) < share_limit(share))


def sample_exact(
    df: DataFrame, key: str, n: int | None = None, share: float | None = None, seed: int = 0
) -> DataFrame:
    """Exactly n rows (or the rounded share): those with the smallest hash, ties by key.

    The cut is found by counting hashes in 4096 coarse cells and then in the
    4096 finer cells of the cell that holds the cut, so no sort and no single
    task sees the whole table. Keys must be unique.
    """
    h = key_hash(F.col(key), seed)
    shift = 32 - COARSE_BITS
    cells = dict(df.groupBy(F.shiftright(h, shift)).count().collect())
    total = sum(cells.values())
    want = min(total, n if n is not None else round(share * total))
    if want == total:
        return df
    coarse, left = _cut(cells, want)
    inside = df.filter(F.shiftright(h, shift) == coarse)
    fine_shift = shift - COARSE_BITS
    cells = dict(inside.groupBy(F.shiftright(h, fine_shift)).count().collect())
    fine, left = _cut(cells, left)
    # What is left is one of 2^24 equal hash ranges: some 60,000 rows of 10^12.
    edge = inside.filter(F.shiftright(h, fine_shift) == fine).orderBy(h, key).limit(left)
    return df.filter(F.shiftright(h, fine_shift) < fine).unionByName(edge)


def _cut(cells: dict[int, int], want: int) -> tuple[int, int]:
    """The cell in which the running count passes ``want``, and how many it still needs."""
    seen = 0
    for cell in sorted(cells):
        if seen + cells[cell] > want:
            return cell, want - seen
        seen += cells[cell]
    raise ValueError("more rows wanted than there are")


def train_test_split(df: DataFrame, key: str, test_share: float = 0.3, seed: int = 0) -> DataFrame:
    """Add ``is_train``. A filter on it is pushed into each side's own scan."""
    limit = share_limit(1.0 - test_share)
    return df.withColumn("is_train", key_hash(F.col(key), seed) < limit)


def kfold(df: DataFrame, key: str, k: int, seed: int = 0) -> DataFrame:
    """Add ``fold`` in 0..k-1."""
    return df.withColumn("fold", fold_of(F.col(key), k, seed))


def fold_of(key: Column, k: int, seed: int = 0) -> Column:
    return F.floor(key_hash(key, seed) * k / MODULUS).cast("int")


def split_flags(key: str, splits: int = 10, test_share: float = 0.3, seeds: Sequence[int] | None = None) -> list[Column]:
    """For each split an expression of the key: is the row in the training part?"""
    seeds = list(seeds) if seeds is not None else [7919 * (i + 1) for i in range(splits)]
    return [key_hash(F.col(key), s) < share_limit(1.0 - test_share) for s in seeds]


def shuffle_splits(
    df: DataFrame, key: str, splits: int = 10, test_share: float = 0.3, seeds: Sequence[int] | None = None
) -> DataFrame:
    """Long table (key, split, is_train): independent random splits of the same rows."""
    flags = split_flags(key, splits, test_share, seeds)
    rows = F.array(*[F.struct(F.lit(i).alias("split"), f.alias("is_train")) for i, f in enumerate(flags)])
    return df.select(key, F.explode(rows).alias("_s")).select(key, "_s.split", "_s.is_train")
