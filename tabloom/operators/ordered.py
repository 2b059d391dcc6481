"""Ordered computations that do not put one long series into one task.

A window over ``(key, order)`` sends every row of a key to one task. That is
fine until one key holds a large part of the table. ``split_long`` looks at the
row count per key and, only for keys above the limit, cuts the key into
consecutive blocks by value; running sums, neighbours and carried values then
work per block and are joined up through one small row per block.

The limit is never below ``total rows / MAX_BLOCKS``, so there are at most
``2 * MAX_BLOCKS`` block borders over all long keys together. That bound is why
they may be collected and broadcast. The order column must be a number, whatever
the size of the table, and in a long key should have few equal values: group
such rows first.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tabloom.session import staging_path
from tabloom.sources.inline import inline_table

MAX_BLOCKS = 16384
BLOCK_ROWS = 2_000_000
BLOCK = "_block"


@dataclass
class Split:
    """Rows with a block number, and whether any key was cut."""

    df: DataFrame
    keys: list[str]
    order: str
    cut: bool

    def window(self):
        return Window.partitionBy(*self.keys, BLOCK)


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(right[f"_r_{k}"])
    return cond


def attach(df: DataFrame, per_key: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join a per-key table; null keys match null keys. The engine picks the join by size."""
    right = per_key.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    return df.join(right, _same(df, right, keys), how).drop(*[f"_r_{k}" for k in keys])


def attach_small(df: DataFrame, small: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join of a per-key table of proven size."""
    return attach(df, F.broadcast(small), keys)


def split_long(
    df: DataFrame, keys: Sequence[str], order: str, block_rows: int = BLOCK_ROWS
) -> Split:
    """Number the blocks of each key. Runs one counting job, a second only if a key is long."""
    keys = list(keys)
    if not isinstance(df.schema[order].dataType, T.NumericType):
        raise TypeError(f"{order} must be a number to be cut into blocks")
    per_key = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    total, longest = per_key.agg(F.sum("_n"), F.max("_n")).first()
    limit = max(block_rows, math.ceil((total or 0) / MAX_BLOCKS))
    if not longest or longest <= limit:
        return Split(df.withColumn(BLOCK, F.lit(0)), keys, order, False)

    pieces = math.ceil(longest / limit)
    points = [i / pieces for i in range(1, pieces)]
    long_keys = per_key.filter(F.col("_n") > limit)
    rows = df.select(*keys, order)
    if keys:
        rows = attach_small(rows, long_keys, keys).filter(F.col("_n").isNotNull())
    else:
        rows = rows.withColumn("_n", F.lit(longest))
    # A key with fewer rows than the longest takes every so-many-th border only.
    bounds = rows.groupBy(*keys).agg(
        F.percentile_approx(order, points, max(10_000, 20 * pieces)).alias("_b"),
        F.first("_n").alias("_n"),
    )
    bounds = bounds.withColumn("_parts", F.ceil(F.col("_n") / limit).cast("int")).withColumn(
        "_b",
        F.array_sort(
            F.array_distinct(
                F.transform(
                    F.sequence(F.lit(1), F.greatest(F.col("_parts") - 1, F.lit(1))),
                    lambda i: F.element_at(
                        "_b", F.greatest(F.lit(1), (i * pieces / F.col("_parts")).cast("int"))
                    ),
                )
            )
        ),
    )
    # Collected so that every later reader sees the same borders, whatever is recomputed.
    table = bounds.select(*keys, "_b")
    found = table.collect()
    if keys:
        blocked = attach_small(df, inline_table(df.sparkSession, found, table.schema), keys)
    else:
        blocked = df.withColumn("_b", F.lit(list(found[0]["_b"])))
    value = F.coalesce(_borders_below(F.col("_b"), F.col(order)), F.lit(0))
    return Split(blocked.withColumn(BLOCK, value).drop("_b"), keys, order, True)


def _borders_below(borders: Column, value: Column) -> Column:
    """Number of sorted borders below the value, by a search in two levels."""
    step = F.greatest(F.ceil(F.sqrt(F.size(borders))).cast("int"), F.lit(1))
    full = (F.size(borders) / step).cast("int")
    strides = F.when(full >= 1, F.sequence(F.lit(1), full)).otherwise(F.array().cast("array<int>"))
    coarse = F.size(F.filter(strides, lambda i: F.element_at(borders, i * step) < value)) * step
    rest = F.slice(borders, coarse + 1, step)
    return coarse + F.size(F.filter(rest, lambda b: b < value))


def _earlier_blocks(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)


def running_sums(
    split: Split, values: dict[str, Column], tie: Sequence[str] = ()
) -> DataFrame:
    """Inclusive running sums in order, one output column per entry of ``values``."""
    w = split.window().orderBy(split.order, *tie).rowsBetween(Window.unboundedPreceding, 0)
    local = split.df.withColumns({out: F.sum(v).over(w) for out, v in values.items()})
    if not split.cut:
        return local.drop(BLOCK)
    sums = split.df.groupBy(*split.keys, BLOCK).agg(*[F.sum(v).alias(f"_s_{o}") for o, v in values.items()])
    before = _earlier_blocks(split.keys)
    carry = sums.select(
        *split.keys, BLOCK, *[F.sum(f"_s_{o}").over(before).alias(f"_c_{o}") for o in values]
    )
    # Keys that were not cut have the first block only, which carries nothing.
    joined = attach_small(local, carry.filter(F.col(BLOCK) > 0), [*split.keys, BLOCK])
    return joined.withColumns(
        {o: F.col(o) + F.coalesce(F.col(f"_c_{o}"), F.lit(0)) for o in values}
    ).drop(BLOCK, *[f"_c_{o}" for o in values])


def with_following(split: Split, columns: Sequence[str], depth: int = 1) -> DataFrame:
    """Add ``<column>_<i>``: the value i rows later in the same key, for i up to ``depth``.

    The first ``depth`` rows of a block are also given to the block before it,
    so each block can answer by itself.
    """
    columns = list(columns)
    order = split.window().orderBy(split.order)
    wanted = {
        f"{c}_{i}": F.lead(c, i).over(order) for c in columns for i in range(1, depth + 1)
    }
    if not split.cut:
        return split.df.withColumns(wanted).drop(BLOCK)
    fields = list(dict.fromkeys([split.order, *columns]))
    rank = F.row_number().over(order)
    heads = split.df.select(*split.keys, BLOCK, *fields, rank.alias("_r")).filter(F.col("_r") <= depth)
    ahead = Window.partitionBy(*split.keys).orderBy(BLOCK, "_r")
    packed = F.struct(*fields)
    halo = (
        heads.withColumn("_halo", F.array(*[F.lead(packed, i).over(ahead) for i in range(1, depth + 1)]))
        .withColumn("_last", F.lead(BLOCK).over(ahead))
        .filter(F.col("_last") > F.col(BLOCK))
        .select(*split.keys, BLOCK, F.explode(F.filter("_halo", lambda x: x.isNotNull())).alias("_h"))
        .select(*split.keys, BLOCK, *[F.col(f"_h.{f}").alias(f) for f in fields], F.lit(True).alias("_extra"))
    )
    both = split.df.unionByName(halo, allowMissingColumns=True)
    return both.withColumns(wanted).filter(F.col("_extra").isNull()).drop("_extra", BLOCK)


def with_nearest(split: Split, knot: Column, value: str) -> DataFrame:
    """Add ``_before`` and ``_after``: the nearest ``(order, value)`` knot at or around each row.

    ``knot`` tells which rows are knots. A knot counts as its own nearest.
    """
    point = F.when(knot, F.struct(F.col(split.order).alias("x"), F.col(value).alias("y")))
    marked = split.df.withColumn("_p", point)
    # Both ways with a frame that only grows: one that starts at the current row
    # would be worked out anew for each row.
    upward = split.window().orderBy(split.order)
    downward = split.window().orderBy(F.desc(split.order))
    latest = F.last("_p", ignorenulls=True)
    found = marked.withColumns(
        {
            "_before": latest.over(upward.rangeBetween(Window.unboundedPreceding, 0)),
            "_after": latest.over(downward.rangeBetween(Window.unboundedPreceding, 0)),
        }
    )
    if not split.cut:
        return found.drop("_p", BLOCK)
    ends = marked.groupBy(*split.keys, BLOCK).agg(F.min("_p").alias("_lo"), F.max("_p").alias("_hi"))
    later = Window.partitionBy(*split.keys).orderBy(F.desc(BLOCK)).rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(
        *split.keys,
        BLOCK,
        F.last("_hi", ignorenulls=True).over(_earlier_blocks(split.keys)).alias("_cb"),
        F.last("_lo", ignorenulls=True).over(later).alias("_ca"),
    )
    carry = carry.filter(F.col("_cb").isNotNull() | F.col("_ca").isNotNull())  # cut keys only
    joined = attach_small(found, carry, [*split.keys, BLOCK])
    return joined.withColumns(
        {"_before": F.coalesce("_before", "_cb"), "_after": F.coalesce("_after", "_ca")}
    ).drop("_p", "_cb", "_ca", BLOCK)


def exact_quantiles(
    df: DataFrame, column: str, probs: Sequence[float], block_rows: int = BLOCK_ROWS, accuracy: int = 10_000
) -> DataFrame:
    """One row ``q0, q1, …``: exact quantiles with linear interpolation; nulls and NaN are left out.

    Approximate quantiles give an interval around each wanted rank, a count gives the ranks of the intervals, and only
    the values inside them are sorted. So two passes read the column and a few of every ``accuracy`` values are shuffled.
    """
    value = F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double"))
    known = df.select(value.alias("_v")).filter(F.col("_v").isNotNull())
    n = known.count()
    if not n:
        nothing = ", ".join(f"q{i} double" for i in range(len(probs)))
        return inline_table(df.sparkSession, [(None,) * len(probs)], nothing)
    margin = 3 / accuracy + 2 / n  # the error of the approximation, and the rows next to a rank
    marks = [min(max(p + side * margin, 0.0), 1.0) for p in probs for side in (-1, 1)]
    ends = known.agg(F.percentile_approx("_v", marks, accuracy)).first()[0]
    v = F.col("_v")
    spans = list(zip(ends[::2], ends[1::2]))
    inside = functools.reduce(lambda a, b: a | b, [v.between(lo, hi) for lo, hi in spans])
    # rows below an interval that are in none: what the running count of the sorted values leaves out there
    skipped = known.agg(*[F.count_if((v < lo) & ~inside) for lo, _ in spans]).first()
    counts = known.filter(inside).groupBy("_v").agg(F.count("*").alias("_n"))
    ranked = running_sums(split_long(counts, [], "_v", block_rows), {"_cum": F.col("_n")})

    def at(i: int, rank: int) -> Column:
        reached = v.between(*spans[i]) & (F.col("_cum") + skipped[i] > rank)
        return F.min(F.when(reached, v))

    out = []
    for i, p in enumerate(probs):
        pos = p * (n - 1)
        low = at(i, math.floor(pos))
        out.append((low + (at(i, math.ceil(pos)) - low) * (pos - math.floor(pos))).alias(f"q{i}"))
    return ranked.agg(*out)


SMALL_GROUP = 10_000


def group_quantiles(
    df: DataFrame, keys: Sequence[str], column: str, probs: Sequence[float], block_rows: int = BLOCK_ROWS,
    accuracy: int = 10_000, small: int = SMALL_GROUP
) -> DataFrame:
    """(keys…, q0, q1, …): exact quantiles per group with linear interpolation; nulls and NaN are left out.

    The first pass gathers one rank sketch per group; sketches of a group merge before and after the shuffle, whatever
    its size. Of a group with more than ``small`` values, only those between the sketch's bounds around a wanted rank go
    on; all others are counted in the second pass. What goes on is ranked by running sums, in blocks where a group
    is long, so no group has to fit into one task.
    """
    keys = list(keys)
    value = F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double"))
    known = df.select(*keys, value.alias("_v")).filter(F.col("_v").isNotNull())
    margin = 3 / accuracy + 2 / small  # the error of the sketch, and the values next to a rank
    marks = [min(max(p + side * margin, 0.0), 1.0) for p in probs for side in (-1, 1)]
    ends = known.groupBy(*keys).agg(
        F.count("*").alias("_rows"), F.percentile_approx("_v", marks, accuracy).alias("_ends"))
    ends_path, path = staging_path(df.sparkSession, "group-ends"), staging_path(df.sparkSession, "group-values")
    ends.write.parquet(ends_path)
    ends = df.sparkSession.read.parquet(ends_path)
    rows = attach(known, ends, keys)
    v, few = F.col("_v"), F.col("_rows") <= small
    spans = [v.between(F.col("_ends")[2 * i], F.col("_ends")[2 * i + 1]) for i in range(len(probs))]
    inside = functools.reduce(lambda a, b: a | b, spans, few)
    below = [F.count_if(~inside & (v < F.col("_ends")[2 * i])).alias(f"_below{i}") for i in range(len(probs))]
    kept = rows.withColumn("_kept", F.when(inside, v))
    kept.groupBy(*keys, "_kept").agg(F.count("*").alias("_n"), *below).write.parquet(path)
    counted = df.sparkSession.read.parquet(path)
    skipped = counted.filter(F.col("_kept").isNull()).drop("_kept", "_n")
    values = counted.filter(F.col("_kept").isNotNull()).select(*keys, "_kept", "_n")
    ranked = running_sums(split_long(values, keys, "_kept", block_rows), {"_cum": F.col("_n")})
    ranked = attach(attach(ranked, ends, keys), skipped, keys)
    k = F.col("_kept")

    def at(i: int, rank: Column) -> Column:
        span = k.between(F.col("_ends")[2 * i], F.col("_ends")[2 * i + 1])
        reached = (few | span) & (F.col("_cum") + F.coalesce(F.col(f"_below{i}"), F.lit(0)) > rank)
        return F.min(F.when(reached, k))

    out = []
    for i, p in enumerate(probs):
        pos = F.lit(float(p)) * (F.col("_rows") - 1)
        out += [at(i, F.floor(pos)).alias(f"_low{i}"), at(i, F.ceil(pos)).alias(f"_high{i}")]
    found = ranked.groupBy(*keys, "_rows").agg(*out)
    share = [F.lit(float(p)) * (F.col("_rows") - 1) for p in probs]
    return found.select(*keys, *[
        (F.col(f"_low{i}") + (F.col(f"_high{i}") - F.col(f"_low{i}")) * (x - F.floor(x))).alias(f"q{i}")
        for i, x in enumerate(share)])
