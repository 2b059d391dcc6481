"""Per-series operators over a long table ``(keys…, x, y)``.

Neighbour and running computations go through ``ordered``, which cuts a series
that is too long for one task. Within a series x must be unique.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.operators import ordered as od
from tabloom.operators.ordered import BLOCK_ROWS
from tabloom.session import staging_path

MAX_ORDER, MAX_ORDERS = 8, 64
FIT_ROWS = 1024  # points of a series that one factorisation takes, if the series is not very long


def reset_index(df: DataFrame, keys: Sequence[str], x: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add ``idx``: 0, 1, … within each series in order of x."""
    counted = od.running_sums(od.split_long(df, keys, x, block_rows), {"idx": F.lit(1)})
    return counted.withColumn("idx", F.col("idx") - 1)


def grid(df: DataFrame, keys: Sequence[str], x: str, n: int) -> DataFrame:
    """n evenly spaced probes from the first to the last x of each series, both included."""
    if n < 2:
        raise ValueError("a grid has at least its two ends")
    ends = df.groupBy(*keys).agg(F.min(x).cast("double").alias("_a"), F.max(x).cast("double").alias("_b"))
    step = (F.col("_b") - F.col("_a")) / (n - 1)
    points = ends.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    at = F.when(F.col("_i") == n - 1, F.col("_b")).otherwise(F.col("_a") + step * F.col("_i"))
    return points.select(*keys, F.col("_i").alias("i"), at.alias("x"))


def interp_join(
    knots: DataFrame,
    probes: DataFrame,
    keys: Sequence[str],
    x: str = "x",
    y: str = "y",
    clamp: bool = True,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Probes with ``y``: the piecewise-linear value of the knots at the probe.

    Outside the knots the end value is taken, or null with ``clamp=False``.
    Knots and probes go through one ordered pass, not through a range join.
    """
    have = knots.select(*keys, x, y, F.lit(True).alias("_knot"))
    ask = probes.withColumn("_knot", F.lit(False))
    both = ask.unionByName(have, allowMissingColumns=True)
    near = od.with_nearest(od.split_long(both, keys, x, block_rows), F.col("_knot"), y)
    b, a = F.col("_before"), F.col("_after")
    width = a["x"] - b["x"]
    inside = F.when(width == 0, b["y"]).otherwise(b["y"] + (a["y"] - b["y"]) * (F.col(x) - b["x"]) / width)
    if clamp:
        value = F.when(b.isNull(), a["y"]).when(a.isNull(), b["y"]).otherwise(inside)
    else:
        value = F.when(b.isNotNull() & a.isNotNull(), inside)
    return near.filter(~F.col("_knot")).withColumn(y, value).drop("_before", "_after", "_knot")


def _difference(xs: Sequence[Column], ends: Sequence[Column], ys: Sequence[Column]) -> list[Column]:
    """Divided differences of the orders after that of ``ys``, starting at the first node; the first entry is ``ys[0]``.

    ``ys[i]`` is a difference over the nodes from ``xs[i]`` to ``ends[i]``; of order 0 both are the node itself.
    """
    level, out = list(ys), [ys[0]]
    for j in range(1, len(xs)):
        level = [
            (level[i + 1] - level[i])
            / F.when(ends[i + j] == xs[i], F.raise_error(F.lit("x must be unique in a series"))).otherwise(
                ends[i + j] - xs[i]
            )
            for i in range(len(level) - 1)
        ]
        out.append(level[0])
    return out


def divided_diff(
    df: DataFrame, keys: Sequence[str], x: str, y: str, order: int, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """(keys…, x, ord, value): the divided-difference table up to the given order.

    A pass gives ``MAX_ORDER`` orders, from the values of the last order before, whose last nodes go along; what a pass
    hands on is written below the staging folder.
    """
    if not 0 <= order <= MAX_ORDERS:
        raise ValueError(f"order must be between 0 and {MAX_ORDERS}")
    value = F.col(y).cast("double")
    rows = df.select(*keys, F.col(x).cast("double").alias(x), F.col(x).cast("double").alias("_end"), value.alias("_v"))
    out, done = None, 0
    while True:
        step = min(order - done, MAX_ORDER)
        ahead = od.with_following(od.split_long(rows, keys, x, block_rows), [x, "_end", "_v"], max(step, 1))
        over = [[F.col(c)] + [F.col(f"{c}_{i}") for i in range(1, step + 1)] for c in (x, "_end", "_v")]
        found = _difference(*over)
        table = F.array(*[F.struct(F.lit(done + j).alias("ord"), d.alias("value")) for j, d in enumerate(found) if j or not done])
        long = ahead.select(*keys, x, F.explode(table).alias("d")).select(*keys, x, "d.ord", "d.value")
        out = long if out is None else out.unionByName(long)
        done += step
        if done >= order:
            return out.filter(F.col("value").isNotNull())
        path = staging_path(df.sparkSession, "differences")
        last = ahead.select(*keys, x, F.col(f"_end_{step}").alias("_end"), found[-1].alias("_v"))
        last.filter(F.col("_v").isNotNull()).write.parquet(path)
        rows = df.sparkSession.read.parquet(path)


def degree_by_dd(dd: DataFrame, keys: Sequence[str], threshold: float = 0.01) -> DataFrame:
    """(keys…, degree): one less than the first order whose differences all stay below the threshold.

    If all orders of the series are in the table and none does, the number of points less one. A series whose higher
    orders are missing from the table is an error, not a guess.
    """
    per = dd.groupBy(*keys, "ord").agg(F.max(F.abs("value")).alias("_m"), F.count("*").alias("_n"))
    small = F.when((F.col("ord") >= 1) & (F.col("_m") < threshold), F.col("ord"))
    points = F.max(F.when(F.col("ord") == 0, F.col("_n")))
    undecided = F.raise_error(F.lit("a series needs orders beyond those in the table"))
    last = F.when(F.max("ord") < points - 1, undecided).otherwise(points - 1)
    return per.groupBy(*keys).agg(F.coalesce(F.min(small) - 1, last).cast("int").alias("degree"))


def newton_coefficients(
    df: DataFrame, keys: Sequence[str], x: str, y: str, max_points: int, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """(keys…, nodes, coefs) of the polynomial through all points of each series.

    A series with more than ``max_points`` points is an error: a polynomial
    through many points is of no use, and its nodes would have to be collected.
    """
    if max_points > MAX_ORDER + 1:
        raise ValueError(f"max_points must be at most {MAX_ORDER + 1}")
    rows = df.select(*keys, F.col(x).cast("double").alias(x), F.col(y).cast("double").alias(y))
    indexed = reset_index(rows, keys, x, block_rows)
    ahead = od.with_following(od.split_long(indexed, keys, x, block_rows), [x, y], max_points)
    xs = [F.col(x)] + [F.col(f"{x}_{i}") for i in range(1, max_points)]
    ys = [F.col(y)] + [F.col(f"{y}_{i}") for i in range(1, max_points)]
    too_long = F.raise_error(F.lit("series has too many points for one polynomial"))
    coefs = F.when(F.col(f"{x}_{max_points}").isNotNull(), too_long).otherwise(F.array(*_difference(xs, xs, ys)))
    return ahead.filter(F.col("idx") == 0).select(
        *keys,
        F.filter(F.array(*xs), lambda v: v.isNotNull()).alias("nodes"),
        F.filter(coefs, lambda v: v.isNotNull()).alias("coefs"),
    )


def newton_value(nodes: Column, coefs: Column, at: Column) -> Column:
    """Newton form from the innermost bracket outwards."""
    pairs = F.reverse(F.arrays_zip(nodes.alias("x"), coefs.alias("c")))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc * (at - p["x"]) + p["c"])


def newton_interp(
    df: DataFrame, probes: DataFrame, keys: Sequence[str], x: str, y: str, max_points: int = MAX_ORDER + 1
) -> DataFrame:
    """Probes (keys…, x) with the value of each series' interpolating polynomial."""
    fitted = newton_coefficients(df, keys, x, y, max_points)
    joined = od.attach(probes, fitted, keys, "inner")
    return joined.withColumn(y, newton_value(F.col("nodes"), F.col("coefs"), F.col(x))).drop("nodes", "coefs")


def local_interp(
    knots: DataFrame, probes: DataFrame, keys: Sequence[str], x: str, y: str, points: int = MAX_ORDER + 1,
    block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Probes (keys…, x) with ``y``: the value of the polynomial through the ``points`` knots around the probe.

    Half of the knots lie on either side; near an end, and outside, they are the first or last ones. A series with fewer
    knots uses all of them, so up to ``points`` knots this is ``newton_interp``. Each knot carries the knots that follow
    it, so a probe joins one row: that of the first knot of its stencil. Probes of series without a knot have no row.
    """
    if not 1 <= points <= MAX_ORDER + 1:
        raise ValueError(f"points must be between 1 and {MAX_ORDER + 1}")
    keys = list(keys)
    rows = knots.select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    indexed = reset_index(rows, keys, "_x", block_rows)
    ahead = od.with_following(od.split_long(indexed, keys, "_x", block_rows), ["_x", "_y"], max(points - 1, 1))
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    have = indexed.select(*keys, F.col("_x").alias(x), F.col("idx").cast("double").alias("_at"), F.lit(True).alias("_knot"))
    ask = probes.withColumn("_asked", F.struct(*probes.columns)).select(
        *keys, F.col(x).cast("double").alias(x), "_asked", F.lit(False).alias("_knot"))
    both = ask.unionByName(have, allowMissingColumns=True)
    near = od.with_nearest(od.split_long(both, keys, x, block_rows), F.col("_knot"), "_at").filter(~F.col("_knot"))
    near = od.attach(near.select(*keys, x, "_asked", F.col("_before.y").alias("_at")), sizes, keys, "inner")
    start = F.coalesce(F.col("_at"), F.lit(-1.0)) - (points // 2 - 1)
    start = F.greatest(F.least(start, (F.col("_n") - points).cast("double")), F.lit(0.0)).cast("bigint")
    stencils = ahead.withColumn("_first", F.col("idx").cast("bigint")).drop("idx")
    found = od.attach(near.withColumn("_first", start).withColumnRenamed(x, "_probe"), stencils, [*keys, "_first"], "inner")
    xs = [F.col("_x")] + [F.col(f"_x_{i}") for i in range(1, points)]
    ys = [F.col("_y")] + [F.col(f"_y_{i}") for i in range(1, points)]
    nodes = F.filter(F.array(*xs), lambda v: v.isNotNull())
    coefs = F.filter(F.array(*_difference(xs, xs, ys)), lambda v: v.isNotNull())
    return found.select("_asked.*", newton_value(nodes, coefs, F.col("_probe")).alias(y))


def trapezoid(df: DataFrame, keys: Sequence[str], x: str, y: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(keys…, area, n) under the sampled curve; spacing may vary."""
    ahead = od.with_following(od.split_long(df, keys, x, block_rows), [x, y], 1)
    strip = (F.col(f"{x}_1") - F.col(x)) * (F.col(y) + F.col(f"{y}_1")) / 2
    return ahead.groupBy(*keys).agg(F.coalesce(F.sum(strip), F.lit(0.0)).alias("area"), F.count("*").alias("n"))


def _simpson(df: DataFrame, keys: Sequence[str], x: str, y: str, period: int) -> DataFrame:
    """Simpson sums on evenly spaced samples.

    The place of a sample follows from its x, so the samples need no sorting.
    ``problem`` tells why there is no area.
    """
    ends = df.groupBy(*keys).agg(
        F.count("*").alias("_n"), F.min(x).cast("double").alias("_a"), F.max(x).cast("double").alias("_b")
    )
    h = (F.col("_b") - F.col("_a")) / (F.col("_n") - 1)
    ends = ends.withColumn("_h", F.when(F.col("_n") > 1, h))
    rows = od.attach(df, ends, keys)
    place = F.round((F.col(x) - F.col("_a")) / F.col("_h")).cast("bigint")
    off = F.abs(F.col(x) - F.col("_a") - place * F.col("_h")) > F.col("_h") * 1e-6
    end = (place == 0) | (place == F.col("_n") - 1)
    if period == 2:
        weight, factor = F.when(end, 1.0).when(place % 2 == 1, 4.0).otherwise(2.0), F.lit(1.0 / 3)
    else:
        weight, factor = F.when(end, 1.0).when(place % 3 == 0, 2.0).otherwise(3.0), F.lit(3.0 / 8)
    per = (
        rows.groupBy(*keys, place.alias("_place"), "_n", "_h")
        .agg(F.count("*").alias("_k"), F.sum(weight * F.col(y)).alias("_s"), F.max(off).alias("_off"))
        .groupBy(*keys, F.col("_n").alias("n"), "_h")
        .agg(F.sum("_s").alias("_s"), F.max("_off").alias("_off"), F.max("_k").alias("_k"))
    )
    m = F.col("n") - 1
    uneven = F.col("_off") | (F.col("_k") > 1)
    problem = (
        F.when(m < period, "too few samples")
        .when(m % period != 0, f"interval count is no multiple of {period}")
        .when(uneven, "samples are not evenly spaced")
    )
    return per.select(
        *keys,
        F.when(problem.isNull(), F.col("_s") * F.col("_h") * factor).alias("area"),
        problem.alias("problem"),
    )


def simpson13(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Area by the 1/3 rule; needs an even number of intervals."""
    return _simpson(df, keys, x, y, 2)


def simpson38(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Area by the 3/8 rule; needs a number of intervals that three divides."""
    return _simpson(df, keys, x, y, 3)


def successive_rel_error(
    df: DataFrame, keys: Sequence[str], step: str, value: str, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Add ``rel_error``: change from the step before, relative to the value; null at the first step."""
    back = df.withColumn("_back", -F.col(step))
    prior = od.with_following(od.split_long(back, keys, "_back", block_rows), [value], 1)
    change = F.abs(F.try_divide(F.col(value) - F.col(f"{value}_1"), F.col(value)))
    return prior.withColumn("rel_error", change).drop("_back", f"{value}_1")


def stop_step(errors: DataFrame, keys: Sequence[str], step: str, threshold: float) -> DataFrame:
    """First step of each series whose relative error is below the threshold."""
    return errors.groupBy(*keys).agg(
        F.min(F.when(F.col("rel_error") < threshold, F.col(step))).alias("stop_step")
    )


def poly_fit(df: DataFrame, keys: Sequence[str], x: str, y: str, degree: int) -> DataFrame:
    """(keys…, mid, half, coefs, n): least-squares polynomial in z = (x - mid) / half per series.

    Up to degree 6 the rows are brought down to sums of powers of z, one short row per series, by an ordinary
    aggregation, and only these rows are solved in Python. Such sums square the condition number, so higher degrees
    (up to 30) go by orthogonal triangles: see ``_fit_by_triangles``.
    """
    if not 0 <= degree <= 30:
        raise ValueError("degree must be between 0 and 30")
    keys = list(keys)
    if degree > 6:
        return _fit_by_triangles(df, keys, x, y, degree)
    ends = df.groupBy(*keys).agg(F.min(x).cast("double").alias("_a"), F.max(x).cast("double").alias("_b"))
    half = (F.col("_b") - F.col("_a")) / 2
    ends = ends.select(
        *keys, ((F.col("_a") + F.col("_b")) / 2).alias("mid"), F.when(half > 0, half).otherwise(1.0).alias("half")
    )
    rows = od.attach(df, ends, keys)
    z = (F.col(x) - F.col("mid")) / F.col("half")
    powers = [F.lit(1.0)]
    for _ in range(2 * degree):
        powers.append(powers[-1] * z)
    sums = rows.groupBy(*keys, "mid", "half").agg(
        F.array(*[F.sum(p) for p in powers]).alias("_zz"),
        F.array(*[F.sum(p * F.col(y)) for p in powers[: degree + 1]]).alias("_zy"),
        F.count("*").alias("n"),
    )
    place = np.add.outer(np.arange(degree + 1), np.arange(degree + 1))

    def solve(batches):
        for pdf in batches:
            if len(pdf):
                left = np.stack(pdf["_zz"].to_numpy())[:, place]
                right = np.stack(pdf["_zy"].to_numpy())[:, :, None]
                pdf = pdf.assign(coefs=list((np.linalg.pinv(left) @ right)[:, :, 0]))
            else:
                pdf = pdf.assign(coefs=pd.Series(dtype=object))
            yield pdf.drop(columns=["_zz", "_zy"])

    kept = [f for f in sums.schema.fields if f.name not in ("_zz", "_zy")]
    schema = T.StructType([*kept, T.StructField("coefs", T.ArrayType(T.DoubleType()))])
    return sums.mapInPandas(solve, schema)


def _triangle(rows: np.ndarray, width: int) -> np.ndarray:
    """The triangle R of a QR factorisation, ``width`` rows high however few rows there are."""
    return np.linalg.qr(np.vstack([rows, np.zeros((max(width - len(rows), 0), width))]), mode="r")


def _fit_by_triangles(df: DataFrame, keys: list[str], x: str, y: str, degree: int) -> DataFrame:
    """Per block of a series the triangle R of a QR factorisation of [Chebyshev polynomials of z | y], then one of them all.

    Stacked triangles of parts have the triangle of the whole, so the least-squares problem of a series of any length
    comes down to a matrix of ``degree + 2`` columns. A series is one block unless it is long. Blocks go by the hash of
    the point, equal points being one row with a weight, and grow with the root of the series, as do the triangles to stack.
    """
    width = degree + 2
    known = df.select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).dropna(subset=["_x", "_y"])
    points = known.groupBy(*keys, "_x", "_y").agg(F.count("*").alias("_w"))
    ends = points.groupBy(*keys).agg(
        F.min("_x").alias("_a"), F.max("_x").alias("_b"), F.count("*").alias("_points"), F.sum("_w").alias("n"))
    half = (F.col("_b") - F.col("_a")) / 2
    size = F.greatest(F.lit(float(FIT_ROWS)), F.sqrt(F.col("_points") * width))
    ends = ends.select(
        *keys, ((F.col("_a") + F.col("_b")) / 2).alias("mid"), F.when(half > 0, half).otherwise(1.0).alias("half"), "n",
        F.ceil(F.col("_points") / size).alias("_blocks"))
    z = (F.col("_x") - F.col("mid")) / F.col("half")
    head = [*keys, "mid", "half", "n"]
    rows = od.attach(points, ends, keys).select(
        *head, F.pmod(F.xxhash64("_x", "_y"), F.col("_blocks")).alias("_block"), z.alias("_z"), "_y", "_w")
    blocks = rows.groupBy(*head, "_block").agg(*[F.collect_list(c).alias(c) for c in ("_z", "_y", "_w")])
    own = T.StructType([blocks.schema[c] for c in head]).simpleString()[len("struct<"):-1].replace(":", " ")

    def first(batches):
        for pdf in batches:
            out = []
            for zs, ys, weights in zip(pdf["_z"], pdf["_y"], pdf["_w"]):
                basis = np.polynomial.chebyshev.chebvander(zs, degree)
                out.append(_triangle(np.column_stack([basis, ys]) * np.sqrt(weights)[:, None], width).ravel())
            yield pdf[head].assign(_r=pd.Series(out, dtype=object, index=pdf.index))

    parts = blocks.mapInPandas(first, f"{own}, _r array<double>")
    whole = parts.groupBy(*head).agg(F.collect_list("_r").alias("_r"))

    def solve(batches):
        for pdf in batches:
            out = []
            for stacked in pdf["_r"]:
                r = _triangle(np.concatenate(list(stacked)).reshape(-1, width), width)
                found = np.linalg.lstsq(r[: degree + 1, : degree + 1], r[: degree + 1, -1], rcond=1e-13)[0]
                plain = np.polynomial.chebyshev.cheb2poly(found)
                out.append(np.pad(plain, (0, degree + 1 - len(plain))))
            yield pdf[head].assign(coefs=pd.Series(out, dtype=object, index=pdf.index))

    return whole.mapInPandas(solve, f"{own}, coefs array<double>")


def poly_value(coefs: Column, mid: Column, half: Column, at: Column) -> Column:
    z = (at - mid) / half
    return F.aggregate(F.reverse(coefs), F.lit(0.0), lambda acc, c: acc * z + c)


def model_vs_actual(model: DataFrame, actual: DataFrame, on: Sequence[str]) -> DataFrame:
    """Pair modelled and observed values step by step."""
    return actual.join(model, list(on), "inner")


def positive_mask(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column) > 0)
