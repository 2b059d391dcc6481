"""Discretising, encoding and scaling of feature columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions import clean as cl
from tabloom.functions.binning import count_above
from tabloom.operators.ordered import BLOCK_ROWS, attach, exact_quantiles, group_quantiles


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def cut_equal_width(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Add ``bin, lo, hi`` for k equal-width right-closed bins.

    The lowest edge is moved down by a thousandth of the range so that the
    minimum has a bin. If all values are equal the edges lie around that value.
    """
    c = F.col(column).cast("double")
    ends = df.agg(F.min(c).alias("a"), F.max(c).alias("b"))
    flat = F.col("a") == F.col("b")
    pad = F.when(F.col("a") == 0, 0.001).otherwise(F.abs("a") * 0.001)
    ends = ends.select(
        flat.alias("flat"), F.when(flat, F.col("a") - pad).otherwise(F.col("a")).alias("low"),
        F.when(flat, F.col("b") + pad).otherwise(F.col("b")).alias("high"),
    )
    span = F.col("high") - F.col("low")
    first = F.when(F.col("flat"), F.col("low")).otherwise(F.col("low") - span * 0.001)
    inner = [F.col("low") + span / bins * i for i in range(1, bins)]
    # The edges are worked out once, in the one-row subquery.
    edges = ends.select(F.array(first, *inner, F.col("high"))).scalar()
    code = F.when(c.isNotNull(), count_above(c, [edges[i] for i in range(1, bins)]))
    numbered = df.withColumn("bin", code)
    return numbered.withColumns({"lo": F.get(edges, F.col("bin")), "hi": F.get(edges, F.col("bin") + 1)})


def qcut(
    df: DataFrame,
    column: str,
    q: int,
    labels: Sequence[str] | None = None,
    out: str = "qbin",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add the exact quantile bin, right-closed with the minimum included."""
    probs = [i / q for i in range(1, q)]
    row = exact_quantiles(df, column, probs, block_rows)
    cuts = row.select(F.struct(*row.columns)).scalar()
    c = F.col(column).cast("double")
    code = F.when(c.isNotNull(), count_above(c, [cuts[f"q{i}"] for i in range(len(probs))]))
    if labels:
        code = F.element_at(F.array(*[F.lit(x) for x in labels]), code + 1)
    return df.withColumn(out, code)


def qcut_by(df: DataFrame, keys: Sequence[str], column: str, q: int, out: str = "qbin", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add the exact quantile bin within the row's group, right-closed with the minimum included; null keys are a group."""
    cuts = group_quantiles(df, keys, column, [i / q for i in range(1, q)], block_rows)
    marks = [f"_cut{i}" for i in range(q - 1)]
    rows = attach(df, cuts.withColumnsRenamed({f"q{i}": m for i, m in enumerate(marks)}), keys)
    c = F.col(column).cast("double")
    code = F.when(c.isNotNull() & ~F.isnan(c), count_above(c, [F.col(m) for m in marks]))
    return rows.withColumn(out, code).drop(*marks)


def one_hot(df: DataFrame, column: str, max_values: int = 1000) -> DataFrame:
    """Indicator columns beside the original, in value order; null gives all zeros.

    Wide output needs its column names when the plan is made, so the distinct
    values are read first; more than ``max_values`` of them is an error.
    """
    found = df.select(column).filter(F.col(column).isNotNull()).distinct().limit(max_values + 1).collect()
    if len(found) > max_values:
        raise ValueError(f"{column} has more than {max_values} values")
    values = sorted(r[0] for r in found)
    return df.withColumns(
        {f"{column}_{v}": F.coalesce((F.col(column) == v).cast("int"), F.lit(0)) for v in values}
    )


def standardize(df: DataFrame, columns: Sequence[str], train: Column | None = None) -> DataFrame:
    """(x - mean) / population deviation, both taken from the training rows."""
    fit = df.filter(train) if train is not None else df
    stats = fit.agg(
        F.struct(
            *[F.avg(c).alias(f"m_{c}") for c in columns],
            *[F.stddev_pop(c).alias(f"s_{c}") for c in columns],
        )
    ).scalar()
    return df.withColumns(
        {f"{c}_z": F.try_divide(F.col(c) - stats[f"m_{c}"], stats[f"s_{c}"]) for c in columns}
    )


def poly_features(c: Column, degree: int, name: str) -> list[Column]:
    return [F.pow(c, F.lit(float(d))).alias(f"{name}_{d}") for d in range(1, degree + 1)]


def compartments(df: DataFrame, population: float = 66e6) -> DataFrame:
    """Recovered, Infected and Susceptible per day, in date order."""
    day = cl.parse_date(F.col("date"), "yyyyMMdd")
    recovered = cl.row_sum(F.col("recovered"), F.col("death"))
    infected = cl.row_sum(F.col("positive")) - recovered
    return df.select(
        day.alias("date"),
        (F.lit(population) - infected - recovered).alias("Susceptible"),
        infected.alias("Infected"),
        recovered.alias("Recovered"),
    ).orderBy("date")
