"""Sinks. Every writer overwrites its own target, so a repeated job leaves one result."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.operators.ordered import BLOCK_ROWS, running_sums, split_long


def sink_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """CSV with a header. ``single_file`` is for results known to be small."""
    out = df.coalesce(1) if single_file else df
    out.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def sink_json(df: DataFrame, path: str, single_file: bool = False) -> None:
    (df.coalesce(1) if single_file else df).write.mode("overwrite").json(path)


def sink_kv_text(counts: DataFrame, path: str, key: str = "word", value: str = "count") -> None:
    """``key<TAB>count`` lines; keys are in order within each output file. The counts lie by key already."""
    spread = counts.select(key, value).sortWithinPartitions(key)
    plain = {"sep": "\t", "quote": "", "emptyValue": ""}
    spread.write.mode("overwrite").options(**plain).csv(path)


def kafka_rows(events: DataFrame) -> DataFrame:
    """The columns a Kafka sink takes: topic, key, value and headers."""
    headers = F.transform(
        F.map_entries("attributes"),
        lambda e: F.struct(e["key"].alias("key"), e["value"].cast("binary").alias("value")),
    )
    return events.select("topic", F.col("key").cast("binary"), F.col("value").cast("binary"), headers.alias("headers"))


def byte_budget_extract(
    df: DataFrame,
    order: str,
    columns: Sequence[str],
    budget_bytes: int = 25 * 1024 * 1024,
    chunk_rows: int = 10_000,
    header: bool = True,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The longest run of whole row chunks, from the first row on, whose CSV file fits the budget.

    A line is as long as ``sink_csv`` writes it, quotes included; the header counts unless it is left out.

    Row numbers and byte sums are running sums over blocks, so no task sees all
    rows. The last chunk may be short. ``order`` must be unique.
    """
    line = F.to_csv(F.struct(*columns), {"escape": '"'})
    sized = df.withColumn("_bytes", F.octet_length(line) + 1)
    header_bytes = len(",".join(columns).encode()) + 1 if header else 0
    split = split_long(sized, [], order, block_rows)
    summed = running_sums(split, {"_row": F.lit(1), "_sum": F.col("_bytes")})
    total = df.agg(F.count("*")).scalar()
    ends = (F.col("_row") % chunk_rows == 0) | (F.col("_row") == total)
    fits = ends & (F.col("_sum") + header_bytes <= budget_bytes)
    last = summed.agg(F.coalesce(F.max(F.when(fits, F.col("_row"))), F.lit(0))).scalar()
    return summed.filter(F.col("_row") <= last).drop("_bytes", "_row", "_sum")
