"""Readers with declared schemas."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.operators.rollup import ROLLUP_COLUMNS
from tabloom.sources.inline import inline_table


def scan_text(spark: SparkSession, path: str) -> DataFrame:
    """One row per line, column ``line``. Large files are split between tasks."""
    return spark.read.text(path).withColumnRenamed("value", "line")


def scan_csv(spark: SparkSession, path: str, schema: str, **options: str) -> DataFrame:
    """CSV with a header and a declared schema, so no pass over the data to guess types."""
    reader = spark.read.schema(schema).option("header", True).options(**options)
    return reader.csv(path)


def scan_csv_latin1(spark: SparkSession, path: str, schema: str, **options: str) -> DataFrame:
    return scan_csv(spark, path, schema, encoding="ISO-8859-1", **options)


def scan_chunked(
    spark: SparkSession,
    path: str,
    schema: str,
    handle: Callable[[DataFrame, int], None],
    checkpoint: str,
    files_per_chunk: int = 1,
    fmt: str = "parquet",
    **options: str,
) -> int:
    """Give the files to ``handle(rows, chunk number)`` some at a time; returns how many chunks this run gave.

    Progress is kept in the checkpoint folder, so a broken run goes on where it
    stopped instead of starting anew.
    """
    stream = (
        spark.readStream.schema(schema)
        .options(**options)
        .option("maxFilesPerTrigger", files_per_chunk)
        .format(fmt)
        .load(path)
    )
    seen = set()

    def count_and_handle(rows: DataFrame, chunk: int) -> None:
        handle(rows, chunk)
        seen.add(chunk)

    run = (
        stream.writeStream.foreachBatch(count_and_handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    return len(seen)


def scan_rollup_dir(spark: SparkSession, folder: str) -> tuple[DataFrame, dict[str, str]]:
    """All rollup files of a folder as one long table, and what happened to each of the eight.

    A file that is not there is left out; one without its two columns fails alone.
    """
    parts, state = [], {}
    for kind, dimension in ROLLUP_COLUMNS.items():
        try:
            found = spark.read.option("header", True).csv(f"{folder}/movies_{kind}.csv")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            state[kind] = "missing"
            continue
        if not {dimension, "movie_count"} <= set(found.columns):
            state[kind] = "wrong columns"
            continue
        state[kind] = "read"
        parts.append(
            found.select(
                F.lit(kind).alias("aggregation_type"),
                F.col(dimension).alias("dimension"),
                F.col("movie_count").try_cast("bigint").alias("movie_count"),
                F.lit(f"movies_{kind}.csv").alias("data_source"),
            )
        )
    if not parts:
        schema = "aggregation_type string, dimension string, movie_count bigint, data_source string"
        return inline_table(spark, [], schema), state
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out, state
