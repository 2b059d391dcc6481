"""Named queries and, where SQL can say the same, their check query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name`` together with its check SQL."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle.strip()
        return fn

    return add


def hash_sql(key: str, seed: int = 0) -> str:
    """The sampling hash of a key column in check SQL."""
    return f"('0x' || substr(md5('{seed}:' || {key}), 1, 8))::BIGINT"


def table(spark: SparkSession, sf_dir: str, name: str, heavy: bool = False) -> DataFrame:
    """A table as Parquet; ``heavy`` says that each of its rows costs much work."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if heavy else df


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows out to ``spark.tabloom.input.partitions`` tasks, if the session sets it.

    A file with one row group is read by one task. Large tables have many row
    groups; leave the setting out there.
    """
    parts = df.sparkSession.conf.get("spark.tabloom.input.partitions", None)
    return df.repartition(int(parts)) if parts else df
