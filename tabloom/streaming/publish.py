"""Publishing with Structured Streaming: file intake, routing, retries and live counts.

Each micro-batch writes below its own batch number. If a batch is repeated
after a failure it overwrites what it wrote before, so every event is there
once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.operators.events import DEAD_LETTER_TOPIC, noted
from tabloom.session import staging_path

# Publishing defaults.
BATCH_WAIT = "10 seconds"
MAX_RETRIES, BACKOFF_BASE = 3, 2


def stream_table(
    spark: SparkSession, folder: str, files: str = "*.parquet", files_per_trigger: int | None = None
) -> DataFrame:
    """Parquet files of a folder as a stream; the schema is that of the files now there."""
    schema = spark.read.option("pathGlobFilter", files).parquet(folder).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", files)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def run_stream(
    events: DataFrame,
    handle: Callable[[DataFrame, int], None],
    checkpoint: str,
    mode: str = "append",
    every: str | None = None,
):
    """Start the stream: all that is there now and then stop, or a batch ``every`` so often (usually `BATCH_WAIT`)."""
    writer = events.writeStream.foreachBatch(handle).outputMode(mode).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def publish_to(path: str) -> Callable[[DataFrame, int], None]:
    """Batch handler that writes events by topic below ``path``."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").partitionBy("topic").parquet(f"{path}/batch={batch_id}")

    return handle


def keep_updates(path: str) -> Callable[[DataFrame, int], None]:
    """Batch handler for updated results: the newest row of a key is its current state."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return handle


def current_result(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The last row of each key that ``keep_updates`` wrote."""
    states = spark.read.option("basePath", path).parquet(path)
    values = [c for c in states.columns if c not in (*keys, "batch")]
    last = states.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_last"))
    return last.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in values])


def publish_stream(spark: SparkSession, events: DataFrame, label: str) -> DataFrame:
    """Publish everything now available and return what was written."""
    path = staging_path(spark, label)
    run_stream(events, publish_to(path), staging_path(spark, f"{label}-progress")).awaitTermination()
    return spark.read.parquet(path)


def live_rollup(spark: SparkSession, counts: DataFrame, label: str, keys: Sequence[str]) -> DataFrame:
    """Run a streaming count over all input now available and return its last state.

    Each batch writes the keys it changed. With a watermark, state of closed windows is let go and late rows are dropped.
    """
    path = staging_path(spark, label)
    run_stream(counts, keep_updates(path), staging_path(spark, f"{label}-progress"), mode="update").awaitTermination()
    return current_result(spark, path, keys)


def windowed_counts(events: DataFrame, time: str, dimension: str, width: str, late: str) -> DataFrame:
    """Count per time window and dimension; rows later than ``late`` are dropped and old windows let go."""
    return (
        events.withWatermark(time, late)
        .groupBy(F.window(time, width), dimension)
        .agg(F.count("*").alias("n"))
        .select(F.col("window.start").alias("window_start"), dimension, "n")
    )


def retry_publish(
    events: DataFrame,
    deliver: Callable[[DataFrame, int], DataFrame],
    failed_at: Column,
    max_retries: int = MAX_RETRIES,
    pause: Callable[[float], None] | None = None,
) -> DataFrame:
    """Deliver events, trying the failed ones again; the exhausted become dead letters.

    ``deliver(rows, attempt)`` hands rows to the sink and returns them with a
    boolean ``ok``. Its answer is written down before it is used, because a
    delivery must not happen again when a lost task is recomputed. ``pause`` is
    given the seconds to wait before each attempt. Returns the rows with
    ``attempts`` and ``outcome``.
    """
    spark = events.sparkSession
    done, waiting = [], events
    for attempt in range(max_retries + 1):
        if pause and attempt:
            pause(backoff_seconds(attempt))
        path = staging_path(spark, f"attempt-{attempt}")
        deliver(waiting, attempt).withColumn("attempts", F.lit(attempt + 1)).write.parquet(path)
        tried = spark.read.parquet(path)
        done.append(tried.filter("ok").withColumn("outcome", F.lit("published")))
        waiting = tried.filter(~F.col("ok")).drop("ok", "attempts")
        last = tried.filter(~F.col("ok"))
    notes = {
        "error_reason": F.lit("retries exhausted"),
        "failed_at": F.unix_seconds(failed_at),
        "original_topic": F.col("topic"),
    }
    done.append(
        last.withColumns(
            {
                "attributes": noted(F.col("attributes"), notes),
                "topic": F.lit(DEAD_LETTER_TOPIC),
                "outcome": F.lit("deadlettered"),
            }
        )
    )
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.drop("ok")


def backoff_seconds(attempt: int) -> float:
    """Wait before a retry; the first try has none."""
    return 0.0 if attempt == 0 else float(BACKOFF_BASE**attempt)
