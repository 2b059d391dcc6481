"""Dead letters that come back as a stream: each event at most once, and none that was published before.

Copies of one event within the watermark meet in keyed state, which lets keys go once the watermark has passed them. What
is left of a batch is held against the events published by then, earlier replays included; that is read anew for
each batch, so nothing about published events is kept in state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tabloom.operators import events as ev
from tabloom.streaming.publish import publish_to, run_stream

LATE = "7 days"


def replay_stream(dead: DataFrame, published: Callable[[], DataFrame], still_bad: Column, path: str, checkpoint: str,
                  late: str = LATE) -> StreamingQuery:
    """Start the replay of the dead letters of a stream and write what is published again below ``path``.

    ``published`` gives the events on their topics as they are now; events below ``path`` count as published too. A
    batch that is repeated overwrites its own folder, and is not held against what it wrote itself.
    """
    failed_at = F.timestamp_seconds(ev.attr("failed_at").cast("bigint"))
    ready = dead.where(~F.coalesce(still_bad, F.lit(False))).withColumn("replay_time", failed_at)
    once = ready.withWatermark("replay_time", late).dropDuplicatesWithinWatermark(["key"]).drop("replay_time")
    write = publish_to(path)

    def handle(batch: DataFrame, batch_id: int) -> None:
        known = published().select("key")
        if batch_id:
            earlier = batch.sparkSession.read.parquet(path).where(F.col("batch") < batch_id)
            known = known.unionByName(earlier.select("key"))
        write(ev.replay_dead_letters(batch, known, F.lit(False)), batch_id)

    return run_stream(once, handle, checkpoint)
