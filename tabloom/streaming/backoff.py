"""Publishing with back-off that holds nothing up: refused events wait in keyed state, each until its own time.

Two streams. The first hands every event to the sink once, a partition at a time, and writes down the sink's answers
through Spark's file sink, whose log makes each batch visible as a whole or not at all. The second stream reads the
refused events from there. Per group of event keys it keeps the events, their numbers of attempts and when each is due
next; a processing-time timer calls the group when its first event is due, and events that are not due are not tried.
Both streams go on from their checkpoints.

A delivery whose answer was lost with its task is made again, so the sink must know events by their key.
"""

from __future__ import annotations

import pickle
import time
import zlib
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tabloom.operators.events import DEAD_LETTER_TOPIC, noted
from tabloom.streaming.publish import BACKOFF_BASE, MAX_RETRIES

Deliver = Callable[[Sequence[str], Sequence[str], int], Sequence[bool]]
_TRIED = "key string, event string, ok boolean"
_SETTLED = "key string, event string, ok boolean, attempts int"
GROUPS = 4096


def first_attempt(events: DataFrame, deliver: Deliver, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Deliver all events once and write (key, event, ok) below ``path``; ``event`` is the row as JSON.

    ``deliver(keys, events, attempt)`` runs in the tasks and says for each event whether the sink took it.
    """
    packed = events.select(F.col("key"), F.to_json(F.struct("*")).alias("event"))

    def run(frames):
        for frame in frames:
            yield frame.assign(ok=list(deliver(frame["key"].tolist(), frame["event"].tolist(), 0)))

    writer = packed.mapInPandas(run, _TRIED).writeStream.format("parquet").option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start(path)


def later_attempts(tried: str, deliver: Deliver, path: str, checkpoint: str, spark, max_retries: int = MAX_RETRIES,
                   base: float = BACKOFF_BASE, every: str = "1 second", groups: int = GROUPS) -> StreamingQuery:
    """Try the refused events below ``tried`` again, ``base ** attempt`` seconds after their last attempt.

    Writes (key, event, ok, attempts) below ``path`` once an event is settled: taken, or refused ``max_retries`` times more.
    An event that is settled leaves no state. Each batch looks at the timers, so ``every``, or a second if that is longer,
    bounds how late one is: a source of ticks makes a batch due each second, since a query that is started again
    runs none of its own accord before there is input.

    The keys fall into so many ``groups`` by their hash, and the sink is given the events of a group that are due together,
    so a batch costs a call per group and not one per event. A checkpoint goes on with the number it began with.
    """

    def attempt(_, frames, state: GroupState):
        now = state.getCurrentProcessingTimeMs()
        waiting = pickle.loads(zlib.decompress(bytes(state.get[0]))) if state.exists else {}  # by key: event, tries, when due
        if not state.hasTimedOut:
            for frame in frames:
                for key, event in zip(frame["key"], frame["event"]):  # the same event again, while it waits, changes nothing
                    waiting.setdefault(key, (event, 1, now + max(1, round(1000 * base))))
        due: dict[int, list] = {}
        for key, (_event, tries, at) in waiting.items():
            if at <= now:
                due.setdefault(tries, []).append(key)
        for tries, keys in due.items():
            answers = list(deliver(keys, [waiting[k][0] for k in keys], tries))
            tries += 1
            last = []
            for key, ok in zip(keys, answers, strict=True):
                event = waiting[key][0]
                if ok or tries > max_retries:
                    del waiting[key]
                    last.append((key, event, bool(ok), tries))
                else:
                    waiting[key] = event, tries, now + max(1, round(1000 * base**tries))
            if last:
                yield pd.DataFrame(last, columns=["key", "event", "ok", "attempts"])
        if waiting:
            state.update((zlib.compress(pickle.dumps(waiting), 1),))
            state.setTimeoutDuration(max(1, min(at for _, _, at in waiting.values()) - now))
        elif state.exists:
            state.remove()

    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load().where("value < 0")
    ticks = ticks.select(F.lit("").alias("key"), F.lit("").alias("event"), F.lit(False).alias("ok"))
    refused = spark.readStream.schema(_TRIED).parquet(tried).where(~F.col("ok")).unionByName(ticks)
    grouped = refused.withColumn("group", F.pmod(F.xxhash64("key"), F.lit(groups)))
    settled = grouped.groupBy("group").applyInPandasWithState(
        attempt, _SETTLED, "waiting binary", "append", GroupStateTimeout.ProcessingTimeTimeout)
    writer = settled.writeStream.format("parquet").option("checkpointLocation", checkpoint)
    return writer.outputMode("append").trigger(processingTime=every).start(path)


def stop_when_settled(query: StreamingQuery, spark, tried: str, settled: str, timeout: float = 600) -> None:
    """Wait until every event that is refused by now has a last answer, then stop the query of the later attempts.

    ``timeout`` is how many seconds may pass without a new answer. Looking takes no more than half of the time.
    """
    waiting = spark.read.schema(_TRIED).parquet(tried).where(~F.col("ok")).select("key").distinct().count()
    known, end = 0, time.monotonic() + timeout
    while time.monotonic() < end:
        if query.exception():
            raise query.exception()
        began = time.monotonic()
        if not waiting:
            query.stop()
            return
        if query.lastProgress:  # its sink is there once a batch has ended
            answers = spark.read.schema(_SETTLED).parquet(settled)
            found = answers.count()
            if found >= waiting and answers.select("key").distinct().count() >= waiting:
                query.stop()
                return
            if found > known:
                known, end = found, time.monotonic() + timeout
        time.sleep(max(0.2, time.monotonic() - began))
    query.stop()
    raise TimeoutError("events are still waiting")


def outcomes(tried: DataFrame, settled: DataFrame, schema: str, failed_at: Column) -> DataFrame:
    """The events with ``attempts`` and ``outcome``; those never taken are noted and on the dead-letter topic.

    Refused events that still wait have no row yet.
    """
    first = tried.where("ok").select("event", "ok", F.lit(1).alias("attempts"))
    rows = first.unionByName(settled.select("event", "ok", "attempts"))
    rows = rows.select(F.from_json("event", schema).alias("e"), "ok", "attempts").select("e.*", "ok", "attempts")
    notes = {
        "error_reason": F.lit("retries exhausted"),
        "failed_at": F.unix_seconds(failed_at),
        "original_topic": F.col("topic"),
    }
    return rows.withColumns({
        "attributes": F.when(F.col("ok"), F.col("attributes")).otherwise(noted(F.col("attributes"), notes)),
        "topic": F.when(F.col("ok"), F.col("topic")).otherwise(F.lit(DEAD_LETTER_TOPIC)),
        "outcome": F.when(F.col("ok"), F.lit("published")).otherwise(F.lit("deadlettered")),
    }).drop("ok")
