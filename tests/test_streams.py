"""Back-off, row-limited intake, whole batches by topic, replay: also after a stop, and with lost tasks."""

import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from tabloom.operators import events as ev
from tabloom.plans import QUERIES
from tabloom.sources import topics
from tabloom.streaming import backoff, intake, replay
from tabloom.streaming import publish as pb



def _events(df):
    return df.select("id", F.lit(ev.RAW_TOPIC).alias("topic"), F.concat(F.lit("k"), "id").alias("key"), F.lit("{}").alias("value"),
                     ev.known_attributes({"eventType": F.lit("t"), "failed_at": F.lit(1_700_000_000)}).alias("attributes"))


def _paths(folder, *names):
    return [str(folder / n) for n in names]


def test_refused_events_do_not_delay_others_and_outlive_a_stop(spark, tmp_path):
    source, tried, settled, first, later = _paths(tmp_path, "in", "tried", "settled", "p1", "p2")

    def _deliver(keys, rows, attempt):
        return [json.loads(row)["id"] % 5 <= attempt for row in rows]

    for a in (0, 50):  # a second batch goes out while events of the first still wait
        spark.range(a, a + 50).coalesce(1).write.mode("append").parquet(source)
        events = _events(pb.stream_table(spark, source))
        backoff.first_attempt(events, _deliver, tried, first).awaitTermination()
    got = spark.read.parquet(tried)
    assert got.count() == 100 and got.where("ok").count() == 20
    query = backoff.later_attempts(tried, _deliver, settled, later, spark, base=1.5, every="0 seconds")
    end = time.monotonic() + 60
    while time.monotonic() < end and not (query.lastProgress and sum(s["numRowsTotal"] for s in query.lastProgress["stateOperators"])):
        time.sleep(0.05)
    query.stop()  # events wait in the state of the checkpoint
    query = backoff.later_attempts(tried, _deliver, settled, later, spark, base=1.5, every="0 seconds")
    backoff.stop_when_settled(query, spark, tried, settled, 120)
    out = backoff.outcomes(spark.read.parquet(tried), spark.read.parquet(settled), events.schema, F.lit("2024-01-01").cast("timestamp")).collect()
    assert len(out) == len({r.key for r in out}) == 100
    assert {(r.id % 5, r.attempts, r.outcome) for r in out} == {
        (0, 1, "published"), (1, 2, "published"), (2, 3, "published"), (3, 4, "published"), (4, 4, "deadlettered")}
    assert all((r.topic == ev.DEAD_LETTER_TOPIC) == (r.attributes.get("error_reason") == "retries exhausted") for r in out)


def test_refused_events_are_tried_again_many_at_a_time(spark, tmp_path):
    source, tried, settled, first, later = _paths(tmp_path, "in", "tried", "settled", "p1", "p2")
    calls = str(tmp_path / "calls")

    def _deliver(keys, rows, attempt):
        if attempt:
            with open(calls, "a") as out:
                out.write(f"{attempt} {len(keys)}\n")
        return [json.loads(row)["id"] % 5 <= attempt for row in rows]

    rows = spark.range(300).unionByName(spark.range(100))  # a third of the keys come twice
    rows.withColumn("id", F.when(F.col("id") != 299, F.col("id"))).coalesce(2).write.parquet(source)  # and one has no key
    events = _events(pb.stream_table(spark, source).withColumn("id", F.coalesce("id", F.lit(299))))
    events = events.withColumn("key", F.when(F.col("id") != 299, F.col("key")))
    backoff.first_attempt(events, _deliver, tried, first).awaitTermination()
    query = backoff.later_attempts(tried, _deliver, settled, later, spark, base=0.1, every="0 seconds", groups=3)
    backoff.stop_when_settled(query, spark, tried, settled, 120)
    got = spark.read.parquet(settled).collect()
    assert len(got) == len({r.key for r in got}) == 240 and any(r.key is None for r in got)
    want = {1: (True, 2), 2: (True, 3), 3: (True, 4), 4: (False, 4)}
    assert all((r.ok, r.attempts) == want[json.loads(r.event)["id"] % 5] for r in got)
    made = [tuple(map(int, line.split())) for line in open(calls)]
    assert {a: sum(n for b, n in made if b == a) for a in (1, 2, 3)} == {1: 240, 2: 180, 3: 120}
    assert len(made) == 9  # a call per group and attempt


def test_intake_counts_rows(spark, tmp_path):
    source, progress = _paths(tmp_path, "in", "p")
    spark.range(0, 2500, 1, 3).write.option("parquet.block.size", 1000).parquet(source)
    sizes, seen = {}, []

    def handle(batch, i):
        seen.extend(r.id for r in batch.collect())
        sizes[i] = batch.count()

    def run(batches):
        query = intake.row_stream(spark, source, 400, progress, 150).writeStream.foreachBatch(handle).option(
            "checkpointLocation", progress).trigger(processingTime="0 seconds").start()
        end = time.monotonic() + 60
        while len(sizes) < batches and time.monotonic() < end and not query.exception():
            time.sleep(0.05)
        query.processAllAvailable() if batches == 7 else None
        query.stop()

    run(3)
    run(7)
    assert sorted(sizes.values()) == [100] + [400] * 6 and set(seen) == set(range(2500))
    spark.range(2500, 2600).coalesce(1).withColumn("id", F.col("id")).write.parquet(f"{source}-more")
    part, = (tmp_path / "in-more").glob("*.parquet")
    part.rename(tmp_path / "in" / "part-99999.parquet")  # files come in the order of their names
    run(8)
    assert sorted(sizes.values()) == [100, 100] + [400] * 6 and set(seen) == set(range(2600))


def test_ranges_of_a_row_group_go_on_where_the_last_one_ended(spark, tmp_path, monkeypatch):
    spark.range(0, 100_000, 1, 1).write.option("compression", "none").parquet(str(tmp_path / "in"))
    spark.range(100_000, 130_000, 1, 1).write.option("parquet.block.size", 50_000).mode("append").parquet(str(tmp_path / "in"))
    options = {"path": str(tmp_path / "in"), "max_rows": "7000", "task_rows": "3000", "checkpoint": str(tmp_path / "p")}
    reader = intake.RowRangeReader(options, spark.read.parquet(options["path"]).schema)
    opened, file = [], intake._file
    place, ranges = reader.initialOffset(), []
    while (end := reader.latestOffset()) != place:
        ranges += reader.partitions(place, end)
        place = end
    monkeypatch.setattr(intake, "_file", lambda path: opened.append(path) or file(path))

    def read(parts):
        return [[v for batch in reader.read(p) for v in batch["id"].to_pylist()] for p in parts]

    got = read(ranges)
    assert sorted(v for part in got for v in part) == list(range(130_000)) and len(ranges) > 40
    assert len(opened) == len(set(opened)) == 2  # not once for each range
    assert read(ranges[::-1]) == got[::-1]  # a range that comes again
    assert read(ranges[::3]) == got[::3]  # others are read elsewhere


def test_lanes_share_the_batches(spark, tmp_path):
    source, progress = _paths(tmp_path, "in", "p")
    spark.range(0, 2500, 1, 3).write.option("parquet.block.size", 1000).parquet(source)
    batches, together, lock = {}, threading.Barrier(3), threading.Lock()

    def handle(batch, i):
        rows = [r.id for r in batch.collect()]
        if i < 3:
            together.wait(60)  # the first batches of all lanes are at work
        with lock:
            assert i not in batches
            batches[i] = rows

    def run():
        queries = intake.start_lanes(spark, source, 400, handle, progress, 3)
        try:
            for query in queries:
                query.processAllAvailable()
        finally:
            for query in queries:
                query.stop()
        assert spark.conf.get(intake._LOGS, None) is None

    run()
    assert {i: len(rows) for i, rows in batches.items()} == dict.fromkeys(range(6), 400) | {6: 100}
    run()  # nothing new
    assert sorted(sum(batches.values(), [])) == list(range(2500))
    spark.range(2500, 3700).coalesce(1).write.parquet(f"{source}-more")
    part, = (tmp_path / "in-more").glob("*.parquet")
    part.rename(tmp_path / "in" / "part-99999.parquet")
    run()  # the lane whose batch was cut short fills it, the others take their turns
    assert sorted(map(len, batches.values())) == [100, 100, 300] + [400] * 8
    assert sorted(sum(batches.values(), [])) == list(range(3700))
    for query in intake.start_lanes(spark, source, 400, handle, progress, 2):
        with pytest.raises(Exception, match="goes on with the lane"):
            query.processAllAvailable()


def test_ranges_that_lanes_read_in_turn_go_on_in_a_worker(spark, tmp_path, monkeypatch):
    spark.range(0, 100_000, 1, 1).write.parquet(str(tmp_path / "in"))
    schema, opened, file = spark.read.parquet(str(tmp_path / "in")).schema, [], intake._file
    readers = [intake.RowRangeReader({"path": str(tmp_path / "in"), "max_rows": "1000", "task_rows": "3000", "lane": str(k), "lanes": "4",
                                      "checkpoint": str(tmp_path / f"p{k}")}, schema) for k in range(4)]
    ranges = [[], [], [], []]
    for k, reader in enumerate(readers):
        place = reader.initialOffset()
        while (end := reader.latestOffset()) != place:
            ranges[k] += reader.partitions(place, end)
            place = end
    assert all(p.stop - p.first == 1000 and p.first // 1000 % 4 == k for k in range(4) for p in ranges[k])
    monkeypatch.setattr(intake, "PLACES", [])
    monkeypatch.setattr(intake, "_file", lambda path: opened.append(path) or file(path))
    turns = [p for a in range(0, 25, 5) for k in (3, 0, 2, 1) for p in ranges[k][a : a + 5]]  # each lane some batches ahead of another
    got = [v for p in turns for batch in readers[0].read(p) for v in batch["id"].to_pylist()]
    assert got == [v for p in turns for v in range(p.first, p.stop)] and sorted(got) == list(range(100_000))
    assert len(opened) <= 4


def test_batches_of_the_intake_are_in_flight_together(spark, tmp_path, monkeypatch):
    together, publish_to = threading.Barrier(2), pb.publish_to

    def slow(path):
        write = publish_to(path)

        def handle(batch, i):
            if i < 2:
                together.wait(60)
            write(batch, i)

        return handle

    monkeypatch.setattr(pb, "publish_to", slow)
    spark.range(7000).withColumnRenamed("id", "event_id").write.parquet(str(tmp_path / "events.parquet"))
    assert [tuple(r) for r in QUERIES["throttled_intake"](spark, str(tmp_path)).collect()] == [(7000, 3, 3000)]


def test_batches_of_topics_are_whole(spark, tmp_path):
    path = str(tmp_path / "sink")
    events = _events(spark.range(0, 100, 1, 4)).withColumn(
        "topic", F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b"))
    topics.write_batch(events, path, "one")
    topics.write_batch(events, path, "one")  # changes nothing
    assert topics.read(spark, path).count() == 100
    assert topics.read(spark, path, "a").count() == 34 and topics.read(spark, path, "b").count() == 33
    assert len(list((tmp_path / "sink" / "data").iterdir())) == topics.manifest(spark, path).count()
    broken = events.where("id < 90").unionByName(events.withColumn("id", F.expr("if(id = 99, raise_error('lost'), id)")))
    with pytest.raises(Exception, match="lost"):
        topics.write_batch(broken, path, "two")
    assert topics.read(spark, path).count() == 100
    assert {r.batch for r in topics.manifest(spark, path).collect()} == {"one"}
    assert sorted(map(tuple, topics.read(spark, path).select("id", "key").collect())) == [(i, f"k{i}") for i in range(100)]


def test_stream_into_topics(spark, tmp_path):
    source, path, progress = _paths(tmp_path, "in", "sink", "p")
    for a in (0, 30):
        spark.range(a, a + 30).write.mode("append").parquet(source)
        topics.write_stream(_events(pb.stream_table(spark, source)), path, progress).awaitTermination()
    assert topics.read(spark, path).select("key").distinct().count() == topics.read(spark, path).count() == 60
    assert sorted(r.batch for r in topics.manifest(spark, path).select("batch").distinct().collect()) == ["0" * 12, "0" * 11 + "1"]


def test_replayed_once(spark, tmp_path):
    source, out, progress = _paths(tmp_path, "dead", "out", "p")
    dead = _events(spark.range(20)).withColumn("topic", F.lit(ev.DEAD_LETTER_TOPIC))
    published = _events(spark.range(5))
    for copies in (2, 1):
        for _ in range(copies):
            dead.coalesce(1).write.mode("append").parquet(source)
        stream = pb.stream_table(spark, source, files_per_trigger=1)
        run = replay.replay_stream(stream, lambda: published, F.col("id") >= 15, out, progress, late="1 hour")
        run.awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(5, 15))
    later = dead.withColumn("attributes", F.map_concat(
        F.map_filter("attributes", lambda k, _: k != "failed_at"), F.create_map(F.lit("failed_at"), F.lit(str(1_700_100_000)))))
    for rows in (later.where("id = 0"), later.where("id = 1")):  # the watermark passes the first keys: they leave the state
        rows.coalesce(1).write.mode("append").parquet(source)
        run = replay.replay_stream(pb.stream_table(spark, source), lambda: published, F.col("id") >= 15, out, progress, late="1 hour")
        run.awaitTermination()
    assert run.lastProgress["stateOperators"][0]["numRowsTotal"] <= 2
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(5, 15))
