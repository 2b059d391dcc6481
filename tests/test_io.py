"""Readers, writers and streams, with small splits to force records across them."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from tabloom.functions import binning as bn
from tabloom.functions import clean as cl
from tabloom.operators import events as ev
from tabloom.operators import rollup as ro
from tabloom.session import staging_path, staging_root
from tabloom.sources import onefile, readers, writers
from tabloom.sources.dirty_csv import scan_dirty_csv
from tabloom.sources.inline import inline_table
from tabloom.streaming import publish as pb

PROBE = '''id,title,genres,revenue
1,"He said \\"hi\\", ok","Drama, Crime",100
2,"She said ""yo"", ok","Drama",5
3,plain,"",abc
4.5,half,"A,,B ",7
x,"multi
line","A",8
6,too,many,cols,here
7,short
'''


def test_dirty_csv_probe(spark, tmp_path):
    (tmp_path / "p.csv").write_text(PROBE)
    rows, bad = scan_dirty_csv(spark, str(tmp_path / "p.csv"))
    got = {r.id: r for r in rows.collect()}
    assert set(got) == {"1", "2", "3", "4.5", "x", "7"}
    assert got["1"].title == 'He said "hi", ok' and got["2"].title == 'She said "yo", ok'
    assert got["3"].genres == "" and got["x"].title == "multi\nline" and got["7"].genres is None
    assert [r.text for r in bad.collect()] == ["6,too,many,cols,here"]
    kept = rows.withColumn("id", cl.strict_int64(F.col("id"))).filter("id is not null")
    assert sorted(r.id for r in kept.collect()) == [1, 2, 3, 7]


@pytest.mark.parametrize("split", [97, 1000, 10**7])
def test_dirty_csv_over_split_borders(spark, tmp_path, split):
    rnd = random.Random(split)
    pieces = ["a", "bc", ",", '"', "\n", "é", "\\", " ", "line\nline\nline\n", ""]
    want = []
    for part in range(2):
        rows = [[f"{part}-{i}", "".join(rnd.choices(pieces, k=rnd.randrange(6))), str(i)] for i in range(150)]
        want += [tuple(r) for r in rows]
        buffer = io.StringIO()
        out = csv.writer(buffer, lineterminator="\n")
        out.writerow(["id", "text", "n"])
        for r in rows:
            out.writerow([r[0], r[1].replace("\\", "\\\\"), r[2]])
        (tmp_path / f"{part}.csv").write_text(buffer.getvalue())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        rows, bad = scan_dirty_csv(spark, str(tmp_path), ["id", "text", "n"])
        got, left = sorted(map(tuple, rows.collect())), bad.count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert left == 0
    assert got == sorted(want)


def test_open_quote_is_an_error(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("tabloom.sources.dirty_csv.MAX_SPLITS", 3)
    (tmp_path / "open.csv").write_text('id,t\n1,"left open\n' + "2,x\n" * 200)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    try:
        with pytest.raises(ValueError, match="left open"):
            scan_dirty_csv(spark, str(tmp_path / "open.csv"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


class _Session:
    """Just enough of a session to ask for a setting."""

    def __init__(self, master, folder=None):
        self.conf = {"spark.checkpoint.dir": folder} if folder else {}
        self.sparkContext = self
        self.master, self.applicationId, self.folder = master, f"app-{master}", None

    def setCheckpointDir(self, folder):
        self.folder = folder


def test_staging_folder(spark):
    assert staging_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir").rstrip("/") + "/x-")
    assert staging_root(_Session("yarn", "/shared/place")) == "/shared/place"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        staging_root(_Session("yarn"))
    alone = _Session("local[2]")
    assert staging_root(alone) == staging_root(alone) == alone.folder


def test_rollup_folder_with_gaps(spark, tmp_path):
    writers.sink_csv(inline_table(spark, [("Drama", 3), (None, 1)], "genre string, movie_count bigint"), str(tmp_path / "movies_by_genre.csv"))
    writers.sink_csv(inline_table(spark, [("x", 1)], "wrong string, movie_count bigint"), str(tmp_path / "movies_by_year.csv"))
    rows, state = readers.scan_rollup_dir(spark, str(tmp_path))
    assert state["by_genre"] == "read" and state["by_year"] == "wrong columns" and state["by_region"] == "missing"
    assert sorted((r.dimension or "", r.movie_count) for r in rows.collect()) == [("", 1), ("Drama", 3)]
    none, _ = readers.scan_rollup_dir(spark, str(tmp_path / "nowhere"))
    assert none.count() == 0


def test_csv_and_json_sinks(spark, tmp_path):
    df = inline_table(spark, [(1, 'a "b", c', 2.5), (2, None, None)], "i int, s string, d double")
    writers.sink_csv(df, str(tmp_path / "c"), single_file=True)
    assert len(list((tmp_path / "c").glob("part-*"))) == 1
    back = readers.scan_csv(spark, str(tmp_path / "c"), "i int, s string, d double", escape='"')
    assert sorted(map(tuple, back.collect())) == [(1, 'a "b", c', 2.5), (2, None, None)]
    writers.sink_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2


@pytest.mark.parametrize("block", [2_000_000, 40])
def test_one_ordered_file(spark, tmp_path, block):
    rows = [(i * 7919 % 1009, f'é "q", {i}' if i % 3 else None) for i in range(1009)]
    df = inline_table(spark, rows, "i int, s string").repartition(6)
    path = tmp_path / "out" / "one.csv"
    size = onefile.sink_csv_file(df, f"file://{path}", [F.asc("i")], block)
    assert size == path.stat().st_size
    back = list(csv.DictReader(io.StringIO(path.read_text(encoding="utf-8"))))
    assert [(int(r["i"]), r["s"] or None) for r in back] == sorted(rows)
    onefile.sink_csv_file(df.limit(0), str(path), [F.asc("i")], block)
    assert path.read_text() == "i,s\n"
    with pytest.raises(ValueError, match="mounted"):
        onefile.sink_csv_file(df, "hdfs://x/one.csv", [F.asc("i")])


def test_kv_text_is_sorted_within_files(spark, tmp_path):
    writers.sink_kv_text(spark.range(200).select(F.col("id").cast("string").alias("word"), F.lit(1).alias("count")), str(tmp_path / "kv"))
    for part in (tmp_path / "kv").glob("part-*"):
        words = [line.split("\t")[0] for line in part.read_text().splitlines()]
        assert words == sorted(words)


def _events(df):
    return df.select("id", F.lit(ev.RAW_TOPIC).alias("topic"), F.col("id").cast("string").alias("key"), F.lit("{}").alias("value"),
                     ev.known_attributes({"eventType": F.lit("t")}).alias("attributes"))


def test_retries_try_only_what_failed(spark):
    seen = []

    def deliver(rows, attempt):
        seen.append(rows.count())
        return rows.withColumn("ok", F.col("id") % 5 <= attempt)

    out = pb.retry_publish(_events(spark.range(50)), deliver, F.lit("2024-01-01").cast("timestamp")).collect()
    assert seen == [50, 40, 30, 20] and len(out) == 50
    assert {(r.id % 5, r.attempts, r.outcome) for r in out} == {
        (0, 1, "published"), (1, 2, "published"), (2, 3, "published"), (3, 4, "published"), (4, 4, "deadlettered")}
    assert all(r.attributes["original_topic"] == ev.RAW_TOPIC for r in out if r.outcome == "deadlettered")
    assert [pb.backoff_seconds(a) for a in range(4)] == [0, 2, 4, 8]


def test_stream_goes_on_and_repeats_nothing(spark, tmp_path):
    source, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    for start in (0, 100):
        spark.range(start, start + 100).write.mode("append").parquet(source)
        stream = _events(pb.stream_table(spark, source))
        pb.run_stream(stream, pb.publish_to(out), progress).awaitTermination()
        # A repeated batch overwrites its own folder.
        pb.publish_to(out)(_events(spark.range(100)), 0)
    assert spark.read.parquet(out).count() == 200
    assert spark.read.parquet(out).select("key").distinct().count() == 200


def test_windowed_counts(spark, tmp_path):
    rows = spark.range(100).select(F.timestamp_seconds(F.col("id") * 30).alias("ts"), (F.col("id") % 2).alias("kind"))
    rows.write.parquet(str(tmp_path / "in"))
    counts = pb.windowed_counts(pb.stream_table(spark, str(tmp_path / "in")), "ts", "kind", "10 minutes", "1 minute")
    got = {(r.window_start.minute, r.kind): r.n for r in pb.live_rollup(spark, counts, "w", ["window_start", "kind"]).collect()}
    assert got == {(m, k): 10 for m in (0, 10, 20, 30, 40) for k in (0, 1)}


def test_late_rows_are_dropped_and_state_let_go(spark, tmp_path):
    source, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    states = []
    for minutes in ((0, 1, 2), (600, 601), (3, 602)):  # the third batch has a row that comes 10 hours late
        spark.createDataFrame([(m,) for m in minutes], "m long").select(
            F.timestamp_seconds(F.col("m") * 60).alias("ts"), F.lit("a").alias("kind")).coalesce(1).write.mode("append").parquet(source)
        counts = pb.windowed_counts(pb.stream_table(spark, source), "ts", "kind", "10 minutes", "1 minute")
        run = pb.run_stream(counts, pb.keep_updates(out), progress, mode="update")
        run.awaitTermination()
        states.append(run.lastProgress["stateOperators"][0]["numRowsTotal"])
    got = {int(r.window_start.timestamp() // 60): r.n for r in pb.current_result(spark, out, ["window_start", "kind"]).collect()}
    assert got == {0: 3, 600: 3} and states[-1] == 1


def test_chunked_scan_sees_every_row_once(spark, tmp_path):
    spark.range(100).repartition(5).write.parquet(str(tmp_path / "in"))
    sizes = []
    n = readers.scan_chunked(spark, str(tmp_path / "in"), "id bigint", lambda rows, i: sizes.append(rows.count()), str(tmp_path / "p"), 2)
    assert n == 3 and len(sizes) == 3 and sum(sizes) == 100


def test_kafka_rows(spark):
    row = writers.kafka_rows(_events(spark.range(1))).first()
    assert bytes(row.key) == b"0" and row.headers[0].key == "eventType"


def test_rollups_agree_with_single_counts(spark):
    rows = [("Drama, Crime", "France", 2001, 7.5), ("Drama", "", 2001, None), ("", "France,Japan", None, 3.0)]
    raw = inline_table(spark, rows, "genres string, production_countries string, release_year int, vote_average double")
    facts = ro.with_bins(
        raw.withColumns({
            "genres": cl.split_list(F.col("genres")), "production_countries": cl.split_list(F.col("production_countries")),
            "release_decade": cl.decade(F.col("release_year")), "original_language": F.lit("en"),
            "revenue": F.lit(1.0), "runtime": F.lit(90.0),
        })
    )
    long = {(r.aggregation_type, r.dimension): r.movie_count for r in ro.all_rollups(facts).collect()}
    assert long["by_genre", "Drama"] == 2 and long["by_region", "France"] == 2 and long["by_year", None] == 1
    assert long["by_rating_bin", "5.00–5.99"] == 0 and long["by_rating_bin", None] == 1
    bins = [r.movie_count for r in ro.bin_counts(facts, "rating_bin", bn.rating_bins()).collect()]
    assert bins[0] == 1 and sum(bins) == 3 and len(bins) == 11


def test_staging_can_be_cleared(spark):
    from tabloom.session import clear_staging, staging_path

    paths = [staging_path(spark, "x") for _ in range(2)]
    spark.range(3).write.parquet(paths[0])
    assert clear_staging(spark) >= 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(paths[0])
    assert clear_staging(spark) == 0


def test_dirty_csv_is_parsed_once_a_row(spark, tmp_path):
    lines = ["id,title,revenue", '1,"a, \\"b\\"",3', "2,x\\,y", "3,\ue000,1d", "", "x,bad id,1", "5", "6,a,b,c", '7,"two', 'lines",4']
    (tmp_path / "in.csv").write_text("\n".join(lines) + "\n")
    rows, bad = scan_dirty_csv(spark, str(tmp_path / "in.csv"))
    clean = ro.clean_movies(rows, 2024)
    plan = clean._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_csv(") == 1 and plan.count('"[^"]*"') == 1
    assert sorted(map(tuple, rows.collect()), key=str) == sorted([
        ("1", 'a, "b"', "3"), ("2", "x", "y"), ("3", "\\", "1d"), ("x", "bad id", "1"), ("5", None, None), ("7", "two\nlines", "4")], key=str)
    assert [r.text for r in bad.collect()] == ["6,a,b,c"]
    assert sorted(map(tuple, clean.select("id", "revenue").collect())) == [(1, 3.0), (2, None), (3, None), (5, None), (7, 4.0)]
