"""Round trips through text, CSV, JSON and event files, and streaming runs."""

from __future__ import annotations

import json

from pyspark.sql import Window
from pyspark.sql import functions as F

from tabloom.functions import clean as cl
from tabloom.functions import text as ft
from tabloom.operators import events as ev
from tabloom.operators import rollup as ro
from tabloom.operators import series as se
from tabloom.operators import text as ot
from tabloom.plans.events import _ATTR_SQL, _EPOCH, _FAULT_SQL, _ANALYTICS_SQL, analytics_events, event_time, events_of_raw, raw_events
from tabloom.plans.registry import query, spread, table
from tabloom.plans.rollups import _GENRES_SQL, rollups_sql
from tabloom.plans.text import _FREQ, _WORDS
from tabloom.plans.views import AS_OF_YEAR, BINNED_SQL, FACTS, RAW_SQL, as_facts, as_raw, facts_view, raw_view
from tabloom.session import staging_path
from tabloom.sources import readers, topics, writers
from tabloom.sources.dirty_csv import scan_dirty_csv as dirty
from tabloom.sources.inline import inline_table as literal
from tabloom.sources.onefile import sink_csv_file
from tabloom.streaming import backoff, replay
from tabloom.streaming import publish as pb
from tabloom.streaming.intake import start_lanes

_LINES = "string_split_regex(text, '\\r\\n|\\r|\\n')"


@query("scan_text", f"""
    SELECT count(*) AS lines, count(*) FILTER (line = '') AS empty_lines, sum(length(line))::BIGINT AS chars
    FROM (SELECT unnest({_LINES}) AS line FROM documents)
""")
def scan_text(spark, sf_dir):
    path = staging_path(spark, "text")
    table(spark, sf_dir, "documents").select("text").write.text(path)
    return readers.scan_text(spark, path).agg(
        F.count("*").alias("lines"), F.count_if(F.col("line") == "").alias("empty_lines"), F.sum(F.length("line")).alias("chars")
    )


_DIRTY = {
    "id": "concat('  ', CAST(o_orderkey AS STRING))",
    "title": """CASE o_orderkey % 5 WHEN 0 THEN concat('He said "hi", ', CAST(o_orderkey AS STRING))
        WHEN 1 THEN concat('two', chr(10), 'lines ', CAST(o_custkey AS STRING)) WHEN 2 THEN 'a "quoted" word'
        WHEN 3 THEN concat('back', chr(92), 'slash') ELSE 'plain' END""",
    "genres": "CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'Drama, Crime' ELSE 'Drama' END",
    "revenue": "CAST(o_custkey AS STRING)",
}


@query("scan_dirty_csv", "SELECT " + ", ".join(f"{e} AS {n}" for n, e in _DIRTY.items()) + ", o_orderkey % 97 = 0 AS bad FROM orders")
def scan_dirty_csv(spark, sf_dir):
    """Rows with both escapes, line breaks and (every 97th) a field too many."""
    orders = table(spark, sf_dir, "orders")
    rows = orders.select("o_orderkey", *[F.expr(e).alias(n) for n, e in _DIRTY.items()])
    bs = F.replace(F.col("title"), F.lit("\\"), F.lit("\\\\"))
    slashed = F.replace(bs, F.lit('"'), F.lit('\\"'))
    doubled = F.replace(bs, F.lit('"'), F.lit('""'))
    title = F.concat(F.lit('"'), F.when(F.col("o_orderkey") % 2 == 0, slashed).otherwise(doubled), F.lit('"'))
    genres = F.when(F.col("genres").contains(","), F.concat(F.lit('"'), "genres", F.lit('"'))).otherwise(F.col("genres"))
    extra = F.when(F.col("o_orderkey") % 97 == 0, F.lit("one,more"))
    path = staging_path(spark, "dirty")
    lines = rows.select(F.concat_ws(",", "id", title, genres, "revenue", extra).alias("value"))
    lines.write.text(path)
    names = ["id", "title", "genres", "revenue"]
    good, bad = dirty(spark, path, names, header=False)
    again = F.from_csv("text", "id string, title string, genres string, revenue string, x string, y string", {"escape": '"'})
    parsed = bad.select(again.alias("r")).select("r.*")
    quarantined = parsed.select(*[F.coalesce(c, F.lit("")).alias(c) for c in names], F.lit(True).alias("bad"))
    return good.withColumn("bad", F.lit(False)).unionByName(quarantined)


@query("scan_csv", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def scan_csv(spark, sf_dir):
    path = staging_path(spark, "csv")
    columns = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
    writers.sink_csv(table(spark, sf_dir, "orders").select(*columns), path)
    schema = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderpriority string"
    return readers.scan_csv(spark, path, schema)


@query("scan_csv_latin1", """
    SELECT doc_id AS stars, length(regexp_replace(text, '[\\r\\n]+', ' ', 'g')) AS n,
      length(text) - length(replace(text, 'é', '')) AS accents FROM documents
""")
def scan_csv_latin1(spark, sf_dir):
    path = staging_path(spark, "latin1")
    docs = table(spark, sf_dir, "documents").select(
        F.regexp_replace("text", "[\\r\\n]+", " ").alias("text"), F.col("doc_id").alias("stars")
    )
    options = {"encoding": "ISO-8859-1", "escape": '"', "header": "true", "quoteAll": "true",
               "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    docs.write.options(**options).csv(path)
    back = readers.scan_csv_latin1(spark, path, "text string, stars bigint", escape='"', emptyValue="")
    accents = F.length("text") - F.length(F.replace(F.col("text"), F.lit("é"), F.lit("")))
    return back.select("stars", F.length("text").cast("bigint").alias("n"), accents.cast("bigint").alias("accents"))


@query("scan_chunked", """
    SELECT event_type, count(*) AS n, round(sum(value), 4) AS total,
      (SELECT ceil(count(DISTINCT ts::DATE) / 2)::BIGINT FROM events) AS chunks
    FROM events GROUP BY event_type
""")
def scan_chunked(spark, sf_dir):
    """One file a day, two files a chunk: the number of chunks follows the number of files."""
    source, out = staging_path(spark, "chunks"), staging_path(spark, "chunk-sums")
    events = table(spark, sf_dir, "events").select("event_type", "value", F.col("ts").cast("date").alias("day"))
    events.repartition("day").write.partitionBy("day").parquet(source)

    def add_up(rows, chunk):
        sums = rows.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        sums.write.mode("overwrite").parquet(f"{out}/chunk={chunk}")

    progress = staging_path(spark, "chunk-progress")
    readers.scan_chunked(spark, source, "event_type string, value double, day date", add_up, progress, files_per_chunk=2)
    sums = spark.read.parquet(out)
    return sums.groupBy("event_type").agg(
        F.sum("n").alias("n"), F.round(F.sum("total"), 4).alias("total")
    ).withColumn("chunks", sums.agg(F.count_distinct("chunk")).scalar())


def save_rollups(facts, folder):
    """The eight rollup files, from one pass over the facts."""
    rollups = ro.all_rollups(facts).persist()
    for kind, dimension in ro.ROLLUP_COLUMNS.items():
        part = rollups.filter(F.col("aggregation_type") == kind)
        part = part.select(F.col("dimension").alias(dimension), "movie_count").orderBy(F.desc("movie_count"), dimension)
        writers.sink_csv(part, f"{folder}/movies_{kind}.csv")
    rollups.unpersist()


@query("scan_rollup_dir", f"""
    SELECT aggregation_type, dimension, movie_count, 'movies_' || aggregation_type || '.csv' AS data_source FROM ({rollups_sql()})
""")
def scan_rollup_dir(spark, sf_dir):
    folder = staging_path(spark, "rollups")
    save_rollups(facts_view(spark, sf_dir), folder)
    return readers.scan_rollup_dir(spark, folder)[0]


@query("sink_json", f"""
    SELECT (SELECT count(*) FROM documents) AS lines, count(*) AS words, count(DISTINCT word) AS unique_words FROM ({_WORDS})
""")
def sink_json(spark, sf_dir):
    path = staging_path(spark, "metrics")
    docs = table(spark, sf_dir, "documents").select("text")
    writers.sink_json(ot.word_metrics(docs, ft.word_tokens(F.col("text"))), path, single_file=True)
    return spark.read.schema("lines bigint, words bigint, unique_words bigint").json(path)


@query("inline_table", f"""
    SELECT (SELECT count(*) FROM documents) AS lines, count(*) AS words, count(DISTINCT word) AS unique_words FROM ({_WORDS})
""")
def inline_table(spark, sf_dir):
    """The metrics of a finished run as a table of their own: the totals are one row."""
    docs = table(spark, sf_dir, "documents", heavy=True).select("text")
    totals = ot.word_metrics(docs, ft.word_tokens(F.col("text"))).first()
    return literal(spark, [tuple(totals)], "lines bigint, words bigint, unique_words bigint")


@query("sink_csv", f"SELECT genre, movie_count FROM ({_GENRES_SQL})")
def sink_csv(spark, sf_dir):
    path = staging_path(spark, "by-genre")
    writers.sink_csv(ro.exploded_counts(facts_view(spark, sf_dir), "genres", "genre"), path)
    return readers.scan_csv(spark, path, "genre string, movie_count bigint")


@query("sink_kv_text", _FREQ)
def sink_kv_text(spark, sf_dir):
    path = staging_path(spark, "kv")
    words = ot.word_freq(table(spark, sf_dir, "documents"), ft.word_tokens(F.col("text")))
    writers.sink_kv_text(words, path)
    parts = F.split("line", "\t")
    return readers.scan_text(spark, path).select(parts[0].alias("word"), parts[1].cast("bigint").alias("count"))


@query("sink_events", f"""
    SELECT 'movie-events-raw' AS topic, count(*) AS n FROM orders
    UNION ALL SELECT 'movie-events-analytics', count(*) FROM ({_ANALYTICS_SQL})
""")
def sink_events(spark, sf_dir):
    path = staging_path(spark, "events")
    movies = ev.movie_events(facts_view(spark, sf_dir), event_time())
    topics.write_batch(movies.unionByName(analytics_events(spark, sf_dir)), path, "first")
    return topics.read(spark, path).groupBy("topic").agg(F.count("*").alias("n"))


@query("byte_budget_extract", """
    WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS rn, count(*) OVER () AS n,
        sum(octet_length(encode(concat_ws(',', o_orderkey, o_custkey, o_orderstatus, o_orderpriority))) + 1) OVER (ORDER BY o_orderkey) AS s FROM orders)
    SELECT o_orderkey FROM r WHERE rn <= (SELECT coalesce(max(rn), 0) FROM r WHERE (rn % 1000 = 0 OR rn = n)
      AND s + length('o_orderkey,o_custkey,o_orderstatus,o_orderpriority') + 1 <= 262144)
""")
def byte_budget_extract(spark, sf_dir):
    columns = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]
    orders = table(spark, sf_dir, "orders").select(*columns)
    kept = writers.byte_budget_extract(orders, "o_orderkey", columns, budget_bytes=262144, chunk_rows=1000)
    return kept.select("o_orderkey")


@query("stream_movie_events", f"SELECT 'movie-' || id || '-{_EPOCH}' AS key, rating_tier, title FROM ({_ATTR_SQL})")
def stream_movie_events(spark, sf_dir):
    orders = spread(pb.stream_table(spark, sf_dir, "orders.parquet"))
    written = pb.publish_stream(spark, ev.movie_events(as_facts(orders), event_time()), "movie-events")
    return written.select(
        "key", ev.attr("ratingTier").alias("rating_tier"), F.get_json_object("value", "$.data.title").alias("title")
    )


@query("stream_analytics_events", f"SELECT 'analytics-' || aggregation_type || '-' || dimension || '-{_EPOCH}' AS key FROM ({_ANALYTICS_SQL})")
def stream_analytics_events(spark, sf_dir):
    """Rollup files as they arrive become analytics events; the total is that of all files now there."""
    folder = staging_path(spark, "rollup-intake")
    ro.all_rollups(facts_view(spark, sf_dir)).repartition("aggregation_type").write.parquet(folder)
    total = ro.grand_total(spark.read.parquet(folder)).first()[0]
    rollups = pb.stream_table(spark, folder)
    events = ev.analytics_events(rollups, event_time(), F.lit(total))
    return pb.publish_stream(spark, events, "analytics-events").select("key")


@query("stream_dead_letter", f"""
    SELECT row_key, CASE WHEN reason IS NULL THEN 'movie-events-raw' ELSE 'movie-events-deadletter' END AS topic FROM ({_FAULT_SQL})
""")
def stream_dead_letter(spark, sf_dir):
    events = events_of_raw(as_raw(spread(pb.stream_table(spark, sf_dir, "orders.parquet"))))
    return pb.publish_stream(spark, events, "dead-letters").select("row_key", "topic")


@query("stream_replay", f"""
    SELECT DISTINCT 'movie-' || v::BIGINT || '-{_EPOCH}' AS key, 'movie-events-raw' AS topic FROM ({_FAULT_SQL})
    WHERE reason = 'missing title' AND v NOT IN (SELECT v FROM ({_FAULT_SQL}) WHERE reason IS NULL)
""")
def stream_replay(spark, sf_dir):
    """Every dead letter arrives twice, and once more for a second run of the stream; each goes out once."""
    events = staging_path(spark, "raw-events")
    raw_events(spark, sf_dir).write.partitionBy("topic").parquet(events)
    known = spark.read.parquet(events)
    dead = known.where(F.col("topic") == ev.DEAD_LETTER_TOPIC)
    source, out, progress = (staging_path(spark, n) for n in ("dead-letters", "replayed", "replay-progress"))
    for copies in (2, 1):
        for _ in range(copies):
            dead.write.mode("append").parquet(source)
        stream = pb.stream_table(spark, source)
        published = known.where(F.col("topic") == ev.RAW_TOPIC)
        replay.replay_stream(stream, lambda: published, F.col("reason") == "invalid id", out, progress).awaitTermination()
    return spark.read.parquet(out).select("key", "topic")


@query("stream_subscription", f"""
    SELECT 'movie-events-all' AS subscription, id FROM ({_ATTR_SQL})
    UNION ALL SELECT 'movie-events-high-rated', id FROM ({_ATTR_SQL}) WHERE rating_tier = 'high'
    UNION ALL SELECT 'movie-events-blockbusters', id FROM ({_ATTR_SQL}) WHERE revenue_tier = 'blockbuster'
    UNION ALL SELECT 'movie-events-recent', id FROM ({_ATTR_SQL}) WHERE decade IN ('2010s', '2020s')
""")
def stream_subscription(spark, sf_dir):
    orders = spread(pb.stream_table(spark, sf_dir, "orders.parquet"))
    routed = ev.route_subscriptions(ev.movie_events(as_facts(orders), event_time(), keep=["id"]), ["topic", "id"])
    return pb.publish_stream(spark, routed, "subscriptions").select("subscription", "id")


@query("live_rollup", "SELECT event_type AS dimension, count(*) AS n FROM events GROUP BY event_type")
def live_rollup(spark, sf_dir):
    events = pb.stream_table(spark, sf_dir, "events.parquet")
    return pb.live_rollup(spark, ev.live_counts(events, F.col("event_type")), "live-rollup", ["dimension"])


@query("windowed_counts", """
    SELECT strftime(time_bucket(INTERVAL '1 day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2
""")
def windowed_counts(spark, sf_dir):
    events = pb.stream_table(spark, sf_dir, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    counts = pb.windowed_counts(events, "ts", "event_type", "1 day", "1 hour")
    out = pb.live_rollup(spark, counts, "windowed", ["window_start", "event_type"])
    return out.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n")


_BATCH_ROWS, _LANES = 3000, 5


@query("throttled_intake", f"""
    SELECT count(*) AS n, ceil(count(*) / {_BATCH_ROWS})::BIGINT AS batches, least(count(*), {_BATCH_ROWS}) AS largest FROM events
""")
def throttled_intake(spark, sf_dir):
    """Files of any size, batches of a fixed number of messages, a fixed number of batches in flight."""
    source, out, progress = (staging_path(spark, n) for n in ("intake", "throttled", "throttled-progress"))
    events = table(spark, sf_dir, "events").select("event_id", F.lit("movie-events-raw").alias("topic"))
    events.repartitionByRange(3, "event_id").write.parquet(source)
    runs = start_lanes(spark, source, _BATCH_ROWS, pb.publish_to(out), progress, _LANES)
    try:
        for run in runs:
            run.processAllAvailable()
    finally:
        for run in runs:
            run.stop()
    sizes = spark.read.parquet(out).groupBy("batch").agg(F.count("*").alias("n"))
    return sizes.agg(F.sum("n").alias("n"), F.count("*").alias("batches"), F.max("n").alias("largest"))


_RETRY_SQL = """
    SELECT id, least(id % 7 + 1, 4)::INTEGER AS attempts, CASE WHEN id % 7 <= 3 THEN 'published' ELSE 'deadlettered' END AS outcome,
      CASE WHEN id % 7 <= 3 THEN 'movie-events-raw' ELSE 'movie-events-deadletter' END AS topic FROM (SELECT o_orderkey AS id FROM orders)
"""


@query("retry_publish", _RETRY_SQL)
def retry_publish(spark, sf_dir):
    """A sink that refuses each event as many times as its key says."""
    events = ev.movie_events(facts_view(spark, sf_dir), event_time(), keep=["id"])

    def deliver(rows, attempt):
        return rows.withColumn("ok", F.col("id") % 7 <= attempt)

    return pb.retry_publish(events, deliver, event_time()).select("id", "attempts", "outcome", "topic")


@query("stream_retry", _RETRY_SQL)
def stream_retry(spark, sf_dir):
    """The same sink behind a stream: refused events wait for their timers, the others go through at once."""
    orders = pb.stream_table(spark, sf_dir, "orders.parquet")
    events = ev.movie_events(as_facts(orders), event_time(), keep=["id"])
    tried, settled, first, later = (staging_path(spark, n) for n in ("tried", "settled", "tried-progress", "settled-progress"))

    def deliver(keys, rows, attempt):
        return [json.loads(row)["id"] % 7 <= attempt for row in rows]

    backoff.first_attempt(events, deliver, tried, first).awaitTermination()
    query = backoff.later_attempts(tried, deliver, settled, later, spark, base=0.2, every="0 seconds")
    backoff.stop_when_settled(query, spark, tried, settled)
    out = backoff.outcomes(spark.read.parquet(tried), spark.read.parquet(settled), events.schema, event_time())
    return out.select("id", "attempts", "outcome", "topic")


_FACT_COLUMNS = ["id", "release_year", "release_decade", "vote_average", "revenue", "runtime", "adult", "rating_bin",
                 "revenue_bin", "runtime_bin"]


def film_job(spark, sf_dir):
    """The whole job through files: dirty CSV with every column, clean facts, one facts file set and eight rollups.

    Returns the folder; ``facts.csv`` and ``movies_<kind>.csv`` lie in it.
    """
    folder = staging_path(spark, "film-job")
    orders = table(spark, sf_dir, "orders").selectExpr(*[f"CAST({e} AS STRING) AS {n}" for n, e in FACTS.items()])
    orders = orders.withColumnsRenamed({"genres_csv": "genres", "countries_csv": "production_countries"})
    writers.sink_csv(orders, f"{folder}/raw.csv")
    raw, _ = dirty(spark, f"{folder}/raw.csv")
    facts = ro.with_bins(ro.clean_movies(raw, AS_OF_YEAR)).persist()
    lists = {c: F.array_join(c, ",") for c in ("genres", "production_countries")}
    writers.sink_csv(facts.withColumns(lists), f"{folder}/facts.csv")
    save_rollups(facts, folder)
    facts.unpersist()
    return folder


def _job_facts(spark, folder):
    """The facts file read back with types."""
    found = spark.read.option("header", True).option("escape", '"').csv(f"{folder}/facts.csv")
    types = {"id": "bigint", "release_year": "int", "release_decade": "int", "vote_average": "double", "revenue": "double",
             "budget": "double", "popularity": "double", "runtime": "double", "vote_count": "bigint", "adult": "boolean",
             "release_date": "date"}
    facts = found.withColumns({c: F.col(c).try_cast(t) for c, t in types.items()})
    return facts.withColumns({c: cl.split_list(F.col(c)) for c in ("genres", "production_countries")})


@query("film_job_facts", f"SELECT {', '.join(_FACT_COLUMNS)} FROM ({BINNED_SQL})")
def film_job_facts(spark, sf_dir):
    return _job_facts(spark, film_job(spark, sf_dir)).select(*_FACT_COLUMNS)


@query("film_job_rollups", f"""
    SELECT aggregation_type, dimension, movie_count, 'movies_' || aggregation_type || '.csv' AS data_source FROM ({rollups_sql()})
""")
def film_job_rollups(spark, sf_dir):
    found, state = readers.scan_rollup_dir(spark, film_job(spark, sf_dir))
    if set(state.values()) != {"read"}:
        raise ValueError(f"rollup files are missing: {state}")
    return found


@query("film_job_events", f"""
    SELECT 'movie-' || id || '-{_EPOCH}' AS key, 'movie-events-raw' AS topic FROM ({_ATTR_SQL})
    UNION ALL SELECT 'analytics-' || aggregation_type || '-' || dimension || '-{_EPOCH}', 'movie-events-analytics' FROM ({_ANALYTICS_SQL})
""")
def film_job_events(spark, sf_dir):
    """Both publishers start from the job's files."""
    folder = film_job(spark, sf_dir)
    rollups = readers.scan_rollup_dir(spark, folder)[0]
    movies = ev.movie_events(_job_facts(spark, folder), event_time())
    totals = ev.analytics_events(rollups, event_time(), ro.grand_total(rollups).scalar())
    path = staging_path(spark, "film-events")
    topics.write_batch(movies.unionByName(totals), path, "film-job")
    return topics.read(spark, path).select("key", "topic")


@query("word_counts_csv", f"SELECT word, \"count\", row_number() OVER (ORDER BY \"count\" DESC, word) AS place FROM ({_FREQ})")
def word_counts_csv(spark, sf_dir):
    """The ordered counts as CSV parts, read back with each row's place: part after part, line after line."""
    path = staging_path(spark, "word-counts")
    counts = ot.word_freq(table(spark, sf_dir, "documents"), ft.word_tokens(F.col("text")))
    writers.sink_csv(ot.ordered_words(counts), path)
    lines = spark.read.schema("word string, count bigint").option("header", True).csv(path).select(
        "*", F.col("_metadata.file_name").alias("part"), F.monotonically_increasing_id().alias("line"))
    sizes = lines.groupBy("part").count()
    before = sizes.select("part", F.coalesce(F.sum("count").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("line"))
    return lines.join(before, "part").select("word", "count", (place + F.col("before")).cast("bigint").alias("place"))


@query("word_counts_file", f"SELECT word, \"count\", row_number() OVER (ORDER BY \"count\" DESC, word) AS place FROM ({_FREQ})")
def word_counts_file(spark, sf_dir):
    """The ordered counts as one CSV file written by many tasks, read back with each line's place."""
    path = f"{staging_path(spark, 'word-counts')}/counts.csv"
    freq = ot.word_freq(table(spark, sf_dir, "documents").select("text"), ft.word_tokens(F.col("text")))
    sink_csv_file(freq, path, [F.desc("count"), F.asc("word")])
    lines = readers.scan_csv(spark, path, "word string, count bigint", escape='"')
    placed = se.reset_index(lines.withColumn("_at", F.monotonically_increasing_id()), [], "_at")
    return placed.select("word", "count", (F.col("idx") + 1).cast("bigint").alias("place"))


@query("top5_csv", f'{_FREQ} ORDER BY "count" DESC, word LIMIT 5')
def top5_csv(spark, sf_dir):
    path = staging_path(spark, "top5")
    counts = ot.word_freq(table(spark, sf_dir, "documents"), ft.word_tokens(F.col("text")))
    writers.sink_csv(ot.top_words(counts, 5), path, single_file=True)
    return readers.scan_csv(spark, path, "word string, count bigint")


@query("metrics_csv", f"""
    SELECT (SELECT count(*) FROM documents) AS lines, count(*) AS words, count(DISTINCT word) AS unique_words FROM ({_WORDS})
""")
def metrics_csv(spark, sf_dir):
    path = staging_path(spark, "metrics-csv")
    docs = table(spark, sf_dir, "documents").select("text")
    writers.sink_csv(ot.word_metrics(docs, ft.word_tokens(F.col("text"))), path, single_file=True)
    return readers.scan_csv(spark, path, "lines bigint, words bigint, unique_words bigint")
