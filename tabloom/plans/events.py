"""Event envelopes, routing and publish statistics over film facts and the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.functions import clean as cl
from tabloom.operators import events as ev
from tabloom.operators import rollup as ro
from tabloom.plans.clean import _REVENUE_TIER, _RATING_TIER
from tabloom.plans.registry import query, table
from tabloom.plans.rollups import all_rollups, rollups_sql, _GENRES_SQL
from tabloom.sources.inline import inline_table
from tabloom.plans.views import AS_OF_YEAR, BINNED_SQL, COUNTRY_LIST, GENRE_LIST, RAW_SQL, facts_view, raw_view

EVENT_TIME = "2024-09-20 13:19:00"
_EPOCH = 1726838340
_GENRE_ATTR = f"""nullif(array_to_string(list_transform({GENRE_LIST}, lambda g: CASE g WHEN 'Science Fiction' THEN 'sci-fi'
    WHEN 'TV Movie' THEN 'tv-movie' ELSE replace(lower(g), ' ', '-') END), ','), '')"""
_ATTR_SQL = f"""SELECT *, CASE WHEN vote_average IS NOT NULL THEN {_RATING_TIER} END AS rating_tier,
    CASE WHEN revenue IS NOT NULL THEN {_REVENUE_TIER} END AS revenue_tier,
    release_decade || 's' AS decade, {_GENRE_ATTR} AS genre,
    nullif(array_to_string({COUNTRY_LIST}, ','), '') AS country FROM ({BINNED_SQL})"""


def event_time():
    return F.lit(EVENT_TIME).cast("timestamp")


def movie_events(spark, sf_dir):
    return ev.movie_events(facts_view(spark, sf_dir), event_time(), keep=["id"])


@query("event_attributes", f"""
    SELECT id, 'movie.created' AS "eventType", 'movie-denormalizer' AS source, original_language AS language,
      decade, rating_tier AS "ratingTier", revenue_tier AS "revenueTier",
      CASE WHEN adult THEN 'true' WHEN NOT adult THEN 'false' END AS adult, genre, country,
      (2 + (original_language IS NOT NULL)::INT + (decade IS NOT NULL)::INT + (rating_tier IS NOT NULL)::INT
        + (revenue_tier IS NOT NULL)::INT + (adult IS NOT NULL)::INT + (genre IS NOT NULL)::INT
        + (country IS NOT NULL)::INT)::INTEGER AS n
    FROM ({_ATTR_SQL})
""")
def event_attributes(spark, sf_dir):
    names = ["eventType", "source", "language", "decade", "ratingTier", "revenueTier", "adult", "genre", "country"]
    return movie_events(spark, sf_dir).select(
        "id", *[ev.attr(n).alias(n) for n in names], F.size("attributes").alias("n")
    )


_MOVIE_SCHEMA = """specversion string, type string, source string, id string, time string,
    datacontenttype string, data struct<movie_id string, title string, original_title string,
    original_language string, release_date string, release_year int, release_decade int,
    ratings struct<average double, count bigint, bin string>,
    financial struct<revenue double, budget double, revenue_bin string>,
    technical struct<runtime int, runtime_bin string, adult boolean>, popularity double>"""


@query("movie_envelope", f"""
    SELECT 'movie-' || id || '-{_EPOCH}' AS event_id, '1.0' AS specversion, 'movie.created' AS type,
      '2024-09-20T13:19:00+00:00' AS "time", CAST(id AS VARCHAR) AS movie_id, title, original_title,
      original_language, CAST(release_date AS VARCHAR) AS release_date, release_year, release_decade,
      vote_average AS rating, vote_count AS votes, rating_bin, revenue, budget, revenue_bin,
      runtime::INTEGER AS runtime, runtime_bin, adult, popularity,
      concat_ws(',', 'movie_id', 'title', CASE WHEN original_title IS NOT NULL THEN 'original_title' END,
        CASE WHEN original_language IS NOT NULL THEN 'original_language' END, 'release_date', 'release_year',
        'release_decade', 'ratings', 'financial', 'technical', 'popularity') AS members
    FROM ({BINNED_SQL})
""")
def movie_envelope(spark, sf_dir):
    e = F.col("e")
    parsed = movie_events(spark, sf_dir).select(
        F.from_json("value", _MOVIE_SCHEMA).alias("e"),
        F.array_join(F.json_object_keys(F.get_json_object("value", "$.data")), ",").alias("members"),
    )
    data = e["data"]
    return parsed.select(
        e["id"].alias("event_id"), e["specversion"].alias("specversion"), e["type"].alias("type"),
        e["time"].alias("time"),
        *[data[c].alias(c) for c in ("movie_id", "title", "original_title", "original_language", "release_date",
                                     "release_year", "release_decade", "popularity")],
        data["ratings"]["average"].alias("rating"), data["ratings"]["count"].alias("votes"),
        data["ratings"]["bin"].alias("rating_bin"),
        *[data["financial"][c].alias(c) for c in ("revenue", "budget", "revenue_bin")],
        *[data["technical"][c].alias(c) for c in ("runtime", "runtime_bin", "adult")],
        "members",
    )


_ANALYTICS_SQL = f"""SELECT aggregation_type, dimension, movie_count, total AS total_movies,
    round(100.0::DOUBLE * movie_count / total, 2) AS percentage
    FROM ({rollups_sql()}), (SELECT sum(movie_count)::BIGINT AS total FROM ({_GENRES_SQL}))
    WHERE dimension IS NOT NULL AND movie_count > 0"""


def analytics_events(spark, sf_dir):
    rollups = all_rollups(spark, sf_dir)
    return ev.analytics_events(rollups, event_time(), ro.grand_total(rollups).scalar())


@query("analytics_envelope", f"""
    SELECT 'analytics-' || aggregation_type || '-' || dimension || '-{_EPOCH}' AS event_id, aggregation_type,
      dimension, movie_count, percentage, total_movies, 'v1.0' AS data_version,
      'movies_' || aggregation_type || '.csv' AS data_source FROM ({_ANALYTICS_SQL})
""")
def analytics_envelope(spark, sf_dir):
    schema = """id string, data struct<aggregation_type string, dimension string,
        metrics struct<movie_count bigint, percentage double, total_movies bigint>,
        metadata struct<calculated_at string, data_version string>>"""
    d = F.col("e.data")
    parsed = analytics_events(spark, sf_dir).select(
        F.from_json("value", schema).alias("e"), ev.attr("dataSource").alias("data_source")
    )
    return parsed.select(
        F.col("e.id").alias("event_id"), d["aggregation_type"].alias("aggregation_type"),
        d["dimension"].alias("dimension"), d["metrics"]["movie_count"].alias("movie_count"),
        d["metrics"]["percentage"].alias("percentage"), d["metrics"]["total_movies"].alias("total_movies"),
        d["metadata"]["data_version"].alias("data_version"), "data_source",
    )


@query("valid_dimension", f"""
    SELECT aggregation_type, count(*) AS processed,
      count(*) FILTER (dimension IS NULL OR movie_count <= 0 OR movie_count IS NULL) AS skipped FROM ({rollups_sql()}) GROUP BY 1
""")
def valid_dimension(spark, sf_dir):
    rollups = all_rollups(spark, sf_dir)
    rows = rollups.select("aggregation_type", F.lit(1).alias("n")).unionByName(
        ev.valid_dimension(rollups).select("aggregation_type", F.lit(-1).alias("n")))
    return rows.groupBy("aggregation_type").agg(
        F.count_if(F.col("n") == 1).alias("processed"), F.sum("n").alias("skipped")
    )


@query("attr_equals", f"SELECT id FROM ({_ATTR_SQL}) WHERE rating_tier = 'high'")
def attr_equals(spark, sf_dir):
    return movie_events(spark, sf_dir).filter(ev.attr_equals("ratingTier", "high")).select("id")


@query("attr_or", f"SELECT id FROM ({_ATTR_SQL}) WHERE decade IN ('2000s', '2010s')")
def attr_or(spark, sf_dir):
    return movie_events(spark, sf_dir).filter(ev.attr_or("decade", ["2000s", "2010s"])).select("id")


@query("attr_has", f"SELECT id FROM ({_ATTR_SQL}) WHERE list_contains(string_split(genre, ','), 'action')")
def attr_has(spark, sf_dir):
    return movie_events(spark, sf_dir).filter(ev.attr_has("genre", "action")).select("id")


_ROUTED_SQL = f"""
    SELECT 'movie-events-all' AS subscription, count(*) AS n FROM ({_ATTR_SQL})
    UNION ALL SELECT 'movie-events-high-rated', count(*) FROM ({_ATTR_SQL}) WHERE rating_tier = 'high'
    UNION ALL SELECT 'movie-events-blockbusters', count(*) FROM ({_ATTR_SQL}) WHERE revenue_tier = 'blockbuster'
    UNION ALL SELECT 'movie-events-recent', count(*) FROM ({_ATTR_SQL}) WHERE decade IN ('2010s', '2020s') HAVING count(*) > 0
    UNION ALL SELECT 'analytics-events-all', count(*) FROM ({_ANALYTICS_SQL})
    UNION ALL SELECT 'analytics-events-genre', count(*) FROM ({_ANALYTICS_SQL}) WHERE aggregation_type = 'by_genre'
"""


@query("route_subscriptions", _ROUTED_SQL)
def route_subscriptions(spark, sf_dir):
    events = movie_events(spark, sf_dir).drop("id").unionByName(analytics_events(spark, sf_dir))
    routed = ev.route_subscriptions(events, ["key"])
    return routed.groupBy("subscription").agg(F.count("*").alias("n"))


def raw_events(spark, sf_dir):
    return events_of_raw(raw_view(spark, sf_dir))


def events_of_raw(raw):
    """Events of all raw rows, good or bad, with the reason why a row is bad."""
    typed = ro.with_bins(ro.clean_movies(raw.withColumnRenamed("id", "raw_id"), AS_OF_YEAR))
    typed = typed.withColumns(
        {"id": cl.strict_int64(F.col("raw_id")), "title": cl.safe_string(F.col("title"))}
    ).withColumn("reason", ev.movie_fault(F.col("id"), F.col("title")))
    events = ev.movie_events(typed, event_time(), keep=["row_key", "reason"])
    return ev.with_dead_letters(events, F.col("reason"), event_time())


_FAULT_SQL = f"""SELECT row_key, v, CASE WHEN v IS NULL OR isinf(v) OR v <> floor(v) THEN 'invalid id'
    WHEN trim(title) = '' THEN 'missing title' END AS reason
    FROM (SELECT *, try_cast(id AS DOUBLE) AS v FROM ({RAW_SQL}))"""


@query("dead_letter", f"""
    SELECT row_key, CASE WHEN reason IS NULL THEN 'movie-events-raw' ELSE 'movie-events-deadletter' END AS topic,
      reason AS error_reason, CASE WHEN reason IS NOT NULL THEN '{_EPOCH}' END AS failed_at,
      CASE WHEN reason IS NOT NULL THEN 'movie-events-raw' END AS original_topic FROM ({_FAULT_SQL})
""")
def dead_letter(spark, sf_dir):
    notes = ["error_reason", "failed_at", "original_topic"]
    return raw_events(spark, sf_dir).select("row_key", "topic", *[ev.attr(n).alias(n) for n in notes])


@query("replay_dead_letter", f"""
    SELECT row_key, 'movie-events-raw' AS topic, false AS has_notes FROM ({_FAULT_SQL}) WHERE reason = 'missing title'
      AND v NOT IN (SELECT v FROM ({_FAULT_SQL}) WHERE reason IS NULL)
""")
def replay_dead_letter(spark, sf_dir):
    events = raw_events(spark, sf_dir)
    dead = events.filter(F.col("topic") == ev.DEAD_LETTER_TOPIC)
    published = events.filter(F.col("topic") == ev.RAW_TOPIC)
    again = ev.replay_dead_letters(dead, published, F.col("reason") == "invalid id")
    return again.select("row_key", "topic", ev.attr("error_reason").isNotNull().alias("has_notes"))


# A publish log over the event table: outcomes are planted by key.
LOG = {
    "job": "event_type",
    "message_id": "event_id",
    "source": "user_id",
    "ts": "ts",
    "outcome": """CASE WHEN event_id % 50 = 0 THEN 'failed' WHEN event_id % 70 = 1 THEN 'deadlettered'
        WHEN event_id % 33 = 2 THEN 'skipped' WHEN event_id % 91 = 3 THEN 'delayed' ELSE 'published' END""",
}
_LOG_SQL = "SELECT " + ", ".join(f"{e} AS {n}" for n, e in LOG.items()) + " FROM events"


def publish_log(spark, sf_dir):
    log = table(spark, sf_dir, "events").selectExpr(*[f"{e} AS {n}" for n, e in LOG.items()])
    return log.withColumn("ts", F.col("ts").cast("timestamp"))


_COUNTS_SQL = """count(*) AS processed, count(*) FILTER (outcome = 'published') AS published,
    count(*) FILTER (outcome = 'failed') AS failed, count(*) FILTER (outcome = 'deadlettered') AS deadlettered,
    count(*) FILTER (outcome = 'skipped') AS skipped, count(*) FILTER (outcome = 'delayed') AS other, epoch_us(max(ts)) - epoch_us(min(ts)) AS us"""


@query("publish_stats", f"""
    SELECT job, processed, published, failed, deadlettered, skipped, other, round(us / 1e6, 3) AS duration_seconds,
      round(CASE WHEN us > 0 THEN published / (us / 1e6) ELSE 0 END, 6) AS messages_per_second,
      round(CASE WHEN published + failed > 0 THEN published / (published + failed) ELSE 1 END, 6) AS success_rate
    FROM (SELECT job, {_COUNTS_SQL} FROM ({_LOG_SQL}) GROUP BY job
          UNION ALL SELECT 'ALL', {_COUNTS_SQL} FROM ({_LOG_SQL}))
""")
def publish_stats(spark, sf_dir):
    stats = ev.publish_stats(publish_log(spark, sf_dir)).drop("first_ts", "last_ts")
    return stats.withColumns(
        {
            "duration_seconds": F.round("duration_seconds", 3),
            "messages_per_second": F.round("messages_per_second", 6),
            "success_rate": F.round("success_rate", 6),
        }
    )


_RUNS_SQL = f"""SELECT user AS job_id, CASE WHEN user % 11 = 0 THEN 'running' WHEN user % 13 = 0 THEN 'pending'
      WHEN f > 2 THEN 'failed' ELSE 'completed' END AS status,
    a AS start_time, b AS end_time FROM (SELECT source AS user, count(*) FILTER (outcome = 'failed') AS f,
      floor(epoch(min(ts))) AS a, floor(epoch(max(ts))) AS b FROM ({_LOG_SQL}) GROUP BY 1)"""


@query("job_summary", f"""
    SELECT count(*) AS submitted, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'running') AS running,
      0::BIGINT AS other, count(*) FILTER (status = 'completed') AS completed,
      count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'cancelled') AS cancelled,
      sum(end_time - start_time) AS total_duration,
      round(count(*) FILTER (status = 'completed') / count(*) FILTER (status IN ('completed', 'failed')), 6) AS job_success_rate FROM ({_RUNS_SQL})
""")
def job_summary(spark, sf_dir):
    failures = F.count_if(F.col("outcome") == "failed")
    runs = publish_log(spark, sf_dir).groupBy(F.col("source").alias("job_id")).agg(
        F.when(F.col("job_id") % 11 == 0, "running").when(F.col("job_id") % 13 == 0, "pending")
        .when(failures > 2, "failed").otherwise("completed").alias("status"),
        F.unix_seconds(F.min("ts")).cast("double").alias("start_time"),
        F.unix_seconds(F.max("ts")).cast("double").alias("end_time"),
    )
    return ev.job_summary(runs).withColumn("job_success_rate", F.round("job_success_rate", 6))


@query("alert_rules", f"""
    WITH s AS (SELECT failed / (published + failed) AS failed_rate, deadlettered::DOUBLE AS deadletter_count,
        (epoch_us(TIMESTAMP '2024-01-31 06:00:00') - last_us) / 3.6e9 AS lag_hours,
        (processed - published)::DOUBLE AS backlog
      FROM (SELECT {_COUNTS_SQL}, epoch_us(max(ts)) AS last_us FROM ({_LOG_SQL})))
    SELECT rule, round(value, 6) AS value, threshold::DOUBLE AS threshold, value > threshold AS fired FROM (
      SELECT 'failed_rate' AS rule, failed_rate AS value, 0.05 AS threshold FROM s
      UNION ALL SELECT 'deadletter_count', deadletter_count, 100 FROM s
      UNION ALL SELECT 'lag_hours', lag_hours, 1 FROM s
      UNION ALL SELECT 'backlog', backlog, 10000 FROM s)
""")
def alert_rules(spark, sf_dir):
    stats = ev.publish_stats(publish_log(spark, sf_dir)).filter(F.col("job") == "ALL")
    as_of = F.lit("2024-01-31 06:00:00").cast("timestamp")
    values = stats.select(
        (F.col("failed") / (F.col("published") + F.col("failed"))).alias("failed_rate"),
        F.col("deadlettered").alias("deadletter_count"),
        ((F.unix_micros(as_of) - F.unix_micros("last_ts")) / 3.6e9).alias("lag_hours"),
        (F.col("processed") - F.col("published")).alias("backlog"),
    )
    return ev.alert_rules(values).withColumn("value", F.round("value", 6))


@query("retention_filter", """
    SELECT event_id, topic FROM (SELECT event_id, CASE event_type WHEN 'error' THEN 'movie-events-deadletter'
        WHEN 'click' THEN 'movie-events-analytics' ELSE 'movie-events-raw' END AS topic, ts::DATE AS d FROM events)
    WHERE d > DATE '2024-02-05' - CASE topic WHEN 'movie-events-deadletter' THEN 30 ELSE 7 END
""")
def retention_filter(spark, sf_dir):
    topic = (
        F.when(F.col("event_type") == "error", ev.DEAD_LETTER_TOPIC)
        .when(F.col("event_type") == "click", ev.ANALYTICS_TOPIC)
        .otherwise(ev.RAW_TOPIC)
    )
    events = table(spark, sf_dir, "events").select(
        "event_id", topic.alias("topic"), F.col("ts").cast("date").alias("event_date")
    )
    kept = ev.retention_filter(events, "event_date", F.lit("2024-02-05").cast("date"))
    return kept.select("event_id", "topic")


@query("rate_window", """
    SELECT event_id, event_type, n AS in_window, n > 3 AS over_limit FROM (
      SELECT event_id, event_type, count(*) OVER (PARTITION BY event_type ORDER BY ts
        RANGE BETWEEN INTERVAL 59999999 MICROSECONDS PRECEDING AND CURRENT ROW) AS n FROM events)
""")
def rate_window(spark, sf_dir):
    messages = table(spark, sf_dir, "events").select(
        "event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us")
    )
    return ev.rate_window(messages, "event_type", "us", limit=3).drop("us")


@query("validate_inputs", """
    SELECT * FROM (VALUES ('orders: present', true), ('orders: columns', true), ('orders: rows', (SELECT count(*) > 0 FROM orders)),
      ('events: present', true), ('events: columns', true), ('events: rows', (SELECT count(*) > 0 FROM events)),
      ('part: present', true), ('part: columns', false), ('part: rows', false)) t("check", ok)
""")
def validate_inputs(spark, sf_dir):
    found = ev.validate_inputs(
        {
            "orders": (table(spark, sf_dir, "orders"), ["o_orderkey", "o_totalprice"]),
            "events": (table(spark, sf_dir, "events"), ["event_id", "ts"]),
            "part": (table(spark, sf_dir, "part"), ["p_partkey", "p_color"]),
        }
    )
    return inline_table(spark, found, "check string, ok boolean")
