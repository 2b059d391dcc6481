"""Envelopes, dead letters, rates and publish statistics."""

import json

import pytest
from pyspark.sql import functions as F

from tabloom.operators import events as ev
from tabloom.operators import rollup as ro
from tabloom.sources.inline import inline_table

FACT_SCHEMA = """id bigint, title string, original_title string, original_language string, release_date date,
    release_year int, release_decade int, vote_average double, vote_count bigint, revenue double, budget double,
    runtime double, adult boolean, popularity double, genres array<string>, production_countries array<string>"""


@pytest.fixture(scope="module")
def facts(spark):
    import datetime as dt

    rows = [
        (27205, "In \"ception\"", None, "en", dt.date(2010, 7, 15), 2010, 2010, 8.364, 34495, 825532764.0, 160000000.0,
         148.0, False, 83.952, ["Action", "Science Fiction"], ["United Kingdom"]),
        (2, "x", "y", None, None, None, None, None, None, None, None, None, None, None, [], []),
    ]
    return ro.with_bins(inline_table(spark, rows, FACT_SCHEMA))


def when():
    return F.lit("2024-09-20 13:19:00").cast("timestamp")


def test_movie_event(facts):
    rows = {r.key: r for r in ev.movie_events(facts, when()).collect()}
    full = rows["movie-27205-1726838340"]
    assert full.attributes == {
        "eventType": "movie.created", "source": "movie-denormalizer", "language": "en", "decade": "2010s",
        "ratingTier": "high", "revenueTier": "blockbuster", "adult": "false", "genre": "action,sci-fi",
        "country": "United Kingdom",
    }
    event = json.loads(full.value)
    assert event["specversion"] == "1.0" and event["time"] == "2024-09-20T13:19:00+00:00"
    assert list(event["data"]) == ["movie_id", "title", "original_language", "release_date", "release_year",
                                   "release_decade", "ratings", "financial", "technical", "popularity"]
    assert event["data"]["title"] == 'In "ception"'
    assert event["data"]["financial"] == {"revenue": 825532764.0, "budget": 160000000.0, "revenue_bin": "500,000,000–999,999,999"}
    bare = json.loads(rows["movie-2-1726838340"].value)["data"]
    assert bare == {
        "movie_id": "2", "title": "x", "original_title": "y",
        "ratings": {"average": None, "count": None, "bin": None},
        "financial": {"revenue": None, "budget": None, "revenue_bin": None},
        "technical": {"runtime": None, "runtime_bin": None, "adult": None},
    }
    assert rows["movie-2-1726838340"].attributes == {"eventType": "movie.created", "source": "movie-denormalizer"}


def test_camel_case(facts):
    event = json.loads(ev.movie_events(facts, when(), camel=True).filter(F.col("key").contains("27205")).first().value)
    assert {"movieId", "originalLanguage", "releaseDecade"} <= set(event["data"])
    assert set(event["data"]["technical"]) == {"runtime", "runtimeBin", "adult"}


def test_analytics_event(spark):
    rollups = inline_table(
        spark, [("by_genre", "Drama", 242114), ("by_genre", None, 5), ("by_genre", "None", 0)],
        "aggregation_type string, dimension string, movie_count bigint",
    )
    rows = ev.analytics_events(rollups, when(), F.lit(1272533).cast("bigint")).collect()
    assert len(rows) == 1 and rows[0].key == "analytics-by_genre-Drama-1726838340"
    data = json.loads(rows[0].value)["data"]
    assert data["metrics"] == {"movie_count": 242114, "percentage": 19.03, "total_movies": 1272533}
    assert rows[0].attributes["dataSource"] == "movies_by_genre.csv"
    zero = ev.analytics_events(rollups, when(), F.lit(0).cast("bigint")).first()
    assert json.loads(zero.value)["data"]["metrics"]["percentage"] is None


def test_grand_total_falls_back(spark):
    def total(rows):
        return ro.grand_total(inline_table(spark, rows, "aggregation_type string, dimension string, movie_count bigint")).first()[0]

    years = [("by_year", "2000", 3), ("by_year", None, 9)]
    assert total([("by_genre", "a", 5), *years]) == 5
    assert total(years) == 3
    assert total([("by_region", "x", 1)]) == 0


def test_subscriptions_and_filters(facts):
    events = ev.movie_events(facts, when())
    got = sorted((r.subscription, r.key.split("-")[1]) for r in ev.route_subscriptions(events, ["key"]).collect())
    assert got == [("movie-events-all", "2"), ("movie-events-all", "27205"), ("movie-events-blockbusters", "27205"),
                   ("movie-events-high-rated", "27205"), ("movie-events-recent", "27205")]
    assert events.filter(ev.attr_has("genre", "action")).count() == 1
    assert events.filter(ev.attr_has("genre", "act")).count() == 0


def test_dead_letters_keep_every_row(facts):
    reason = F.when(F.col("id") == 2, "bad")
    events = ev.with_dead_letters(ev.movie_events(facts, when(), keep=["id"]), reason, when(), {"aggregation_type": F.lit("by_x")})
    rows = {r.id: r for r in events.collect()}
    assert rows[27205].topic == ev.RAW_TOPIC and "error_reason" not in rows[27205].attributes
    assert rows[2].topic == ev.DEAD_LETTER_TOPIC
    notes = {k: rows[2].attributes[k] for k in ("error_reason", "failed_at", "original_topic", "aggregation_type")}
    assert notes == {"error_reason": "bad", "failed_at": "1726838340", "original_topic": ev.RAW_TOPIC, "aggregation_type": "by_x"}
    dead, live = events.filter(F.col("topic") == ev.DEAD_LETTER_TOPIC), events.filter(F.col("topic") == ev.RAW_TOPIC)
    again = ev.replay_dead_letters(dead, live, F.lit(False)).collect()
    assert [r.topic for r in again] == [ev.RAW_TOPIC] and set(again[0].attributes) == {"eventType", "source"}
    assert ev.replay_dead_letters(dead, events, F.lit(False)).count() == 0


def test_rate_window_against_brute_force(spark):
    import random

    rnd = random.Random(5)
    rows = [(i, "hot" if rnd.random() < 0.8 else "cold", rnd.choice([rnd.randrange(0, 300_000_000), 60_000_000, 120_000_000])) for i in range(400)]
    df = inline_table(spark, rows, "id int, s string, us bigint")
    got = {r.id: (r.in_window, r.over_limit) for r in ev.rate_window(df, "s", "us", limit=60).collect()}
    for i, s, t in rows:
        n = sum(1 for j, s2, t2 in rows if s2 == s and t - 60_000_000 < t2 <= t)
        assert got[i] == (n, n > 60)


def test_publish_stats_add_up(spark):
    log = spark.range(1000).select(
        F.concat(F.lit("job"), (F.col("id") % 3).cast("string")).alias("job"),
        F.timestamp_micros(F.col("id") * 1000000).alias("ts"),
        F.element_at(F.array(*map(F.lit, [*ev.OUTCOMES, "unheard of", None])), (F.col("id") % 6 + 1).cast("int")).alias("outcome"),
    )
    rows = {r.job: r for r in ev.publish_stats(log).collect()}
    for r in rows.values():
        assert r.processed == r.published + r.failed + r.deadlettered + r.skipped + r.other
    assert rows["ALL"].processed == 1000 and rows["ALL"].success_rate == pytest.approx(0.5)
    empty = ev.publish_stats(log.filter("false")).collect()
    assert [(r.job, r.processed, r.success_rate, r.messages_per_second) for r in empty] == [("ALL", 0, 1.0, 0.0)]
    nothing = inline_table(spark, [], "status string, start_time double, end_time double")
    assert ev.job_summary(nothing).first().job_success_rate == 0.0


def test_alerts_are_strict(spark):
    stats = inline_table(spark, [(0.05, 100.0, 1.5, 10001.0)], "failed_rate double, deadletter_count double, lag_hours double, backlog double")
    fired = {r.rule: r.fired for r in ev.alert_rules(stats).collect()}
    assert fired == {"failed_rate": False, "deadletter_count": False, "lag_hours": True, "backlog": True}


def test_validate_inputs(spark):
    found = dict(ev.validate_inputs({"a": (spark.range(1), ["id"]), "b": (None, ["id"]), "c": (spark.range(0), ["id"])}))
    assert found == {"a: present": True, "a: columns": True, "a: rows": True, "b: present": False,
                     "c: present": True, "c: columns": True, "c: rows": False}
