"""Event envelopes, attributes, routing and publish statistics."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabloom.functions import binning as bn
from tabloom.operators.rollup import pct_of_total

# Topic names, event types, source names and limits.
RAW_TOPIC = "movie-events-raw"
ANALYTICS_TOPIC = "movie-events-analytics"
DEAD_LETTER_TOPIC = "movie-events-deadletter"
MOVIE_EVENT, ANALYTICS_EVENT, EVENT_SOURCE = "movie.created", "analytics.aggregation", "movie-denormalizer"
SPEC_VERSION, CONTENT_TYPE, DATA_VERSION = "1.0", "application/json", "v1.0"
RATE_LIMIT_PER_MINUTE = 8000
RETENTION_DAYS = {RAW_TOPIC: 7, ANALYTICS_TOPIC: 7, DEAD_LETTER_TOPIC: 30}
OUTCOMES = ["published", "failed", "deadlettered", "skipped"]
# The named subscriptions as (name, topic, attribute, accepted values).
SUBSCRIPTIONS = [
    ("movie-events-all", RAW_TOPIC, None, []),
    ("movie-events-high-rated", RAW_TOPIC, "ratingTier", ["high"]),
    ("movie-events-blockbusters", RAW_TOPIC, "revenueTier", ["blockbuster"]),
    ("movie-events-recent", RAW_TOPIC, "decade", ["2020s", "2010s"]),
    ("analytics-events-all", ANALYTICS_TOPIC, None, []),
    ("analytics-events-genre", ANALYTICS_TOPIC, "aggregationType", ["by_genre"]),
    ("deadletter-monitor", DEAD_LETTER_TOPIC, None, []),
]
# Alert thresholds.
ALERTS = {"failed_rate": 0.05, "deadletter_count": 100.0, "lag_hours": 1.0, "backlog": 10000.0}


def known_attributes(entries: dict[str, Column]) -> Column:
    """Attribute map of the entries that are not null."""
    pairs = [x for name, value in entries.items() for x in (F.lit(name), value.cast("string"))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())


def movie_attributes(have: Sequence[str]) -> Column:
    """Filter attributes of a film event; each optional one only where its value is known."""
    entries = {"eventType": F.lit(MOVIE_EVENT), "source": F.lit(EVENT_SOURCE)}
    if "original_language" in have:
        entries["language"] = F.lower("original_language")
    if "release_decade" in have:
        entries["decade"] = F.concat(F.col("release_decade").cast("string"), F.lit("s"))
    if "vote_average" in have:
        rating = F.col("vote_average")
        entries["ratingTier"] = F.when(rating.isNotNull(), bn.rating_tier(rating))
    if "revenue" in have:
        revenue = F.col("revenue")
        entries["revenueTier"] = F.when(revenue.isNotNull(), bn.revenue_tier(revenue))
    if "adult" in have:
        entries["adult"] = F.col("adult").cast("string")
    if "genres" in have:
        names = F.array_join(F.transform("genres", bn.normalize_genre), ",")
        entries["genre"] = F.nullif(names, F.lit(""))
    if "production_countries" in have:
        entries["country"] = F.nullif(F.array_join("production_countries", ","), F.lit(""))
    return known_attributes(entries)


def _camel(name: str) -> str:
    return re.sub(r"_(\w)", lambda m: m.group(1).upper(), name)


def _inner_json(fields: dict[str, Column], camel: bool, keep_nulls: bool) -> Column:
    """The members of a JSON object without its braces; null when there are none."""
    named = [v.alias(_camel(n) if camel else n) for n, v in fields.items()]
    text = F.to_json(F.struct(*named), {"ignoreNullFields": str(not keep_nulls).lower()})
    return F.nullif(F.substring(text, F.lit(2), F.length(text) - 2), F.lit(""))


def _group(fields: dict[str, Column], camel: bool) -> Column:
    return F.struct(*[v.alias(_camel(n) if camel else n) for n, v in fields.items()])


def _envelope(kind: str, event_id: Column, event_time: Column, data_json: Column) -> Column:
    iso = F.date_format(event_time, "yyyy-MM-dd'T'HH:mm:ssxxx")
    head = _inner_json(
        {
            "specversion": F.lit(SPEC_VERSION),
            "type": F.lit(kind),
            "source": F.lit(EVENT_SOURCE),
            "id": event_id,
            "time": iso,
            "datacontenttype": F.lit(CONTENT_TYPE),
        },
        camel=False,
        keep_nulls=True,
    )
    return F.concat(F.lit("{"), head, F.lit(',"data":{'), data_json, F.lit("}}"))


def movie_events(facts: DataFrame, event_time: Column, camel: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """One (topic, key, value, attributes) row per film.

    Unknown members at the top of ``data`` are left out; inside ratings,
    financial and technical they stay as null.
    """
    movie_id = F.coalesce(F.col("id").cast("string"), F.lit(""))
    event_id = F.concat(F.lit("movie-"), movie_id, F.lit("-"), F.unix_seconds(event_time).cast("string"))
    top = {"movie_id": movie_id}
    top |= {c: F.col(c) for c in ("title", "original_title", "original_language")}
    top |= {"release_date": F.col("release_date").cast("string")}
    top |= {c: F.col(c) for c in ("release_year", "release_decade")}
    ratings = {"average": F.col("vote_average"), "count": F.col("vote_count").cast("bigint"), "bin": F.col("rating_bin")}
    money = {c: F.col(c) for c in ("revenue", "budget", "revenue_bin")}
    technical = {"runtime": F.col("runtime").try_cast("int"), "runtime_bin": F.col("runtime_bin"), "adult": F.col("adult")}
    groups = {
        "ratings": _group(ratings, camel),
        "financial": _group(money, camel),
        "technical": _group(technical, camel),
    }
    data = F.concat_ws(
        ",",
        _inner_json(top, camel, keep_nulls=False),
        _inner_json(groups, camel, keep_nulls=True),
        _inner_json({"popularity": F.col("popularity")}, camel, keep_nulls=False),
    )
    return facts.select(
        *keep,
        F.lit(RAW_TOPIC).alias("topic"),
        event_id.alias("key"),
        _envelope(MOVIE_EVENT, event_id, event_time, data).alias("value"),
        movie_attributes(facts.columns).alias("attributes"),
    )


def valid_dimension(rollups: DataFrame) -> DataFrame:
    return rollups.filter(F.col("dimension").isNotNull() & (F.col("movie_count") > 0))


def analytics_events(rollups: DataFrame, event_time: Column, total: Column, camel: bool = False) -> DataFrame:
    """One (topic, key, value, attributes) row per rollup row with a dimension and a count."""
    kind, dimension, n = F.col("aggregation_type"), F.col("dimension"), F.col("movie_count")
    event_id = F.concat_ws("-", F.lit("analytics"), kind, dimension, F.unix_seconds(event_time).cast("string"))
    iso = F.date_format(event_time, "yyyy-MM-dd'T'HH:mm:ssxxx")
    metrics = {"movie_count": n, "percentage": pct_of_total(n, total), "total_movies": total}
    data = _inner_json(
        {
            "aggregation_type": kind,
            "dimension": dimension,
            "metrics": _group(metrics, camel),
            "metadata": _group({"calculated_at": iso, "data_version": F.lit(DATA_VERSION)}, camel),
        },
        camel,
        keep_nulls=True,
    )
    attributes = known_attributes(
        {
            "eventType": F.lit(ANALYTICS_EVENT),
            "aggregationType": kind,
            "dimension": dimension,
            "dataSource": F.concat(F.lit("movies_"), kind, F.lit(".csv")),
        }
    )
    return valid_dimension(rollups).select(
        F.lit(ANALYTICS_TOPIC).alias("topic"),
        event_id.alias("key"),
        _envelope(ANALYTICS_EVENT, event_id, event_time, data).alias("value"),
        attributes.alias("attributes"),
    )


def attr(name: str) -> Column:
    return F.try_element_at("attributes", F.lit(name))


def attr_equals(name: str, value: str) -> Column:
    return attr(name) == value


def attr_or(name: str, values: Sequence[str]) -> Column:
    return attr(name).isin(list(values))


def attr_has(name: str, value: str) -> Column:
    """Whether a comma-joined attribute holds the value."""
    return F.array_contains(F.split(attr(name), ","), value)


def route_subscriptions(events: DataFrame, keep: Sequence[str]) -> DataFrame:
    """(subscription, kept columns) for every subscription an event matches, in one pass."""
    hits = []
    for name, topic, attribute, values in SUBSCRIPTIONS:
        match = F.col("topic") == topic
        if attribute:
            match = match & F.coalesce(attr_or(attribute, values), F.lit(False))
        hits.append(F.when(match, F.lit(name)))
    matched = F.filter(F.array(*hits), lambda x: x.isNotNull())
    return events.select(F.explode(matched).alias("subscription"), *keep)


def movie_fault(raw_id: Column, title: Column) -> Column:
    """Why a film row cannot be published, or null."""
    return F.when(raw_id.isNull(), "invalid id").when(title.isNull(), "missing title")


# What a dead letter notes about itself.
NOTES = ["error_reason", "failed_at", "original_topic", "aggregation_type"]


def noted(attributes: Column, notes: dict[str, Column]) -> Column:
    """Attributes with fresh notes; notes of an earlier failure are replaced."""
    return F.map_concat(F.map_filter(attributes, lambda k, _: ~k.isin(NOTES)), known_attributes(notes))


def with_dead_letters(
    events: DataFrame, reason: Column, failed_at: Column, extra: dict[str, Column] | None = None
) -> DataFrame:
    """Send rows with a reason to the dead-letter topic and note why, when and from where.

    The choice is one expression per row, so each input row leaves exactly once.
    """
    notes = {
        "error_reason": reason,
        "failed_at": F.unix_seconds(failed_at),
        "original_topic": F.col("topic"),
        **(extra or {}),
    }
    bad = reason.isNotNull()
    return events.withColumns(
        {
            "attributes": F.when(bad, noted(F.col("attributes"), notes)).otherwise(F.col("attributes")),
            "topic": F.when(bad, F.lit(DEAD_LETTER_TOPIC)).otherwise(F.col("topic")),
        }
    )


def replay_dead_letters(dead: DataFrame, published: DataFrame, still_bad: Column) -> DataFrame:
    """Dead letters that are valid now and were not published before, back on their topic."""
    ready = dead.filter(~F.coalesce(still_bad, F.lit(False)))
    fresh = ready.join(published.select("key"), "key", "left_anti")
    return fresh.withColumns(
        {
            "topic": attr("original_topic"),
            "attributes": F.map_filter("attributes", lambda k, _: ~k.isin(NOTES)),
        }
    )


def publish_stats(log: DataFrame, all_label: str = "ALL") -> DataFrame:
    """Counts, rate and success share per job and over all jobs.

    ``log`` has (job, ts, outcome). The total row is made from the per-job rows. Outcomes without a column of their
    own, null included, are counted as ``other``, so the columns add up to ``processed``.
    """
    counts = [F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES]
    counts.append(F.count_if(~F.coalesce(F.col("outcome").isin(list(OUTCOMES)), F.lit(False))).alias("other"))
    jobs = log.groupBy("job").agg(
        F.count("*").alias("processed"), *counts, F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )
    whole = jobs.agg(
        F.lit(all_label).alias("job"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("processed", *OUTCOMES, "other")],
        F.min("first_ts").alias("first_ts"),
        F.max("last_ts").alias("last_ts"),
    )
    seconds = (F.unix_micros("last_ts") - F.unix_micros("first_ts")) / 1e6
    sent = F.col("published") + F.col("failed")
    return jobs.unionByName(whole).withColumns(
        {
            "duration_seconds": F.coalesce(seconds, F.lit(0.0)),
            "messages_per_second": F.when(seconds > 0, F.col("published") / seconds).otherwise(F.lit(0.0)),
            "success_rate": F.when(sent > 0, F.col("published") / sent).otherwise(F.lit(1.0)),
        }
    )


def job_summary(runs: DataFrame) -> DataFrame:
    """Submitted jobs, how many are in each state, and the success share of the finished ones.

    A state without a column of its own counts as ``other``.
    """
    states = ["pending", "running", "completed", "failed", "cancelled"]

    def having(status: str) -> Column:
        return F.count_if(F.col("status") == status)

    done = F.col("completed") + F.col("failed")
    return runs.agg(
        F.count("*").alias("submitted"),
        *[having(s).alias(s) for s in states],
        F.count_if(~F.coalesce(F.col("status").isin(states), F.lit(False))).alias("other"),
        F.sum(F.col("end_time") - F.col("start_time")).alias("total_duration"),
    ).withColumn("job_success_rate", F.when(done > 0, F.col("completed") / done).otherwise(F.lit(0.0)))


def alert_rules(stats: DataFrame) -> DataFrame:
    """Long (rule, value, threshold, fired). ``stats`` is one row with a column per rule."""
    rows = F.array(
        *[
            F.struct(F.lit(r).alias("rule"), F.col(r).cast("double").alias("value"), F.lit(t).alias("threshold"))
            for r, t in ALERTS.items()
        ]
    )
    out = stats.select(F.explode(rows).alias("r")).select("r.*")
    return out.withColumn("fired", F.coalesce(F.col("value") > F.col("threshold"), F.lit(False)))


def retention_filter(events: DataFrame, event_date: str, as_of: Column) -> DataFrame:
    """Rows still inside the retention time of their topic; a topic without a limit, or no topic, keeps its rows."""
    days = F.create_map(*[F.lit(x) for kv in RETENTION_DAYS.items() for x in kv])
    limit = F.try_element_at(days, F.col("topic"))
    return events.filter(limit.isNull() | (F.col(event_date) > F.date_sub(as_of, limit)))


def rate_window(
    messages: DataFrame, source: str, micros: str, limit: int = RATE_LIMIT_PER_MINUTE
) -> DataFrame:
    """Add ``in_window`` (messages of the source in the last 60 s, this one included) and ``over_limit``.

    A message counts from its own time on and stops counting 60 s later, so the
    number in the window is a running sum of comings and goings. Each message
    counts in its own minute and, as history, in the next one; a task thus
    holds two minutes of one source, however busy the source is. Messages of
    the same time count for each other.
    """
    span = 60_000_000
    now = F.col(micros)
    minute = ((now - F.pmod(now, F.lit(span))) / span).cast("bigint")

    def mark(at: Column, time: Column, step: int, own: bool) -> Column:
        return F.struct(
            at.alias("m"), time.alias("t"), F.lit(step).alias("step"), F.lit(own).alias("own")
        )

    marks = F.array(
        mark(minute, now, 1, True), mark(minute + 1, now, 1, False), mark(minute + 1, now + span, -1, False)
    )
    steps = messages.withColumn("_s", F.explode(marks))
    # All that comes or goes at a time is counted at it: the window is open at its far end.
    order = Window.partitionBy(source, F.col("_s.m")).orderBy(F.col("_s.t"))
    running = F.sum("_s.step").over(order.rangeBetween(Window.unboundedPreceding, 0))
    counted = steps.withColumn("in_window", running).filter("_s.own").drop("_s")
    return counted.withColumn("over_limit", F.col("in_window") > limit)


def live_counts(events: DataFrame, dimension: Column) -> DataFrame:
    """Count per dimension; works on batch and, in complete mode, on streaming input."""
    return events.groupBy(dimension.alias("dimension")).agg(F.count("*").alias("n"))


def validate_inputs(checks: dict[str, tuple[DataFrame | None, Sequence[str]]]) -> list[tuple[str, bool]]:
    """(check, ok) per input: it is there, has the needed columns and at least one row."""
    out = []
    for name, (df, columns) in checks.items():
        out.append((f"{name}: present", df is not None))
        if df is None:
            continue
        have_columns = set(columns) <= set(df.columns)
        out.append((f"{name}: columns", have_columns))
        out.append((f"{name}: rows", have_columns and bool(df.select(*columns).take(1))))
    return out
