"""Clean facts and the count rollups made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions import binning as bn
from tabloom.functions import clean as cl
from tabloom.sources.inline import inline_table

# Columns of the facts table, and per rollup the dimension column.
NUMBER_FIELDS = ["vote_average", "vote_count", "revenue", "runtime", "budget", "popularity"]
FACT_COLUMNS = ["id", "title", "original_title", "original_language", "release_date", "release_year",
                "release_decade", "vote_average", "vote_count", "revenue", "budget", "runtime",
                "adult", "popularity", "rating_bin", "revenue_bin", "runtime_bin"]
ROLLUP_COLUMNS = {"by_genre": "genre", "by_region": "country", "by_year": "release_year",
                  "by_decade": "release_decade", "by_rating_bin": "rating_bin",
                  "by_revenue_bin": "revenue_bin", "by_runtime_bin": "runtime_bin",
                  "by_language": "original_language"}


def select_present(df: DataFrame, columns) -> DataFrame:
    """The listed columns that exist, in the listed order."""
    return df.select(*[c for c in columns if c in df.columns])


def clean_movies(raw: DataFrame, as_of_year: int) -> DataFrame:
    """Typed rows from an all-string table. Rows whose id is no whole number go.

    Only columns that are present are touched. ``as_of_year`` stands for the
    current year so that a rerun gives the same rows.
    """
    have = set(raw.columns)
    unknown = F.lit(None).cast("double")
    out = {c: F.nanvl(cl.safe_double(F.col(c)), unknown) for c in NUMBER_FIELDS if c in have}
    if "id" in have:
        out["id"] = cl.strict_int64(F.col("id"))
    if "release_date" in have:
        out["release_date"] = cl.parse_date(F.col("release_date"))
    if "adult" in have:
        out["adult"] = cl.bool_flag(F.col("adult"))
    for c in cl.LIST_FIELDS:
        if c in have:
            out[c] = cl.split_list(F.col(c))
    if "original_language" in have:
        out["original_language"] = cl.norm_language(F.col("original_language"))
    df = raw.withColumns(out)
    if "release_date" in have:
        df = df.withColumn("release_year", cl.release_year(F.col("release_date"), as_of_year))
        df = df.withColumn("release_decade", cl.decade(F.col("release_year")))
    flags = {"has_revenue": "revenue", "has_runtime": "runtime", "has_vote": "vote_average"}
    df = df.withColumns(
        {f: F.col(c).isNotNull() if c in have else F.lit(False) for f, c in flags.items()}
    )
    return df.filter(F.col("id").isNotNull()) if "id" in have else df


def with_bins(
    df: DataFrame,
    rating: bn.Bins | None = None,
    revenue: bn.Bins | None = None,
    runtime: bn.Bins | None = None,
) -> DataFrame:
    """Add the rating, revenue and runtime bin labels."""
    plan = {
        "rating_bin": ("vote_average", rating or bn.rating_bins()),
        "revenue_bin": ("revenue", revenue or bn.revenue_bins()),
        "runtime_bin": ("runtime", runtime or bn.runtime_bins()),
    }
    return df.withColumns({out: bins.label(F.col(c)) for out, (c, bins) in plan.items()})


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Count per value, null included and last, most frequent first."""
    return (
        df.groupBy(column)
        .agg(F.count("*").alias("movie_count"))
        .orderBy(F.col(column).isNull(), F.desc("movie_count"), F.asc(column))
    )


def bin_counts(df: DataFrame, bin_column: str, bins: bn.Bins) -> DataFrame:
    """Count per bin in bin order with empty bins as zero; a null row only if there are nulls.

    The bin list is fixed by the caller, so it is safe to broadcast.
    """
    counts = df.groupBy(bin_column).agg(F.count("*").alias("n"))
    spark = df.sparkSession
    known = (
        F.broadcast(bins.table(spark))
        .join(counts, F.col("label") == F.col(bin_column), "left")
        .select("code", F.col("label").alias(bin_column), F.coalesce("n", F.lit(0)).alias("movie_count"))
    )
    missing = counts.filter(F.col(bin_column).isNull()).select(
        F.lit(-1).alias("code"), bin_column, F.col("n").alias("movie_count")
    )
    return known.unionByName(missing).orderBy("code").drop("code")


def exploded_counts(df: DataFrame, list_column: str, name: str) -> DataFrame:
    """Count per list element; an empty list adds nothing."""
    return (
        df.select(F.explode(list_column).alias(name))
        .groupBy(name)
        .agg(F.count("*").alias("movie_count"))
        .orderBy(F.desc("movie_count"), F.asc(name))
    )


def _pair(kind: str, dimension: Column) -> Column:
    return F.struct(F.lit(kind).alias("aggregation_type"), dimension.cast("string").alias("dimension"))


def all_rollups(facts: DataFrame) -> DataFrame:
    """All eight rollups as (aggregation_type, dimension, movie_count) in one pass.

    Each row becomes one small pair per dimension value, and the pairs are
    combined before the shuffle, so one scan and one small exchange replace
    eight of each. Bins nobody falls into are added with a count of zero.
    """
    single = [k for k in ROLLUP_COLUMNS if k not in ("by_genre", "by_region")]
    pairs = F.concat(
        F.array(*[_pair(k, F.col(ROLLUP_COLUMNS[k])) for k in single]),
        F.transform("genres", lambda g: _pair("by_genre", g)),
        F.transform("production_countries", lambda g: _pair("by_region", g)),
    )
    counts = (
        facts.select(F.explode(pairs).alias("p"))
        .groupBy("p.aggregation_type", "p.dimension")
        .agg(F.count("*").alias("movie_count"))
    )
    spark = facts.sparkSession
    labels = [
        (kind, label)
        for kind, bins in [
            ("by_rating_bin", bn.rating_bins()),
            ("by_revenue_bin", bn.revenue_bins()),
            ("by_runtime_bin", bn.runtime_bins()),
        ]
        for label in bins.labels
    ]
    zero = inline_table(spark, labels, "aggregation_type string, dimension string").withColumn(
        "movie_count", F.lit(0).cast("bigint")
    )
    return (
        counts.unionByName(zero)
        .groupBy("aggregation_type", "dimension")
        .agg(F.sum("movie_count").alias("movie_count"))
    )


def value_shares(df: DataFrame, column: str) -> DataFrame:
    """Relative frequency of each value, nulls left out of the total."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / counts.agg(F.sum("n")).scalar())


def grand_total(rollups: DataFrame) -> DataFrame:
    """One row ``total``: genre counts, else the counts of known years, else 0."""
    def part(kind: str) -> Column:
        return F.sum(F.when(F.col("aggregation_type") == kind, F.col("movie_count")))

    years = F.sum(
        F.when(
            (F.col("aggregation_type") == "by_year") & F.col("dimension").isNotNull(),
            F.col("movie_count"),
        )
    )
    return rollups.agg(F.coalesce(part("by_genre"), years, F.lit(0)).cast("bigint").alias("total"))


def pct_of_total(count: Column, total: Column) -> Column:
    return F.when(total > 0, F.round(count / total * 100, 2))
