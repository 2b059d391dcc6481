"""Typing, tidying, binning and encoding queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.functions import binning as bn
from tabloom.functions import clean as cl
from tabloom.operators import encode as en
from tabloom.operators import rollup as ro
from tabloom.plans.registry import hash_sql, query, table
from tabloom.plans.views import AS_OF_YEAR, BINNED_SQL, FACTS_SQL, GENRE_LIST, RAW_SQL, facts_view, raw_view

_ID = "try_cast(id AS DOUBLE)"


@query("select_present", f"SELECT id, title, revenue FROM ({FACTS_SQL})")
def select_present(spark, sf_dir):
    return ro.select_present(facts_view(spark, sf_dir), ["id", "title", "tagline", "revenue"])


@query("select_by_dtype", "SELECT p_partkey, p_size, p_retailprice FROM part")
def select_by_dtype(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.select(*en.numeric_columns(part))


@query("select_text_columns", "SELECT p_name, p_brand, p_type FROM part")
def select_text_columns(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.select(*en.text_columns(part))


@query("drop_cols", "SELECT * EXCLUDE (c_mktsegment) FROM customer")
def drop_cols(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    return customer.drop(customer.columns[-1])


@query("safe_double", f"""
    SELECT row_key, CASE WHEN NOT isinf({_ID}) THEN {_ID} END AS id_number,
           try_cast(revenue AS DOUBLE) AS revenue
    FROM ({RAW_SQL})
""")
def safe_double(spark, sf_dir):
    return raw_view(spark, sf_dir).select(
        "row_key",
        cl.safe_double(F.col("id"), only_finite=True).alias("id_number"),
        cl.safe_double(F.col("revenue")).alias("revenue"),
    )


@query("safe_int", f"""
    SELECT row_key, CASE WHEN NOT isinf({_ID}) THEN trunc({_ID})::BIGINT END AS id_whole FROM ({RAW_SQL})
""")
def safe_int(spark, sf_dir):
    return raw_view(spark, sf_dir).select("row_key", cl.safe_int(F.col("id")).alias("id_whole"))


@query("strict_int64", f"""
    SELECT row_key, CASE WHEN NOT isinf({_ID}) AND {_ID} = floor({_ID}) THEN {_ID}::BIGINT END AS id
    FROM ({RAW_SQL})
""")
def strict_int64(spark, sf_dir):
    return raw_view(spark, sf_dir).select("row_key", cl.strict_int64(F.col("id")).alias("id"))


@query("safe_string", f"""
    SELECT row_key, nullif(trim(title), '') AS title, nullif(trim(original_language), '') AS lang
    FROM ({RAW_SQL})
""")
def safe_string(spark, sf_dir):
    return raw_view(spark, sf_dir).select(
        "row_key",
        cl.safe_string(F.col("title")).alias("title"),
        cl.safe_string(F.col("original_language")).alias("lang"),
    )


@query("safe_bool", f"""
    SELECT row_key, CASE WHEN adult IS NULL THEN NULL
      ELSE lower(trim(adult)) IN ('true', '1', 'yes', 'on') END AS adult FROM ({RAW_SQL})
""")
def safe_bool(spark, sf_dir):
    return raw_view(spark, sf_dir).select("row_key", cl.safe_bool(F.col("adult")).alias("adult"))


@query("bool_flag", f"""
    SELECT row_key, CASE lower(trim(adult)) WHEN 'true' THEN true WHEN 'false' THEN false END AS adult
    FROM ({RAW_SQL})
""")
def bool_flag(spark, sf_dir):
    return raw_view(spark, sf_dir).select("row_key", cl.bool_flag(F.col("adult")).alias("adult"))


@query("parse_date", f"""
    SELECT row_key, CAST(try_cast(release_date AS DATE) AS VARCHAR) AS release_date,
      strftime(strptime(strftime(try_cast(release_date AS DATE), '%Y%m%d'), '%Y%m%d'), '%Y-%m-%d') AS compact
    FROM ({RAW_SQL})
""")
def parse_date(spark, sf_dir):
    compact = F.regexp_replace("release_date", "-", "")
    return raw_view(spark, sf_dir).select(
        "row_key",
        cl.parse_date(F.col("release_date")).cast("string").alias("release_date"),
        cl.parse_date(compact, "yyyyMMdd").cast("string").alias("compact"),
    )


@query("year_decade", f"""
    SELECT row_key, y AS release_year, CAST(floor(y / 10) * 10 AS INTEGER) AS release_decade FROM (
      SELECT row_key, CASE WHEN year(d) BETWEEN 1888 AND 2034 THEN year(d)::INTEGER END AS y
      FROM (SELECT row_key, try_cast(release_date AS DATE) AS d FROM ({RAW_SQL})))
""")
def year_decade(spark, sf_dir):
    year = cl.release_year(cl.parse_date(F.col("release_date")), AS_OF_YEAR)
    return raw_view(spark, sf_dir).select(
        "row_key", year.alias("release_year"), cl.decade(year).alias("release_decade")
    )


@query("date_ordinal", """
    SELECT o_orderkey, CAST(date_diff('day', DATE '0001-01-01', o_orderdate::DATE) + 1 AS INTEGER) AS ordinal
    FROM orders
""")
def date_ordinal(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    day = F.col("o_orderdate").cast("date")
    return orders.select("o_orderkey", cl.date_ordinal(day).alias("ordinal"))


@query("split_list", f"""
    SELECT id, array_to_string({GENRE_LIST}, '|') AS genres, len({GENRE_LIST})::INTEGER AS n
    FROM ({FACTS_SQL})
""")
def split_list(spark, sf_dir):
    genres = cl.split_list(F.col("genres"))
    return raw_view(spark, sf_dir).select(
        F.col("row_key").alias("id"), F.array_join(genres, "|").alias("genres"), F.size(genres).alias("n")
    )


@query("norm_language", f"""
    SELECT row_key, nullif(lower(trim(original_language)), '') AS original_language FROM ({RAW_SQL})
""")
def norm_language(spark, sf_dir):
    return raw_view(spark, sf_dir).select(
        "row_key", cl.norm_language(F.col("original_language")).alias("original_language")
    )


_CLEAN_SQL = f"""
    SELECT row_key, CASE WHEN NOT isinf({_ID}) AND {_ID} = floor({_ID}) THEN {_ID}::BIGINT END AS id,
      try_cast(vote_average AS DOUBLE) AS vote_average, try_cast(revenue AS DOUBLE) AS revenue,
      try_cast(runtime AS DOUBLE) AS runtime, try_cast(budget AS DOUBLE) AS budget,
      CASE lower(trim(adult)) WHEN 'true' THEN true WHEN 'false' THEN false END AS adult,
      nullif(lower(trim(original_language)), '') AS original_language,
      try_cast(release_date AS DATE) AS d, genres AS genres_csv
    FROM ({RAW_SQL})
"""


@query("clean_facts", f"""
    SELECT row_key, id, vote_average, revenue, runtime, budget, adult, original_language,
      CASE WHEN year(d) BETWEEN 1888 AND 2034 THEN year(d)::INTEGER END AS release_year,
      CASE WHEN year(d) BETWEEN 1888 AND 2034 THEN (year(d) // 10 * 10)::INTEGER END AS release_decade,
      array_to_string({GENRE_LIST}, '|') AS genres,
      revenue IS NOT NULL AS has_revenue, runtime IS NOT NULL AS has_runtime,
      vote_average IS NOT NULL AS has_vote
    FROM ({_CLEAN_SQL}) WHERE id IS NOT NULL
""")
def clean_facts(spark, sf_dir):
    df = ro.clean_movies(raw_view(spark, sf_dir), AS_OF_YEAR)
    return df.select(
        "row_key", "id", "vote_average", "revenue", "runtime", "budget", "adult", "original_language",
        "release_year", "release_decade", F.array_join("genres", "|").alias("genres"),
        "has_revenue", "has_runtime", "has_vote",
    )


@query("presence_flags", f"""
    SELECT count(*) FILTER (revenue IS NOT NULL) AS with_revenue,
      count(*) FILTER (runtime IS NOT NULL) AS with_runtime,
      count(*) FILTER (vote_average IS NOT NULL) AS with_vote FROM ({_CLEAN_SQL}) WHERE id IS NOT NULL
""")
def presence_flags(spark, sf_dir):
    df = ro.clean_movies(raw_view(spark, sf_dir), AS_OF_YEAR)
    return df.agg(
        F.count_if("has_revenue").alias("with_revenue"),
        F.count_if("has_runtime").alias("with_runtime"),
        F.count_if("has_vote").alias("with_vote"),
    )


@query("drop_bad_ids", f"""
    SELECT count(*) AS rows_in, count(id) AS rows_kept, count(*) - count(id) AS rows_dropped
    FROM ({_CLEAN_SQL})
""")
def drop_bad_ids(spark, sf_dir):
    raw = raw_view(spark, sf_dir).select("id")
    kept = ro.clean_movies(raw, 2024).agg(F.count("*")).scalar()
    counted = raw.agg(F.count("*").alias("rows_in")).withColumn("rows_kept", kept)
    return counted.withColumn("rows_dropped", F.col("rows_in") - F.col("rows_kept"))


@query("drop_nulls", f"SELECT id, revenue, runtime FROM ({FACTS_SQL}) WHERE revenue IS NOT NULL AND runtime IS NOT NULL")
def drop_nulls(spark, sf_dir):
    facts = facts_view(spark, sf_dir).select("id", "revenue", "runtime", "adult")
    return facts.na.drop(how="any", subset=["revenue", "runtime"]).drop("adult")


@query("isin", "SELECT * FROM part WHERE p_type IN ('ECONOMY', 'STANDARD')")
def isin(spark, sf_dir):
    return table(spark, sf_dir, "part").filter(F.col("p_type").isin("ECONOMY", "STANDARD"))


@query("bin_left_closed", f"SELECT id, rating_bin, revenue_bin, runtime_bin FROM ({BINNED_SQL})")
def bin_left_closed(spark, sf_dir):
    return facts_view(spark, sf_dir).select("id", "rating_bin", "revenue_bin", "runtime_bin")


_RATING_TIER = """CASE WHEN vote_average >= 0 AND vote_average < 4 THEN 'low'
    WHEN vote_average >= 4 AND vote_average < 7 THEN 'medium'
    WHEN vote_average >= 7 AND vote_average < 10.1 THEN 'high' ELSE 'unknown' END"""
_REVENUE_TIER = """CASE WHEN revenue >= 0 AND revenue < 1000000 THEN 'indie'
    WHEN revenue >= 1000000 AND revenue < 100000000 THEN 'mid'
    WHEN revenue >= 100000000 THEN 'blockbuster' ELSE 'unknown' END"""


@query("rating_tier", f"SELECT id, {_RATING_TIER} AS tier FROM ({FACTS_SQL})")
def rating_tier(spark, sf_dir):
    return facts_view(spark, sf_dir).select("id", bn.rating_tier(F.col("vote_average")).alias("tier"))


@query("revenue_tier", f"SELECT id, {_REVENUE_TIER} AS tier FROM ({FACTS_SQL})")
def revenue_tier(spark, sf_dir):
    return facts_view(spark, sf_dir).select("id", bn.revenue_tier(F.col("revenue")).alias("tier"))


@query("normalize_genre", f"""
    SELECT id, array_to_string(list_transform({GENRE_LIST}, lambda g: CASE g WHEN 'Science Fiction' THEN 'sci-fi'
      WHEN 'TV Movie' THEN 'tv-movie' ELSE replace(lower(g), ' ', '-') END), ',') AS genres
    FROM ({FACTS_SQL})
""")
def normalize_genre(spark, sf_dir):
    named = F.transform("genres", bn.normalize_genre)
    return facts_view(spark, sf_dir).select("id", F.array_join(named, ",").alias("genres"))


@query("map_values", f"""
    SELECT id, CASE WHEN original_language IS NULL THEN 0 WHEN original_language = 'f' THEN 1
      WHEN original_language = 'o' THEN 2 END AS code FROM ({FACTS_SQL})
""")
def map_values(spark, sf_dir):
    code = cl.map_values(F.col("original_language"), {"f": 1, "o": 2}, null_value=0)
    return facts_view(spark, sf_dir).select("id", code.alias("code"))


_CUT = """
    SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, lo0, hi0, (hi0 - lo0) / 3 AS step
    FROM lineitem, (SELECT min(l_quantity) AS lo0, max(l_quantity) AS hi0 FROM lineitem)
"""


@query("cut_equal_width", f"""
    SELECT bin, round(min(CASE bin WHEN 0 THEN lo0 - (hi0 - lo0) * 0.001 ELSE lo0 + step * bin END), 6) AS lo,
      round(min(lo0 + step * (bin + 1)), 6) AS hi, count(*) AS n
    FROM (SELECT *, CASE WHEN l_quantity > lo0 + 2 * step THEN 2 WHEN l_quantity > lo0 + step THEN 1
      ELSE 0 END AS bin FROM ({_CUT})) GROUP BY bin
""")
def cut_equal_width(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_quantity")
    cut = en.cut_equal_width(lines, "l_quantity", 3)
    return cut.groupBy("bin").agg(
        F.round(F.min("lo"), 6).alias("lo"), F.round(F.min("hi"), 6).alias("hi"), F.count("*").alias("n")
    )


@query("qcut", """
    SELECT o_orderkey, CASE WHEN o_totalprice > q[3] THEN 3 WHEN o_totalprice > q[2] THEN 2
      WHEN o_totalprice > q[1] THEN 1 ELSE 0 END AS qbin
    FROM orders, (SELECT quantile_cont(o_totalprice, [0.25, 0.5, 0.75]) AS q FROM orders)
""")
def qcut(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return en.qcut(orders, "o_totalprice", 4).select("o_orderkey", "qbin")


@query("qcut_by_group", """
    SELECT o_orderkey, o_custkey, CASE WHEN o_totalprice > q[3] THEN 3 WHEN o_totalprice > q[2] THEN 2
      WHEN o_totalprice > q[1] THEN 1 ELSE 0 END AS qbin
    FROM orders JOIN (SELECT o_custkey, quantile_cont(o_totalprice, [0.25, 0.5, 0.75]) AS q FROM orders GROUP BY o_custkey) USING (o_custkey)
""")
def qcut_by_group(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return en.qcut_by(orders, ["o_custkey"], "o_totalprice", 4).select("o_orderkey", "o_custkey", "qbin")


@query("qcut_labels", """
    SELECT qbin, count(*) AS n FROM (
      SELECT CASE WHEN c_acctbal > m THEN 'high' ELSE 'low' END AS qbin
      FROM customer, (SELECT quantile_cont(c_acctbal, 0.5) AS m FROM customer)) GROUP BY qbin
""")
def qcut_labels(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").select("c_acctbal")
    return en.qcut(customer, "c_acctbal", 2, ["low", "high"]).groupBy("qbin").agg(F.count("*").alias("n"))


@query("exact_quantiles", """
    SELECT round(quantile_cont(l_extendedprice, 0.01), 4) AS q0, round(quantile_cont(l_extendedprice, 0.5), 4) AS q1,
      round(quantile_cont(l_extendedprice, 0.99), 4) AS q2 FROM lineitem
""")
def exact_quantiles(spark, sf_dir):
    from tabloom.operators.ordered import exact_quantiles as quantiles

    row = quantiles(table(spark, sf_dir, "lineitem"), "l_extendedprice", [0.01, 0.5, 0.99])
    return row.select(*[F.round(c, 4).alias(c) for c in row.columns])


@query("one_hot", """
    SELECT c_custkey, c_mktsegment,
      (c_mktsegment = 'AUTOMOBILE')::INTEGER AS "c_mktsegment_AUTOMOBILE",
      (c_mktsegment = 'BUILDING')::INTEGER AS "c_mktsegment_BUILDING",
      (c_mktsegment = 'FURNITURE')::INTEGER AS "c_mktsegment_FURNITURE",
      (c_mktsegment = 'HOUSEHOLD')::INTEGER AS "c_mktsegment_HOUSEHOLD",
      (c_mktsegment = 'MACHINERY')::INTEGER AS "c_mktsegment_MACHINERY" FROM customer
""")
def one_hot(spark, sf_dir):
    return en.one_hot(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment")


@query("abs_all", "SELECT abs(c_custkey) AS c_custkey, abs(c_nationkey) AS c_nationkey, abs(c_acctbal) AS c_acctbal FROM customer")
def abs_all(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    return customer.select(*[F.abs(c).alias(c) for c in en.numeric_columns(customer)])


@query("log1p", "SELECT o_orderkey, round(ln(1 + o_totalprice), 6) AS y FROM orders")
def log1p(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(F.log1p("o_totalprice"), 6).alias("y"))


# Daily counts shaped like an epidemic table: some days miss a value.
_DAILY = """SELECT CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS date,
    nullif(count(*) FILTER (o_orderstatus = 'F'), 0) AS recovered,
    nullif(count(*) FILTER (o_orderstatus = 'P'), 0) AS death,
    nullif(count(*) FILTER (o_orderpriority <> '5-LOW'), 0) AS positive FROM orders GROUP BY 1"""


def daily(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy(F.date_format("o_orderdate", "yyyyMMdd").cast("int").alias("date")).agg(
        *[
            F.nullif(F.count_if(cond), F.lit(0)).alias(name)
            for name, cond in {
                "recovered": F.col("o_orderstatus") == "F",
                "death": F.col("o_orderstatus") == "P",
                "positive": F.col("o_orderpriority") != "5-LOW",
            }.items()
        ]
    )


@query("fill_null", f"""
    SELECT date, coalesce(recovered, 0) AS recovered, coalesce(death, 0) AS death,
      coalesce(positive, 0) AS positive FROM ({_DAILY})
""")
def fill_null(spark, sf_dir):
    return daily(spark, sf_dir).na.fill(0, ["recovered", "death", "positive"])


@query("row_sum_skipna", f"""
    SELECT max(coalesce(recovered, 0) + coalesce(death, 0))::DOUBLE AS max_sum,
      max(positive) AS max_positive FROM ({_DAILY})
""")
def row_sum_skipna(spark, sf_dir):
    return daily(spark, sf_dir).agg(
        F.max(cl.row_sum(F.col("recovered"), F.col("death"))).alias("max_sum"),
        F.max("positive").alias("max_positive"),
    )


@query("derive_compartments", f"""
    SELECT CAST(strptime(CAST(date AS VARCHAR), '%Y%m%d')::DATE AS VARCHAR) AS date,
      r::DOUBLE AS "Recovered", (p - r)::DOUBLE AS "Infected", (66e6 - (p - r) - r)::DOUBLE AS "Susceptible"
    FROM (SELECT date, coalesce(recovered, 0) + coalesce(death, 0) AS r, coalesce(positive, 0) AS p
          FROM ({_DAILY}))
""")
def derive_compartments(spark, sf_dir):
    df = en.compartments(daily(spark, sf_dir))
    return df.withColumn("date", F.col("date").cast("string"))


@query("percent_error", """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
      round(CASE WHEN l_extendedprice <> 0 THEN
        abs((l_extendedprice - l_quantity * 1500) / l_extendedprice) * 100 END, 4) AS err FROM lineitem
""")
def percent_error(spark, sf_dir):
    err = cl.percent_error(F.col("l_extendedprice"), F.col("l_quantity") * 1500)
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(err, 4).alias("err")
    )


@query("standardize", f"""
    SELECT o_orderkey, round((o_totalprice - m) / s, 6) AS o_totalprice_z FROM orders,
      (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s FROM orders
       WHERE {hash_sql('o_orderkey')} < 3006477107)
""")
def standardize(spark, sf_dir):
    from tabloom.operators.sampling import key_hash, share_limit

    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    train = key_hash(F.col("o_orderkey")) < share_limit(0.7)
    z = en.standardize(orders, ["o_totalprice"], train)
    return z.select("o_orderkey", F.round("o_totalprice_z", 6).alias("o_totalprice_z"))


@query("poly_features", """
    SELECT o_orderkey, round(z, 9) AS z_1, round(z * z, 9) AS z_2, round(z * z * z, 9) AS z_3
    FROM (SELECT o_orderkey, o_totalprice / 1000000 AS z FROM orders)
""")
def poly_features(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") / 1000000).alias("z"))
    powers = orders.select("o_orderkey", *en.poly_features(F.col("z"), 3, "z"))
    return powers.select("o_orderkey", *[F.round(c, 9).alias(c) for c in ("z_1", "z_2", "z_3")])
