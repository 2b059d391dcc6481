"""Count rollups over the typed facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.functions import binning as bn
from tabloom.operators import rollup as ro
from tabloom.plans.registry import query, table
from tabloom.plans.views import BINNED_SQL, COUNTRY_LIST, FACTS_SQL, GENRE_LIST, facts_view


def _counts_sql(column: str) -> str:
    return f"SELECT {column}, count(*) AS movie_count FROM ({FACTS_SQL}) GROUP BY {column}"


@query("by_year", _counts_sql("release_year"))
def by_year(spark, sf_dir):
    return ro.value_counts(facts_view(spark, sf_dir), "release_year")


@query("by_decade", _counts_sql("release_decade"))
def by_decade(spark, sf_dir):
    return ro.value_counts(facts_view(spark, sf_dir), "release_decade")


@query("by_language", _counts_sql("original_language"))
def by_language(spark, sf_dir):
    return ro.value_counts(facts_view(spark, sf_dir), "original_language")


_GENRES_SQL = f"""SELECT genre, count(*) AS movie_count FROM
    (SELECT unnest({GENRE_LIST}) AS genre FROM ({FACTS_SQL})) GROUP BY genre"""
_REGIONS_SQL = f"""SELECT country, count(*) AS movie_count FROM
    (SELECT unnest({COUNTRY_LIST}) AS country FROM ({FACTS_SQL})) GROUP BY country"""


@query("by_genre", _GENRES_SQL)
def by_genre(spark, sf_dir):
    return ro.exploded_counts(facts_view(spark, sf_dir), "genres", "genre")


@query("by_region", _REGIONS_SQL)
def by_region(spark, sf_dir):
    return ro.exploded_counts(facts_view(spark, sf_dir), "production_countries", "country")


_ALL_BINS = {
    "rating_bin": ["0.00–0.99", "1.00–1.99", "2.00–2.99", "3.00–3.99", "4.00–4.99", "5.00–5.99", "6.00–6.99",
                   "7.00–7.99", "8.00–8.99", "9.00–9.99"],
    "revenue_bin": ["0–99,999", "100,000–999,999", "1,000,000–9,999,999", "10,000,000–99,999,999",
                    "100,000,000–499,999,999", "500,000,000–999,999,999", "1,000,000,000–4,999,999,999",
                    "5,000,000,000–∞"],
    "runtime_bin": ["0–79", "80–99", "100–119", "120–139", "140–159", "160–199", "200–∞"],
}


def _bins_sql(column: str) -> str:
    labels = ", ".join(f"('{x}')" for x in _ALL_BINS[column])
    counts = f"SELECT {column}, count(*) AS n FROM ({BINNED_SQL}) GROUP BY {column}"
    return f"""SELECT v.label AS {column}, coalesce(c.n, 0) AS movie_count
        FROM (VALUES {labels}) v(label) LEFT JOIN ({counts}) c ON v.label = c.{column}
        UNION ALL SELECT {column}, n FROM ({counts}) WHERE {column} IS NULL"""


@query("by_rating_bin", _bins_sql("rating_bin"))
def by_rating_bin(spark, sf_dir):
    return ro.bin_counts(facts_view(spark, sf_dir), "rating_bin", bn.rating_bins())


@query("by_revenue_bin", _bins_sql("revenue_bin"))
def by_revenue_bin(spark, sf_dir):
    return ro.bin_counts(facts_view(spark, sf_dir), "revenue_bin", bn.revenue_bins())


@query("by_runtime_bin", _bins_sql("runtime_bin"))
def by_runtime_bin(spark, sf_dir):
    return ro.bin_counts(facts_view(spark, sf_dir), "runtime_bin", bn.runtime_bins())


# A bin no part price can reach, to show that empty bins are listed.
@query("bins_left_join", """
    SELECT v.label AS price_bin, count(p.p_partkey) AS movie_count
    FROM (VALUES (0, 500, '0–499'), (500, 1000, '500–999'), (1000, 1500, '1000–1499'), (1500, 99999, '1500–99998'))
      v(lo, hi, label) LEFT JOIN part p ON p.p_retailprice >= v.lo AND p.p_retailprice < v.hi GROUP BY v.label
""")
def bins_left_join(spark, sf_dir):
    bins = bn.runtime_bins([0, 500, 1000, 1500, 99999])
    part = table(spark, sf_dir, "part").select(bins.label(F.col("p_retailprice")).alias("price_bin"))
    return ro.bin_counts(part, "price_bin", bins)


def rollups_sql() -> str:
    def simple(kind, column):
        return f"""SELECT '{kind}' AS aggregation_type, CAST({column} AS VARCHAR) AS dimension,
            count(*) AS movie_count FROM ({FACTS_SQL}) GROUP BY {column}"""

    parts = [simple("by_year", "release_year"), simple("by_decade", "release_decade"),
             simple("by_language", "original_language")]
    parts += [f"SELECT 'by_{c}' AS aggregation_type, {c} AS dimension, movie_count FROM ({_bins_sql(c)})"
              for c in _ALL_BINS]
    parts.append(f"SELECT 'by_genre', genre, movie_count FROM ({_GENRES_SQL})")
    parts.append(f"SELECT 'by_region', country, movie_count FROM ({_REGIONS_SQL})")
    return " UNION ALL ".join(parts)


@query("all_rollups", rollups_sql())
def all_rollups(spark, sf_dir):
    return ro.all_rollups(facts_view(spark, sf_dir))


@query("grand_total", f"SELECT sum(movie_count)::BIGINT AS total FROM ({_GENRES_SQL})")
def grand_total(spark, sf_dir):
    return ro.grand_total(all_rollups(spark, sf_dir))


@query("pct_of_total", f"""
    SELECT aggregation_type, dimension, movie_count, round(100.0::DOUBLE * movie_count / total, 2) AS percentage
    FROM ({rollups_sql()}), (SELECT sum(movie_count)::BIGINT AS total FROM ({_GENRES_SQL}))
""")
def pct_of_total(spark, sf_dir):
    rollups = all_rollups(spark, sf_dir)
    total = ro.grand_total(rollups).scalar()
    return rollups.withColumn("percentage", ro.pct_of_total(F.col("movie_count"), total))


@query("attach_total", f"""
    SELECT genre, movie_count, (SELECT count(*) FROM ({FACTS_SQL})) AS total_movies FROM ({_GENRES_SQL})
""")
def attach_total(spark, sf_dir):
    facts = facts_view(spark, sf_dir)
    total = facts.agg(F.count("*")).scalar()
    return ro.exploded_counts(facts, "genres", "genre").withColumn("total_movies", total)


@query("value_shares", """
    SELECT p_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6)::DOUBLE AS share FROM part GROUP BY p_type
""")
def value_shares(spark, sf_dir):
    shares = ro.value_shares(table(spark, sf_dir, "part"), "p_type")
    return shares.withColumn("share", F.round("share", 6))


@query("nulls_last", """
    SELECT original_language, movie_count FROM (SELECT original_language, count(*) AS movie_count
      FROM (""" + FACTS_SQL + """) GROUP BY original_language)
""")
def nulls_last(spark, sf_dir):
    counts = facts_view(spark, sf_dir).groupBy("original_language").agg(F.count("*").alias("movie_count"))
    return counts.orderBy(F.asc_nulls_last("original_language"))


@query("sort_by_code", f"""
    SELECT (CASE WHEN rating_bin IS NULL THEN -1 ELSE CAST(left(rating_bin, 1) AS INTEGER) END)::INTEGER AS code,
      count(*) AS movie_count FROM ({BINNED_SQL}) GROUP BY 1
""")
def sort_by_code(spark, sf_dir):
    facts = facts_view(spark, sf_dir)
    code = F.coalesce(bn.rating_bins().code(F.col("vote_average")), F.lit(-1))
    return facts.groupBy(code.alias("code")).agg(F.count("*").alias("movie_count")).orderBy("code")


@query("sort_date", "SELECT CAST(o_orderdate::DATE AS VARCHAR) AS day, count(*) AS n FROM orders GROUP BY 1")
def sort_date(spark, sf_dir):
    day = F.col("o_orderdate").cast("date").cast("string").alias("day")
    return table(spark, sf_dir, "orders").groupBy(day).agg(F.count("*").alias("n")).orderBy("day")


@query("head", "SELECT * FROM customer ORDER BY c_custkey LIMIT 5")
def head(spark, sf_dir):
    return table(spark, sf_dir, "customer").orderBy("c_custkey").limit(5)


@query("argmin", "SELECT p_type, min(p_retailprice) AS price, arg_min(p_partkey, (p_retailprice, p_partkey)) AS p_partkey FROM part GROUP BY p_type")
def argmin(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_type").agg(
        F.min("p_retailprice").alias("price"),
        F.min_by("p_partkey", F.struct("p_retailprice", "p_partkey")).alias("p_partkey"),
    )


@query("column_max", "SELECT l_returnflag, max(l_extendedprice) AS top FROM lineitem GROUP BY l_returnflag")
def column_max(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.max("l_extendedprice").alias("top"))


@query("union_all", """
    SELECT 'customer' AS side, c_nationkey AS nationkey, c_acctbal AS acctbal FROM customer
    UNION ALL SELECT 'supplier', s_nationkey, s_acctbal FROM supplier
""")
def union_all(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").select(
        F.lit("customer").alias("side"), F.col("c_nationkey").alias("nationkey"), F.col("c_acctbal").alias("acctbal"))
    supplier = table(spark, sf_dir, "supplier").select(
        F.col("s_acctbal").alias("acctbal"), F.lit("supplier").alias("side"), F.col("s_nationkey").alias("nationkey"))
    return customer.unionByName(supplier)


@query("hstack", "SELECT p_partkey, p_type, (p_type = 'ECONOMY')::INTEGER AS is_economy, p_size FROM part")
def hstack(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        "p_partkey", "p_type", (F.col("p_type") == "ECONOMY").cast("int").alias("is_economy"), "p_size"
    )


@query("pivot", """
    PIVOT (SELECT p_brand, p_type, p_partkey FROM part) ON p_type USING count(p_partkey) GROUP BY p_brand
""")
def pivot(spark, sf_dir):
    wide = table(spark, sf_dir, "part").groupBy("p_brand").pivot("p_type")
    return wide.agg(F.count("p_partkey")).na.fill(0)


@query("align_inner", f"""
    SELECT x.id, x.revenue, y.runtime FROM (SELECT id, revenue FROM ({FACTS_SQL}) WHERE revenue IS NOT NULL) x
    JOIN (SELECT id, runtime FROM ({FACTS_SQL}) WHERE runtime IS NOT NULL) y ON x.id = y.id
""")
def align_inner(spark, sf_dir):
    facts = facts_view(spark, sf_dir)
    features = facts.select("id", "revenue").na.drop()
    labels = facts.select("id", "runtime").na.drop()
    return features.join(labels, "id", "inner")
