"""Film-like views over ``orders``. The expressions are valid in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.functions import clean as cl
from tabloom.operators.rollup import with_bins
from tabloom.plans.registry import table

AS_OF_YEAR = 2024

# Strings with planted defects, one row per order.
RAW = {
    "row_key": "o_orderkey",
    "id": """CASE WHEN o_orderkey % 101 = 0 THEN 'x'
        WHEN o_orderkey % 103 = 0 THEN concat(CAST(o_orderkey AS STRING), '.5')
        WHEN o_orderkey % 107 = 0 THEN '1e3' WHEN o_orderkey % 109 = 0 THEN 'inf'
        ELSE CAST(o_orderkey AS STRING) END""",
    "title": """CASE WHEN o_orderkey % 37 = 0 THEN '   '
        ELSE concat('  title ', CAST(o_orderkey AS STRING), ' ') END""",
    "original_title": "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE concat('t', CAST(o_custkey AS STRING)) END",
    "original_language": """CASE o_orderkey % 4 WHEN 0 THEN ' EN ' WHEN 1 THEN 'fr'
        WHEN 2 THEN '' ELSE NULL END""",
    "release_date": """CASE WHEN o_orderkey % 41 = 0 THEN 'garbage'
        WHEN o_orderkey % 43 = 0 THEN '1700-01-01'
        ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END""",
    "vote_average": """CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 47 = 0 THEN 'n/a'
        ELSE concat(CAST(o_orderkey * 37 % 1001 // 100 AS STRING), '.',
                    CAST(o_orderkey % 10 AS STRING)) END""",
    "vote_count": "CAST(o_orderkey % 5000 AS STRING)",
    "revenue": """CASE WHEN o_orderkey % 31 = 0 THEN 'abc' WHEN o_orderkey % 29 = 0 THEN '-1'
        ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) *
          CASE o_orderkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 100 WHEN 2 THEN 1000 ELSE 10000 END
          AS STRING) END""",
    "budget": "CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE CAST(o_custkey * 1000 AS STRING) END",
    "runtime": "CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE CAST(o_orderkey % 260 AS STRING) END",
    "adult": """CASE o_orderkey % 5 WHEN 0 THEN 'True' WHEN 1 THEN ' false ' WHEN 2 THEN 'yes'
        WHEN 3 THEN '' ELSE NULL END""",
    "popularity": "CAST(o_custkey % 1000 AS STRING)",
    "genres": """CASE o_orderkey % 6 WHEN 0 THEN 'Drama, Crime' WHEN 1 THEN 'Science Fiction'
        WHEN 2 THEN 'Drama,,TV Movie ' WHEN 3 THEN '' WHEN 4 THEN NULL
        ELSE 'Action,Drama,Action' END""",
    "production_countries": """CASE o_orderkey % 3 WHEN 0 THEN 'France, Japan' WHEN 1 THEN 'Japan'
        ELSE '' END""",
}

# The same films with types, as clean rows.
FACTS = {
    "id": "o_orderkey",
    "title": "concat('title ', CAST(o_orderkey AS STRING))",
    "original_title": "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE concat('t', CAST(o_custkey AS STRING)) END",
    "original_language": "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE lower(o_orderstatus) END",
    "release_date": "CAST(o_orderdate AS DATE)",
    "vote_average": """CASE WHEN o_orderkey % 17 = 0 THEN NULL
        ELSE CAST(o_orderkey * 37 % 1001 AS DOUBLE) / 100 END""",
    "vote_count": "o_orderkey % 5000",
    "revenue": """CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 29 = 0 THEN CAST(-1 AS DOUBLE)
        ELSE CAST(floor(o_totalprice) AS DOUBLE) * CASE o_orderkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 100
        WHEN 2 THEN 1000 ELSE 10000 END END""",
    "budget": "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_custkey * 1000 AS DOUBLE) END",
    "runtime": "CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE CAST(o_orderkey % 260 AS DOUBLE) END",
    "adult": "CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE o_orderkey % 50 = 0 END",
    "popularity": "CAST(o_custkey % 1000 AS DOUBLE)",
    "genres_csv": RAW["genres"],
    "countries_csv": RAW["production_countries"],
}


def _sql(view: dict[str, str]) -> str:
    return "SELECT " + ", ".join(f"{e} AS {n}" for n, e in view.items()) + " FROM orders"


RAW_SQL = _sql(RAW)
_YEARS = """SELECT *, CASE WHEN year(release_date) BETWEEN 1888 AND 2034
    THEN CAST(year(release_date) AS INTEGER) END AS release_year FROM"""
FACTS_SQL = f"""SELECT *, CAST(release_year // 10 * 10 AS INTEGER) AS release_decade
    FROM ({_YEARS} ({_sql(FACTS)}))"""

RATING_CASE = """CASE WHEN vote_average < 0 OR vote_average >= 10.001 THEN NULL
    WHEN vote_average >= 9 THEN '9.00–9.99'
    WHEN vote_average IS NOT NULL THEN concat(floor(vote_average)::INT, '.00–', floor(vote_average)::INT, '.99') END"""
REVENUE_CASE = """CASE WHEN revenue < 0 THEN NULL WHEN revenue < 1e5 THEN '0–99,999'
    WHEN revenue < 1e6 THEN '100,000–999,999' WHEN revenue < 1e7 THEN '1,000,000–9,999,999'
    WHEN revenue < 1e8 THEN '10,000,000–99,999,999' WHEN revenue < 5e8 THEN '100,000,000–499,999,999'
    WHEN revenue < 1e9 THEN '500,000,000–999,999,999' WHEN revenue < 5e9 THEN '1,000,000,000–4,999,999,999'
    WHEN revenue IS NOT NULL THEN '5,000,000,000–∞' END"""
RUNTIME_CASE = """CASE WHEN runtime < 0 THEN NULL WHEN runtime < 80 THEN '0–79' WHEN runtime < 100 THEN '80–99'
    WHEN runtime < 120 THEN '100–119' WHEN runtime < 140 THEN '120–139' WHEN runtime < 160 THEN '140–159'
    WHEN runtime < 200 THEN '160–199' WHEN runtime IS NOT NULL THEN '200–∞' END"""
BINNED_SQL = f"""SELECT *, {RATING_CASE} AS rating_bin, {REVENUE_CASE} AS revenue_bin,
    {RUNTIME_CASE} AS runtime_bin FROM ({FACTS_SQL})"""
GENRE_LIST = "list_filter(list_transform(string_split(coalesce(genres_csv, ''), ','), lambda x: trim(x)), lambda x: x <> '')"
COUNTRY_LIST = "list_filter(list_transform(string_split(coalesce(countries_csv, ''), ','), lambda x: trim(x)), lambda x: x <> '')"


def as_facts(orders: DataFrame) -> DataFrame:
    """Typed film facts from order rows; works on batch and on streaming input."""
    df = orders.selectExpr(*[f"{e} AS {n}" for n, e in FACTS.items()])
    year = cl.release_year(F.col("release_date"), AS_OF_YEAR)
    df = df.withColumns(
        {
            "release_year": year,
            "release_decade": cl.decade(year),
            "genres": cl.split_list(F.col("genres_csv")),
            "production_countries": cl.split_list(F.col("countries_csv")),
        }
    )
    return with_bins(df.drop("genres_csv", "countries_csv"))


def as_raw(orders: DataFrame) -> DataFrame:
    return orders.selectExpr(*[f"{e.replace('//', 'div')} AS {n}" for n, e in RAW.items()])


def facts_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_facts(table(spark, sf_dir, "orders", heavy=True))


def raw_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_raw(table(spark, sf_dir, "orders", heavy=True))
