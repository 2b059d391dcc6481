"""Statistics and model-evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.operators import stats as st
from tabloom.operators.encode import text_columns
from tabloom.operators.sampling import MODULUS, key_hash
from tabloom.plans.registry import hash_sql, query, table

_COLS = [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"), ("c_acctbal", "double"),
         ("c_mktsegment", "string")]


@query("profile", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, '{t}' AS dtype, count({c}) AS non_null, count(*) AS rows FROM customer" for c, t in _COLS))
def profile(spark, sf_dir):
    return st.profile(table(spark, sf_dir, "customer"))


_DAY_SQL = """SELECT o_orderdate, nullif(count(*) FILTER (o_orderstatus = 'F'), 0) AS f,
    nullif(count(*) FILTER (o_orderstatus = 'P'), 0) AS p FROM orders GROUP BY o_orderdate"""


@query("null_total", f"SELECT sum((f IS NULL)::INT + (p IS NULL)::INT)::BIGINT AS nulls FROM ({_DAY_SQL})")
def null_total(spark, sf_dir):
    days = table(spark, sf_dir, "orders").groupBy("o_orderdate").agg(
        F.nullif(F.count_if(F.col("o_orderstatus") == "F"), F.lit(0)).alias("f"),
        F.nullif(F.count_if(F.col("o_orderstatus") == "P"), F.lit(0)).alias("p"),
    )
    return st.null_total(days)


@query("duplicate_total", """
    SELECT (SELECT count(*) FROM lineitem) - count(*) AS duplicates
    FROM (SELECT DISTINCT * FROM lineitem)
""")
def duplicate_total(spark, sf_dir):
    return st.duplicate_total(table(spark, sf_dir, "lineitem"))


@query("nunique", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n FROM part" for c in ("p_name", "p_brand", "p_type")))
def nunique(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return st.nunique(part, text_columns(part))


_STATS = """l_returnflag, count(v) AS n, avg(v) AS mean, var_pop(v) AS var_pop, stddev_pop(v) AS std_pop"""
_STATS_SQL = f"SELECT {_STATS} FROM (SELECT l_returnflag, l_extendedprice / 1000 AS v FROM lineitem) GROUP BY l_returnflag"


def _price_stats(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_extendedprice") / 1000).alias("v"))
    return st.pop_stats(lines, "v", ["l_returnflag"])


def _rounded(df, columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("pop_stats", f"""
    SELECT l_returnflag, n, round(mean, 6) AS mean, round(var_pop, 6) AS var_pop, round(std_pop, 6) AS std_pop
    FROM ({_STATS_SQL})
""")
def pop_stats(spark, sf_dir):
    df = _rounded(_price_stats(spark, sf_dir), ["mean", "var_pop", "std_pop"])
    return df.select("l_returnflag", "n", "mean", "var_pop", "std_pop")


@query("coef_variation", f"SELECT l_returnflag, round(100 * std_pop / mean, 6) AS cv_percent FROM ({_STATS_SQL})")
def coef_variation(spark, sf_dir):
    return _rounded(_price_stats(spark, sf_dir), ["cv_percent"]).select("l_returnflag", "cv_percent")


@query("ci95", f"""
    SELECT l_returnflag, round(mean - 1.96::DOUBLE * std_pop / sqrt(n), 6) AS ci_low,
      round(mean + 1.96::DOUBLE * std_pop / sqrt(n), 6) AS ci_high FROM ({_STATS_SQL})
""")
def ci95(spark, sf_dir):
    return _rounded(_price_stats(spark, sf_dir), ["ci_low", "ci_high"]).select("l_returnflag", "ci_low", "ci_high")


_QUANTITY_EDGES = list(range(0, 61, 10))
_HIST_SQL = """SELECT b::INTEGER AS code, (b * 10)::DOUBLE AS lo, (b * 10 + 10)::DOUBLE AS hi, (b * 10 + 5)::DOUBLE AS center,
    count(l_quantity) AS n FROM range(0, 6) r(b) LEFT JOIN lineitem ON l_quantity >= b * 10
    AND (l_quantity < b * 10 + 10 OR (b = 5 AND l_quantity = 60)) GROUP BY b"""
_CUM_SQL = f"""SELECT *, (sum(n) OVER (ORDER BY lo))::BIGINT AS cum_n, n / sum(n) OVER () AS share,
    sum(n) OVER (ORDER BY lo) / sum(n) OVER () AS cdf FROM ({_HIST_SQL})"""


def quantity_histogram(spark, sf_dir):
    return st.histogram(table(spark, sf_dir, "lineitem").select("l_quantity"), "l_quantity", _QUANTITY_EDGES)


@query("histogram", _HIST_SQL)
def histogram(spark, sf_dir):
    return quantity_histogram(spark, sf_dir)


@query("histogram_k", """
    SELECT code::INTEGER AS code, count(*) AS n FROM (
      SELECT least(floor((o_totalprice - lo) / ((hi - lo) / 8)), 7) AS code
      FROM orders, (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)) GROUP BY code
""")
def histogram_k(spark, sf_dir):
    return st.histogram_k(table(spark, sf_dir, "orders"), "o_totalprice", 8).select("code", "n")


@query("relative_freq", f"SELECT code, round(share, 6) AS share FROM ({_CUM_SQL})")
def relative_freq(spark, sf_dir):
    return _rounded(st.cumulative(quantity_histogram(spark, sf_dir)), ["share"]).select("code", "share")


@query("cum_counts", f"SELECT code, cum_n FROM ({_CUM_SQL})")
def cum_counts(spark, sf_dir):
    return st.cumulative(quantity_histogram(spark, sf_dir)).select("code", "cum_n")


@query("ecdf", f"SELECT 0::DOUBLE AS x, 0::DOUBLE AS cdf UNION ALL SELECT hi, round(cdf, 6) FROM ({_CUM_SQL})")
def ecdf(spark, sf_dir):
    return _rounded(st.ecdf_points(quantity_histogram(spark, sf_dir)), ["cdf"])


@query("value_ecdf", """
    SELECT o_totalprice, n, round(sum(n) OVER (ORDER BY o_totalprice) / sum(n) OVER (), 6) AS cdf
    FROM (SELECT o_totalprice, count(*) AS n FROM orders GROUP BY o_totalprice)
""")
def value_ecdf(spark, sf_dir):
    return _rounded(st.value_ecdf(table(spark, sf_dir, "orders"), "o_totalprice"), ["cdf"])


@query("weighted_mean", f"SELECT round(sum(n * center) / sum(n), 6) AS mean FROM ({_HIST_SQL})")
def weighted_mean(spark, sf_dir):
    return _rounded(st.weighted_mean(quantity_histogram(spark, sf_dir)), ["mean"])


@query("binned_median", f"SELECT arg_min(center, lo) AS median FROM ({_CUM_SQL}) WHERE cdf >= 0.5")
def binned_median(spark, sf_dir):
    return st.binned_median(quantity_histogram(spark, sf_dir))


@query("inverse_cdf_lookup", f"""
    SELECT o_orderkey, (SELECT min(center) FROM ({_CUM_SQL}) c WHERE h.u <= c.cdf) AS draw
    FROM (SELECT o_orderkey, {hash_sql('o_orderkey')} / 4294967296 AS u FROM orders) h
""")
def inverse_cdf_lookup(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    u = key_hash(F.col("o_orderkey")) / MODULUS
    return st.inverse_cdf(orders, u, quantity_histogram(spark, sf_dir))


# Known class and a score that follows from the text length.
_SCORED_SQL = """SELECT l.doc_id, l.quality AS y, d.n_chars / (d.n_chars + 1500.0::DOUBLE) AS score,
    (d.n_chars > 1500)::INTEGER AS pred FROM labels l JOIN documents d ON l.doc_id = d.doc_id"""


def scored(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("int").alias("y"))
    return labels.join(docs, "doc_id").select(
        "doc_id", "y", (F.col("n_chars") / (F.col("n_chars") + 1500.0)).alias("score"),
        (F.col("n_chars") > 1500).cast("int").alias("pred"),
    )


@query("counts_with_pct", f"SELECT pred, count(*) AS \"count\", round(count(*) / sum(count(*)) OVER (), 6) AS pct FROM ({_SCORED_SQL}) GROUP BY pred")
def counts_with_pct(spark, sf_dir):
    return _rounded(st.counts_with_pct(scored(spark, sf_dir), "pred"), ["pct"])


@query("crosstab", """
    SELECT o_orderstatus, count(*) FILTER (o_orderpriority = '1-URGENT') AS "pred_1-URGENT",
      count(*) FILTER (o_orderpriority = '2-HIGH') AS "pred_2-HIGH", count(*) FILTER (o_orderpriority = '3-MEDIUM') AS "pred_3-MEDIUM",
      count(*) FILTER (o_orderpriority = '4-NOT SPECIFIED') AS "pred_4-NOT SPECIFIED", count(*) FILTER (o_orderpriority = '5-LOW') AS "pred_5-LOW"
    FROM orders GROUP BY o_orderstatus UNION ALL SELECT 'X', 0, 0, 0, 0, 0
""")
def crosstab(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority")
    labels = ["F", "O", "P", "X"]
    kinds = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    return st.crosstab(orders, "o_orderstatus", "o_orderpriority", kinds, labels)


@query("confusion", f"""
    SELECT y, count(*) FILTER (pred = 0) AS pred_0, count(*) FILTER (pred = 1) AS pred_1 FROM ({_SCORED_SQL}) GROUP BY y
""")
def confusion(spark, sf_dir):
    return st.crosstab(scored(spark, sf_dir), "y", "pred", [0, 1])


@query("accuracy", f"SELECT round(avg((y = pred)::INT), 6) AS accuracy FROM ({_SCORED_SQL})")
def accuracy(spark, sf_dir):
    return _rounded(st.accuracy(scored(spark, sf_dir), "y", "pred"), ["accuracy"])


@query("classification_report", f"""
    WITH c AS (SELECT k::VARCHAR AS label, count(*) FILTER (y = k AND pred = k) AS tp, count(*) FILTER (y = k) AS support,
        count(*) FILTER (pred = k) AS claimed FROM ({_SCORED_SQL}), (VALUES (0), (1)) v(k) GROUP BY k),
    r AS (SELECT label, tp, support, coalesce(tp / nullif(claimed, 0), 0) AS p, coalesce(tp / nullif(support, 0), 0) AS r FROM c),
    f AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f FROM r)
    SELECT label, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, support FROM f
    UNION ALL SELECT 'accuracy', round(sum(tp) / sum(support), 6), round(sum(tp) / sum(support), 6), round(sum(tp) / sum(support), 6), sum(support)::BIGINT FROM f
    UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6), sum(support)::BIGINT FROM f
    UNION ALL SELECT 'weighted avg', round(sum(p * support) / sum(support), 6), round(sum(r * support) / sum(support), 6),
      round(sum(f * support) / sum(support), 6), sum(support)::BIGINT FROM f
""")
def classification_report(spark, sf_dir):
    report = st.classification_report(scored(spark, sf_dir), "y", "pred")
    return _rounded(report, ["precision", "recall", "f1"])


_ROC_SQL = f"""SELECT score AS threshold, pos, neg, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp,
    sum(pos) OVER () AS p, sum(neg) OVER () AS n
    FROM (SELECT score, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y <> 1) AS neg FROM ({_SCORED_SQL}) GROUP BY score)"""


@query("roc_points", f"""
    SELECT NULL::DOUBLE AS threshold, 0::DOUBLE AS fpr, 0::DOUBLE AS tpr
    UNION ALL SELECT round(threshold, 9), round(fp / n, 6), round(tp / p, 6) FROM ({_ROC_SQL})
""")
def roc_points(spark, sf_dir):
    points = st.roc_points(scored(spark, sf_dir), "y", "score")
    return points.select(F.round("threshold", 9).alias("threshold"), F.round("fpr", 6).alias("fpr"), F.round("tpr", 6).alias("tpr"))


@query("auc", f"SELECT round(sum(neg * (tp - pos / 2)) / (max(p) * max(n)), 6) AS auc FROM ({_ROC_SQL})")
def auc(spark, sf_dir):
    return _rounded(st.auc(scored(spark, sf_dir), "y", "score"), ["auc"])


def _predicted(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_quantity") * 1.5).alias("p"), "l_discount"
    )


@query("rmse", "SELECT count(*) AS n, round(sqrt(avg(pow(l_extendedprice / 1000 - l_quantity * 1.5::DOUBLE, 2))), 6) AS rmse FROM lineitem")
def rmse(spark, sf_dir):
    return _rounded(st.errors(_predicted(spark, sf_dir), "y", "p"), ["rmse"]).select("n", "rmse")


@query("masked_mse", """
    SELECT count(*) AS n, round(avg(pow(l_extendedprice / 1000 - l_quantity * 1.5::DOUBLE, 2)), 5) AS mse FROM lineitem WHERE l_discount > 0
""")
def masked_mse(spark, sf_dir):
    lines = _predicted(spark, sf_dir)
    return _rounded(st.errors(lines, "y", "p", F.col("l_discount") > 0), ["mse"], 5).select("n", "mse")


@query("feasible_argmin", """
    SELECT arg_min(c, (cost, c)) AS best, round(min(cost), 4) AS best_cost FROM (
      SELECT o_custkey AS c, avg(o_totalprice) AS cost, count(*) FILTER (o_totalprice > 450000) AS bad FROM orders GROUP BY 1)
    WHERE bad = 0
""")
def feasible_argmin(spark, sf_dir):
    runs = table(spark, sf_dir, "orders").select(
        "o_custkey", "o_totalprice", (F.col("o_totalprice") > 450000).cast("int").alias("bad")
    )
    return _rounded(st.feasible_argmin(runs, "o_custkey", "o_totalprice", "bad"), ["best_cost"], 4)
