"""Series, sampling and matrix queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.operators import matrix as mx
from tabloom.operators import sampling as sa
from tabloom.operators import series as se
from tabloom.operators import stats as st
from tabloom.plans.registry import hash_sql, query, table
from tabloom.plans.stats import _CUM_SQL, quantity_histogram

_H = hash_sql("o_orderkey", "{s}")
_HOURS_SQL = "(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 3.6e9"
_SERIES_SQL = f"SELECT user_id, event_type, event_id, {_HOURS_SQL} AS x, value AS y FROM events"
_DAILY_SQL = "SELECT user_id, (ts::DATE - DATE '2024-01-01')::INTEGER AS x, sum(value) AS y FROM events GROUP BY 1, 2"
_YEARLY_SQL = """SELECT c_nationkey AS k, year(o_orderdate)::INTEGER AS x, sum(o_totalprice) / 1e6 AS y
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2"""


def user_series(spark, sf_dir):
    """(user_id, event_type, event_id, x in hours, y) for every event."""
    micros = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit("2024-01-01").cast("timestamp"))
    return table(spark, sf_dir, "events").select(
        "user_id", "event_type", "event_id", (micros / 3.6e9).alias("x"), F.col("value").alias("y")
    )


def daily_series(spark, sf_dir):
    day = F.date_diff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    return table(spark, sf_dir, "events").groupBy("user_id", day.alias("x")).agg(F.sum("value").alias("y"))


def yearly_series(spark, sf_dir):
    """Seven yearly points for each nation."""
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("k"))
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.year("o_orderdate").alias("x"), "o_totalprice")
    return orders.join(customer, "o_custkey").groupBy("k", "x").agg((F.sum("o_totalprice") / 1e6).alias("y"))


def _round(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("reset_index", "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS idx FROM events")
def reset_index(spark, sf_dir):
    return se.reset_index(user_series(spark, sf_dir).select("event_id", "user_id", "x"), ["user_id"], "x").drop("x")


@query("grid", f"""
    SELECT user_id, i::INTEGER AS i, round(CASE i WHEN 4 THEN b ELSE a + (b - a) / 4 * i END, 6) AS x
    FROM (SELECT user_id, min(x) AS a, max(x) AS b FROM ({_SERIES_SQL}) GROUP BY 1), range(0, 5) r(i)
""")
def grid(spark, sf_dir):
    return _round(se.grid(user_series(spark, sf_dir), ["user_id"], "x", 5), "x")


_BLEND = """CASE WHEN b.x IS NULL THEN {lo} WHEN a.x IS NULL THEN {hi} WHEN a.x = b.x THEN b.y
    ELSE b.y + (a.y - b.y) * (q.x - b.x) / (a.x - b.x) END"""


@query("interp_join", f"""
    WITH s AS ({_SERIES_SQL}), k AS (SELECT user_id, x, y FROM s WHERE event_type = 'view'),
      q AS (SELECT user_id, event_id, x FROM s WHERE event_type <> 'view')
    SELECT q.event_id, round({_BLEND.format(lo='a.y', hi='b.y')}, 6) AS y FROM q
      ASOF LEFT JOIN k b ON q.user_id = b.user_id AND q.x >= b.x
      ASOF LEFT JOIN k a ON q.user_id = a.user_id AND q.x <= a.x
""")
def interp_join(spark, sf_dir):
    series = user_series(spark, sf_dir)
    knots = series.filter(F.col("event_type") == "view").select("user_id", "x", "y")
    probes = series.filter(F.col("event_type") != "view").select("user_id", "event_id", "x")
    return _round(se.interp_join(knots, probes, ["user_id"]), "y").select("event_id", "y")


@query("interp_join_strict", f"""
    WITH s AS ({_SERIES_SQL}), k AS (SELECT user_id, x, y FROM s WHERE event_type = 'view'),
      q AS (SELECT user_id, event_id, x FROM s WHERE event_type <> 'view')
    SELECT q.event_id, round({_BLEND.format(lo='NULL', hi='NULL')}, 6) AS y FROM q
      ASOF LEFT JOIN k b ON q.user_id = b.user_id AND q.x >= b.x
      ASOF LEFT JOIN k a ON q.user_id = a.user_id AND q.x <= a.x
""")
def interp_join_strict(spark, sf_dir):
    series = user_series(spark, sf_dir)
    knots = series.filter(F.col("event_type") == "view").select("user_id", "x", "y")
    probes = series.filter(F.col("event_type") != "view").select("user_id", "event_id", "x")
    return _round(se.interp_join(knots, probes, ["user_id"], clamp=False), "y").select("event_id", "y")


@query("spline_interp_strict", f"""
    WITH k AS (SELECT 0::DOUBLE AS x, 0::DOUBLE AS cdf UNION ALL SELECT hi, cdf FROM ({_CUM_SQL})),
      q AS (SELECT DISTINCT l_quantity + l_discount * 10 AS x FROM lineitem)
    SELECT q.x, round(CASE WHEN a.x = b.x THEN b.cdf ELSE b.cdf + (a.cdf - b.cdf) * (q.x - b.x) / (a.x - b.x) END, 6) AS cdf FROM q
      ASOF LEFT JOIN k b ON q.x >= b.x ASOF LEFT JOIN k a ON q.x <= a.x
""")
def spline_interp_strict(spark, sf_dir):
    knots = st.ecdf_points(quantity_histogram(spark, sf_dir))
    at = (F.col("l_quantity") + F.col("l_discount") * 10).alias("x")
    probes = table(spark, sf_dir, "lineitem").select(at).distinct()
    return _round(se.interp_join(knots, probes, [], "x", "cdf", clamp=False), "cdf")


@query("divided_diff", f"""
    WITH d0 AS ({_DAILY_SQL}),
    l AS (SELECT user_id, x, y, lead(x, 1) OVER w AS x1, lead(y, 1) OVER w AS y1, lead(x, 2) OVER w AS x2, lead(y, 2) OVER w AS y2
      FROM d0 WINDOW w AS (PARTITION BY user_id ORDER BY x)),
    d AS (SELECT user_id, x::DOUBLE AS x, y AS v0, (y1 - y) / (x1 - x) AS v1, ((y2 - y1) / (x2 - x1) - (y1 - y) / (x1 - x)) / (x2 - x) AS v2 FROM l)
    SELECT user_id, x, ord, round(value, 6) AS value FROM (
      SELECT user_id, x, 0 AS ord, v0 AS value FROM d UNION ALL SELECT user_id, x, 1, v1 FROM d UNION ALL SELECT user_id, x, 2, v2 FROM d)
    WHERE value IS NOT NULL
""")
def divided_diff(spark, sf_dir):
    return _round(se.divided_diff(daily_series(spark, sf_dir), ["user_id"], "x", "y", 2), "value")


@query("degree_by_dd", f"""
    WITH p AS (SELECT k, x, y, row_number() OVER (PARTITION BY k ORDER BY x) AS r, count(*) OVER (PARTITION BY k) AS n FROM ({_YEARLY_SQL})),
    s AS (SELECT k, n, r AS i, j FROM p, range(1, 7) o(j) WHERE r + j <= n),
    t AS (SELECT s.k, s.n, s.i, s.j, a.r, any_value(a.y) / product(a.x - b.x) AS v FROM s
      JOIN p a ON a.k = s.k AND a.r BETWEEN s.i AND s.i + s.j JOIN p b ON b.k = s.k AND b.r BETWEEN s.i AND s.i + s.j AND b.r <> a.r
      GROUP BY s.k, s.n, s.i, s.j, a.r),
    d AS (SELECT k, n, j, i, abs(sum(v)) AS v FROM t GROUP BY k, n, j, i),
    m AS (SELECT k, n, j, max(v) AS m FROM d GROUP BY k, n, j)
    SELECT k, coalesce(min(j) FILTER (m < 2.5) - 1, max(n) - 1)::INTEGER AS degree FROM m GROUP BY k
""")
def degree_by_dd(spark, sf_dir):
    """Seven yearly points have six orders, and all are looked at."""
    dd = se.divided_diff(yearly_series(spark, sf_dir), ["k"], "x", "y", 6)
    return se.degree_by_dd(dd, ["k"], 2.5)


@query("newton_interp", f"""
    WITH s AS ({_YEARLY_SQL}), q AS (SELECT DISTINCT k, 1997.5::DOUBLE AS x FROM s),
      t AS (SELECT q.k, q.x, i.x AS xi, any_value(i.y) * product((q.x - j.x) / (i.x - j.x)) AS v
        FROM q JOIN s i ON i.k = q.k JOIN s j ON j.k = q.k AND j.x <> i.x GROUP BY q.k, q.x, i.x)
    SELECT k, x, round(sum(v), 5) AS y FROM t GROUP BY k, x
""")
def newton_interp(spark, sf_dir):
    series = yearly_series(spark, sf_dir)
    probes = series.select("k").distinct().withColumn("x", F.lit(1997.5))
    return _round(se.newton_interp(series, probes, ["k"], "x", "y"), "y", digits=5)


@query("local_interp", f"""
    WITH s AS ({_DAILY_SQL}), q AS (SELECT user_id, x + 1::DOUBLE / 3 AS x FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY x) - 1 AS idx,
        count(*) OVER (PARTITION BY user_id) AS n FROM s),
      b AS (SELECT q.user_id, q.x, any_value(r.n) AS n, greatest(least(max(r.idx) FILTER (r.x <= q.x) - 1, any_value(r.n) - 4), 0) AS start
        FROM q JOIN r ON r.user_id = q.user_id GROUP BY q.user_id, q.x),
      t AS (SELECT b.user_id, b.x, i.x AS xi, any_value(i.y) * coalesce(product((b.x - j.x) / (i.x - j.x)), 1) AS v FROM b
        JOIN r i ON i.user_id = b.user_id AND i.idx BETWEEN b.start AND b.start + 3
        LEFT JOIN r j ON j.user_id = b.user_id AND j.idx BETWEEN b.start AND b.start + 3 AND j.x <> i.x GROUP BY b.user_id, b.x, i.x)
    SELECT user_id, x, round(sum(v), 6) AS y FROM t GROUP BY user_id, x
""")
def local_interp(spark, sf_dir):
    """Cubics through the four days around a third of each day."""
    series = daily_series(spark, sf_dir)
    probes = series.select("user_id", (F.col("x") + 1 / 3).alias("x"))
    return _round(se.local_interp(series, probes, ["user_id"], "x", "y", 4), "y", digits=6)


@query("trapezoid", f"""
    SELECT user_id, round(coalesce(sum((x1 - x) * (y + y1) / 2), 0), 5) AS area, count(*) AS n FROM (
      SELECT *, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM ({_SERIES_SQL}) WINDOW w AS (PARTITION BY user_id ORDER BY x))
    GROUP BY user_id
""")
def trapezoid(spark, sf_dir):
    rows = user_series(spark, sf_dir).select("user_id", "x", "y")
    return _round(se.trapezoid(rows, ["user_id"], "x", "y"), "area", digits=5)


def _simpson_sql(weights: str, factor: str, period: int) -> str:
    return f"""
    SELECT k, round(CASE WHEN (n - 1) % {period} = 0 AND gap = 1 THEN s * {factor} END, 6) AS area,
      CASE WHEN n - 1 < {period} THEN 'too few samples' WHEN (n - 1) % {period} <> 0 THEN 'interval count is no multiple of {period}'
        WHEN gap <> 1 THEN 'samples are not evenly spaced' END AS problem
    FROM (SELECT k, count(*) AS n, (max(x) - min(x)) / (count(*) - 1) AS gap, sum(w * y) AS s FROM (
      SELECT k, x, y, {weights} AS w FROM (SELECT *, x - min(x) OVER p AS i, max(x) OVER p - min(x) OVER p AS m
        FROM ({_YEARLY_SQL}) WINDOW p AS (PARTITION BY k))) GROUP BY k)"""


@query("simpson13", _simpson_sql("CASE WHEN i = 0 OR i = m THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END", "1.0::DOUBLE / 3", 2))
def simpson13(spark, sf_dir):
    return _round(se.simpson13(yearly_series(spark, sf_dir), ["k"], "x", "y"), "area")


@query("simpson38", _simpson_sql("CASE WHEN i = 0 OR i = m THEN 1 WHEN i % 3 = 0 THEN 2 ELSE 3 END", "3.0::DOUBLE / 8", 3))
def simpson38(spark, sf_dir):
    return _round(se.simpson38(yearly_series(spark, sf_dir), ["k"], "x", "y"), "area")


@query("successive_rel_error", f"""
    SELECT user_id, x, round(CASE WHEN y <> 0 THEN abs((y - lag(y) OVER (PARTITION BY user_id ORDER BY x)) / y) END, 6) AS rel_error
    FROM ({_DAILY_SQL})
""")
def successive_rel_error(spark, sf_dir):
    errors = se.successive_rel_error(daily_series(spark, sf_dir), ["user_id"], "x", "y")
    return _round(errors, "rel_error").drop("y")


@query("stop_step", f"""
    SELECT user_id, min(CASE WHEN e < 0.05 THEN x END) AS stop_step FROM (SELECT user_id, x,
      CASE WHEN y <> 0 THEN abs((y - lag(y) OVER (PARTITION BY user_id ORDER BY x)) / y) END AS e FROM ({_DAILY_SQL})) GROUP BY user_id
""")
def stop_step(spark, sf_dir):
    errors = se.successive_rel_error(daily_series(spark, sf_dir), ["user_id"], "x", "y")
    return se.stop_step(errors, ["user_id"], "x", 0.05)


@query("poly_fit", f"""
    WITH z AS (SELECT user_id, y, (x - (a + b) / 2) / ((b - a) / 2) AS z, (a + b) / 2 AS mid, (b - a) / 2 AS half
        FROM (SELECT *, min(x) OVER p AS a, max(x) OVER p AS b FROM ({_SERIES_SQL}) WINDOW p AS (PARTITION BY user_id))),
      s AS (SELECT user_id, mid, half, count(*) AS n, sum(z) AS s1, sum(z*z) AS s2, sum(z*z*z) AS s3, sum(z*z*z*z) AS s4,
        sum(y) AS t0, sum(y*z) AS t1, sum(y*z*z) AS t2 FROM z GROUP BY 1, 2, 3),
      d AS (SELECT *, n*(s2*s4 - s3*s3) - s1*(s1*s4 - s3*s2) + s2*(s1*s3 - s2*s2) AS det FROM s),
      c AS (SELECT *, (t0*(s2*s4 - s3*s3) - s1*(t1*s4 - s3*t2) + s2*(t1*s3 - s2*t2)) / det AS c0,
        (n*(t1*s4 - s3*t2) - t0*(s1*s4 - s3*s2) + s2*(s1*t2 - t1*s2)) / det AS c1,
        (n*(s2*t2 - t1*s3) - s1*(s1*t2 - t1*s2) + t0*(s1*s3 - s2*s2)) / det AS c2, (360 - mid) / half AS w FROM d)
    SELECT user_id, n, round(c0 + c1 * w + c2 * w * w, 5) AS y_360 FROM c
""")
def poly_fit(spark, sf_dir):
    fitted = se.poly_fit(user_series(spark, sf_dir), ["user_id"], "x", "y", 2)
    value = se.poly_value(F.col("coefs"), F.col("mid"), F.col("half"), F.lit(360.0))
    return fitted.select("user_id", "n", F.round(value, 5).alias("y_360"))


@query("poly_fit_high")
def poly_fit_high(spark, sf_dir):
    """Degree 12, where sums of powers would lose the digits."""
    fitted = se.poly_fit(user_series(spark, sf_dir), ["user_id"], "x", "y", 12)
    value = se.poly_value(F.col("coefs"), F.col("mid"), F.col("half"), F.lit(360.0))
    return fitted.select("user_id", "n", F.round(value, 5).alias("y_360"))


@query("model_vs_actual", f"""
    SELECT a.user_id, a.x, round(a.y, 6) AS observed, round(m.y, 6) AS modelled FROM ({_DAILY_SQL}) a
    JOIN (SELECT user_id, x, count(*) * 50.0::DOUBLE AS y FROM (SELECT user_id, (ts::DATE - DATE '2024-01-01')::INTEGER AS x FROM events) GROUP BY 1, 2) m
      ON a.user_id = m.user_id AND a.x = m.x
""")
def model_vs_actual(spark, sf_dir):
    actual = daily_series(spark, sf_dir).withColumnRenamed("y", "observed")
    day = F.date_diff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    model = table(spark, sf_dir, "events").groupBy("user_id", day.alias("x")).agg((F.count("*") * 50.0).alias("modelled"))
    return _round(se.model_vs_actual(model, actual, ["user_id", "x"]), "observed", "modelled")


@query("positive_mask", "SELECT event_id, value FROM events WHERE value > 0")
def positive_mask(spark, sf_dir):
    return se.positive_mask(table(spark, sf_dir, "events"), "value").select("event_id", "value")


@query("matmul_coo", """
    SELECT l_suppkey AS i, p_size::BIGINT AS j, sum(q) AS v FROM (
      SELECT l_suppkey, l_partkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2) JOIN part ON l_partkey = p_partkey GROUP BY 1, 2
""")
def matmul_coo(spark, sf_dir):
    ordered = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("v"))
    left = ordered.select(F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("j"), "v")
    right = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("i"), F.col("p_size").cast("bigint").alias("j"), F.lit(1.0).alias("v")
    )
    return mx.matmul_coo(left, right)


@query("sample_fraction", f"SELECT o_orderkey FROM orders WHERE {_H.format(s=0)} < 858993459")
def sample_fraction(spark, sf_dir):
    return sa.sample_fraction(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 0.2)


_RANKED_SQL = "SELECT o_orderkey, row_number() OVER (ORDER BY {h}, o_orderkey) AS r, count(*) OVER () AS n FROM orders"


@query("sample_exact", f"SELECT o_orderkey FROM ({_RANKED_SQL.format(h=_H.format(s=42))}) WHERE r <= round(n * 0.2)")
def sample_exact(spark, sf_dir):
    return sa.sample_exact(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", share=0.2, seed=42)


@query("sample_n", f"SELECT o_orderkey FROM ({_RANKED_SQL.format(h=_H.format(s=66))}) WHERE r <= floor(n * 0.1)")
def sample_n(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    return sa.sample_exact(orders, "o_orderkey", n=int(orders.count() * 0.1), seed=66)


@query("train_test_split", f"SELECT o_orderkey, {_H.format(s=1)} < 3006477107 AS is_train FROM orders")
def train_test_split(spark, sf_dir):
    return sa.train_test_split(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 0.3, seed=1)


@query("kfold", f"SELECT o_orderkey, floor(({_H.format(s=0)}) * 10 / 4294967296)::INTEGER AS fold FROM orders")
def kfold(spark, sf_dir):
    return sa.kfold(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 10)


@query("shuffle_splits", " UNION ALL ".join(
    f"SELECT o_orderkey, {i} AS split, {_H.format(s=7919 * (i + 1))} < 3006477107 AS is_train FROM orders" for i in range(10)))
def shuffle_splits(spark, sf_dir):
    return sa.shuffle_splits(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")
