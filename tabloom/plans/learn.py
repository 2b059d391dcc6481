"""Model queries over orders, line items, documents and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.functions import clean as cl
from tabloom.functions import text as ft
from tabloom.operators import encode as en
from tabloom.operators import learn as ml
from tabloom.operators import network as nw
from tabloom.operators import sampling as sa
from tabloom.operators import stats as st
from tabloom.operators import trees as tr
from tabloom.plans.registry import hash_sql, query, table
from tabloom.plans.text import _STOP_SQL
from tabloom.plans.views import BINNED_SQL, facts_view

_LIMIT = sa.share_limit(0.7)
_HASH = hash_sql("{k}")


def _train(key: str, seed: int = 0):
    return sa.key_hash(F.col(key), seed) < _LIMIT


def _tokens(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", heavy=True).select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("int").alias("quality"))
    return labels.join(docs, "doc_id").select("doc_id", "quality", ft.vector_tokens(F.col("text")).alias("tokens"))


_NB_SQL = f"""
    WITH d AS (SELECT l.doc_id, l.quality AS q, {_HASH.format(k='l.doc_id')} < {_LIMIT} AS is_train, text
        FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
      s AS (SELECT * FROM (SELECT doc_id, q, is_train, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_\\p{{M}}]{{2,}}')) AS word FROM d)
        WHERE word NOT IN ({_STOP_SQL})),
      pr AS (SELECT q, ln(count(*)) AS lp FROM d WHERE is_train GROUP BY q),
      w AS (SELECT word, q, count(*) AS n FROM s WHERE is_train GROUP BY 1, 2),
      v AS (SELECT DISTINCT word FROM w), c AS (SELECT q, sum(n) AS t FROM w GROUP BY q),
      m AS (SELECT v.word, c.q, ln((coalesce(w.n, 0) + 1) / (c.t + (SELECT count(*) FROM v))) AS ll
        FROM v CROSS JOIN c LEFT JOIN w ON w.word = v.word AND w.q = c.q),
      u AS (SELECT s.doc_id, m.q, sum(m.ll) AS ll FROM s JOIN m ON s.word = m.word WHERE NOT s.is_train GROUP BY 1, 2),
      x AS (SELECT d.doc_id, pr.q, pr.lp + coalesce(u.ll, 0) AS score FROM d CROSS JOIN pr
        LEFT JOIN u ON u.doc_id = d.doc_id AND u.q = pr.q WHERE NOT d.is_train)
    SELECT doc_id, arg_max(q, (score, -q))::INTEGER AS predicted FROM x GROUP BY doc_id
"""


def nb_predictions(spark, sf_dir):
    docs = _tokens(spark, sf_dir)
    test = docs.filter(~_train("doc_id")).select("doc_id", "tokens")
    return ml.nb_multinomial(docs.filter(_train("doc_id")), test, "doc_id", "quality", stop=ft.STOP_WORDS)


@query("nb_multinomial", _NB_SQL)
def nb_multinomial(spark, sf_dir):
    return nb_predictions(spark, sf_dir)


@query("nb_multinomial_report", f"""
    WITH p AS (SELECT l.quality::INTEGER AS quality, n.predicted FROM ({_NB_SQL}) n JOIN labels l ON l.doc_id = n.doc_id)
    SELECT quality, count(*) FILTER (predicted = 0) AS pred_0, count(*) FILTER (predicted = 1) AS pred_1 FROM p GROUP BY quality
""")
def nb_multinomial_report(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("int").alias("quality"))
    return st.crosstab(nb_predictions(spark, sf_dir).join(labels, "doc_id"), "quality", "predicted", [0, 1])


_BN_FEATURES = ["c_acctbal", "hh", "low"]


@query("nb_bernoulli", """
    WITH f AS (SELECT c_custkey, c_nationkey AS y, (c_acctbal > 0)::INT AS a, (c_mktsegment = 'HOUSEHOLD')::INT AS b, (c_custkey % 3 > 0)::INT AS c FROM customer),
      m AS (SELECT y, count(*) AS n, (sum(a) + 1) / (count(*) + 2) AS pa, (sum(b) + 1) / (count(*) + 2) AS pb, (sum(c) + 1) / (count(*) + 2) AS pc FROM f GROUP BY y),
      s AS (SELECT f.c_custkey, m.y, ln(m.n / (SELECT count(*) FROM f)) + ln(CASE a WHEN 1 THEN pa ELSE 1 - pa END)
        + ln(CASE b WHEN 1 THEN pb ELSE 1 - pb END) + ln(CASE c WHEN 1 THEN pc ELSE 1 - pc END) AS score FROM f, m)
    SELECT c_custkey, arg_max(y, (round(score, 9), -y)) AS predicted FROM s GROUP BY c_custkey
""")
def nb_bernoulli(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_nationkey", "c_acctbal",
        (F.col("c_mktsegment") == "HOUSEHOLD").cast("int").alias("hh"),
        (F.col("c_custkey") % 3).alias("low"),
    )
    return ml.nb_bernoulli(customer, customer, _BN_FEATURES, "c_nationkey").select("c_custkey", "predicted")


_LR_FEATURES = ["l_quantity", "l_discount"]
_LR_SQL = f"""SELECT l_quantity AS a, l_discount AS b, l_extendedprice AS y, {_HASH.format(k='l_orderkey')} < {_LIMIT} AS is_train FROM lineitem"""
_LR_FIT = f"""
    WITH r AS ({_LR_SQL}), t AS (SELECT * FROM r WHERE is_train),
      c AS (SELECT covar_pop(a, a) AS aa, covar_pop(b, b) AS bb, covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS by_,
        avg(a) AS ma, avg(b) AS mb, avg(y) AS my FROM t),
      k AS (SELECT (ay * bb - by_ * ab) / (aa * bb - ab * ab) AS ka, (by_ * aa - ay * ab) / (aa * bb - ab * ab) AS kb, ma, mb, my FROM c),
      m AS (SELECT my - ka * ma - kb * mb AS k0, ka, kb FROM k)"""


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", *_LR_FEATURES, "l_extendedprice")


@query("linreg", f"""{_LR_FIT}
    SELECT 'intercept' AS term, round(k0, 4) AS value FROM m UNION ALL SELECT 'l_quantity', round(ka, 4) FROM m
    UNION ALL SELECT 'l_discount', round(kb, 4) FROM m
    UNION ALL SELECT 'rmse', round(sqrt(avg(pow(y - k0 - ka * a - kb * b, 2))), 4) FROM r, m WHERE NOT is_train
""")
def linreg(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    model = ml.linreg(lines.filter(_train("l_orderkey")), _LR_FEATURES, "l_extendedprice")
    test = ml.linreg_predict(model, lines.filter(~_train("l_orderkey")), _LR_FEATURES, "l_extendedprice")
    terms = ml.linreg_terms(model, _LR_FEATURES, st.errors(test, "l_extendedprice", "fitted"))
    return terms.withColumn("value", F.round("value", 4))


@query("linreg_residuals", f"""{_LR_FIT}
    SELECT a AS l_quantity, b AS l_discount, round(k0 + ka * a + kb * b, 3) AS fitted, round(k0 + ka * a + kb * b - y, 3) AS residual FROM r, m WHERE is_train
""")
def linreg_residuals(spark, sf_dir):
    train = _lines(spark, sf_dir).filter(_train("l_orderkey"))
    model = ml.linreg(train, _LR_FEATURES, "l_extendedprice")
    fitted = ml.linreg_predict(model, train, _LR_FEATURES, "l_extendedprice")
    return fitted.select(*_LR_FEATURES, F.round("fitted", 3).alias("fitted"), F.round("residual", 3).alias("residual"))


_ORDER_FEATURES = ["month", "weekday", "cust", "day"]


def order_features(spark, sf_dir):
    """Calendar and customer numbers of each order, and whether its price is in the upper half."""
    orders = en.qcut(table(spark, sf_dir, "orders"), "o_totalprice", 2, out="high")
    day = F.col("o_orderdate").cast("date")
    return orders.select(
        "o_orderkey", F.month(day).cast("double").alias("month"), F.dayofweek(day).cast("double").alias("weekday"),
        F.col("o_custkey").cast("double").alias("cust"), cl.date_ordinal(day).cast("double").alias("day"),
        F.col("high").cast("double").alias("high"),
    )


def scored_orders(spark, sf_dir):
    """Test orders with known class, predicted class and probability."""
    rows = en.standardize(order_features(spark, sf_dir), _ORDER_FEATURES, _train("o_orderkey"))
    features = [f"{f}_z" for f in _ORDER_FEATURES]
    model = ml.logreg(rows.filter(_train("o_orderkey")), features, "high")
    return ml.with_probability(model, rows.filter(~_train("o_orderkey")), features, ["o_orderkey", "high"])


@query("logreg")
def logreg(spark, sf_dir):
    return st.counts_with_pct(scored_orders(spark, sf_dir), "predicted")


@query("logreg_rates", f"""
    WITH o AS (SELECT o_orderkey, dayofweek(o_orderdate::DATE) AS weekday, {_HASH.format(k='o_orderkey')} < {_LIMIT} AS is_train,
        (o_totalprice > (SELECT quantile_cont(o_totalprice, 0.5) FROM orders))::INTEGER AS high FROM orders),
      r AS (SELECT weekday, avg(high) AS rate FROM o WHERE is_train GROUP BY weekday)
    SELECT o_orderkey, high, (rate > 0.5)::INTEGER AS predicted, round(rate, 4) AS score FROM o JOIN r USING (weekday) WHERE NOT is_train
""")
def logreg_rates(spark, sf_dir):
    """Without a penalty and with one indicator per weekday, the fitted probabilities are the rates of the weekdays."""
    rows = order_features(spark, sf_dir).select("o_orderkey", F.col("high").cast("int").alias("high"), *[
        (F.col("weekday") == d).cast("double").alias(f"d{d}") for d in range(2, 8)])
    model = ml.logreg(rows.filter(_train("o_orderkey")), [f"d{d}" for d in range(2, 8)], "high", penalty=0.0)
    scored = ml.with_probability(model, rows.filter(~_train("o_orderkey")), [f"d{d}" for d in range(2, 8)], ["o_orderkey", "high"])
    return scored.withColumn("score", F.round("score", 4))


@query("logreg_auc")
def logreg_auc(spark, sf_dir):
    return st.auc(scored_orders(spark, sf_dir), "high", "score")


_STUMP_SQL = f"""
    WITH o AS (SELECT o_orderkey, month(o_orderdate::DATE) AS month, dayofweek(o_orderdate::DATE) + 1 AS weekday,
        (o_totalprice > (SELECT quantile_cont(o_totalprice, 0.5) FROM orders))::INTEGER AS high,
        {_HASH.format(k='o_orderkey')} < {_LIMIT} AS is_train FROM orders),
      c AS (SELECT f, v, sum(high) AS p, count(*) AS n FROM (
          SELECT 'month' AS f, month AS v, high FROM o WHERE is_train UNION ALL SELECT 'weekday', weekday, high FROM o WHERE is_train) GROUP BY f, v),
      s AS (SELECT f, v, sum(p) OVER w AS lp, sum(n) OVER w AS ln, sum(p) OVER (PARTITION BY f) AS tp, sum(n) OVER (PARTITION BY f) AS tn
        FROM c WINDOW w AS (PARTITION BY f ORDER BY v)),
      g AS (SELECT *, tp - lp AS rp, tn - ln AS rn FROM s WHERE ln < tn),
      b AS (SELECT * FROM g ORDER BY lp * (ln - lp) / ln + rp * (rn - rp) / rn LIMIT 1)
    SELECT o_orderkey, high, CASE WHEN CASE b.f WHEN 'month' THEN month ELSE weekday END <= b.v
        THEN (2 * lp > ln)::INTEGER ELSE (2 * rp > rn)::INTEGER END AS predicted
    FROM o, b WHERE NOT is_train
"""


@query("dtree", _STUMP_SQL)
def dtree(spark, sf_dir):
    """One split of month or weekday, where SQL can find the best one too."""
    rows = ml.assemble(order_features(spark, sf_dir), ["month", "weekday"])
    model = ml.dtree("high", maxDepth=1).fit(rows.filter(_train("o_orderkey")))
    test = model.transform(rows.filter(~_train("o_orderkey")))
    return test.select("o_orderkey", F.col("high").cast("int").alias("high"), F.col("prediction").cast("int").alias("predicted"))


@query("dtree_deep")
def dtree_deep(spark, sf_dir):
    rows = ml.assemble(order_features(spark, sf_dir), _ORDER_FEATURES)
    model = ml.dtree("high", maxDepth=5).fit(rows.filter(_train("o_orderkey")))
    test = model.transform(rows.filter(~_train("o_orderkey"))).select("high", "prediction")
    return st.classification_report(test, "high", "prediction")


# The axes of the two grids, numbers of folds and splits, and their seeds.
_SEARCH = tr.settings(["gini", "entropy"], [5, 10, 20, 25, 30], [2, 10, 20], [1, 5, 10], [2, 5, 10, 20])
_WIDE = tr.settings(["gini", "entropy"], [4, 5, 6, 10, 15, 20], [2, 10, 20, 30], [1, 5, 10], [2, 5, 10, 20])
_FOLDS, _WIDE_FOLDS, _SPLITS, _FOLD_SEED = 10, 5, 10, 1


def _searched(spark, sf_dir, grid, folds, features=_ORDER_FEATURES):
    """The training rows, their bins, the score of each setting over folds of them, and the best setting."""
    rows = order_features(spark, sf_dir).filter(_train("o_orderkey"))
    binned = tr.bins(rows, features)
    fold = sa.fold_of(F.col("o_orderkey"), folds, _FOLD_SEED)
    scores, best = tr.grid_search(rows, features, "high", grid, fold, folds, binned=binned)
    return rows, binned, scores, best


@query("grid_search")
def grid_search(spark, sf_dir):
    """All 360 settings over 10 folds."""
    rows, _, scores, _ = _searched(spark, sf_dir, _SEARCH, _FOLDS)
    return tr.scores_table(rows, _SEARCH, scores)


@query("grid_search_wide")
def grid_search_wide(spark, sf_dir):
    """All 576 settings of the second grid over 5 folds."""
    rows, _, scores, _ = _searched(spark, sf_dir, _WIDE, _WIDE_FOLDS)
    return tr.scores_table(rows, _WIDE, scores)


def best_tree_scores(spark, sf_dir):
    """Test orders with their class and the score of the best setting's tree, fitted on all training rows."""
    rows, binned, _, best = _searched(spark, sf_dir, _WIDE, _WIDE_FOLDS)
    tree = tr.fit(rows, _ORDER_FEATURES, "high", best, binned)
    test = order_features(spark, sf_dir).filter(~_train("o_orderkey"))
    return test.select("o_orderkey", "high", tree.predicted().alias("predicted"), tree.score(1.0).alias("score"))


@query("grid_best_roc")
def grid_best_roc(spark, sf_dir):
    return st.roc_points(best_tree_scores(spark, sf_dir), "high", "score")


@query("grid_best_auc")
def grid_best_auc(spark, sf_dir):
    return st.auc(best_tree_scores(spark, sf_dir), "high", "score")


@query("grid_shuffle")
def grid_shuffle(spark, sf_dir):
    """All 576 settings of the second grid over 10 random splits of the training rows."""
    rows = order_features(spark, sf_dir).filter(_train("o_orderkey"))
    splits = tr.mask(sa.split_flags("o_orderkey", splits=_SPLITS))
    scores, _ = tr.grid_search(rows, _ORDER_FEATURES, "high", _WIDE, splits, _SPLITS, masks=True)
    return tr.scores_table(rows, _WIDE, scores)


_STUMPS = tr.settings(["gini", "entropy"], [1], [2], [1], [2])
_ENTROPY = "coalesce({p} * ln({p} / nullif({n}, 0)), 0)"
_STUMP_GRID_SQL = f"""
    WITH o AS (SELECT month(o_orderdate::DATE) AS month, dayofweek(o_orderdate::DATE) + 1 AS weekday,
        (o_totalprice > (SELECT quantile_cont(o_totalprice, 0.5) FROM orders))::INTEGER AS high,
        {hash_sql("o_orderkey", _FOLD_SEED)} * {_WIDE_FOLDS} // 4294967296 AS fold
        FROM orders WHERE {_HASH.format(k='o_orderkey')} < {_LIMIT}),
      c AS (SELECT k, f, v, sum(high) AS p, count(*) AS n FROM (
          SELECT fold, 'month' AS f, month AS v, high FROM o UNION ALL SELECT fold, 'weekday', weekday, high FROM o),
          range({_WIDE_FOLDS}) r(k) WHERE fold <> k GROUP BY ALL),
      s AS (SELECT k, f, v, sum(p) OVER w AS lp, sum(n) OVER w AS ln, sum(p) OVER (PARTITION BY k, f) AS tp, sum(n) OVER (PARTITION BY k, f) AS tn
        FROM c WINDOW w AS (PARTITION BY k, f ORDER BY v)),
      g AS (SELECT *, tp - lp AS rp, tn - ln AS rn FROM s WHERE ln < tn),
      i AS (SELECT *, 'gini' AS criterion, lp * (ln - lp) / ln + rp * (rn - rp) / rn AS impurity FROM g
        UNION ALL SELECT *, 'entropy', -({' + '.join(
            _ENTROPY.format(p=p, n=n) for p, n in [("lp", "ln"), ("(ln - lp)", "ln"), ("rp", "rn"), ("(rn - rp)", "rn")])}) FROM g),
      b AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY k, criterion ORDER BY round(impurity, 9), f, v) = 1),
      a AS (SELECT criterion, k, avg((high = CASE WHEN CASE f WHEN 'month' THEN month ELSE weekday END <= v
          THEN (2 * lp > ln)::INTEGER ELSE (2 * rp > rn)::INTEGER END)::INTEGER) AS score FROM o JOIN b ON fold = k GROUP BY ALL),
      t AS (SELECT criterion, round(avg(score), 9) AS score FROM a GROUP BY criterion)
    SELECT 'criterion=' || criterion || ', max_depth=1, min_split=2, min_leaf=1, max_leaves=2' AS params, score,
      row_number() OVER (ORDER BY score DESC, criterion DESC) = 1 AS is_best FROM t
"""


@query("grid_stump", _STUMP_GRID_SQL)
def grid_stump(spark, sf_dir):
    """Trees of one split, which SQL can find too."""
    rows, _, scores, _ = _searched(spark, sf_dir, _STUMPS, _WIDE_FOLDS, ["month", "weekday"])
    return tr.scores_table(rows, _STUMPS, [round(s, 9) for s in scores])


@query("mlp")
def mlp(spark, sf_dir):
    """All components of the vectors, standardised on the training rows; vectors of mixed length are an error."""
    embeddings = table(spark, sf_dir, "embeddings")
    width, shortest = embeddings.agg(F.max(F.size("embedding")), F.min(F.size("embedding"))).first()
    if width != shortest:
        raise ValueError("embeddings differ in length")
    vectors = embeddings.select(
        "vec_id", (F.col("label") >= 5).cast("double").alias("y"), *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(width)]
    )
    features = [f"e{i}" for i in range(width)]
    model = ml.mlp("y", width, maxIter=40, seed=42)
    fitted = ml.scaled_pipeline(features, model).fit(vectors.filter(_train("vec_id")))
    test = fitted.transform(vectors.filter(~_train("vec_id")))
    from pyspark.ml.functions import vector_to_array

    scored = test.select("vec_id", "y", vector_to_array("probability")[1].alias("score"))
    return st.auc(scored, "y", "score")


@query("mlp_steps")
def mlp_steps(spark, sf_dir):
    """The relu network by mini-batch steps on the vectors' first 18 components; area under the curve of the test rows."""
    embeddings = table(spark, sf_dir, "embeddings")
    vectors = embeddings.select("vec_id", (F.col("label") >= 5).cast("double").alias("y"), *[
        F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(18)])
    rows = en.standardize(vectors, [f"e{i}" for i in range(18)], _train("vec_id"))
    features = [f"e{i}_z" for i in range(18)]
    network = nw.fit(rows.filter(_train("vec_id")), "vec_id", features, "y", epochs=18, batches=4, rate=0.01)
    scored = rows.filter(~_train("vec_id")).select("vec_id", "y", F.round(network.probability(features), 12).alias("score"))
    return st.auc(scored, "y", "score")


@query("feature_frame", f"""
    SELECT id, revenue, runtime, CAST(date_diff('day', DATE '0001-01-01', release_date) + 1 AS INTEGER) AS day,
      CASE WHEN original_language IS NULL THEN 0 WHEN original_language = 'f' THEN 1 WHEN original_language = 'o' THEN 2 ELSE 3 END AS label
    FROM ({BINNED_SQL}) WHERE revenue IS NOT NULL AND runtime IS NOT NULL
""")
def feature_frame(spark, sf_dir):
    facts = facts_view(spark, sf_dir)
    label = cl.map_values(F.col("original_language"), {"f": 1, "o": 2, "p": 3}, null_value=0)
    return facts.select(
        "id", "revenue", "runtime", cl.date_ordinal(F.col("release_date")).alias("day"), label.alias("label")
    ).na.drop(subset=["revenue", "runtime", "day", "label"])
