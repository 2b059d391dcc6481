"""Published and hand-made values for single operators."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.functions import binning as bn
from tabloom.functions import clean as cl
from tabloom.operators import encode as en
from tabloom.operators import learn as ml
from tabloom.operators import matrix as mx
from tabloom.operators import sampling as sa
from tabloom.operators import series as se
from tabloom.operators import stats as st
from tabloom.operators import text as ot
from tabloom.functions import text as ft
from tabloom.sources.inline import inline_table

# Sample tables with known answers.
SAMPLE_25 = [0.9, 1.42, 1.3, 1.55, 1.63, 1.32, 1.35, 1.47, 1.95, 1.66, 1.96, 1.47, 1.92, 1.35, 1.05, 1.85,
             1.74, 1.65, 1.78, 1.71, 2.29, 1.82, 2.06, 2.14, 1.27]
POINTS_7 = [(0.0, 26.0), (1.0, 15.5), (2.5, 5.375), (3.0, 3.5), (4.5, 2.375), (5.0, 3.5), (6.0, 8.0)]
DEMAND = [208, 160, 166, 112, 17, 43, 13, 11]
POPULATION = [3929000, 5308000, 7240000, 9638000, 12866000, 17069000, 23192000, 31443000, 38558000, 50156000,
              62948000, 75995000, 91972000, 105711000, 122755000, 131669000, 150697000, 179323000, 203212000,
              226505000, 248709873, 281416000]


def one(df):
    return df.first()[0]


def value(spark, expr):
    return spark.range(1).select(expr).first()[0]


@pytest.fixture(scope="module")
def demand(spark):
    rows = [(i, 20.0 + 10 * i, 30.0 + 10 * i, 25.0 + 10 * i, n) for i, n in enumerate(DEMAND)]
    return inline_table(spark, rows, "code int, lo double, hi double, center double, n bigint")


@pytest.fixture(scope="module")
def census(spark):
    rows = [("us", 1790.0 + 10 * i, float(p)) for i, p in enumerate(POPULATION)]
    return inline_table(spark, rows, "s string, x double, y double")


def test_statistics(spark):
    df = inline_table(spark, [(v,) for v in SAMPLE_25], "v double")
    r = st.pop_stats(df, "v").first()
    assert r.n == 25 and r["mean"] == pytest.approx(1.6244)
    assert r.var_pop == pytest.approx(0.11057664) and r.std_pop == pytest.approx(0.3325306602)
    assert r.cv_percent == pytest.approx(20.4709837655)
    assert (round(r.ci_low, 8), round(r.ci_high, 8)) == (1.49404798, 1.75475202)
    hist = st.histogram(df, "v", list(np.linspace(0.6, 2.4, 10))).orderBy("code").collect()
    assert [h.n for h in hist] == [0, 1, 1, 5, 4, 6, 5, 2, 1]


def test_weighted_histogram(spark, demand):
    assert one(st.weighted_mean(demand)) == pytest.approx(42.342465753)
    assert one(st.binned_median(demand)) == 35
    cdf = [r.cdf for r in st.cumulative(demand).orderBy("lo").collect()]
    assert cdf == pytest.approx([0.28493151, 0.50410959, 0.73150685, 0.88493151, 0.90821918, 0.96712329, 0.98493151, 1])
    points = sorted((r.x, r.cdf) for r in st.ecdf_points(demand).collect())
    assert points[0] == (20.0, 0.0) and points[-1] == (100.0, 1.0)
    draws = inline_table(spark, [(0.0,), (0.28,), (208 / 730,), (0.2850,), (0.6,), (0.999,), (1.0,)], "u double")
    got = [r.draw for r in st.inverse_cdf(draws, F.col("u"), demand).orderBy("u").collect()]
    assert got == [25, 25, 25, 35, 45, 95, 95]


def test_divided_differences_and_newton(spark):
    df = inline_table(spark, [("p", x, y) for x, y in POINTS_7], "s string, x double, y double")
    dd = se.divided_diff(df, ["s"], "x", "y", 6).filter(F.col("x") == 0).orderBy("ord").collect()
    assert [r.value for r in dd] == pytest.approx([26, -10.5, 1.5, 0, 0, 0, 0], abs=1e-12)
    knots = [x for x, _ in POINTS_7]
    probes = inline_table(spark, [("p", x) for x in [3.5, *knots]], "s string, x double")
    got = {r.x: r.y for r in se.newton_interp(df, probes, ["s"], "x", "y").collect()}
    assert got[3.5] == pytest.approx(2.375)
    assert [got[x] for x in knots] == pytest.approx([y for _, y in POINTS_7])


def test_newton_refuses_long_or_repeated_series(spark):
    long = inline_table(spark, [("p", float(i), 1.0) for i in range(12)], "s string, x double, y double")
    with pytest.raises(Exception, match="too many points"):
        se.newton_coefficients(long, ["s"], "x", "y", 9).collect()
    twice = inline_table(spark, [("p", 1.0, 1.0), ("p", 1.0, 2.0), ("p", 2.0, 2.0)], "s string, x double, y double")
    with pytest.raises(Exception, match="unique"):
        se.divided_diff(twice, ["s"], "x", "y", 1).collect()


def test_census_degree_and_fit(spark, census):
    dd = se.divided_diff(census, ["s"], "x", "y", 8)
    top = {r.ord: r.m for r in dd.groupBy("ord").agg(F.max(F.abs("value")).alias("m")).collect()}
    assert top[6] == pytest.approx(0.1321, abs=1e-4) and top[7] == pytest.approx(0.003362, abs=1e-6)
    assert one(se.degree_by_dd(dd, ["s"], 0.01).select("degree")) == 6
    fit = se.poly_fit(census, ["s"], "x", "y", 6)
    for year, people in [(1968.0, 195_019_217), (1999.0, 277_464_138), (2020.0, 330_262_280)]:
        at = se.poly_value(F.col("coefs"), F.col("mid"), F.col("half"), F.lit(year))
        assert one(fit.select(at)) == pytest.approx(people, rel=1e-6)


def test_areas(spark):
    exact = 5 / 4 * math.e**6 + 1 / 4
    rows = spark.range(301).select(F.lit("f").alias("s"), (F.col("id") / 100).alias("x"))
    rows = rows.withColumn("y", F.col("x") * F.exp(F.col("x") * 2))
    assert one(se.trapezoid(rows, ["s"], "x", "y").select("area")) == pytest.approx(exact, rel=1e-3)
    assert one(se.simpson13(rows, ["s"], "x", "y").select("area")) == pytest.approx(exact, rel=1e-6)
    assert one(se.simpson38(rows, ["s"], "x", "y").select("area")) == pytest.approx(exact, rel=1e-6)
    cosine = spark.range(7).select(F.lit("f").alias("s"), (F.col("id") * math.pi / 12).alias("x"))
    cosine = cosine.withColumn("y", 6 + 3 * F.cos("x"))
    assert one(se.simpson38(cosine, ["s"], "x", "y").select("area")) == pytest.approx(3 * math.pi + 3, rel=1e-4)


def test_simpson_says_why_not(spark):
    def problem(rule, xs):
        rows = inline_table(spark, [("s", float(x), 1.0) for x in xs], "s string, x double, y double")
        return rule(rows, ["s"], "x", "y").first()

    assert problem(se.simpson13, range(4)).problem == "interval count is no multiple of 2"
    assert problem(se.simpson38, range(5)).problem == "interval count is no multiple of 3"
    assert problem(se.simpson13, [0, 1, 5]).problem == "samples are not evenly spaced"
    assert problem(se.simpson13, [0, 1, 1, 3, 4]).problem == "samples are not evenly spaced"
    assert problem(se.simpson13, [2]).problem == "too few samples"
    assert problem(se.simpson13, range(5)).area == pytest.approx(4.0)


def test_matrix_product(spark):
    def coo(rows):
        return inline_table(spark, [(i, j, float(v)) for i, r in enumerate(rows) for j, v in enumerate(r)], "i bigint, j bigint, v double")

    a, b = coo([[1, 5], [3, 10], [-4, 3]]), coo([[4, 3], [0.5, 2]])
    want = {(0, 0): 6.5, (0, 1): 13.0, (1, 0): 17.0, (1, 1): 29.0, (2, 0): -14.5, (2, 1): -6.0}
    for tile in (1, 2, 100):
        assert {(r.i, r.j): r.v for r in mx.matmul_coo(a, b, tile).collect()} == want
    mx.check_sizes(a, b, 2)
    with pytest.raises(ValueError, match="does not fit"):
        mx.check_sizes(a, b, 1)


def test_dates_and_numbers(spark):
    assert value(spark, cl.date_ordinal(F.lit("2020-01-22").cast("date"))) == 737446
    for text, number in [("1d", None), ("1f", None), (" 7 ", 7.0), ("\t1e3\n", 1000.0), ("abc", None), ("", None), (None, None), ("-.5", -0.5)]:
        assert value(spark, cl.safe_double(F.lit(text).cast("string"))) == number
    assert math.isinf(value(spark, cl.safe_double(F.lit("inf"))))
    assert value(spark, cl.safe_double(F.lit("inf"), only_finite=True)) is None
    assert [value(spark, cl.safe_int(F.lit(t))) for t in ("-4.9", "4.9", "nan", "1e30")] == [-4, 4, None, None]
    assert [value(spark, cl.strict_int64(F.lit(t))) for t in ("4.5", "1e3", "x")] == [None, 1000, None]
    assert value(spark, cl.safe_string(F.lit(" \t "))) is None
    assert value(spark, cl.split_list(F.lit("A,,B "))) == ["A", "B"]
    assert value(spark, cl.split_list(F.lit(None).cast("string"))) == []
    assert value(spark, cl.percent_error(F.lit(0.0), F.lit(1.0))) is None


@pytest.mark.parametrize("rating, label", [(7.0, "7.00–7.99"), (10.0, "9.00–9.99"), (10.5, None), (-1.0, None), (0.0, "0.00–0.99"), (None, None), (math.nan, None)])
def test_rating_bin(spark, rating, label):
    assert value(spark, bn.rating_bins().label(F.lit(rating).cast("double"))) == label


def test_bins_and_tiers(spark):
    assert value(spark, bn.revenue_bins().label(F.lit(825532764.0))) == "500,000,000–999,999,999"
    assert value(spark, bn.runtime_bins().label(F.lit(148.0))) == "140–159"
    assert value(spark, bn.runtime_bins().label(F.lit(math.inf))) == "200–∞"
    assert [value(spark, bn.rating_tier(F.lit(v).cast("double"))) for v in (8.364, 10.1, -1, None)] == ["high", "unknown", "unknown", "unknown"]
    assert [value(spark, bn.revenue_tier(F.lit(float(v)))) for v in (825532764, 0, 1e6, -5)] == ["blockbuster", "indie", "mid", "unknown"]
    assert [value(spark, bn.normalize_genre(F.lit(g))) for g in ("Science Fiction", "TV Movie", "Film Noir")] == ["sci-fi", "tv-movie", "film-noir"]
    half = bn.rating_bins(0.5, 0, 10)
    assert len(half.labels) == 20 and half.labels[0] == "0.00–0.49" and half.labels[-1] == "9.50–9.99"


def test_equal_width_and_quantile_bins(spark):
    df = inline_table(spark, [(float(v),) for v in range(10)], "v double")
    cut = en.cut_equal_width(df, "v", 3).orderBy("v").collect()
    assert [r.bin for r in cut] == [0, 0, 0, 0, 1, 1, 1, 2, 2, 2]
    assert cut[0].lo == pytest.approx(-0.009) and cut[-1].hi == 9
    assert [r.q for r in en.qcut(df, "v", 2, out="q").orderBy("v").collect()] == [0] * 5 + [1] * 5
    flat = en.cut_equal_width(inline_table(spark, [(5.0,), (5.0,), (None,)], "v double"), "v", 2).collect()
    assert sorted((r.bin is None, r.bin) for r in flat) == [(False, 0), (False, 0), (True, None)]
    hot = en.one_hot(inline_table(spark, [("b",), ("a",), (None,)], "c string"), "c")
    assert hot.columns == ["c", "c_a", "c_b"] and sorted(map(tuple, hot.collect()), key=str) == sorted([("b", 0, 1), ("a", 1, 0), (None, 0, 0)], key=str)
    with pytest.raises(ValueError, match="more than 1 values"):
        en.one_hot(inline_table(spark, [("b",), ("a",)], "c string"), "c", max_values=1)


def test_words(spark):
    df = inline_table(spark, [("Don't stop, DON'T! x2",), (None,), ("",)], "line string")
    m = ot.word_metrics(df, ft.word_tokens(F.col("line"))).first()
    assert tuple(m) == (3, 4, 3)
    assert [tuple(r) for r in ot.top_words(ot.word_freq(df, ft.word_tokens(F.col("line"))), 2).collect()] == [("don't", 2), ("stop", 1)]
    assert value(spark, ft.whitespace_tokens(F.lit(" a\tB\f c\n"))) == ["a", "B", " c"]
    assert value(spark, ft.vector_tokens(F.lit("A été I42 x"))) == ["été", "i42"]
    assert value(spark, ft.hyphen_tokens(F.lit("Well-known, Éa!"))) == ["well-known", "a"]


def test_report_with_empty_classes(spark):
    df = inline_table(spark, [(1, 1), (1, 2), (2, 2), (3, 2)], "y int, p int")
    rows = {r.label: r for r in st.classification_report(df, "y", "p").collect()}
    assert (rows["3"].precision, rows["3"].recall, rows["3"].f1, rows["3"].support) == (0, 0, 0, 1)
    assert rows["2"].precision == pytest.approx(1 / 3) and rows["accuracy"].f1 == 0.5
    wide = st.crosstab(df, "y", "p", [1, 2, 3, 4]).collect()
    assert [tuple(r) for r in wide] == [(1, 1, 1, 0, 0), (2, 0, 1, 0, 0), (3, 0, 1, 0, 0), (4, 0, 0, 0, 0)]


def test_feasible_argmin(spark):
    runs = inline_table(spark, [(1, 1.0, 0), (1, 3.0, 0), (2, 1.0, 1), (3, 2.5, 0)], "T int, cost double, empty int")
    assert tuple(st.feasible_argmin(runs, "T", "cost", "empty").first()) == (1, 2.0)
    none = st.feasible_argmin(runs.withColumn("empty", F.lit(1)), "T", "cost", "empty").first()
    assert tuple(none) == (None, None)


@pytest.mark.parametrize("n", [0, 1, 137, 4999, 5000, 9000])
def test_exact_sample(spark, n):
    rows = spark.range(5000)
    got = {r.id for r in sa.sample_exact(rows, "id", n=n, seed=3).collect()}
    want = sorted(range(5000), key=lambda i: (int(hashlib.md5(f"3:{i}".encode()).hexdigest()[:8], 16), i))[:n]
    assert got == set(want)


def test_seeds_are_independent(spark):
    rows = spark.range(100_000)
    for seed in (0, 1, 16, 42):
        split = sa.train_test_split(sa.sample_fraction(rows, "id", 0.1, seed=66), "id", 0.3, seed=seed)
        assert 0.65 < split.agg(F.avg(F.col("is_train").cast("int"))).first()[0] < 0.75
    wide = sa.shuffle_splits(rows, "id", splits=4).groupBy("id").pivot("split", [0, 1, 2, 3]).agg(F.first(F.col("is_train").cast("int")))
    pairs = [F.corr(str(i), str(j)) for i in range(4) for j in range(i)]
    assert all(abs(c) < 0.02 for c in wide.agg(*pairs).first())
    folds = sa.kfold(rows, "id", 10).groupBy("fold").count().collect()
    assert all(abs(r["count"] - 10_000) < 400 for r in folds)


def test_words_of_rows(spark):
    from tabloom.operators import text as ot

    df = inline_table(spark, [(1, ["b", "a", "b"]), (2, []), (3, None), (4, ["z"])], "d int, t array<string>")
    assert sorted(map(tuple, ot.words_of_rows(df, F.col("t"), ["d"]).collect())) == [(1, "a", 1), (1, "b", 2), (4, "z", 1)]


def test_crosstab_refuses_unlisted_classes(spark):
    df = inline_table(spark, [(1, 1), (1, 5)], "y int, p int")
    with pytest.raises(Exception, match="not listed"):
        st.crosstab(df, "y", "p", [1]).collect()


def test_degree_needs_all_orders(spark):
    rows = inline_table(spark, [("s", float(i), float(2**i)) for i in range(6)], "s string, x double, y double")
    with pytest.raises(Exception, match="needs orders"):
        se.degree_by_dd(se.divided_diff(rows, ["s"], "x", "y", 2), ["s"], 0.001).collect()


@pytest.mark.parametrize("text, day", [("09/13/2021", "2021-09-13"), ("2021-09-13", "2021-09-13"), ("Sep 3, 2021", "2021-09-03"), ("never", None)])
def test_dates_in_several_forms(spark, text, day):
    from tabloom.functions import clean as cl

    assert value(spark, cl.parse_date(F.lit(text)).cast("string")) == day


def test_whole_ids_are_exact(spark):
    from tabloom.functions import clean as cl

    for text, want in [("9007199254740993", 9007199254740993), ("1e3", 1000), ("4.5", None), (" 12 ", 12), ("99999999999999999999", None)]:
        assert value(spark, cl.strict_int64(F.lit(text))) == want


def test_splits_are_whole_and_repeatable(spark):
    rows = spark.range(2000)
    folds = sa.kfold(rows, "id", 10).groupBy("fold").count().collect()
    assert sorted(r.fold for r in folds) == list(range(10)) and sum(r["count"] for r in folds) == 2000
    split = sa.train_test_split(rows, "id", 0.3)
    assert abs(split.filter("is_train").count() / 2000 - 0.7) < 0.03
    again = sa.train_test_split(rows.repartition(7), "id", 0.3)
    assert split.exceptAll(again).count() == 0


def test_multinomial_bayes_agrees_with_mllib(spark):
    from pyspark.ml.classification import NaiveBayes
    from pyspark.ml.feature import CountVectorizer

    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(30)]
    rows = [(i, int(i % 3), [words[int(w)] for w in rng.integers(5 * (i % 3), 5 * (i % 3) + 20, 12)]) for i in range(150)]
    docs = inline_table(spark, rows, "doc int, y int, tokens array<string>")
    train, test = docs.filter("doc < 90"), docs.filter("doc >= 90")
    mine = {r.doc: r.predicted for r in ml.nb_multinomial(train, test.select("doc", "tokens"), "doc", "y").collect()}
    vectors = CountVectorizer(inputCol="tokens", outputCol="features").fit(train)
    model = NaiveBayes(labelCol="y", modelType="multinomial").fit(vectors.transform(train))
    theirs = {r.doc: int(r.prediction) for r in model.transform(vectors.transform(test)).collect()}
    assert mine == theirs
    empty = inline_table(spark, [(1, [])], "doc int, tokens array<string>")
    assert ml.nb_multinomial(train.filter("y < 2 or doc > 60"), empty, "doc", "y").first().predicted in (0, 1)


def test_regression_models(spark):
    rows = spark.range(400).select("id", (F.col("id") % 20).cast("double").alias("a"), F.sqrt("id").alias("b"))
    rows = rows.withColumn("y", 3 + 2 * F.col("a") - 0.5 * F.col("b"))
    model = ml.linreg(rows, ["a", "b"], "y")
    assert [model.intercept, *model.coefficients] == pytest.approx([3, 2, -0.5])
    fitted = ml.linreg_predict(model, rows, ["a", "b"], "y")
    assert st.errors(fitted, "y", "fitted").first().rmse == pytest.approx(0, abs=1e-6)
    high = rows.withColumn("high", (F.col("a") > 9).cast("double"))
    scaled = en.standardize(high, ["a", "b"])
    scored = ml.with_probability(ml.logreg(scaled, ["a_z", "b_z"], "high"), scaled, ["a_z", "b_z"], ["high"])
    assert one(st.auc(scored, "high", "score")) == pytest.approx(1.0)
