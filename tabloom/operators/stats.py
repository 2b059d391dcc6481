"""Descriptive statistics, histograms and model-evaluation tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tabloom.operators.ordered import BLOCK_ROWS, running_sums, split_long
from tabloom.sources.inline import inline_table

# Fixed value: normal quantile of a two-sided 95 % interval.
Z95 = 1.96


def profile(df: DataFrame) -> DataFrame:
    """(column_name, dtype, non_null, rows), all columns counted in one pass."""
    fields = df.schema.fields
    one = df.agg(
        F.count("*").alias("_rows"), *[F.count(f"`{f.name}`").alias(f"_c{i}") for i, f in enumerate(fields)]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(f.name).alias("column_name"),
                F.lit(f.dataType.simpleString()).alias("dtype"),
                F.col(f"_c{i}").alias("non_null"),
                F.col("_rows").alias("rows"),
            )
            for i, f in enumerate(fields)
        ]
    )
    return one.select(F.explode(rows).alias("r")).select("r.*")


def null_total(df: DataFrame) -> DataFrame:
    total = F.lit(0)
    for c in df.columns:
        total = total + F.col(f"`{c}`").isNull().cast("int")
    return df.agg(F.coalesce(F.sum(total), F.lit(0)).alias("nulls"))


def duplicate_total(df: DataFrame) -> DataFrame:
    """Rows equal to an earlier row; null equals null. Copies are combined before the shuffle."""
    groups = df.groupBy(*df.columns).agg(F.count("*").alias("_n"))
    return groups.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates"))


def nunique(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    """(column_name, n): distinct values of each column, nulls left out."""
    if approximate:
        count = F.approx_count_distinct
    else:
        count = F.count_distinct
    one = df.agg(*[count(c).alias(c) for c in columns])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n")) for c in columns])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def pop_stats(df: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """Count, mean, population variance and deviation, variation in percent and 95 % interval."""
    base = df.groupBy(*keys).agg(
        F.count(column).alias("n"),
        F.avg(column).alias("mean"),
        F.var_pop(column).alias("var_pop"),
        F.stddev_pop(column).alias("std_pop"),
    )
    margin = F.col("std_pop") / F.sqrt("n") * Z95
    return base.withColumns(
        {
            "cv_percent": F.try_divide(F.col("std_pop"), F.col("mean")) * 100,
            "ci_low": F.col("mean") - margin,
            "ci_high": F.col("mean") + margin,
        }
    )


def histogram(df: DataFrame, column: str, edges: Sequence[float]) -> DataFrame:
    """(code, lo, hi, center, n) for each bin between the edges, empty bins too.

    Bins are left-closed and the last one also holds its upper edge; values
    outside the edges do not count.
    """
    c = F.col(column).cast("double")
    inner = [F.lit(float(e)) for e in edges[1:-1]]
    code = F.lit(0)
    for e in inner:
        code = code + F.when(c >= e, 1).otherwise(0)
    inside = c.between(float(edges[0]), float(edges[-1]))
    counts = df.filter(inside).groupBy(code.alias("code")).agg(F.count("*").alias("n"))
    rows = [(i, float(a), float(b), (a + b) / 2.0) for i, (a, b) in enumerate(zip(edges, edges[1:]))]
    bins = inline_table(df.sparkSession, rows, "code int, lo double, hi double, center double")
    return (
        F.broadcast(bins).join(counts, "code", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    )


def histogram_k(df: DataFrame, column: str, k: int) -> DataFrame:
    """Histogram with k equal bins between the minimum and the maximum.

    The two ends are read first: bin edges are part of the plan.
    """
    lo, hi = df.agg(F.min(column).cast("double"), F.max(column).cast("double")).first()
    if lo is None:
        raise ValueError(f"{column} has no values")
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    step = (hi - lo) / k
    return histogram(df, column, [lo + step * i for i in range(k)] + [hi])


def _bin_order():
    # A histogram has a fixed, small number of bins, so one task may order them.
    return Window.orderBy("lo").rowsBetween(Window.unboundedPreceding, 0)


def cumulative(hist: DataFrame) -> DataFrame:
    """Add running counts, shares and the running share at each bin's upper edge."""
    total = hist.agg(F.sum("n")).scalar()
    return hist.withColumns(
        {
            "cum_n": F.sum("n").over(_bin_order()),
            "share": F.try_divide(F.col("n"), total),
            "cdf": F.try_divide(F.sum("n").over(_bin_order()), total),
        }
    )


def ecdf_points(hist: DataFrame) -> DataFrame:
    """(x, cdf) at every edge, from 0 at the first edge to 1 at the last."""
    first = hist.agg(F.min("lo").alias("x")).withColumn("cdf", F.lit(0.0))
    return first.unionByName(cumulative(hist).select(F.col("hi").alias("x"), "cdf"))


def value_ecdf(df: DataFrame, column: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(value, n, cdf) over the distinct values, of which there may be any number."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    total = df.agg(F.count(column)).scalar()
    summed = running_sums(split_long(counts, [], column, block_rows), {"_cum": F.col("n")})
    return summed.withColumn("cdf", F.col("_cum") / total).drop("_cum")


def weighted_mean(hist: DataFrame) -> DataFrame:
    return hist.agg((F.sum(F.col("n") * F.col("center")) / F.sum("n")).alias("mean"))


def binned_median(hist: DataFrame) -> DataFrame:
    """Centre of the first bin at which half of the mass is reached."""
    half = cumulative(hist).filter(F.col("cdf") >= 0.5)
    return half.agg(F.min_by("center", "lo").alias("median"))


def inverse_cdf(df: DataFrame, u: Column, hist: DataFrame, out: str = "draw") -> DataFrame:
    """Look a share u up in the running shares of a histogram; gives the bin centre.

    The histogram is one small array, so the lookup is an expression and no join.
    """
    packed = F.sort_array(F.collect_list(F.struct("lo", "center", "cdf")))
    table = cumulative(hist).agg(packed).scalar()
    reached = F.filter("_cdf", lambda b: u <= b["cdf"])
    hit = F.coalesce(F.try_element_at(reached, F.lit(1)), F.element_at("_cdf", -1))
    return df.withColumn("_cdf", table).withColumn(out, hit["center"]).drop("_cdf")


def counts_with_pct(df: DataFrame, column: str) -> DataFrame:
    counts = df.groupBy(column).agg(F.count("*").alias("count"))
    return counts.withColumn("pct", F.col("count") / counts.agg(F.sum("count")).scalar())


def crosstab(
    df: DataFrame, actual: str, predicted: str, labels: Sequence, actual_labels: Sequence | None = None
) -> DataFrame:
    """One row per actual class, one column per predicted class, in the given label order.

    ``actual_labels`` is for tables whose two sides have different classes. A class that is not listed, null
    included, is an error: no row is left out of the counts.
    """
    kind = df.schema[actual].dataType.simpleString()
    rows_of = list(actual_labels if actual_labels is not None else labels)
    rows = inline_table(df.sparkSession, list(enumerate(rows_of)), f"_pos int, {actual} {kind}")

    def listed(column: str, known: Sequence) -> Column:
        wrong = F.raise_error(F.concat(F.lit(f"{column} has a class that is not listed: "), F.coalesce(F.col(column).cast("string"), F.lit("null"))))
        return F.when(F.col(column).isin(known), F.col(column)).otherwise(wrong)

    known = df.select(listed(actual, rows_of).alias(actual), listed(predicted, list(labels)).alias(predicted))
    wide = known.groupBy(actual).pivot(predicted, list(labels)).agg(F.count(actual))
    full = F.broadcast(rows).join(wide, actual, "left").na.fill(0)
    return full.orderBy("_pos").select(actual, *[F.col(f"`{x}`").alias(f"pred_{x}") for x in labels])


def accuracy(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.agg(F.avg((F.col(actual) == F.col(predicted)).cast("double")).alias("accuracy"))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def classification_report(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """(label, precision, recall, f1, support) per class, then accuracy, macro and weighted means.

    The table is first brought down to class pairs; the rest is a handful of rows.
    """
    pairs = df.groupBy(F.col(actual).alias("a"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    sides = F.array(
        F.struct(F.col("a").cast("string").alias("label"), F.lit(True).alias("real")),
        F.struct(F.col("p").cast("string").alias("label"), F.lit(False).alias("real")),
    )
    long = pairs.select("n", (F.col("a") == F.col("p")).alias("hit"), F.explode(sides).alias("s"))
    per = long.groupBy("s.label").agg(
        F.sum(F.when(F.col("s.real") & F.col("hit"), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("s.real"), F.col("n")).otherwise(0)).alias("support"),
        F.sum(F.when(~F.col("s.real"), F.col("n")).otherwise(0)).alias("claimed"),
    )
    per = per.withColumns(
        {"precision": _ratio(F.col("tp"), F.col("claimed")), "recall": _ratio(F.col("tp"), F.col("support"))}
    ).withColumn(
        "f1", _ratio(F.col("precision") * F.col("recall") * 2, F.col("precision") + F.col("recall"))
    )
    scores = ["precision", "recall", "f1"]
    macro = per.agg(
        F.lit("macro avg").alias("label"), *[F.avg(s).alias(s) for s in scores], F.sum("support").alias("support")
    )
    weighted = per.agg(
        F.lit("weighted avg").alias("label"),
        *[_ratio(F.sum(F.col(s) * F.col("support")), F.sum("support")).alias(s) for s in scores],
        F.sum("support").alias("support"),
    )
    hit = _ratio(F.sum("tp"), F.sum("support"))
    overall = per.agg(
        F.lit("accuracy").alias("label"), *[hit.alias(s) for s in scores], F.sum("support").alias("support")
    )
    columns = ["label", *scores, "support"]
    return per.select(columns).unionByName(overall).unionByName(macro).unionByName(weighted)


def _score_sums(df: DataFrame, label: str, score: str, block_rows: int) -> DataFrame:
    """Per distinct score, from high to low: positives, negatives and their running sums."""
    per = df.groupBy(F.col(score).alias("threshold")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg")
    )
    per = per.withColumn("_down", -F.col("threshold"))
    return running_sums(
        split_long(per, [], "_down", block_rows), {"tp": F.col("pos"), "fp": F.col("neg")}
    ).drop("_down")


def roc_points(df: DataFrame, label: str, score: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(threshold, fpr, tpr) per distinct score, and the start (null, 0, 0)."""
    sums = _score_sums(df, label, score, block_rows)
    total = df.agg(
        F.struct(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) != 1).alias("n"))
    ).scalar()
    points = sums.select(
        "threshold",
        F.try_divide(F.col("fp"), total["n"]).alias("fpr"),
        F.try_divide(F.col("tp"), total["p"]).alias("tpr"),
    )
    nullable = T.StructType([T.StructField(f.name, f.dataType) for f in points.schema])
    start = inline_table(df.sparkSession, [(None, 0.0, 0.0)], nullable)
    return start.unionByName(points)


def auc(df: DataFrame, label: str, score: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Area under the ROC curve by trapezoids; ties count half."""
    sums = _score_sums(df, label, score, block_rows)
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2))
    return sums.agg(F.try_divide(area, F.sum("pos") * F.sum("neg")).alias("auc"))


def errors(df: DataFrame, actual: str, predicted: str, where: Column | None = None) -> DataFrame:
    """(n, mse, rmse) over all rows or those that pass ``where``."""
    rows = df.filter(where) if where is not None else df
    squared = F.pow(F.col(actual) - F.col(predicted), F.lit(2.0))
    return rows.agg(F.count("*").alias("n"), F.avg(squared).alias("mse")).withColumn("rmse", F.sqrt("mse"))


def feasible_argmin(df: DataFrame, candidate: str, cost: str, violations: str) -> DataFrame:
    """(best, best_cost): lowest mean cost among candidates without a violation; nulls if none."""
    per = df.groupBy(candidate).agg(F.sum(violations).alias("_bad"), F.avg(cost).alias("_cost"))
    return per.filter(F.col("_bad") == 0).agg(
        F.min_by(candidate, F.struct("_cost", candidate)).alias("best"), F.min("_cost").alias("best_cost")
    )
