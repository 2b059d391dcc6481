"""What the physical plans must and must not hold."""

import re

import pytest

from tabloom.operators.stats import value_ecdf
from tabloom.plans import QUERIES

BATCH = sorted(
    n for n, f in QUERIES.items() if f.__module__.rsplit(".", 1)[1] in ("text", "clean", "rollups", "events", "stats", "series")
)
# Histograms have a few fixed bins; only these may be ordered in one task.
SMALL_WINDOWS = {"relative_freq", "cum_counts", "ecdf", "binned_median", "inverse_cdf_lookup", "spline_interp_strict"}

# These order distinct values in one task only after counting that they are few.
COUNTED_WINDOWS = {"auc", "exact_quantiles", "qcut", "qcut_labels", "roc_points", "value_ecdf"}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", BATCH)
def test_plan(spark, sf_dir, name):
    plan = plan_of(QUERIES[name](spark, sf_dir))
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    assert ("MapInPandas" in plan) == (name in ("poly_fit", "poly_fit_high"))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "Scan ExistingRDD" not in plan
    bare = [w for w in re.findall(r"Window \[.*", plan) if re.search(r"\], \[[a-z_]+#?\w* (ASC|DESC)[^\]]*\]\s*$", w) and w.count("], [") == 1]
    if name not in SMALL_WINDOWS | COUNTED_WINDOWS:
        assert not bare, bare


def test_columns_and_filters_reach_the_scan(spark, sf_dir):
    plan = plan_of(QUERIES["isin"](spark, sf_dir))
    assert re.search(r"PushedFilters: \[In\(p_type, \[ECONOMY,STANDARD\]\)", plan)
    assert "ReadSchema: struct<l_extendedprice:double,l_returnflag:string>" in plan_of(QUERIES["pop_stats"](spark, sf_dir))
    assert "ReadSchema: struct<text:string>" in plan_of(QUERIES["word_freq"](spark, sf_dir))


def test_top_words_do_not_sort_the_whole_table(spark, sf_dir):
    plan = plan_of(QUERIES["word_freq_topk"](spark, sf_dir))
    assert "TakeOrderedAndProject" in plan and "rangepartitioning" not in plan


def test_many_values_are_not_ordered_in_one_task(spark, sf_dir):
    few = QUERIES["value_ecdf"](spark, sf_dir)
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    many = value_ecdf(orders, "o_totalprice", block_rows=100)
    assert "hashpartitioning(_block" in plan_of(many) and "hashpartitioning(_block" not in plan_of(few)


def test_rollups_share_one_exchange(spark, sf_dir):
    df = QUERIES["pct_of_total"](spark, sf_dir)
    df.collect()
    assert "ReusedExchange" in plan_of(df)
