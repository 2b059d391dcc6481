"""Every named query against its check SQL on the smallest data set."""

import pytest
from oracle import compare, duck

from tabloom.plans import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf_dir, name):
    ok, note, _ = compare(spark, con, name, QUERIES[name], ORACLES.get(name), sf_dir)
    assert ok, note


def test_only_fitted_models_have_no_check():
    assert sorted(set(QUERIES) - set(ORACLES)) == [
        "dtree_deep", "grid_best_auc", "grid_best_roc", "grid_search", "grid_search_wide", "grid_shuffle", "logreg", "logreg_auc", "mlp", "mlp_steps",
        "poly_fit_high"
    ]


@pytest.mark.parametrize("name, key", [
    ("sort_full", lambda r: (-r["count"], r.word.encode())),
    ("word_freq_topk", lambda r: (-r["count"], r.word.encode())),
    ("sort_date", lambda r: r.day),
    ("sort_by_code", lambda r: r.code),
    ("nulls_last", lambda r: (r.original_language is None, r.original_language or "")),
    ("head", lambda r: r.c_custkey),
])
def test_order(spark, sf_dir, name, key):
    """`compare` sorts both sides, so order has a test of its own."""
    rows = QUERIES[name](spark, sf_dir).collect()
    assert len(rows) > 1 and rows == sorted(rows, key=key)
