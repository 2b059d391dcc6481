"""Importance resampling against plain counts: both models, the weights, the cut, the noise."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from tabloom.llm import common, quality

LABELS = "doc_id long, quality int"


def _grams(text):
    """Shape runs of one to three words and word runs of one or two, by their definition."""
    words = text.split()
    shapes = []
    for i, w in enumerate(words):
        signs = ["X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c for c in w]
        shape = "".join(s for j, s in enumerate(signs) if not j or s != signs[j - 1])
        shapes.append("<again>" if i and w.lower() == words[i - 1].lower() else shape)
    lower = [w.lower() for w in words]
    runs = [("shape", *shapes[i:i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]
    return runs + [("word", *lower[i:i + k]) for k in (1, 2) for i in range(len(words) - k + 1)]


def _sentence(rng):
    return (f"The {rng.choice(['dog', 'cat', 'horse', 'bird'])} {rng.choice(['sees', 'hears', 'likes'])} the "
            f"{rng.choice(['house', 'garden', 'river'])} and {rng.choice(['sleeps', 'eats', 'runs'])} there.")


def _text(rng, n=6):
    return " ".join(_sentence(rng) for _ in range(n))


def _salad(rng, n=6):
    words = _text(rng, n).split()
    rng.shuffle(words)
    return " ".join(words)


def test_models_and_weights_by_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, _text(rng) if i % 3 else f"BUY {rng.randint(0, 9)} NOW!! NOW!! {_salad(rng, 1)}") for i in range(120)]
    rows += [(200, None), (201, ""), (202, "x"), (None, _text(rng)), (1, rows[1][1])]
    labels = [(i, int(i % 3 > 0)) for i in range(0, 120, 2)] + [(4, 0), (None, 1), (7, None), (999, 1)]
    good = {i for i, _ in labels if i is not None and all(q == 1 for j, q in labels if j == i and q is not None)} - {7}
    raw, of_good = Counter(), Counter()
    for i, t in rows:
        raw.update(_grams(t or ""))
        if i in good:
            of_good.update(_grams(t or ""))
    share = sum(of_good.values()) / sum(raw.values())

    def weight(t):
        found = [0.0 if raw[g] < quality.RARE else math.log(of_good[g] + share) - math.log(share * (raw[g] + 1)) for g in _grams(t or "")]
        return quality.UNIT * sum(found) / max(len(found), 1)

    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    model = quality.train(docs, spark.createDataFrame(labels, LABELS))
    got = quality.weigh(docs, model).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.log_weight == pytest.approx(weight(r.text), abs=2e-4)


def test_salads_of_good_words_are_rejected(spark):
    rng = random.Random(2)
    rows = [(i, _text(rng) if i % 4 else _salad(rng)) for i in range(400)]
    labels = [(i, int(i % 4 > 0)) for i in range(0, 400, 3)]
    out = quality.resample(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, LABELS)).collect()
    assert sum(r.kept for r in out if r.doc_id % 4) >= 0.98 * 300
    assert sum(r.kept for r in out if not r.doc_id % 4) <= 0.02 * 100


def test_noise_decides_near_the_cut(spark):
    """Texts that are good in part lie close together; which of them stay is drawn, and reruns draw alike."""
    rng = random.Random(3)
    rows = []
    for i in range(900):
        share = i % 30 / 29
        rows.append((i, " ".join(_sentence(rng) if rng.random() < share else "BUY IT NOW!!" for _ in range(40))))
    labels = [(i, int(i % 30 > 15)) for i in range(0, 900, 2)]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, LABELS)
    out = quality.resample(docs, known).collect()
    kept, gone = [r for r in out if r.kept], [r for r in out if not r.kept]
    assert min(r.log_weight for r in kept) < max(r.log_weight for r in gone)
    assert min(r.sample_key for r in kept) > max(r.sample_key for r in gone)
    again = quality.resample(docs.repartition(5), known).collect()
    assert {r.doc_id for r in again if r.kept} == {r.doc_id for r in kept}
    held = spark.range(900).where(common.held_out("id")).count()
    assert 0 < held < 900 and 0.3 < len(kept) / 900 < 0.7


def test_parting_weight():
    w, good = np.array([-9.0, -8, -7, 1, 2, 3]), np.array([0, 0, 0, 1, 1, 1], bool)
    assert quality.parting_weight(w, good) == -3.0
    assert quality.parting_weight(w[::-1], good[::-1]) == -3.0
    assert quality.parting_weight(w, np.ones(6, bool)) == -np.inf and quality.parting_weight(w, np.zeros(6, bool)) == np.inf
    assert quality.parting_weight(w[:0], good[:0]) == -np.inf
    assert quality.parting_weight(np.zeros(4), np.array([0, 1, 0, 1], bool)) == -np.inf
    many = np.concatenate([np.full(500, -50.0), [4.0], np.full(1000, 5.0), [-3.0]])  # one wrong label
    assert -50 < quality.parting_weight(many, np.concatenate([np.zeros(501, bool), np.ones(1001, bool)])) < -3


def test_weights_far_apart(spark):
    df = spark.createDataFrame([(-1e6,), (0.0,), (1e6,), (None,)], "v double")
    assert [quality.kth_largest(df, "v", k) for k in (1, 2, 3)] == [1e6, 0.0, -1e6]


def test_clashing_columns_and_no_labels(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 5), (2, None, "y", 6)], "doc_id long, text string, kept string, log_weight int")
    labels = spark.createDataFrame([(1, 0)], LABELS)
    for known in (labels, labels.limit(0)):
        out = quality.resample(docs, known)
        assert out.columns == ["doc_id", "text", "log_weight", "sample_key", "kept"] and all(r.kept for r in out.collect())
    assert quality.keep_good(docs, labels).columns == docs.columns
