"""Language and toxicity models against plain counts and finite differences."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tabloom.llm import langid, toxicity

DOCS = "doc_id long, text string, lang string"


def _grams(text, orders):
    body = " " + re.sub(r"[^a-zé]+", " ", text.lower()).lstrip() + " "
    return [body[i:i + n] for n in orders for i in range(len(body) - n + 1)]


@pytest.mark.parametrize("orders", [(1,), (1, 2), (3,)])
def test_naive_bayes_by_dictionaries(spark, orders):
    rng = random.Random(sum(orders))
    rows = []
    for i in range(90):
        lang = rng.choice(["aa", "bb", "cc"])
        letters = {"aa": "aaaabé", "bb": "bbbbaé", "cc": "éééabb"}[lang]
        rows.append((i, " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 4))) for _ in range(8)) + rng.choice(["", "!", " 7"]), lang))
    rows += [(200, None, "aa"), (201, "123 !", "bb"), (202, "ab", None), (203, "", "aa")]
    counts, docs = defaultdict(Counter), Counter()
    for _, t, lang in rows:
        if t and lang and re.search(r"[a-zé]", t):
            counts[lang].update(_grams(t, orders))
            docs[lang] += 1
    model = langid.train(spark.createDataFrame(rows, DOCS).repartition(3), orders=orders)
    assert model.languages == sorted(docs)
    tests = ["ab ba é", "Bbb bb", "a", "éé a ÉÉ!", "x y"]
    got = langid.score_texts(model, [*tests, "7!", None])
    assert got[0][-2:] == ["und", "und"] and got[1][-2:].tolist() == [0, 0]
    for t, name, share in zip(tests, *got):
        logs = []
        for lang in model.languages:
            total = sum(counts[lang].values()) + langid.SMOOTHING * (1 << langid.BITS)
            grams = _grams(t, orders)
            logs.append(math.log(docs[lang] / sum(docs.values())) + sum(math.log(counts[lang][g] + langid.SMOOTHING) - math.log(total) for g in grams))
        post = np.exp(np.array(logs) - max(logs))
        post /= post.sum()
        assert name == model.languages[int(np.argmax(logs))] and share == pytest.approx(post.max(), abs=1e-4)


def _risk(weight, bias, positive, unlabelled, prior):
    z_p = np.array([weight[r].sum() + bias for r in positive])
    z_u = np.array([weight[r].sum() + bias for r in unlabelled])
    loss = lambda z, sign: np.logaddexp(0, -sign * z).mean()
    bracket = loss(z_u, -1) - prior * loss(z_p, -1)
    return prior * loss(z_p, 1) + max(0.0, bracket) + toxicity.DECAY / 2 * (weight**2).sum(), bracket


def test_fit_is_where_the_risk_is_flat():
    rng = np.random.default_rng(2)
    rows = lambda n, p: [np.flatnonzero(rng.random(6) < p) for _ in range(n)]
    positive = rows(80, [0.6, 0.5, 0.3, 0.2, 0.5, 0.1])
    unlabelled = rows(30, [0.6, 0.5, 0.3, 0.2, 0.5, 0.1]) + rows(170, [0.1, 0.2, 0.3, 0.5, 0.4, 0.4])
    prior = 0.15
    weight, bias = toxicity.fit(positive, unlabelled, prior, 6, steps=4000)
    here, bracket = _risk(weight, bias, positive, unlabelled, prior)
    assert bracket > 0
    for i in range(7):
        step = np.zeros(7)
        step[i] = 1e-5
        up, _ = _risk(weight + step[:6], bias + step[6], positive, unlabelled, prior)
        down, _ = _risk(weight - step[:6], bias - step[6], positive, unlabelled, prior)
        assert abs(up - down) / 2e-5 < 2e-3
        assert _risk(weight + 1e4 * step[:6], bias + 1e4 * step[6], positive, unlabelled, prior)[0] > here
    assert weight[0] > 0 > weight[3]


def test_fit_keeps_the_bracket_from_going_below_zero():
    positive = [np.array([i]) for i in range(20)]  # each has a word of its own: a free fit would push the bracket down
    weight, bias = toxicity.fit(positive, positive + [np.zeros(0, np.int64)] * 20, 0.9, 20, steps=1500)
    _, bracket = _risk(weight, bias, positive, positive + [np.zeros(0, np.int64)] * 20, 0.9)
    assert bracket > -0.05


def test_telling_words_by_dictionaries(spark):
    rng = random.Random(3)
    plain, bad = [f"{a}lain{b}" for a in "pqrs" for b in "abcdef"], ["nasty", "vileword", "grim"]
    rows = []
    for i in range(600):
        words = [rng.choice(plain) for _ in range(12)] + ([rng.choice(bad), rng.choice(bad)] if i % 10 == 0 else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
    rows += [(900, None), (901, ""), rows[10], rows[10]]
    labels = [(i, int(i % 10 == 0)) for i in range(0, 600, 3)] + [(None, 1), (5, None), (10, 0)]

    def units(t):
        words = re.findall(r"[a-z]+", t)
        return set(words) | {("prefix", n, w[:n]) for w in words for n in toxicity.PREFIXES if len(w) > n}

    toxic = {i for i, q in labels if q == 1 and i is not None}
    n, n_p, total, of_toxic = 0, 0, Counter(), Counter()
    for i, t in rows:
        if t is not None:
            n, n_p = n + 1, n_p + (i in toxic)
            total.update(units(t))
            of_toxic.update(units(t) if i in toxic else ())
    want = set()
    for unit, count in total.items():
        p, u = of_toxic[unit] / n_p, count / n
        if (p - u) / math.sqrt((u * (1 - u) + 1 / n) / n_p) >= toxicity.TELLING and p >= toxicity.LIFT * u:
            want.add(unit)
    model = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, toxic int"))
    buckets = set()
    for unit in want:
        word = unit if isinstance(unit, str) else unit[2]
        if isinstance(unit, str):
            buckets.add(int(toxicity.features([word])[0][0]))
        else:  # of a longer word that begins so: the word's bucket, then one for each prefix
            found = toxicity.features([word + "x"])[0].tolist()
            buckets.add(found[1:][[k for k in toxicity.PREFIXES if len(word) + 1 > k].index(unit[1])])
    assert len(want) >= 3 and set(np.flatnonzero(model.weight).tolist()) == buckets
    scores = toxicity.score_texts(model, ["plaina nasty", "plaina qlainb", ""])
    assert scores[0] > 0.7 > scores[1] and scores[2] < 0.7
