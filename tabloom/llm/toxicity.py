"""Toxicity: non-negative positive-unlabelled learning on hashed words.

Confirmed toxic texts are the positives, all texts that may be learned from are the unlabelled set. The risk is
``prior * R_p(+1) + max(0, R_u(-1) - prior * R_p(-1))``: the unlabelled set stands for the negatives after its
share of positives has been taken out, and the bracket is kept from going below zero, where a flexible model
would start to fit single examples.

How many texts hold a word is counted over every text, and how many toxic ones over all confirmed ones up to about
`MAX_POSITIVE`, beyond that over a sample of so many. The fit itself uses a sample, bounded by `MAX_POSITIVE` and
`MAX_UNLABELLED` rows; each row of it is the list of its telling words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm import chars, common

BITS = 18
PREFIXES = (4, 5)
MAX_POSITIVE = 20_000
MAX_UNLABELLED = 40_000
PRIOR_UNKNOWN = 0.1
TELLING, LIFT = 5.0, 2.0  # a telling word is surely, and by this factor, more frequent in toxic texts
THRESHOLD = 0.7
STEPS, RATE, DECAY = 400, 0.05, 1e-4


@dataclass(frozen=True)
class Model:
    weight: np.ndarray  # one entry per bucket, zero where the bucket tells nothing
    bias: float
    bits: int


def features(texts: list[str | None], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of words and of the first letters of longer words, and the text each belongs to."""
    text, starts = chars.codes(texts)
    text = chars.lower_table()[text]
    begin, end, first = chars.words(text, starts, chars.letter_table())
    owner = np.repeat(np.arange(len(texts)), np.diff(first))
    parts, owners = [chars.hashes(text, begin, end)], [owner]
    for n in PREFIXES:
        longer = end - begin > n
        parts.append(chars.hashes(text, begin[longer], begin[longer] + n, seed=n))
        owners.append(owner[longer])
    return (np.concatenate(parts) >> np.uint64(64 - bits)).astype(np.int64), np.concatenate(owners)


def _once(bucket: np.ndarray, owner: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Each (text, bucket) once, ordered."""
    both = np.unique((owner << bits) | bucket)
    return both & ((1 << bits) - 1), both >> bits


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, width: int,
        steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk with the logistic loss, by full-batch Adam.

    The rows list the columns that are set. Where the bracket is negative, the step goes against it.
    """
    rows = positive + unlabelled
    size = np.array([len(r) for r in rows])
    column = np.concatenate(rows) if size.sum() else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(rows)), size)
    n_p, n_u = len(positive), len(unlabelled)
    weight, bias = np.zeros(width + 1), 0.0
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, steps + 1):
        z = np.bincount(owner, weight[column], len(rows)) + weight[width]
        s = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
        bracket = np.logaddexp(0, z[n_p:]).mean() - prior * np.logaddexp(0, z[:n_p]).mean()
        slope = np.zeros(len(rows))
        if bracket >= 0:
            slope[:n_p] = prior * (s[:n_p] - 1) / n_p - prior * s[:n_p] / n_p
            slope[n_p:] = s[n_p:] / n_u
        else:
            slope[:n_p] = prior * s[:n_p] / n_p
            slope[n_p:] = -s[n_p:] / n_u
        grad = np.bincount(column, slope[owner], width + 1)
        grad[width] = slope.sum()
        grad[:width] += DECAY * weight[:width]
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad**2
        weight -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    bias = float(weight[width])
    return weight[:width], bias


def _count(bits: int):
    """Per task: in how many texts, and in how many positive ones, each bucket occurs."""

    def run(frames):
        total, of_positive = np.zeros((2, 1 << bits), np.int64)
        n = n_p = 0
        for frame in frames:
            texts, mark = frame["text"].tolist(), frame["positive"].to_numpy(bool)
            n, n_p = n + len(texts), n_p + int(mark.sum())
            for a, b in chars.batches(texts):
                bucket, owner = _once(*features(texts[a:b], bits), bits)
                total += np.bincount(bucket, minlength=1 << bits)
                of_positive += np.bincount(bucket[mark[a:b][owner]], minlength=1 << bits)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": np.append(at, -1), "n": np.append(total[at], n),
                            "n_p": np.append(of_positive[at], n_p)})

    return run


def _telling(bits: int, column: np.ndarray):
    def run(frames):
        for frame in frames:
            texts, out = frame.pop("text").tolist(), []
            for a, b in chars.batches(texts):
                bucket, owner = _once(*features(texts[a:b], bits), bits)
                hit = column[bucket] >= 0
                cut = np.searchsorted(owner[hit], np.arange(b - a + 1))
                row = column[bucket[hit]]
                out += [row[i:j].tolist() for i, j in zip(cut[:-1], cut[1:])]
            yield frame.assign(row=out)

    return run


def train(docs: DataFrame, labels: DataFrame, bits: int = BITS, max_positive: int = MAX_POSITIVE,
          max_unlabelled: int = MAX_UNLABELLED) -> Model:
    """Learn from ``docs`` (doc_id, text); ``labels`` (doc_id, toxic) confirms some of them as toxic.

    An id with several labels is toxic if one of them says so; labels without a document, null labels and null
    texts are no evidence. The class prior is the toxic share of the labelled rows, or `PRIOR_UNKNOWN` where
    only positives are labelled. Without positives or without texts every score is low.
    """
    spark = docs.sparkSession
    known = labels.where("doc_id is not null and toxic is not null")
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n_known, n_toxic = known.agg(F.count("*"), F.coalesce(F.sum((F.col("toxic") == 1).cast("long")), F.lit(0))).first()
    draw = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30))
    share = min(1.0, max_positive / max(n_toxic, 1))
    ids = known.where("toxic = 1").where(draw < int(share * (1 << 30))).select("doc_id", F.lit(True).alias("positive"))
    rows = docs.where("text is not null").select("doc_id", "text")
    rows = rows.join(F.broadcast(ids), "doc_id", "left")  # about max_positive ids at most, see the draw above
    rows = rows.withColumn("positive", F.coalesce("positive", F.lit(False)))
    counted = rows.select("text", "positive").mapInPandas(_count(bits), "bucket long, n long, n_p long")
    got = counted.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("n_p").alias("n_p")).toPandas()  # <= 2**bits + 1
    whole = got[got["bucket"] < 0]
    n, n_p = (int(whole["n"].sum()), int(whole["n_p"].sum()))
    if not n_p:
        return Model(np.zeros(1 << bits), -5.0, bits)
    prior = n_toxic / n_known if n_toxic < n_known else PRIOR_UNKNOWN
    words = got[got["bucket"] >= 0]
    p, u = words["n_p"] / n_p, words["n"] / n
    sure = (p - u) / np.sqrt((u * (1 - u) + 1 / n) / n_p) >= TELLING
    telling = words["bucket"][sure & (p >= LIFT * u)].to_numpy()
    telling.sort()
    column = np.full(1 << bits, -1, np.int64)
    column[telling] = np.arange(len(telling))
    part = min(1.0, max_unlabelled / n)
    chosen = rows.withColumn("unlabelled", draw < int(part * (1 << 30))).where("positive or unlabelled")
    sample = chosen.select("text", "positive", "unlabelled").mapInPandas(
        _telling(bits, column), "positive boolean, unlabelled boolean, row array<long>").toPandas()
    vectors = [np.asarray(r, np.int64) for r in sample["row"]]
    if not sample["unlabelled"].any():
        return Model(np.zeros(1 << bits), -5.0, bits)
    order = sorted(range(len(vectors)), key=lambda i: vectors[i].tolist())  # the same sums in every run
    weight, bias = fit([vectors[i] for i in order if sample["positive"][i]],
                       [vectors[i] for i in order if sample["unlabelled"][i]], prior, len(telling))
    dense = np.zeros(1 << bits)
    dense[telling] = weight
    return Model(dense, bias, bits)


def score_texts(model: Model, texts: list[str | None]) -> np.ndarray:
    bucket, owner = features(texts, model.bits)
    hit = model.weight[bucket] != 0
    bucket, owner = _once(bucket[hit], owner[hit], model.bits)
    z = np.bincount(owner, model.weight[bucket], len(texts)) + model.bias
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``score`` (higher: toxic is likelier) and ``predicted`` for every row, from its whole text.

    A null or empty text has no words and gets the score of the bias alone. Repeated rows are scored alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(texts):
        found = [np.zeros(0)] + [score_texts(shared.value, texts[a:b]) for a, b in chars.batches(texts)]
        scores = np.concatenate(found)
        return scores, (scores >= THRESHOLD).astype(np.int32)

    return common.map_texts(docs, keep, "text", "score double, predicted int", work)


def detect(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from the rows that are not held out, then score every row: doc_id, held_out, score, predicted."""
    learn = ~common.held_out("doc_id")
    model = train(docs.where(learn), labels.select("doc_id", "toxic").where(learn))
    marked = docs.select("doc_id", "text", common.held_out("doc_id").alias("held_out"))
    return score(marked, model, keep=("doc_id", "held_out"))
