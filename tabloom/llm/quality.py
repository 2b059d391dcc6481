"""Quality by importance resampling: two hashed n-gram models, one of texts known to be good, one of all texts.

A gram's log ratio says how much likelier the good model makes it; the mean over a text's grams, taken for a text of
``UNIT`` grams, is its log importance weight, so long and short texts are weighed on one scale. The filter samples
without replacement by Gumbel top-k: the k largest of ``log weight + temperature * Gumbel noise``. The noise is a
hash of the row, so reruns agree. k is the number of texts whose weight is above the one that parts the learned labels
best; near it the noise decides, and a text below may take the place of one above.

Grams are runs of one to three word shapes and of one or two words. A shape is the word's characters with upper-case
letters, lower-case letters and digits each turned into one sign and runs of a sign drawn together; a word that repeats
the one before it has a shape of its own. Words are lower-cased and hashed. A bucket with fewer than ``RARE`` grams in
all texts tells nothing and weighs 0, so no text is judged by grams that it alone has. The counts of all texts cover
every text; the model is one vector of ``2 ** bits + 2 ** word_bits`` numbers.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm import chars, common

BITS, WORD_BITS = 16, 18
MAX_ORDER, WORD_ORDER = 3, 2
MAX_GOOD = 50_000
MAX_LABELS = 100_000
SMOOTHING = 1.0
RARE = 20
UNIT = 100
SLACK = 0.002
TEMPERATURE = 1.0
_FIXED = 1 << 20
_AGAIN = np.uint64(0x5851F42D4C957F2D)


@dataclass(frozen=True)
class Model:
    log_ratio: np.ndarray  # fixed point, one entry per bucket
    bits: int
    word_bits: int

    @property
    def flat(self) -> bool:
        return not self.log_ratio.any()


@functools.cache
def _sign_table() -> np.ndarray:
    table = np.arange(0x110000, dtype=np.uint32)
    for i in range(len(table)):
        c = chr(i)
        if c.isalpha():
            table[i] = ord("X") if c.isupper() else ord("x")
        elif c.isdigit():
            table[i] = ord("9")
    return table


def _runs(word: np.ndarray, owner: np.ndarray, order: int, bits: int, seed: int) -> tuple[list, list]:
    """Buckets of the runs of 1 to ``order`` hashes within one text, and whose they are."""
    out, owners = [], []
    step = chars.seeds(order, seed)
    with np.errstate(over="ignore"):
        rolling = np.zeros(len(word), np.uint64)
        for k in range(order):
            rolling = chars.mix(rolling[: max(len(word) - k, 0)] + word[k:] * step[k])
            inside = owner[: len(rolling)] == owner[k:]
            out.append((rolling[inside] >> np.uint64(64 - bits)).astype(np.int64))
            owners.append(owner[: len(rolling)][inside])
    return out, owners


def grams(texts: list[str | None], bits: int = BITS, word_bits: int = WORD_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of each text, those of words behind those of shapes, and the text each belongs to."""
    text, starts = chars.codes(texts)
    begin, end, first = chars.words(text, starts, chars.blank_word_table())
    if not len(begin):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(texts)), np.diff(first))
    lower = chars.hashes(chars.lower_table()[text], begin, end)
    sign = _sign_table()[text]
    fresh = np.ones(len(sign), bool)
    fresh[1:] = sign[1:] != sign[:-1]
    fresh[begin] = True
    place = np.concatenate([[0], np.cumsum(fresh)])
    shape = chars.hashes(sign[fresh], place[begin], place[end - 1] + fresh[end - 1])
    same = np.zeros(len(begin), bool)
    same[1:] = (lower[1:] == lower[:-1]) & (owner[1:] == owner[:-1])
    shape[same] = _AGAIN
    shapes, of_shapes = _runs(shape, owner, MAX_ORDER, bits, 5)
    words, of_words = _runs(lower, owner, WORD_ORDER, word_bits, 7)
    return np.concatenate([*shapes, *(w + (1 << bits) for w in words)]), np.concatenate(of_shapes + of_words)


def _count(bits: int, word_bits: int):
    size = (1 << bits) + (1 << word_bits)

    def run(frames):
        raw, good = np.zeros((2, size), np.int64)
        for frame in frames:
            texts, mark = frame["text"].tolist(), frame["good"].to_numpy(bool)
            for a, b in chars.batches(texts):
                bucket, owner = grams(texts[a:b], bits, word_bits)
                raw += np.bincount(bucket, minlength=size)
                good += np.bincount(bucket[mark[a:b][owner]], minlength=size)
        at = np.flatnonzero(raw)
        yield pd.DataFrame({"bucket": at, "raw": raw[at], "good": good[at]})

    return run


def _labelled(labels: DataFrame) -> DataFrame:
    """(doc_id, good) of labelled ids; an id with several labels is good if all of them say so."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id")
    return known.agg((F.min("quality") == 1).alias("good"))


def _drawn(ids: DataFrame, most: int, seed: int) -> DataFrame:
    """About ``most`` of the rows at most, drawn by a hash of their id."""
    share = min(1.0, most / max(ids.count(), 1))
    return ids.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30)))


def train(docs: DataFrame, labels: DataFrame, bits: int = BITS, word_bits: int = WORD_BITS, max_good: int = MAX_GOOD) -> Model:
    """Count grams of all ``docs`` (doc_id, text) and of those that ``labels`` (doc_id, quality) calls good (1).

    The good model takes a sample of about ``max_good`` good ids at most, so that their ids can go to every task and
    no text is shuffled. Null texts and labels without a text count for nothing. Without a good text the ratio is flat.
    """
    good = _drawn(_labelled(labels).where("good"), max_good, 13)
    rows = docs.where("text is not null").select("doc_id", "text")
    rows = rows.join(F.broadcast(good), "doc_id", "left")  # about max_good ids at most, see the draw
    rows = rows.select("text", F.coalesce("good", F.lit(False)).alias("good"))
    counted = rows.mapInPandas(_count(bits, word_bits), "bucket long, raw long, good long")
    got = counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).toArrow()  # a row per bucket
    raw, good_n = np.zeros((2, (1 << bits) + (1 << word_bits)))
    raw[got["bucket"]], good_n[got["bucket"]] = got["raw"], got["good"]
    return Model(np.rint(log_ratio(raw, good_n) * _FIXED).astype(np.int64), bits, word_bits)


def log_ratio(raw: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Log of good against raw probability per bucket; both models are smoothed in proportion to their size."""
    if not good.sum():
        return np.zeros(len(raw))
    share = good.sum() / raw.sum()
    ratio = np.log(good + SMOOTHING * share) - np.log(share * (raw + SMOOTHING))
    return np.where(raw < RARE, 0.0, ratio)


def weigh(docs: DataFrame, model: Model, temperature: float = TEMPERATURE) -> DataFrame:
    """``docs`` with ``log_weight`` and ``sample_key`` appended.

    The Gumbel noise comes from a hash of id and text: repeated rows share it. Null and wordless texts weigh 0.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def log_weight(texts: pd.Series) -> pd.Series:
        whole, out = texts.tolist(), [np.zeros(0)]
        for a, b in chars.batches(whole):
            bucket, owner = grams(whole[a:b], shared.value.bits, shared.value.word_bits)
            total = np.zeros(b - a, np.int64)  # whole numbers: the order of the sum does not matter
            np.add.at(total, owner, shared.value.log_ratio[bucket])
            count = np.bincount(owner, minlength=b - a)
            out.append(UNIT * total / (_FIXED * np.maximum(count, 1)))
        return pd.Series(np.concatenate(out))

    uniform = (F.pmod(F.xxhash64("doc_id", "text", F.lit(11)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    noise = -F.log(-F.log(uniform))
    return docs.withColumn("log_weight", log_weight("text")).withColumn(
        "sample_key", F.col("log_weight") + temperature * noise)


def kth_largest(values: DataFrame, column: str, k: int) -> float | None:
    """The k-th largest value of a column, nulls left out, found from counts of at most 65,536 cells a pass.

    No sort and no row leaves the executors; each pass pins the value down by 16 bits, to a millionth in the end.
    """
    fixed = values.select(F.round(F.col(column) * _FIXED).cast("long").alias("v")).where("v is not null")
    low, high, n = fixed.agg(F.min("v"), F.max("v"), F.count("*")).first()
    if not n or k <= 0:
        return None
    k = min(k, n)
    for shift in range(max(int(high - low).bit_length() - 1, 0) // 16 * 16, -1, -16):
        cell = F.shiftright(F.col("v") - F.lit(low), shift)
        cells = fixed.groupBy(cell.alias("c")).count().toPandas().sort_values("c", ascending=False)
        behind = cells["count"].cumsum().to_numpy()
        at = int(np.searchsorted(behind, k))
        k -= int(behind[at - 1]) if at else 0
        start = low + (int(cells["c"].iloc[at]) << shift)
        fixed = fixed.where((F.col("v") >= start) & (F.col("v") < start + (1 << shift)))
        low = start
    return low / _FIXED


def parting_weight(weight: np.ndarray, good: np.ndarray) -> float:
    """A weight with the largest difference between the shares of good and of bad rows above it.

    Of all that come within ``SLACK`` of the largest, the middle of the widest gap is taken, so a few wrong labels do not
    decide. Without bad rows that is below all, without good ones above.
    """
    if good.all() or not good.any():
        return -np.inf if good.all() else np.inf  # no label at all: every row stays
    order = np.argsort(weight, kind="stable")
    weight, good = weight[order], good[order]
    lost = np.concatenate([[0], np.cumsum(good)]) / max(good.sum(), 1)
    caught = np.concatenate([[0], np.cumsum(~good)]) / max((~good).sum(), 1)
    low, high = np.append(weight[0], weight), np.append(weight, weight[-1])
    best = np.flatnonzero((caught - lost >= (caught - lost).max() - SLACK) & (high > low))
    if not len(best):
        return -np.inf
    at = best[np.argmax((high - low)[best])]
    return float(low[at] + (high[at] - low[at]) / 2)


def resample(docs: DataFrame, labels: DataFrame, temperature: float = TEMPERATURE, max_labels: int = MAX_LABELS) -> DataFrame:
    """``docs`` with ``log_weight``, ``sample_key`` and ``kept``; columns of these names are replaced.

    Labels are learned from rows that are not held out, raw counts from all rows. k is the number of rows above the
    weight that parts the learned labels best, of which about ``max_labels`` are looked at. All rows tied with the k-th
    are kept. Without a good label every row is kept.
    """
    known = labels.select("doc_id", "quality").where(~common.held_out("doc_id"))
    model = train(docs.select("doc_id", "text"), known)
    docs = docs.drop("log_weight", "sample_key", "kept")
    weighed = weigh(docs, model, temperature)
    if model.flat:
        return weighed.withColumn("kept", F.lit(True))
    keys = common.staged(weighed.select("doc_id", "log_weight", "sample_key"), "quality")
    asked = _drawn(_labelled(known), max_labels, 19)
    judged = keys.join(asked, "doc_id").select("log_weight", "good").toArrow()  # about max_labels rows at most
    least = parting_weight(judged["log_weight"].to_numpy(), judged["good"].to_numpy())
    cut = kth_largest(keys, "sample_key", keys.where(F.col("log_weight") > least).count())
    kept = F.lit(False) if cut is None else F.round(F.col("sample_key") * _FIXED) >= round(cut * _FIXED)
    return weighed.withColumn("kept", kept)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are sampled, with their own columns only."""
    found = resample(docs.select(F.struct("*").alias("__row"), "doc_id", "text"), labels)
    return found.where("kept").select("__row.*")
