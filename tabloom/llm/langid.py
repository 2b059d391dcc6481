"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams per language in every task and adds the counts up in one aggregation; the model is a
matrix of ``buckets`` rows and one column per language, which is broadcast. Its size is bounded by the two
parameters. Scores are sums of fixed-point logarithms in 64-bit integers, so a text has the same score
in whatever batch it stands.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm import chars, common

BITS = 16
ORDERS = (1, 2, 3, 4)
MAX_LANGUAGES = 100
SMOOTHING = 0.5
UNKNOWN = "und"
_SCALE = float(1 << 20)
_FLUSH = 32
_P1, _P2 = chars.seeds(2, 101)


@dataclass(frozen=True)
class Model:
    """``weight[bucket, language]``: fixed-point log probabilities; ``prior`` likewise per language."""

    languages: list[str]
    weight: np.ndarray
    prior: np.ndarray
    bits: int
    orders: tuple[int, ...]


def _letters(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case letters with one blank between words and around each text; text starts; which texts have letters.

    What follows the last word of a text is a blank of its own.
    """
    text, starts = chars.codes(texts)
    text = chars.lower_table()[text]
    letter = chars.letter_table()[text]
    before = np.ones(len(text), bool)
    before[1:] = letter[:-1]
    before[starts[:-1][starts[:-1] < len(text)]] = False
    kept = letter | before
    has = np.zeros(len(text) + 1, np.int64)
    np.cumsum(letter, out=has[1:])
    counts = np.zeros(len(text) + 1, np.int64)
    np.cumsum(kept, out=counts[1:])
    body = np.where(letter, text, np.uint32(32))[kept]
    sizes = np.diff(counts[starts])
    new = np.concatenate([[0], np.cumsum(sizes + 2)])
    out = np.full(new[-1], 32, np.uint32)
    out[np.arange(len(body)) + np.repeat(new[:-1] + 1 - (np.cumsum(sizes) - sizes), sizes)] = body
    return out, new, np.diff(has[starts]) > 0


def _grams(text: np.ndarray, starts: np.ndarray, bits: int, orders: tuple[int, ...]) -> Iterator[tuple]:
    """For each order the buckets of all n-grams that lie within a text, and where each text's begin."""
    rolling = np.zeros(len(text), np.uint64)
    size = np.diff(starts)
    wide = text.astype(np.uint64)
    with np.errstate(over="ignore"):
        for k in range(1, max(orders) + 1):
            rolling = rolling[: max(len(text) - k + 1, 0)] * _P1 + wide[k - 1 :] + np.uint64(k)
            if k not in orders:
                continue
            n = np.maximum(size - k + 1, 0)
            first = np.concatenate([[0], np.cumsum(n)])
            at = np.repeat(starts[:-1] - first[:-1], n) + np.arange(first[-1])
            yield ((rolling[at] * _P2) >> np.uint64(64 - bits)).astype(np.int64), first


def _count(bits: int, orders: tuple[int, ...]):
    def emit(seen):
        for lang, (docs, table) in seen.items():
            at = np.flatnonzero(table)
            yield pd.DataFrame({"lang": lang, "bucket": np.append(at, -1), "n": np.append(table[at], docs)})

    def run(frames):
        seen: dict[str, list] = {}
        for frame in frames:
            texts, langs = frame["text"].tolist(), frame["lang"].to_numpy(object)
            for a, b in chars.batches(texts):
                text, starts, has = _letters(texts[a:b])
                names, code = np.unique(langs[a:b].astype(str), return_inverse=True)
                for name, n in zip(names, np.bincount(code[has], minlength=len(names))):
                    seen.setdefault(name, [0, np.zeros(1 << bits, np.int64)])[0] += int(n)
                for gram, first in _grams(text, starts, bits, orders):
                    owner = np.repeat(np.where(has, code, -1), np.diff(first))
                    for i, name in enumerate(names):
                        seen[name][1] += np.bincount(gram[owner == i], minlength=1 << bits)
            if len(seen) > _FLUSH:
                yield from emit(seen)
                seen = {}
        yield from emit(seen)

    return run


def train(docs: DataFrame, text: str = "text", lang: str = "lang", bits: int = BITS,
          orders: tuple[int, ...] = ORDERS, max_languages: int = MAX_LANGUAGES) -> Model:
    """Learn from every row of ``docs`` whose language is known and whose text has a letter.

    Null or letterless texts and null languages teach nothing. More than ``max_languages`` languages raise an
    error: they bound the matrix. An empty table gives a model without languages.
    """
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    rows = rows.select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    counted = rows.mapInPandas(_count(bits, orders), "lang string, bucket long, n long")
    counted = common.staged(counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "langid")
    known = counted.where("bucket = -1 and n > 0").select("lang").limit(max_languages + 1).collect()
    if len(known) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    names = sorted(r[0] for r in known)
    code = {name: i for i, name in enumerate(names)}
    table = np.zeros((1 << bits, len(names)))
    docs_of = np.zeros(len(names))
    if names:  # at most max_languages * 2**bits rows
        got = counted.where(F.col("lang").isin(names)).toPandas()
        column = got["lang"].map(code).to_numpy()
        mark = (got["bucket"] < 0).to_numpy()
        docs_of[column[mark]] = got["n"][mark]
        table[got["bucket"][~mark], column[~mark]] = got["n"][~mark]
    weight = np.log(table + SMOOTHING) - np.log(table.sum(0) + SMOOTHING * len(table))
    prior = np.log(np.maximum(docs_of, 1) / max(docs_of.sum(), 1))
    return Model(names, np.rint(weight * _SCALE).astype(np.int32), np.rint(prior * _SCALE).astype(np.int64),
                 bits, orders)


def score_texts(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """The likeliest language of each text and its posterior probability; ties go to the first name."""
    text, starts, has = _letters(texts)
    total = np.tile(model.prior, (len(texts), 1))
    for gram, first in _grams(text, starts, model.bits, model.orders):
        some = np.flatnonzero(np.diff(first))
        for a in range(0, len(model.languages), 8):
            if len(some):
                part = model.weight[:, a : a + 8][gram]
                total[some, a : a + 8] += np.add.reduceat(part, first[some], axis=0, dtype=np.int64)
    if not model.languages:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    best = total.argmax(1)
    share = 1 / np.exp((total - total.max(1, keepdims=True)) / _SCALE).sum(1)
    names = [model.languages[i] if ok else UNKNOWN for i, ok in zip(best, has)]
    return names, np.where(has, share, 0.0)


def predict(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``lang_pred`` and ``score`` for every row of ``docs``, from the whole text alone.

    ``und`` with score 0 where the text is null or has no letter, or where no language was learned. Repeated
    rows are scored alike, one by one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(texts):
        names, scores = [], [np.zeros(0)]
        for a, b in chars.batches(texts):
            got = score_texts(shared.value, texts[a:b])
            names += got[0]
            scores.append(got[1])
        return names, np.concatenate(scores)

    return common.map_texts(docs, keep, text, "lang_pred string, score double", work)


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the rows that are not held out, then label every row: doc_id, held_out, lang_pred, score."""
    model = train(docs.where(~common.held_out("doc_id")))
    marked = docs.select("doc_id", "text", common.held_out("doc_id").alias("held_out"))
    return predict(marked, model, keep=("doc_id", "held_out"))
