"""Benchmark decontamination by a prefix-filtered set join.

A window of ten item words is a set of word shingles that a document must hold whole, so one shingle is prefix
enough: the rarest. (An item of one or two words is its own shingle.) Rarity is counted over all documents. A window with a shingle that no document has cannot occur
and goes. Documents give out the places of prefix shingles with the words around them; these meet the windows
in a join on the shingle, positions outside the document are cut off, and the words are compared one by one.

Nothing of the benchmark is broadcast but a Bloom filter of fixed size, which only saves shuffling: a
benchmark too large for it makes more candidate rows, not other results.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm import chars, common

WINDOW = 10
SHINGLE = 3
BLOOM_BITS = 23


def _words(texts: list[str | None]):
    """ASCII-lowered code points, word begins and ends, first word of each text, hashes of the words."""
    text, starts = chars.codes(texts)
    text = chars.ascii_lower_table()[text]
    begin, end, first = chars.words(text, starts, chars.plain_word_table())
    return text, begin, end, first, chars.hashes(text, begin, end)


def _spell(text: np.ndarray, begin: np.ndarray, end: np.ndarray) -> str:
    """The words of one stretch with single spaces."""
    return " ".join(text[b:e].tobytes().decode("utf-32-le", "surrogatepass") for b, e in zip(begin, end))


def _windows_of(size: int):
    def run(frames):
        for frame in frames:
            out = []
            texts, ids = frame["text"].tolist(), frame["item_id"].tolist()
            for a, b in chars.batches(texts):
                text, begin, end, first, _ = _words(texts[a:b])
                for i in range(b - a):
                    n = int(first[i + 1] - first[i])
                    for k in range(first[i], first[i] + (max(n - size, 0) + 1 if n else 0)):
                        stop = min(k + size, first[i + 1])
                        out.append((ids[a + i], _spell(text, begin[k:stop], end[k:stop]), int(stop - k)))
            yield pd.DataFrame(out, columns=["item_id", "window", "n"])

    return run


def _window_shingles(frames):
    for whole in frames:
        for size, frame in whole.groupby(whole["n"].clip(upper=SHINGLE)):
            *_, first, word = _words(frame["window"].tolist())
            grams, cut = chars.shingles(word, first, int(size))
            count = np.diff(cut)
            yield pd.DataFrame({"window": np.repeat(frame["window"].to_numpy(object), count),
                                "n": np.repeat(frame["n"].to_numpy(), count),
                                "place": np.arange(len(grams)) - np.repeat(cut[:-1], count),
                                "shingle": grams.view(np.int64)})


def bloom(keys: DataFrame, bits: int = BLOOM_BITS) -> np.ndarray:
    """A Bloom filter of ``2 ** bits`` bits over the 64-bit column ``shingle``, as 64-bit words."""
    spots = F.explode(F.array(*[F.shiftrightunsigned("shingle", 64 - bits * k).bitwiseAND(F.lit((1 << bits) - 1))
                                for k in (1, 2)])).alias("spot")  # the hashes are mixed, so their bits serve as they are
    words = keys.select(spots).select(F.shiftright("spot", 6).alias("w"), F.expr("shiftleft(1L, int(spot & 63))").alias("b"))
    got = words.groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()  # at most 2 ** (bits - 6) rows
    out = np.zeros(1 << (bits - 6), np.int64)
    out[got["w"].to_numpy(np.int64)] = got["b"].to_numpy(np.int64)
    return out.view(np.uint64)


def _maybe(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    bits = int(np.log2(len(table))) + 6
    hit = np.ones(len(keys), bool)
    for k in (1, 2):
        spot = (keys >> np.uint64(64 - bits * k)) & np.uint64((1 << bits) - 1)
        hit &= (table[(spot >> np.uint64(6)).astype(np.int64)] >> (spot & np.uint64(63)) & np.uint64(1)) == 1
    return hit


def _frequency(table, sizes: list[int]):
    def run(frames):
        for frame in frames:
            texts = frame["text"].tolist()
            for a, b in chars.batches(texts):
                *_, first, word = _words(texts[a:b])
                for size in sizes:
                    grams, cut = chars.shingles(word, first, size)
                    hit = _maybe(table.value, grams)
                    owner = np.repeat(np.arange(b - a), np.diff(cut))[hit]
                    pair = np.unique(np.rec.fromarrays([owner, grams[hit]]))
                    key, n = np.unique(pair.f1, return_counts=True)
                    yield pd.DataFrame({"shingle": key.view(np.int64), "n": n})

    return run


def _places(table, sizes: list[int], size: int):
    """Number of words of each text, and the places of possible prefix shingles with the words around them."""

    def work(texts):
        counts, found = [np.zeros(0, np.int64)], []
        for a, b in chars.batches(texts):
            text, begin, end, first, word = _words(texts[a:b])
            counts.append(np.diff(first))
            rows: list[list[tuple]] = [[] for _ in range(b - a)]
            for width in sizes:
                grams, cut = chars.shingles(word, first, width)
                at = np.flatnonzero(_maybe(table.value, grams))
                for k, i in zip(at, np.searchsorted(cut, at, side="right") - 1):
                    place = int(k - cut[i])
                    low = first[i] + max(place - size + 1, 0)
                    high = min(first[i] + place + size, first[i + 1])
                    rows[i].append((place, int(grams[k].view(np.int64)), int(first[i] + place - low),
                                    _spell(text, begin[low:high], end[low:high])))
            found += rows
        return np.concatenate(counts), found

    return work


def find(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """n_words, n_hit, n_items, items_sha256 and contaminated beside doc_id for every row of ``docs`` (doc_id, text).

    ``items`` has item_id and text. Null and wordless texts have no words and no windows. Rows that repeat an id and a
    text are found alike. Items that share an id count once; an item without an id marks words and is
    not counted. Without items nothing is contaminated; the digest of no items is that of the empty text.
    """
    sc = docs.sparkSession.sparkContext
    windows = items.select(F.col("item_id").cast("string").alias("item_id"), "text").mapInPandas(
        _windows_of(size), "item_id string, window string, n long")
    windows = common.staged(windows.distinct(), "windows")
    grams = windows.select("window", "n").distinct().mapInPandas(
        _window_shingles, "window string, n long, place long, shingle long")
    grams = common.staged(grams, "shingles")
    sizes = sorted(r[0] for r in grams.select(F.least("n", F.lit(SHINGLE))).distinct().collect())  # at most SHINGLE
    texts = docs.select("text").where("text is not null")
    every = sc.broadcast(bloom(grams.select("shingle")))
    often = texts.mapInPandas(_frequency(every, sizes), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("df"))
    rarity = F.struct(F.coalesce("df", F.lit(0)).alias("df"), "shingle", "place")
    prefix = grams.join(often, "shingle", "left").groupBy("window", "n").agg(F.min(rarity).alias("r"))
    prefix = prefix.where("r.df > 0").select("window", "n", "r.shingle", F.col("r.place").alias("shift"))
    prefix = common.staged(prefix, "prefix")
    first = sc.broadcast(bloom(prefix.select("shingle")))

    keyed = docs.select("doc_id", common.row_key("doc_id", "text").alias("row_key"), "text")
    places = common.staged(common.map_texts(
        keyed, ["doc_id", "row_key"], "text",
        "n_words long, found array<struct<place: long, shingle: long, before: long, around: string>>",
        _places(first, sizes, size)), "places")
    seen = places.select("row_key", F.inline("found")).join(prefix, "shingle")
    seen = seen.where("before >= shift").select(
        "row_key", "window", "n", (F.col("place") - F.col("shift")).alias("start"),
        F.expr("concat_ws(' ', slice(split(around, ' '), int(before - shift + 1), int(n)))").alias("there"))
    seen = common.staged(seen.where("there = window").select("row_key", "window", "n", "start"), "hits")

    spans = seen.groupBy("row_key").agg(F.sort_array(F.collect_set(F.struct("start", "n"))).alias("spans"))
    spans = spans.select("row_key", F.expr(
        "aggregate(spans, named_struct('upto', 0L, 'hit', 0L), (s, x) -> named_struct("
        "'upto', greatest(s.upto, x.start + x.n), 'hit', s.hit + greatest(0L, x.start + x.n - greatest(s.upto, x.start)))"
        ", s -> s.hit)").alias("n_hit"))
    of = seen.select("row_key", "window").distinct().join(windows.where("item_id is not null").drop("n"), "window")
    of = of.groupBy("row_key").agg(F.array_sort(F.collect_set("item_id")).alias("ids"))
    out = places.drop("found").join(spans, "row_key", "left").join(of, "row_key", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"),
        F.when(F.col("ids").isNull(), 0).otherwise(F.size("ids")).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("ids", ","), F.lit("")), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` without a contaminated word, with their own columns only.

    Rows are told apart by id and text; those that repeat both stay or go together.
    """
    marked = find(docs.select(common.row_key("doc_id", "text").alias("doc_id"), "text"), items, size)
    bad = marked.where("contaminated").select(F.col("doc_id").alias("__key")).distinct()
    whole = docs.select(F.struct("*").alias("__row"), common.row_key("doc_id", "text").alias("__key"))
    return whole.join(bad, "__key", "left_anti").select("__row.*")
