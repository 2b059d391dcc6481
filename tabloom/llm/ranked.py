"""Ranked lexical search with range-maximum sparse tables over posting lists.

Documents are indexed in shards of bounded size, which need nothing but the documents of one task and the statistics of
the corpus. A shard holds one posting list per term that is asked, with the term's impact on each document, and over
every list a sparse table: the place of the largest impact in each window of a power-of-two length, so the largest impact
in any range of documents takes two look-ups. An item is answered best first: an interval of documents is bounded
by the sum of its lists' range maxima; the intervals with the highest bounds are split at the document of the largest
single impact, which is scored in full, and the two sides get bounds of their own. What is bounded below the
k-th best score so far is never looked at. Intervals with few postings left are scored outright.

Each task keeps its best k documents per item over all its shards, so later shards start with a high bar, and
these few rows are all that is shuffled. Scores are whole numbers, so results do not depend on the order of sums.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm import chars, common

K = 10
SHARD_DOCS = 1 << 14
SHARD_POSTINGS = 1 << 22
ITEM_BLOCK = 10_000
WIDE = 32
LEAF = 8
SALTS = 64


def terms(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the terms of all texts in a row, and the first term of each text (one entry more than texts)."""
    text, starts = chars.codes(texts)
    text = chars.ascii_lower_table()[text]
    begin, end, first = chars.words(text, starts, chars.plain_word_table())
    return chars.hashes(text, begin, end), first


def weight(n_docs: int, df: int) -> int:
    """How much a term that ``df`` of ``n_docs`` documents hold counts."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(w: np.ndarray, tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What ``tf`` occurrences of a term of weight ``w`` add to the score of a document of ``n`` terms."""
    m = 100 - 75 + (75 * n * n_docs) // n_terms
    return w * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


class Shard:
    """Posting lists of ``n_docs`` documents: ``doc``, ``term`` and ``impact`` of each posting, in any order."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, n_docs: int, n_terms: int):
        size = np.bincount(term, minlength=n_terms)
        by_size = np.argsort(-size, kind="stable")  # long lists first, so each level of the tables is a prefix
        self.rank = np.empty(n_terms, np.int64)
        self.rank[by_size] = np.arange(n_terms)
        self.first = np.concatenate([[0], np.cumsum(size[by_size])]).astype(np.int64)
        key = self.rank[term] * n_docs + doc
        order = np.argsort(key, kind="stable")
        self.key, self.doc, self.impact = key[order], doc[order], impact[order]
        self.n_docs, self.n_terms = n_docs, n_terms
        arg = np.arange(len(order), dtype=np.int32)
        levels, base = [arg], [0]
        while True:
            width = 1 << len(levels)
            stop = self.first[np.searchsorted(-size[by_size], -width, side="right")] - width + 1
            if stop <= 0:
                break
            a, b = arg[:stop], arg[width // 2:width // 2 + stop]
            base.append(base[-1] + len(arg))
            arg = np.where(self.impact[a] >= self.impact[b], a, b)
            levels.append(arg)
        self.arg, self.base = np.concatenate(levels), np.array(base, np.int64)

    def best(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Place of the largest impact among the postings ``lo`` to ``hi`` of one list, for many ranges at once."""
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        a = self.arg[self.base[level] + lo]
        b = self.arg[self.base[level] + hi - (1 << level.astype(np.int64))]
        return np.where(self.impact[a] >= self.impact[b], a, b)

    def search(self, term: np.ndarray, times: np.ndarray, k: int, bar: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of the best ``k`` and some more; of scores below ``bar`` some may be left out.

        ``times`` says how often the item has each term.
        """
        rank = self.rank[term]
        lo, hi = self.first[rank], self.first[rank + 1]
        some = hi > lo
        rank, lo, hi, times = rank[some], lo[some], hi[some], times[some]
        found = np.zeros((2, 0), np.int64)
        if not len(rank):
            return found[0], found[1]
        pool = _Intervals(self, np.zeros(len(rank), np.int64), rank, lo, hi, times)
        wide = WIDE
        while True:
            if found.shape[1] > k:
                found = found[:, np.argpartition(-found[1], k - 1)]
                bar = max(bar, int(found[1, k - 1]))
                found = found[:, found[1] >= bar]
            pool = pool.at_least(max(bar, 1))
            if not len(pool.bound):
                return found[0], found[1]
            chosen, pool = pool.highest(wide)
            wide *= 2
            few = chosen.postings <= LEAF * chosen.lists
            new = [chosen.where(few).scored()]
            chosen = chosen.where(~few)
            if len(chosen.bound):
                scored, children = chosen.split()
                new.append(scored)
                pool = pool.joined(children)
            found = np.concatenate([found, *new], axis=1)


class _Intervals:
    """Intervals of documents, each as the ranges of its posting lists: ``owner`` is ascending and tells whose range it is."""

    def __init__(self, shard: Shard, owner, rank, lo, hi, times, value=None, place=None):
        self.shard = shard
        self.owner, self.rank, self.lo, self.hi, self.times = owner, rank, lo, hi, times
        self.place = shard.best(lo, hi) if place is None else place
        self.value = shard.impact[self.place] * times if value is None else value
        new = np.ones(len(owner), bool)
        new[1:] = owner[1:] != owner[:-1]
        self.head = np.flatnonzero(new)
        self.owner = np.cumsum(new) - 1
        self.lists = np.diff(self.head, append=len(owner))
        self.bound = self._sum(self.value)
        self.postings = self._sum(hi - lo)

    def _sum(self, x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x, self.head) if len(x) else np.zeros(0, np.int64)

    def where(self, which: np.ndarray) -> _Intervals:
        own = which[self.owner]
        return _Intervals(self.shard, self.owner[own], self.rank[own], self.lo[own], self.hi[own], self.times[own],
                          self.value[own], self.place[own])

    def at_least(self, bar: int) -> _Intervals:
        return self if not len(self.bound) or self.bound.min() >= bar else self.where(self.bound >= bar)

    def highest(self, n: int) -> tuple[_Intervals, _Intervals]:
        if len(self.bound) <= n:
            return self, self.where(np.zeros(len(self.bound), bool))
        chosen = np.zeros(len(self.bound), bool)
        chosen[np.argpartition(-self.bound, n - 1)[:n]] = True
        return self.where(chosen), self.where(~chosen)

    def joined(self, other: _Intervals) -> _Intervals:
        both = [np.concatenate(p) for p in zip(
            (self.rank, self.lo, self.hi, self.times, self.value, self.place),
            (other.rank, other.lo, other.hi, other.times, other.value, other.place))]
        owner = np.concatenate([self.owner, other.owner + len(self.bound)])
        return _Intervals(self.shard, owner, *both)

    def scored(self) -> np.ndarray:
        """Every document of the intervals that has a posting here, with its score."""
        if not len(self.bound):
            return np.zeros((2, 0), np.int64)
        size = self.hi - self.lo
        at = np.repeat(self.lo - (np.cumsum(size) - size), size) + np.arange(size.sum())
        doc = self.shard.doc[at]
        order = np.argsort(doc, kind="stable")  # intervals do not overlap, so a document is in one of them
        part = (self.shard.impact[at] * np.repeat(self.times, size))[order]
        doc = doc[order]
        head = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        return np.stack([doc[head], np.add.reduceat(part, head)])

    def split(self) -> tuple[np.ndarray, _Intervals]:
        """The document of the largest single impact of each interval with its score, and what is left of both sides."""
        top = np.maximum.reduceat(self.value, self.head)
        first = np.flatnonzero(self.value == top[self.owner])
        first = first[np.append(True, self.owner[first[1:]] != self.owner[first[:-1]])]
        doc = self.shard.doc[self.place[first]]
        at = np.searchsorted(self.shard.key, self.rank * self.shard.n_docs + doc[self.owner])
        safe = np.minimum(at, len(self.shard.doc) - 1)
        has = (at < self.hi) & (self.shard.doc[safe] == doc[self.owner])
        score = self._sum(np.where(has, self.shard.impact[safe] * self.times, 0))
        owner = np.concatenate([2 * self.owner, 2 * self.owner + 1])
        lo, hi = np.concatenate([self.lo, at + has]), np.concatenate([at, self.hi])
        some = np.flatnonzero(hi > lo)
        some = some[np.argsort(owner[some], kind="stable")]
        rank, times = np.tile(self.rank, 2)[some], np.tile(self.times, 2)[some]
        return np.stack([doc, score]), _Intervals(self.shard, owner[some], rank, lo[some], hi[some], times)


def _shards(batches) -> Iterator[tuple]:
    """Bounded groups of the postings of a task: ids and lengths of documents, and document, term and count of each posting."""
    ids, sizes, doc, term, tf, n = [], [], [], [], [], 0
    for batch in batches:
        key, size, own, times = batch.columns
        count = np.diff(own.offsets.to_numpy())
        ids.append(key)
        sizes.append(size.to_numpy())
        doc.append(np.repeat(np.arange(n, n + len(count)), count))
        n += len(count)
        term.append(own.flatten().to_numpy())
        tf.append(times.flatten().to_numpy())
        if n >= SHARD_DOCS or sum(map(len, doc)) >= SHARD_POSTINGS:
            yield ids, *map(np.concatenate, (sizes, doc, term, tf))
            ids, sizes, doc, term, tf, n = [], [], [], [], [], 0
    if n:
        yield ids, *map(np.concatenate, (sizes, doc, term, tf))


def _counted(texts: list[str | None]):
    """Distinct terms of each text and how often it has each, as two lists of arrays."""
    found, times = [], []
    for a, b in chars.batches(texts):
        term, first = terms(texts[a:b])
        for i, j in zip(first[:-1], first[1:]):
            own, n = np.unique(term[i:j], return_counts=True)
            found.append(own.view(np.int64))
            times.append(n)
    return found, times


def _postings(vocabulary):
    """Number of terms of each text, and place in the vocabulary and count of each of its terms that is asked."""

    def work(texts: list[str | None]):
        sizes, own, times = [], [], []
        asked = vocabulary.value
        for a, b in chars.batches(texts):
            term, first = terms(texts[a:b])
            size = np.diff(first)
            at = np.searchsorted(asked, term)
            hit = np.flatnonzero(asked[np.minimum(at, len(asked) - 1)] == term) if len(asked) else np.zeros(0, np.int64)
            pair, n = np.unique(np.repeat(np.arange(b - a), size)[hit] * len(asked) + at[hit], return_counts=True)
            cut = np.searchsorted(pair, np.arange(1, b - a) * len(asked))
            sizes.append(size)
            own += np.split((pair % max(len(asked), 1)).astype(np.int32), cut)
            times += np.split(n.astype(np.int32), cut)
        return np.concatenate([np.zeros(0, np.int64), *sizes]), own, times

    return work


def _searched(shared, k: int):
    """The best ``k`` documents of a task for each item."""

    def run(batches):
        items, w, n_docs, n_terms = shared.value
        best: list[list[tuple]] = [[] for _ in items]
        kind = None
        for ids, size, doc, term, tf in _shards(batches):
            ids = pa.chunked_array(ids).combine_chunks()
            kind = ids.type
            order = np.empty(len(ids), np.int64)
            order[pa.compute.sort_indices(ids, null_placement="at_start").to_numpy()] = np.arange(len(ids))
            tf = tf.astype(np.int64)
            shard = Shard(doc, term, impacts(w[term], tf, size[doc], n_docs, n_terms), len(size), len(w))
            for own, (_, asked, times) in zip(best, items):
                found, score = shard.search(asked, times, k, own[-1][0] if len(own) == k else 0)
                first = np.lexsort((order[found], -score))[:k]
                new = zip(score[first].tolist(), ids.take(pa.array(found[first])).to_pylist())
                own += [(s, key is not None, key) for s, key in new]
                own.sort(key=lambda r: (-r[0], r[1], r[2] if r[1] else 0))
                del own[k:]
        for a in range(0, len(items), 1000):
            rows = [(no, key, s) for (no, *_), own in zip(items[a:a + 1000], best[a:a + 1000]) for s, _, key in own]
            if rows:
                no, key, s = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(no, pa.int64()), pa.array(key, kind), pa.array(s, pa.int64())], ["item_no", "key", "score"])

    return run


def _rank_block(docs: DataFrame, items: DataFrame, text: str, k: int) -> DataFrame | None:
    """(item_no, key, score): the best documents of each task for a block of items; nothing if no text has a term."""
    context = docs.sparkSession.sparkContext
    rows = common.map_texts(items, ["item_no"], "text", "term array<bigint>, times array<bigint>", _counted).toArrow()
    asked = [np.array(t, np.int64).view(np.uint64) for t in rows["term"].to_pylist()]
    vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *asked]))
    postings = common.map_texts(docs, ["key"], text, "n bigint, term array<int>, tf array<int>",
                                _postings(context.broadcast(vocabulary)))
    postings = common.staged(postings.where("n > 0"), "postings")
    n_docs, n_terms = postings.agg(F.count("*"), F.sum("n")).first()
    if not n_docs:
        return None
    df = np.zeros(len(vocabulary), np.int64)  # a row per term that is asked
    held = postings.select(F.explode("term").alias("term")).groupBy("term").count().toArrow()
    df[held["term"].to_numpy()] = held["count"].to_numpy()
    w = np.array([weight(n_docs, int(x)) for x in df], np.int64)
    own = [(no, np.searchsorted(vocabulary, t), np.array(n, np.int64))
           for no, t, n in zip(rows["item_no"].to_pylist(), asked, rows["times"].to_pylist())]
    schema = f"item_no bigint, key {postings.schema['key'].dataType.simpleString()}, score bigint"
    return postings.mapInArrow(_searched(context.broadcast((own, w, n_docs, n_terms)), k), schema)


def rank(docs: DataFrame, items: DataFrame, k: int = K, key: str = "doc_id", item: str = "item_id",
         text: str = "text", block: int = ITEM_BLOCK) -> DataFrame:
    """item, rank (from 1), ``key`` and score of the ``k`` best documents of each item with a score above 0.

    Every row of ``docs`` is ranked: rows that repeat are documents of their own, and equal scores go by ascending key, null
    first. Rows of ``items`` that repeat id and text are one item. A null text has no terms; an item without terms,
    or without a document that holds one, has no rows. Items are taken ``block`` at a time: their terms, never the
    documents', are held by the driver and each task. Other columns are not read.
    """
    asked = items.select(F.col(item).alias("item"), F.col(text).alias("text")).distinct()
    asked = common.staged(asked.withColumn("item_no", F.monotonically_increasing_id()), "items")
    blocks = -(-asked.count() // block)
    docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    parts = [_rank_block(docs, asked.where(F.pmod(F.xxhash64("item_no"), F.lit(blocks)) == i), "text", k)
             for i in range(blocks)]
    hits = docs.sparkSession.createDataFrame([], f"item_no bigint, key {docs.schema['key'].dataType.simpleString()}, score bigint")
    for part in parts:
        hits = hits if part is None else hits.unionByName(part)
    order = [F.desc("score"), F.asc("key")]
    salted = Window.partitionBy("item_no", F.pmod(F.xxhash64("key"), F.lit(SALTS))).orderBy(*order)
    hits = hits.withColumn("rank", F.row_number().over(salted)).where(F.col("rank") <= k)
    hits = hits.withColumn("rank", F.row_number().over(Window.partitionBy("item_no").orderBy(*order)))
    return hits.where(F.col("rank") <= k).join(asked.drop("text"), "item_no").select(
        F.col("item").alias(item), "rank", F.col("key").alias(key), "score")


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TERMS = f"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}')"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, {_TERMS} AS terms FROM documents),
  s AS (SELECT count(*) AS n_docs, sum(len(terms)) :: BIGINT AS n_terms FROM d WHERE len(terms) > 0),
  i AS (SELECT row_number() OVER () AS item_no, item_id, {_TERMS} AS terms FROM (SELECT DISTINCT item_id, text FROM benchmark)),
  q AS (SELECT item_no, term, count(*) AS times FROM (SELECT item_no, unnest(terms) AS term FROM i) GROUP BY ALL),
  p AS (SELECT rn, doc_id, n, term, count(*) AS tf
        FROM (SELECT rn, doc_id, len(terms) AS n, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
  w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) :: BIGINT AS w FROM p, s GROUP BY term, n_docs),
  g AS (SELECT rn, doc_id, term,
          w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * n_docs) // n_terms))) AS gain
        FROM p JOIN w USING (term), s),
  t AS (SELECT item_no, rn, doc_id, sum(times * gain) :: BIGINT AS score FROM q JOIN g USING (term) GROUP BY ALL),
  r AS (SELECT item_no, doc_id, score,
          (row_number() OVER (PARTITION BY item_no ORDER BY score DESC, doc_id NULLS FIRST)) :: INTEGER AS rank
        FROM t WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r JOIN i USING (item_no) WHERE rank <= {K}
"""
