"""Runs: maximal stretches of words that repeat with a period, caught while words are appended.

Dyadic square catching. Level ``l`` cuts the stream into blocks of ``B = 2 ** l`` words. A completed block is a catcher: it
waits for its own words to come again at the distances this level answers for, ``2 B - 1`` to ``4 B - 2``. A stretch that
repeats at distance ``q`` for ``q`` words or more holds a whole block of ``q``'s level, so no square is missed, and
each appended word ends one window per level, which is alike to just two live catchers in distance. (Periods up to 6 need
less: a run has twelve words at least, so blocks of four catch periods 1 to 5 and blocks of two catch 6.) Where a catcher fires, the comparison goes on word by word to both sides, by halving steps over the fingerprints of
the levels; what still matches at the end of the stream stays open and is taken up with the next words. A stretch that
matches at distance ``q`` over ``q`` words or more is a square, and all squares of one stretch are one run.

Words are compared as numbers that stand for one word each; blocks are compared by 64-bit fingerprints, so two different
blocks of a text of a million words are taken for equal with a probability below 1e-6 in all. Memory is about 8 bytes a
word and level of the longest text of a batch.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm import chars, common

LEAST = 12
_GROW = 1 << 12
_FACTOR = chars.seeds(2, 41)


class SquareCatcher:
    """Finds runs of ``LEAST`` words or more in a stream of whole numbers.

    ``append`` takes any number of words at a time and returns the runs that became visible with them, as rows (start, end,
    period); a run may be returned again, longer, while it goes on. ``runs`` gives all maximal runs so far.
    ``longest`` bounds the length of a run, if it is known.
    """

    def __init__(self, longest: int | None = None):
        self.n = 0
        self.longest = longest
        self.levels: list[np.ndarray] = []
        self.open = np.zeros((0, 3), np.int64)  # distance, first and last place that matches, as [first, last)
        self.closed: list[np.ndarray] = []

    def append(self, words: Sequence[int] | np.ndarray) -> np.ndarray:
        words = np.asarray(words, np.int64)
        old, self.n = self.n, self.n + len(words)
        self._fingerprints(words, old)
        found = [self._go_on(self.open)]
        for level in range(1, len(self.levels)):
            found.append(self._catch(level, old))
        found = np.unique(np.concatenate(found), axis=0)
        at_end = found[:, 2] + found[:, 0] == self.n
        self.open = found[at_end]
        done = found[~at_end]
        self.closed.append(done[self._long(done)])
        return _runs(found[self._long(found)])

    def runs(self) -> np.ndarray:
        """(start, end, period) of every maximal run, by start and period; each has its smallest period."""
        return _runs(np.concatenate([*self.closed, self.open[self._long(self.open)]]))

    def _long(self, found: np.ndarray) -> np.ndarray:
        q = found[:, 0]
        return found[:, 2] - found[:, 1] + q >= np.maximum(LEAST, 2 * q)

    def _fingerprints(self, words: np.ndarray, old: int) -> None:
        while 1 << len(self.levels) <= self.n and (
                self.longest is None or (2 << len(self.levels)) - 1 <= max(self.longest // 2, 7)):
            self.levels.append(np.zeros(_GROW, np.uint64))  # before its first window ends
        with np.errstate(over="ignore"):
            for level in range(len(self.levels)):
                half = 1 << level >> 1
                start, stop = max(0, old - (1 << level) + 1), self.n - (1 << level) + 1
                if stop <= start:
                    continue
                if len(self.levels[level]) < stop:
                    more = np.zeros(max(stop, 2 * len(self.levels[level])), np.uint64)
                    more[:len(self.levels[level])] = self.levels[level]
                    self.levels[level] = more
                if not level:
                    self.levels[0][start:stop] = chars.mix(words.view(np.uint64) + _FACTOR[0])
                else:
                    below = self.levels[level - 1]
                    self.levels[level][start:stop] = chars.mix(
                        below[start:stop] * _FACTOR[1] + below[start + half:stop + half])

    def _catch(self, level: int, old: int) -> np.ndarray:
        """Stretches around the blocks of one level that one of the new windows repeats."""
        block, mark = 1 << level, self.levels[level]
        window = np.arange(max(0, old - block + 1), max(0, self.n - block + 1))
        if level == 1:  # blocks of two answer for distance 6 alone
            at = window[window % 2 == 0]
            pairs = [(at, at - 6)]
        else:
            last = (window - (2 * block - 1)) // block * block
            pairs = [(window, last), (window, last - block)]
            if level == 2:
                last = (window - 1) // block * block
                near = window - last == 1
                pairs += [(window, last), (window[near], last[near] - block)]
        hits = []
        for at, first in pairs:
            ok = first >= 0
            at, first = at[ok], first[ok]
            ok = mark[at] == mark[first]
            hits.append(np.stack([at[ok] - first[ok], first[ok]], 1))
        hits = np.concatenate(hits)
        if not len(hits):
            return np.zeros((0, 3), np.int64)
        hits = hits[np.lexsort((hits[:, 1], hits[:, 0]))]
        new = np.ones(len(hits), bool)
        new[1:] = (hits[1:, 0] != hits[:-1, 0]) | (hits[1:, 1] != hits[:-1, 1] + block)
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(hits)) - 1
        q, first, last = hits[head, 0], hits[head, 1], hits[tail, 1] + block
        first = self._back(q, first, level + 1)
        return np.stack([q, first, self._forth(q, last, level + 1)], 1)

    def _go_on(self, stretches: np.ndarray) -> np.ndarray:
        if not len(stretches):
            return stretches
        q, first, last = stretches.T
        return np.stack([q, first, self._forth(q, last, len(self.levels) - 1)], 1)

    def _forth(self, q: np.ndarray, at: np.ndarray, level: int) -> np.ndarray:
        """The end of the match at distance ``q`` from ``at`` on: whole steps of the highest level, then halving ones."""
        at = at.copy()
        level = min(level, len(self.levels) - 1)
        for k in range(level, -1, -1):
            live = np.arange(len(at))
            while len(live):
                live = live[at[live] + q[live] + (1 << k) <= self.n]
                live = live[self.levels[k][at[live]] == self.levels[k][at[live] + q[live]]]
                at[live] += 1 << k
                if k < level:
                    break
        return at

    def _back(self, q: np.ndarray, at: np.ndarray, level: int) -> np.ndarray:
        at = at.copy()
        level = min(level, len(self.levels) - 1)
        for k in range(level, -1, -1):
            live = np.arange(len(at))
            while len(live):
                live = live[at[live] >= 1 << k]
                before = at[live] - (1 << k)
                live = live[self.levels[k][before] == self.levels[k][before + q[live]]]
                at[live] -= 1 << k
                if k < level:
                    break
        return at


def _runs(found: np.ndarray) -> np.ndarray:
    """Stretches (distance, first, last) as runs; a stretch is also there at every multiple of its period."""
    runs = np.stack([found[:, 1], found[:, 2] + found[:, 0], found[:, 0]], 1)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    first = np.ones(len(runs), bool)
    first[1:] = (runs[1:, :2] != runs[:-1, :2]).any(1)
    runs = runs[first]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def runs_of(texts: Sequence[Sequence]) -> list[np.ndarray]:
    """(start, length, period) of every run of each word list.

    The lists go through one catcher, parted by numbers that occur once, so no run reaches from one into the next.
    """
    known: dict = {}
    parts, starts, n = [], [], 0
    for i, words in enumerate(texts):
        parts.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)))
        parts.append(np.array([-1 - i]))
        starts.append(n)
        n += len(words) + 1
    catcher = SquareCatcher(max(map(len, texts), default=0))
    if n:
        catcher.append(np.concatenate(parts))
    runs = catcher.runs()
    cut = np.searchsorted(runs[:, 0], [*starts, n])
    return [np.stack([runs[a:b, 0] - s, runs[a:b, 1] - runs[a:b, 0], runs[a:b, 2]], 1)
            for a, b, s in zip(cut[:-1], cut[1:], starts)]


def collapsed(words: Sequence, runs: np.ndarray) -> list:
    """The words outside the repeated part of every run: of a run, its first period stays."""
    if not len(runs):
        return list(words)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]


RUN = "struct<start: bigint, length: bigint, period: bigint>"


def find(docs: DataFrame, text: str = "text", alter: Callable[[object, list[bytes]], list[bytes]] | None = None,
         key: str = "doc_id") -> DataFrame:
    """``docs`` without ``text``, with ``n_words``, ``runs`` (an array of start, length, period) and ``collapsed``, the text
    with every run cut to its first period and words parted by one space.

    Words are ``[^\\x20\\x09-\\x0D]+``. ``alter`` may change the words of a row, given the value of ``key`` and the words as UTF-8.
    A row is answered alone, so repeated rows get the same answer. Null and blank texts have no words, no runs
    and an empty text. Columns of the input named like new ones are replaced. Nothing is shuffled.
    """
    made = ("n_words", "runs", "collapsed")
    keep = [c for c in docs.columns if c != text and c not in made]
    asked = F.col(key) if alter else F.lit(0)

    def work(rows: list[dict]) -> tuple:
        numbers, found, short = [], [], []
        for a, b in chars.batches([r["t"] for r in rows]):
            words = [(r["t"] or "").encode("utf-8", "surrogatepass").split() for r in rows[a:b]]
            if alter:
                words = [alter(r["k"], w) for r, w in zip(rows[a:b], words)]
            numbers += map(len, words)
            for w, runs in zip(words, runs_of(words)):
                found.append([{"start": s, "length": n, "period": q} for s, n, q in runs.tolist()])
                short.append(b" ".join(collapsed(w, runs)).decode("utf-8", "surrogatepass"))
        return numbers, found, short

    source = docs.select(*keep, F.struct(asked.alias("k"), F.col(text).alias("t")).alias("__in"))
    return common.map_texts(source, keep, "__in", f"n_words bigint, runs array<{RUN}>, collapsed string", work, rows=2000)
