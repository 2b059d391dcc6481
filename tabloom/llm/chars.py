"""Texts as arrays of code points: words, shingles and character n-grams without a Python loop per character.

All helpers take a list of texts and work on one concatenated ``uint32`` array. Callers feed them batches of
bounded size (`batches`), so memory does not grow with the table. One text is never cut: a longer text makes
its own batch.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np

BATCH_CHARS = 1 << 20
_POINTS = 0x110000
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)


@functools.cache
def letter_table() -> np.ndarray:
    """True where a code point is a letter in Unicode."""
    return np.fromiter((chr(i).isalpha() for i in range(_POINTS)), bool, _POINTS)


@functools.cache
def lower_table() -> np.ndarray:
    """The lower-case form of each code point, where that is one code point."""
    low = (chr(i).lower() for i in range(_POINTS))
    return np.fromiter((ord(c) if len(c) == 1 else i for i, c in enumerate(low)), np.uint32, _POINTS)


@functools.cache
def ascii_lower_table() -> np.ndarray:
    """A-Z to a-z, all else as it is."""
    table = np.arange(_POINTS, dtype=np.uint32)
    table[65:91] += 32
    return table


@functools.cache
def blank_word_table() -> np.ndarray:
    """True for characters of ``[^\\x20\\x09-\\x0D]+``."""
    table = np.ones(_POINTS, bool)
    table[[0x20, *range(0x09, 0x0E)]] = False
    return table


@functools.cache
def plain_word_table() -> np.ndarray:
    """True for characters of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``."""
    table = np.ones(_POINTS, bool)
    table[0x00:0x30] = table[0x3A:0x61] = table[0x7B:0x80] = False
    return table


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: nearby inputs give unrelated outputs."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


def seeds(n: int, seed: int = 0) -> np.ndarray:
    """``n`` fixed odd 64-bit numbers."""
    with np.errstate(over="ignore"):
        start = np.uint64(seed * 1_000_003 + 1) * _STEP
        return mix(start + np.arange(1, n + 1, dtype=np.uint64) * _STEP) | np.uint64(1)


def codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in a row, and where each text starts (one entry more than texts)."""
    parts = [t or "" for t in texts]
    starts = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=starts[1:])
    return np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32), starts


def batches(texts: Iterable[str | None], chars: int = BATCH_CHARS) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts with at most ``chars`` characters, or one longer text."""
    first = size = 0
    n = 0
    for n, text in enumerate(texts, 1):
        size += len(text or "")
        if size > chars and n - 1 > first:
            yield first, n - 1
            first, size = n - 1, len(text or "")
    if n > first:
        yield first, n


def words(text: np.ndarray, starts: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each word in ``text``, and the first word of each text (one entry more than texts).

    A word is an unbroken run of characters that are True in ``inside`` and belong to one text.
    """
    hit = inside[text]
    new = np.zeros(len(text) + 1, bool)
    new[starts] = True
    before = np.zeros(len(text), bool)
    before[1:] = hit[:-1]
    begin = np.flatnonzero(hit & (~before | new[:-1]))
    after = np.zeros(len(text), bool)
    after[:-1] = hit[1:]
    end = np.flatnonzero(hit & (~after | new[1:])) + 1
    return begin, end, np.searchsorted(begin, starts)


def hashes(text: np.ndarray, begin: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each slice, the same wherever the slice stands.

    A polynomial over the 64-bit integers, kept as prefix sums: the slice's own sum is scaled by a power that
    depends on its end alone, so that equal slices at different places agree, then mixed with the length.
    """
    if not len(begin):
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        base = seeds(1, seed + 17)[0]
        value = mix(text.astype(np.uint64) + np.uint64(seed + 1))
        lengths = end - begin
        power = np.ones(int(lengths.max()) + 1, np.uint64)
        power[1:] = np.cumprod(np.full(len(power) - 1, base, np.uint64))
        place = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        terms = value[np.repeat(begin, lengths) + place] * power[place]
        total = np.add.reduceat(terms, np.cumsum(lengths) - lengths)
        return mix(total + lengths.astype(np.uint64) * _STEP)


def shingles(word: np.ndarray, first: np.ndarray, size: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of ``size`` words within a text, and the first shingle of each text.

    A text with fewer words, but not none, has its whole sequence as one shingle. With enough words, shingle
    ``k`` of a text starts at its word ``k``.
    """
    n = np.diff(first)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    out_first = np.concatenate([[0], np.cumsum(count)]).astype(np.int64)
    if not out_first[-1]:
        return np.zeros(0, np.uint64), out_first
    at = np.repeat(first[:-1] - out_first[:-1], count) + np.arange(out_first[-1])
    length = np.minimum(np.repeat(n, count), size)
    factor = seeds(size, seed + 29)
    with np.errstate(over="ignore"):
        total = length.astype(np.uint64) * _STEP
        for k in range(size):
            live = k < length
            part = word[np.where(live, at + k, 0)] * factor[k]
            total = mix(total + np.where(live, part, np.uint64(0)))
    return total, out_first
