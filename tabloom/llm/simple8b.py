"""Simple-8b: whole numbers packed into 64-bit words.

The upper four bits of a word are its selector. Selectors 1 to 14 pack 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2 or 1 values
of equal width, the first value in the lowest bits. Selector 0 is a run: a 28-bit count and a 32-bit value.
Selector 15 is an escape: the value needs more than 60 bits and stands as it is in a tail behind the words, at
the place the payload names. A word holds as many values as fit, chosen greedily. Values left over in the last word are
zeros that the reader cuts off, because it knows how many values there are.
"""

from __future__ import annotations

import numpy as np

# How many values a word of selectors 1 to 14 holds, and the width of each.
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
WIDTHS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
RUN, ESCAPE = 0, 15
_PAYLOAD = np.uint64((1 << 60) - 1)
_RUN_MOST = (1 << 28) - 1
_U = np.uint64


def _bits(values: np.ndarray) -> np.ndarray:
    """Bits of each value, from 1 to 61; the largest of some widths may count one more, which only costs room."""
    return np.clip(np.frexp(values.astype(np.float64))[1], 1, 61).astype(np.uint8)


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, tail) of an array of unsigned 64-bit numbers; the tail holds what needs an escape."""
    values = np.asarray(values, np.uint64)
    n = len(values)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    padded = np.concatenate([values, np.zeros(60, np.uint64)])
    widest, size = np.concatenate([_bits(values), np.zeros(60, np.uint8)]), 1
    best = ESCAPE - (widest[:n] <= 60).view(np.uint8)
    for selector in range(13, 0, -1):  # windows grow: the widest value of each comes from two shorter windows
        count = COUNTS[selector - 1]
        widest = np.maximum(widest[:len(widest) - (count - size)], widest[count - size:])
        size = count
        best -= (widest[:n] <= WIDTHS[selector - 1]).view(np.uint8)  # what fits in a word fits in each with fewer places
    step = np.array([1, *COUNTS, 1], np.int64)[best]
    change = np.flatnonzero(np.append(values[1:] != values[:-1], True))
    if len(change) < n:
        left = np.arange(n, 0, -1)
        run = np.repeat(change, np.diff(change, prepend=-1)) + 1 - np.arange(n)
        runs = (run > np.minimum(step, left)) & (run > 1) & (values >> _U(32) == 0)
        best[runs], step[runs] = RUN, np.minimum(run[runs], _RUN_MOST)
    jump, at, i = step.tolist(), [], 0
    while i < n:
        at.append(i)
        i += jump[i]
    at = np.array(at, np.int64)
    kind = best[at]
    words = kind.astype(np.uint64) << _U(60)
    for selector in range(1, 15):
        here = np.flatnonzero(kind == selector)
        if len(here):
            count, width = COUNTS[selector - 1], WIDTHS[selector - 1]
            shift = np.arange(count, dtype=np.uint64) * _U(width)
            words[here] |= np.bitwise_or.reduce(padded[at[here][:, None] + np.arange(count)] << shift, axis=1)
    here = np.flatnonzero(kind == RUN)
    words[here] |= step[at[here]].astype(np.uint64) << _U(32) | values[at[here]]
    here = np.flatnonzero(kind == ESCAPE)
    words[here] |= np.arange(len(here), dtype=np.uint64)
    return words, values[at[here]]


def decode(words: np.ndarray, tail: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` values of ``encode``; every selector's words are unpacked at once."""
    kind = (words >> _U(60)).astype(np.int64)
    load = words & _PAYLOAD
    count = np.array([0, *COUNTS, 1], np.int64)[kind]
    here = np.flatnonzero(kind == RUN)
    count[here] = (load[here] >> _U(32)).astype(np.int64)
    start = np.cumsum(count) - count
    total = int(count.sum())
    if not n <= total < n + 60:
        raise ValueError(f"{total} values are packed, {n} are asked for")
    out = np.zeros(total, np.uint64)
    for selector in range(1, 15):
        here = np.flatnonzero(kind == selector)
        if len(here):
            size, width = COUNTS[selector - 1], WIDTHS[selector - 1]
            shift = np.arange(size, dtype=np.uint64) * _U(width)
            out[start[here][:, None] + np.arange(size)] = load[here][:, None] >> shift & _U((1 << width) - 1)
    here = np.flatnonzero(kind == RUN)
    if len(here):
        size = count[here]
        place = np.repeat(start[here] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        out[place] = np.repeat(load[here] & _U(0xFFFFFFFF), size)
    here = np.flatnonzero(kind == ESCAPE)
    out[start[here]] = tail[load[here].astype(np.int64)]
    return out[:n]
