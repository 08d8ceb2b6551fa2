"""Restricted recompression of word sequences: locally consistent phrases.

A round names pairs: every symbol falls on the left or the right side by a bit
of its name, and a left symbol followed by a right one becomes one new symbol,
whose name follows from the two names alone.  Names are therefore global: equal
pairs have equal names in every document and every task, with nothing to
exchange.  A pair longer than ``max_words`` stays unmerged.

Each symbol also carries its *evidence*: the interval of words that decides its
borders.  A window of words that holds the whole evidence of a symbol has the
same symbol at the same place in every document in which the window occurs.
"""

from __future__ import annotations

import numpy as np

from .textops import U, mix

ROUNDS = 3
MAX_WORDS = 8


def phrases(names: np.ndarray, doc: np.ndarray, rounds: int = ROUNDS, max_words: int = MAX_WORDS):
    """Symbols after the rounds: ``(name, length in words, evidence start, evidence end)``."""
    n = len(names)
    name, own = names, doc
    at, to = np.arange(n), np.arange(1, n + 1)  # words covered
    low, high = at.copy(), to.copy()  # evidence
    for level in range(rounds):
        if len(name) < 2:
            break
        right = (mix(name ^ U(0xA5A5A5A5 + level)) >> U(17)) & U(1) == U(1)
        length = to - at
        same = own[1:] == own[:-1]
        merge = ~right[:-1] & right[1:] & same & (length[:-1] + length[1:] <= max_words)
        # an unmerged left symbol rests on what follows it, a right one on what
        # precedes it; beyond the ends of a document lies no word, so no window
        # holds that evidence
        after = np.append(np.where(same, high[1:], n + 1000), n + 1000)
        before = np.concatenate([[-1000], np.where(same, low[:-1], -1000)])
        new_low = np.where(right, np.minimum(low, before), low)
        new_high = np.where(right, high, np.maximum(high, after))
        first = np.flatnonzero(merge)
        new_name, new_to = name.copy(), to.copy()
        new_name[first] = mix(mix(name[first] + U(level + 1)) + name[first + 1] * U(0x9FB21C651E98DF25))
        new_to[first] = to[first + 1]
        new_low[first] = np.minimum(low[first], low[first + 1])
        new_high[first] = np.maximum(high[first], high[first + 1])
        keep = np.ones(len(name), bool)
        keep[first + 1] = False
        name, own, at, to, low, high = new_name[keep], own[keep], at[keep], new_to[keep], new_low[keep], new_high[keep]
    return name, to - at, low, high


_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)


def _spans(names: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Name of each interval of words, from differences of one running polynomial sum."""
    power = np.multiply.accumulate(np.concatenate([[U(1)], np.full(len(names), U(_STEP))]))
    back = np.multiply.accumulate(np.concatenate([[U(1)], np.full(len(names), U(_BACK))]))
    total = np.concatenate([[U(0)], np.cumsum(mix(names) * power[:-1], dtype=U)])
    return mix((total[high] - total[low]) * back[low] + (high - low).astype(U))


def window_keys(names: np.ndarray, doc: np.ndarray, size: int, rounds: int = ROUNDS, max_words: int = MAX_WORDS):
    """For each window of ``size`` words, ``(start, key)``: the name of one phrase inside it.

    Of the phrases whose evidence lies in the window the one with the widest stands for it, named with
    the words of that evidence (ties: by name); a window that holds none is its own key.  Equal windows have equal
    keys wherever they are, so two documents that share a window share its key.
    """
    n = len(names) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U)
    name, length, low, high = phrases(names, doc, rounds, max_words)
    fits = high - low <= size
    name, length, low, high = name[fits], length[fits], low[fits], high[fits]
    # the evidence lies in the window as well: its words make the key rarer than the phrase's own
    weight = ((high - low).astype(U) << U(56)) | (mix(name ^ _spans(names, low, high)) >> U(8))
    best = np.zeros(n, U)
    for back in range(size):
        start = low - back
        ok = (start >= 0) & (start < n) & (high <= start + size)
        np.maximum.at(best, start[ok], weight[ok])
    starts = np.flatnonzero(doc[:n] == doc[size - 1 :])
    best = best[starts]
    bare = np.flatnonzero(best == 0)
    if len(bare):
        at = starts[bare]
        total = np.zeros(len(at), U)
        for i in range(size):
            total += mix(names[at + i] + U(i))
        best[bare] = mix(total) >> U(8)
    return starts, best
