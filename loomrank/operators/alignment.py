"""Global alignment of many pairs of sequences at once, in numpy.

Scores, matches and columns are packed in one integer, so that a maximum is the best
score, of those the most matches, of those the fewest columns.  A row of the table is
worked out for all pairs and columns together: what a run of gaps along the row
brings is a running maximum.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

_K = 1 << 20
_LOW = -(1 << 62)
#: cells of a table held at once
CELLS = 1 << 21


def _codes(seqs: Sequence[str], width: int) -> np.ndarray:
    out = np.zeros((len(seqs), width), np.uint32)
    for i, s in enumerate(seqs):
        out[i, : len(s)] = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)
    return out


def _chunks(a: Sequence[str], b: Sequence[str], layers: int) -> Iterator[list[int]]:
    """Pairs of like size, so many that their tables stay below ``CELLS``."""
    order = sorted(range(len(a)), key=lambda i: (len(a[i]), len(b[i])))
    part: list[int] = []
    wide = 0
    for i in order:
        size = (max(wide, len(b[i])) + 1) * ((len(a[i]) + 1) if layers > 1 else 1) * layers
        if part and size * (len(part) + 1) > CELLS:
            yield part
            part, wide = [], 0
        part.append(i)
        wide = max(wide, len(b[i]))
    if part:
        yield part


def global_matches(a: Sequence[str | None], b: Sequence[str | None], match: int = 2, mismatch: int = -1, gap: int = -2) -> list[tuple[int, int] | None]:
    """``(matches, columns)`` of a best alignment with linear gaps; of best ones that with most matches, then fewest columns.

    None where a side is missing or both are empty.
    """
    out: list[tuple[int, int] | None] = [None] * len(a)
    some = [i for i in range(len(a)) if a[i] is not None and b[i] is not None and (a[i] or b[i])]
    one = gap * _K * _K - 1  # a gap: its score, no match, one column
    for part in _chunks([a[i] for i in some], [b[i] for i in some], 1):
        rows = [some[p] for p in part]
        n, m = (np.array([len(s[i]) for i in rows]) for s in (a, b))
        x, y = _codes([a[i] for i in rows], n.max()), _codes([b[i] for i in rows], m.max())
        steps = one * np.arange(m.max() + 1, dtype=np.int64)
        row = np.repeat(steps[None], len(rows), 0)
        best = row[np.arange(len(rows)), m].copy()
        for i in range(1, n.max() + 1):
            same = x[:, i - 1 : i] == y
            new = row + one
            new[:, 1:] = np.maximum(new[:, 1:], row[:, :-1] + np.where(same, match * _K * _K + _K - 1, mismatch * _K * _K - 1))
            row = np.maximum.accumulate(new - steps, 1) + steps
            ended = n == i
            best[ended] = row[np.flatnonzero(ended), m[ended]]
        columns = -best % _K
        matches = (best + columns) // _K % _K
        for i, k, c in zip(rows, matches.tolist(), columns.tolist(), strict=True):
            out[i] = k, c
    return out


def global_identities(a: Sequence[str | None], b: Sequence[str | None], match: int = 2, mismatch: int = -1, gap: int = -2) -> list[float | None]:
    """Matches over columns of :func:`global_matches`; None where a side is missing or both are empty."""
    return [None if found is None else found[0] / found[1] for found in global_matches(a, b, match, mismatch, gap)]


def global_identity(a: str | None, b: str | None, match: int = 2, mismatch: int = -1, gap: int = -2) -> float | None:
    return global_identities([a], [b], match, mismatch, gap)[0]


def fit_targets(chains: Sequence[str], targets: Sequence[str], match: float = 2, mismatch: float = -1, opening: float = -2, extending: float = -0.5, places: bool = False) -> list[tuple]:
    """Whole targets in chains, with affine gaps: ``(score, matches[, matched])``.

    Residues of the chain before and behind the target cost nothing; a gap costs
    ``opening`` for its first place and ``extending`` for each further one.  Of
    alignments of the best score one of most matches is taken; ``matched`` lists
    the target's places (from 0) that meet an equal residue in it.
    """
    half = 2 * _K  # scores are multiples of one half
    hit, miss, first, more = (int(v * half) for v in (match, mismatch, opening, extending))
    hit += 1
    out: list[tuple] = [()] * len(chains)
    for part in _chunks(chains, targets, 3 if places else 1):
        n, m = (np.array([len(s[i]) for i in part]) for s in (chains, targets))
        x, y = _codes([chains[i] for i in part], n.max()), _codes([targets[i] for i in part], m.max())
        steps = more * np.arange(m.max() + 1, dtype=np.int64)
        shape = (len(part), m.max() + 1)

        def along(start: np.ndarray) -> np.ndarray:
            """Best ending in a run of target residues without a partner."""
            run = np.full(shape, _LOW, np.int64)
            run[:, 1:] = np.maximum.accumulate(start - steps, 1)[:, :-1] + steps[:-1] + first
            return run

        pair, down = np.full(shape, _LOW, np.int64), np.full(shape, _LOW, np.int64)
        pair[:, 0] = 0
        side = along(pair)
        table = [(pair, down, side)]
        best = np.maximum(pair, side)[np.arange(len(part)), m]
        where = np.zeros(len(part), np.int64)
        for i in range(1, n.max() + 1):
            any_ = np.maximum(np.maximum(pair, down), side)
            new_down = np.maximum(np.maximum(pair, side) + first, down + more)
            new_pair = np.full(shape, _LOW, np.int64)
            new_pair[:, 1:] = any_[:, :-1] + np.where(x[:, i - 1 : i] == y, hit, miss)
            new_pair[:, 0] = 0  # the target may begin here
            pair, down = new_pair, new_down
            side = along(np.maximum(pair, down))
            end = np.maximum(pair, side)[np.arange(len(part)), m]
            better = (i <= n) & (end > best)
            best, where = np.where(better, end, best), np.where(better, i, where)
            if places:
                table.append((pair, down, side))
        score = np.floor_divide(best, _K)  # in halves
        for k, p in enumerate(part):
            found = (float(score[k]) / 2, int(best[k] - score[k] * _K))
            out[p] = (*found, _trace(table, k, int(where[k]), int(m[k]), chains[p], targets[p], first, more)) if places else found
    return out


def _trace(table: list, k: int, i: int, j: int, chain: str, target: str, first: int, more: int) -> list[int]:
    """Places of the target that meet an equal residue, along one best path that ends at (i, j)."""
    at = 0 if table[i][0][k, j] >= table[i][2][k, j] else 2
    matched = []
    while j:
        if at == 0:
            if chain[i - 1] == target[j - 1]:
                matched.append(j - 1)
            i, j = i - 1, j - 1
            at = int(np.argmax([table[i][s][k, j] for s in range(3)]))
        elif at == 1:
            back = [table[i - 1][0][k, j] + first, table[i - 1][1][k, j] + more, table[i - 1][2][k, j] + first]
            i, at = i - 1, int(np.argmax(back))
        else:
            back = [table[i][0][k, j - 1] + first, table[i][1][k, j - 1] + first, table[i][2][k, j - 1] + more]
            j, at = j - 1, int(np.argmax(back))
    return matched[::-1]


#: beginnings for each target that a first pass follows
BEAM = 8


def best_fits(chains: Sequence[str], keys: Sequence[int], targets: Sequence[str], match: float = 2, mismatch: float = -1, opening: float = -2, extending: float = -0.5) -> list[tuple[float, int, int]]:
    """``(score, matches, key)`` of the best chain for each target, scored as by :func:`fit_targets`; chains are distinct.

    The best has the highest score, then the most matches, then the smallest key.
    Chains that begin alike share the rows of their beginning. A beginning is left once
    all residues still to come, were they to match, could not bring it to the score of a
    chain that a first pass along few beginnings has found.
    """
    order = sorted(range(len(chains)), key=lambda i: chains[i])
    chains, keys = [chains[i] for i in order], np.array([keys[i] for i in order], np.int64)
    levels = _beginnings(chains)
    empty = 0 if not chains[0] else -1  # it sorts first
    costs = [int(v * 2 * _K) for v in (match, mismatch, opening, extending)]
    costs[0] += 1
    out: list[tuple[float, int, int]] = [()] * len(targets)
    # so few targets at once that even all beginnings together stay within a few tables
    widest = max((len(x[0]) for x in levels), default=1)
    order = sorted(range(len(targets)), key=lambda i: len(targets[i]))
    step = max(1, 4 * CELLS // (widest * (max(map(len, targets)) + 1)))
    for at in range(0, len(order), step):
        part = order[at : at + step]
        some = [targets[i] for i in part]
        floor, _ = _descend(some, levels, keys, empty, costs, np.full(len(part), _LOW), BEAM)
        for i, best, key in zip(part, *_descend(some, levels, keys, empty, costs, floor), strict=True):
            score = int(best) // _K
            out[i] = score / 2, int(best) - score * _K, int(key)
    return out


def _beginnings(chains: list[str]) -> list[tuple[np.ndarray, ...]]:
    """For each depth the distinct beginnings of sorted chains: last letter, parent, most residues behind it, the chain that ends there or -1."""
    sizes = np.array([len(s) for s in chains])
    codes = _codes(chains, sizes.max())
    same, parent, levels = np.arange(len(chains)) > 0, np.zeros(len(chains), np.int64), []
    for depth in range(1, sizes.max() + 1):
        long_ = sizes >= depth
        same[1:] &= long_[1:] & long_[:-1] & (codes[1:, depth - 1] == codes[:-1, depth - 1])
        new = long_ & ~same
        node, first = np.cumsum(new) - 1, np.flatnonzero(new)
        left, ends = np.zeros(len(first), np.int64), np.full(len(first), -1, np.int64)
        np.maximum.at(left, node[long_], sizes[long_] - depth)
        ends[node[sizes == depth]] = np.flatnonzero(sizes == depth)
        levels.append((codes[first, depth - 1], parent[first], left, ends))
        parent = node
    return levels


def _descend(targets: list[str], levels: list, keys: np.ndarray, empty: int, costs: list[int], floor: np.ndarray, beam: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Best packed value of each target and the smallest key that has it; what stays below ``floor`` is not followed, with ``beam`` only few are."""
    hit, miss, first, more = costs
    m = np.array([len(s) for s in targets])
    width, t = m.max() + 1, np.arange(len(targets))
    y = _codes(targets, m.max()).T

    def along(start: np.ndarray) -> np.ndarray:
        side = np.full(start.shape, _LOW, np.int64)
        for j in range(1, width):
            np.maximum(start[j - 1] + first, side[j - 1] + more, out=side[j])
        return side

    pair, down = np.full((width, len(t)), _LOW, np.int64), np.full((width, len(t)), _LOW, np.int64)
    pair[0] = 0
    side, node = along(pair), np.zeros(len(t), np.int64)
    best = np.maximum(pair, side)[m, t]
    ended = [(t, best, np.full(len(t), keys[empty]))] if empty >= 0 else []
    for letters, parents, left, ends in levels:
        low, high = np.searchsorted(parents, node), np.searchsorted(parents, node, "right")
        old = np.repeat(np.arange(len(node)), high - low)
        if not len(old):
            break
        node = np.arange(len(old)) + np.repeat(low - np.cumsum(high - low) + (high - low), high - low)
        t = t[old]
        any_ = np.maximum(np.maximum(pair, down), side)
        down = np.maximum(np.maximum(pair, side) + first, down + more)[:, old]
        pair = np.full(down.shape, _LOW, np.int64)
        pair[1:] = any_[:-1, old] + np.where(y[:, t] == letters[node], hit, miss)
        pair[0] = 0  # the target may begin here
        side = along(np.maximum(pair, down))
        best = np.maximum(best[old], np.maximum(pair, side)[m[t], np.arange(len(t))])
        done = np.flatnonzero(ends[node] >= 0)
        ended.append((t[done], best[done], keys[ends[node[done]]]))
        floor = floor.copy()
        np.maximum.at(floor, t[done], best[done])
        # what may still come: a match for every residue left on both sides, the target's others in one gap
        any_, hope, ahead = np.maximum(np.maximum(pair, down), side), best.copy(), left[node]
        for j in range(width):
            rest = m[t] - j
            lone = np.maximum(rest - ahead, 0)
            value = any_[j] + np.minimum(rest, ahead) * hit + np.where(lone > 0, first + more * (lone - 1), 0)
            np.maximum(hope, np.where(rest >= 0, value, _LOW), out=hope)
        keep = (hope >= floor[t]) & (ahead > 0)
        if beam:
            ranked = np.lexsort((-hope, ~keep, t))
            within = np.arange(len(t)) - np.searchsorted(t[ranked], t[ranked])
            keep[ranked[within >= beam]] = False
        t, node, best, pair, down, side = t[keep], node[keep], best[keep], pair[:, keep], down[:, keep], side[:, keep]
    t, best, key = (np.concatenate(x) for x in zip(*ended, strict=True))
    order = np.lexsort((key, -best, t))
    order = order[np.unique(t[order], return_index=True)[1]]
    top, place = np.full(len(targets), _LOW), np.full(len(targets), -1)
    top[t[order]], place[t[order]] = best[order], key[order]
    return top, place
