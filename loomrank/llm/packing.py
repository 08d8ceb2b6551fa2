"""Best-fit packing into sequences of several permitted lengths.

Documents are dealt by a hash of their id into shards of bounded total length;
each shard is packed by itself, so work and memory of a task do not grow with
the corpus, and a shard of many bins loses next to nothing against one packing.
A document longer than the longest capacity is split into full pieces and a rest.

Within a shard, longest pieces first: a piece goes to the open bin that it fills
most (best fit).  If none has room, a bin is opened.  Each size under consideration
that holds the piece is tried: the longest pieces that are still to be placed and
fit are put in it in thought, and its price is the cost of the permitted size that
such a bin would be cut down to, over what it would hold.  The least price wins.
At the end every bin is downsized to the smallest permitted size that holds its
contents.

Sizes are chosen jointly: a shard is packed with every mix of permitted sizes that
may be opened (31 mixes of five sizes), single sizes among them, and the mix of
least total cost is kept.  So no fixed size, downsized or not, is cheaper.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, session_settings

CAPACITIES = (512, 1024, 2048, 4096, 8192)
#: a bin costs its length, a share for attention over its length, and a fixed overhead
OVERHEAD, ATTENTION = 16.0, 0.05
SHARD_TOKENS = 4_000_000


def bin_cost(capacity: int, overhead: float = OVERHEAD, attention: float = ATTENTION) -> float:
    return overhead + capacity * (1 + attention * capacity / 8192)


def _filled(room: int, waiting: int, count: list[int]) -> int:
    """What is left of ``room`` after the longest waiting pieces that fit; bit n of ``waiting``: some piece of length n waits."""
    limit = room + 1
    while low := waiting & ((1 << limit) - 1):
        n = low.bit_length() - 1
        room -= n * min(count[n], room // n)
        limit = min(room + 1, n)
    return room


def pack(lengths: np.ndarray, capacities: tuple[int, ...] = CAPACITIES, opened: tuple[int, ...] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """``(bin of each piece, capacity of each bin)`` when bins of the sizes ``opened`` may be opened.

    Bins end in any of the ``capacities``; no length is above the largest size opened.
    Pieces of length 0 go to no bin (-1).  Equal pieces go by position; of open
    bins with equal room the one that came to it last is taken, and of sizes with
    equal prices the smallest.
    """
    sizes = np.array(sorted(capacities))
    ends = np.array([bin_cost(int(c)) for c in sizes])
    opened = tuple(sorted(opened or capacities))
    order = np.argsort(-lengths, kind="stable")
    bins = np.full(len(lengths), -1, np.int64)
    room: dict[int, list[int]] = {}  # free length -> open bins
    open_mask = 0  # bit r: some bin has r free
    n_bins = 0
    count = np.bincount(lengths).tolist() if len(lengths) else []
    waiting = sum(1 << n for n, c in enumerate(count) if n and c)
    for i in order.tolist():
        need = int(lengths[i])
        if need == 0:
            break
        count[need] -= 1
        if not count[need]:
            waiting ^= 1 << need
        above = open_mask >> need
        if above:
            r = need + (above & -above).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                open_mask ^= 1 << r
        else:
            price = []
            for c in opened:
                if c >= need:
                    held = c - _filled(c - need, waiting, count)
                    price.append((ends[int(np.searchsorted(sizes, held))] / held, c))
            b, r = n_bins, min(price)[1]
            n_bins += 1
        r -= need
        if r:
            room.setdefault(r, []).append(b)
            open_mask |= 1 << r
        bins[i] = b
    inside = bins >= 0
    held = np.bincount(bins[inside], weights=lengths[inside], minlength=n_bins).astype(np.int64)
    return bins, sizes[np.searchsorted(sizes, held)]


def mixes(longest: int, capacities: tuple[int, ...] = CAPACITIES) -> list[tuple[int, ...]]:
    """The mixes of sizes that hold every piece, fewest sizes first."""
    return [m for k in range(1, len(capacities) + 1) for m in combinations(sorted(capacities), k) if m[-1] >= longest]


def pack_jointly(lengths: np.ndarray, capacities: tuple[int, ...] = CAPACITIES) -> tuple[np.ndarray, np.ndarray, tuple[int, ...], dict[tuple[int, ...], float]]:
    """The cheapest packing over all mixes: ``(bins, sizes, its mix, cost of each mix)``; of equal costs the first mix wins."""
    best, costs = None, {}
    for mix in mixes(int(lengths.max(initial=0)), capacities):
        bins, size = pack(lengths, capacities, mix)
        costs[mix] = sum(bin_cost(int(c)) for c in size)
        if best is None or costs[mix] < costs[best[2]]:
            best = bins, size, mix
    return *best, costs


def best_fit(docs: DataFrame, length_col: str, id_col: str = "doc_id", capacities: tuple[int, ...] = CAPACITIES, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """``(doc_id, piece, start, n_tokens, bin_id, bin_capacity, bin_tokens, slot, mix)``, one row per piece.

    Pieces cover ``[start, start + n_tokens)`` of their document; the pieces of a
    document may lie in several shards.  ``slot`` orders the pieces of a bin, ``mix`` lists the
    sizes that its shard opens.  Documents
    of null, zero or negative length have one row with piece 0 and a null bin.
    Rows with equal ids are packed separately, equal lengths in the order of ids
    and pieces.  Other columns are ignored, whatever their names; an empty table
    gives no rows.
    """
    session_settings(docs.sparkSession)
    largest, sizes = max(capacities), tuple(sorted(capacities))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.greatest(F.coalesce(F.col(length_col).cast("long"), F.lit(0)), F.lit(0)).alias("length"))
    rows = cut(rows, "lengths")  # counted once, for the total and for the packing
    total = rows.agg(F.sum("length")).first()[0] or 0
    shards = max(1, math.ceil(total / shard_tokens))
    # a document may fill shards of its own: pieces, not documents, are dealt out
    rows = rows.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("length") / largest) - 1, F.lit(0).cast("long")))))
    rows = rows.withColumn("start", F.col("piece") * largest).withColumn("n_tokens", F.least(F.lit(largest).cast("long"), F.col("length") - F.col("start")))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "length", F.lit(3)), F.lit(shards)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece", "n_tokens"], kind="stable", na_position="last")
        bins, size, mix, _ = pack_jointly(pdf["n_tokens"].to_numpy(), sizes)
        inside = bins >= 0
        out = pdf[["doc_id", "piece", "start", "n_tokens"]].copy()
        out["doc_id"] = out["doc_id"].astype("Int64")
        held = np.bincount(bins[inside], weights=pdf["n_tokens"].to_numpy()[inside], minlength=len(size)).astype(np.int64)
        shard = int(pdf["shard"].iloc[0])
        at = np.where(inside, bins, 0)
        for name, value in (("bin_id", (shard << 32) + at), ("bin_capacity", size[at] if len(size) else at), ("bin_tokens", held[at] if len(size) else at)):
            out[name] = pd.array(value, "Int64")
            out.loc[~inside, name] = pd.NA
        out["slot"] = out.groupby("bin_id", dropna=False).cumcount().astype("Int64")
        out.loc[~inside, "slot"] = pd.NA
        out["mix"] = ",".join(map(str, mix))
        return out

    return rows.groupBy("shard").applyInPandas(run, "doc_id long, piece long, start long, n_tokens long, bin_id long, bin_capacity long, bin_tokens long, slot long, mix string")
