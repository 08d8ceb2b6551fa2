"""Repair of damaged conversations: cheapest edits by bidirectional Dijkstra over the edit lattice.

A node of the lattice is (rows dealt with, last role kept): nothing yet, system, user
or assistant.  Keep, Rerole and Delete take the next row, Insert takes none.  A forward
and a reverse heap run until their least costs together exceed the best way known;
then every crossing of that cost is looked at, and the one whose whole audit is
ASCII-least wins.

A best way has the least audit of its cost on each of its parts, since two audits of
one cost between two nodes are never each other's beginning.  So a conversation longer
than ``LONG`` rows is solved in segments, from every role to every role, which are
then put together: no task holds all rows of a conversation.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import spread
from .common import SPACES, cut, session_settings

#: rows of a conversation that are solved at once
LONG = 1024
INSERT, DELETE, REROLE, UNFINISHED = 5, 2, 1, 5
START, SYSTEM, USER, ASSISTANT = range(4)
_STATE = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
#: what may follow each state, and what an inserted or renamed row becomes there
_NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
_TURN = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: a row as the lattice sees it: what its role begins with, and ``D`` (must go), ``T`` (truncated) or ``K``
Code = tuple[str, str]


def _steps(codes: tuple[Code, ...], i: int, state: int) -> Iterator[tuple[int, str, int, int]]:
    """``(cost, initial, rows dealt with, state)`` of the edits that leave a node."""
    turn = _TURN[state]
    yield INSERT, "I", i, turn
    if i < len(codes):
        role, fault = codes[i]
        yield DELETE, "D", i + 1, state
        if fault != "D":
            more = UNFINISHED if fault == "T" else 0
            yield REROLE + more, "R", i + 1, turn
            if _STATE.get(role) in _NEXT[state]:
                yield more, "K", i + 1, _STATE[role]


def _into(codes: tuple[Code, ...], i: int, state: int) -> Iterator[tuple[int, str, int, int]]:
    """``(cost, initial, rows dealt with, state)`` of the edits that lead to a node, and where they come from."""
    for before in range(4):
        if _TURN[before] == state:
            yield INSERT, "I", i, before
    if i:
        for before in range(4):
            for cost, letter, at, after in _steps(codes, i - 1, before):
                if at == i and after == state:
                    yield cost, letter, i - 1, before


def _less(a: int | None, b: int) -> int:
    return b if a is None else min(a, b)


@lru_cache(1 << 16)
def least_edits(codes: tuple[Code, ...], entry: int = START, exits: tuple[int, ...] = (START, ASSISTANT)) -> tuple[int, str] | None:
    """``(cost, audit)`` of the best way from ``entry`` before all rows to one of ``exits`` behind them; None if there is none."""
    n = len(codes)
    ahead: dict[tuple[int, int], tuple[int, str]] = {(0, entry): (0, "")}
    behind: dict[tuple[int, int], tuple[int, str]] = {(n, e): (0, "") for e in exits}
    # at one cost rows are taken in order, so that ways without cost are complete before a node is left
    front, back = [(0, 0, entry)], [(0, 0, e) for e in exits]
    done_front: set[tuple[int, int]] = set()
    done_back: set[tuple[int, int]] = set()
    best = None
    heapq.heapify(back)
    while front and back and (best is None or front[0][0] + back[0][0] <= best):
        if front[0][0] <= back[0][0]:
            cost, i, state = heapq.heappop(front)
            here = (i, state)
            if here in done_front:
                continue
            done_front.add(here)
            if here in behind:
                best = _less(best, cost + behind[here][0])
            audit = ahead[here][1]
            for more, letter, at, after in _steps(codes, i, state):
                new = (cost + more, audit + letter)
                if (at, after) not in ahead or new < ahead[at, after]:
                    ahead[at, after] = new
                    heapq.heappush(front, (new[0], at, after))
        else:
            cost, gone, state = heapq.heappop(back)
            here = (n - gone, state)
            if here in done_back:
                continue
            done_back.add(here)
            if here in ahead:
                best = _less(best, cost + ahead[here][0])
            audit = behind[here][1]
            for more, letter, at, before in _into(codes, n - gone, state):
                new = (cost + more, letter + audit)
                if (at, before) not in behind or new < behind[at, before]:
                    behind[at, before] = new
                    heapq.heappush(back, (new[0], n - at, before))
    if best is None:
        return None
    # a way of the best cost leaves the forward side at a node that both have settled or over one step between them
    found = [ahead[x][1] + behind[x][1] for x in done_front & done_back if ahead[x][0] + behind[x][0] == best]
    for i, state in done_front:
        cost, audit = ahead[i, state]
        for more, letter, *to in _steps(codes, i, state):
            end = tuple(to)
            if end in done_back and cost + more + behind[end][0] == best:
                found.append(audit + letter + behind[end][1])
    # a way without cost may be seen from the front alone, before the back has settled its end
    if not found:
        found = [ahead[x][1] + behind[x][1] for x in set(ahead) & set(behind) if ahead[x][0] + behind[x][0] == best]
    return best, min(found)


def _apply(rows: list[tuple[str, str]], audit: str, state: int = START) -> tuple[list[str], int]:
    """The repaired ``role:text`` of rows, and the state behind them."""
    out, at = [], 0
    for letter in audit:
        if letter == "K":
            state = _STATE[rows[at][0][:1]]
            out.append(f"{rows[at][0]}:{rows[at][1]}")
        elif letter in "RI":
            state = _TURN[state]
            out.append(f"{ROLE[state]}:{rows[at][1] if letter == 'R' else ''}")
        at += letter != "I"
    return out, state


def damaged(rows: DataFrame) -> DataFrame:
    """``(conv, turn, role, text, copies)``: rows of ``conversations`` after damage, those dropped with no copies.

    The damage is named by ``crc32("conv_id:turn") % 20``; nulls are written as one blank.
    """
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.crc32(key) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    text = F.when(kind.isin(0, 1), "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text)
    copies = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    return rows.select(F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), F.when(kind == 4, "user").otherwise(role).alias("role"), text.alias("text"), copies.alias("copies"))


def _blank(text: Column) -> Column:
    return ~F.regexp_like(text, F.lit(rf"[^{SPACES}]"))


def _fault(text: str, seen: bool) -> str:
    end = text.rstrip(" \t\n\x0b\x0c\r")
    return "B" if not end else "D" if seen else "K" if end[-1] in ".!?" else "T"


_EMPTY = hashlib.sha256(b"").hexdigest()
_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_RESULT = ", ".join(f"{c} long" for c in _COUNTS) + ", audit string, repaired_sha256 string"
_LEGAL = {"su", "ua", "au"}


def _one(rows: list[tuple[int | None, str, str]]) -> list:
    """The result of one conversation of bounded length, its rows in order."""
    if not rows:
        return [0] * 6 + ["", _EMPTY]
    turns = {t for t, _, _ in rows if t is not None}
    seen: set[tuple[str, str]] = set()
    faults, codes = [], []
    for _, role, text in rows:
        fault = _fault(text, (role, text) in seen)
        seen.add((role, text))
        faults.append(fault)
        codes.append((role[:1], "D" if fault in "BD" else fault))
    firsts = [c[0] for c in codes]
    illegal = sum(a + b not in _LEGAL for a, b in zip(firsts, firsts[1:], strict=False))
    cost, audit = least_edits(tuple(codes))
    kept, _ = _apply([(r, t) for _, r, t in rows], audit)
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return [gaps, *[faults.count(f) for f in "BDT"], illegal, cost, audit, hashlib.sha256("\n".join(kept).encode("utf-8", "surrogatepass")).hexdigest()]


def _short(rows: DataFrame, kind: str) -> DataFrame:
    """Results of conversations whose rows all come to one task, in order, one conversation after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, held, any_ = None, [], False
        for batch in batches:
            out = []
            for c, turn, role, text, copies in zip(*[col.to_pylist() for col in batch.columns], strict=True):
                if any_ and c != conv:
                    out.append([conv, *_one(held)])
                    held = []
                conv, any_ = c, True
                held += [(turn, role, text)] * copies
            if out:
                yield _records(out, batch.schema.field(0).type)
        if any_:
            yield _records([[conv, *_one(held)]], batch.schema.field(0).type)

    order = ["conv", F.col("turn").asc_nulls_first(), "role", "text"]
    return rows.repartition("conv").sortWithinPartitions(*order).mapInArrow(run, f"conv {kind}, {_RESULT}")


def _records(rows: list[list], kind: pa.DataType) -> pa.RecordBatch:
    types = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["conv", *_COUNTS, "audit", "repaired_sha256"])


def _segmented(rows: DataFrame, kind: str, long: int) -> DataFrame:
    """The same for conversations of any length: numbered across tasks, solved by segments, hashed as a stream."""
    rows = rows.where("copies > 0").withColumn("k", F.to_json(F.struct("conv")))
    rows = rows.groupBy("k", "conv", "turn", "role", "text").agg(F.sum("copies").alias("m"))
    rows = rows.select("k", "conv", "turn", "role", "text", F.explode(F.sequence(F.lit(1).cast("long"), "m")).alias("copy"))
    rows = spread.number_rows(rows, ["k"], [F.col("turn").asc_nulls_first(), "role", "text", "copy"], "at")
    first = rows.groupBy("k", "role", "text").agg(F.min("at").alias("first"))
    end = F.substring(F.regexp_replace("text", rf"[{SPACES}]+$", ""), -1, 1)
    fault = F.when(_blank(F.col("text")), "B").when(F.col("at") > F.col("first"), "D").when(end.isin(".", "!", "?"), "K").otherwise("T")
    rows = rows.join(first, ["k", "role", "text"]).withColumn("fault", fault).withColumn("segment", F.floor((F.col("at") - 1) / long))
    rows = cut(rows.select("k", "conv", "turn", "role", "text", "at", "fault", "segment"), "coded")

    def table(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        codes = tuple((r[:1], "D" if f in "BD" else f) for r, f in zip(pdf["role"], pdf["fault"], strict=True))
        firsts = [c[0] for c in codes]
        out = []
        for entry in range(4):
            for leave in range(4):
                way = least_edits(codes, entry, (leave,))
                if way is not None:
                    out.append((pdf["k"].iloc[0], int(pdf["segment"].iloc[0]), entry, leave, *way))
        illegal = sum(a + b not in _LEGAL for a, b in zip(firsts, firsts[1:], strict=False))
        return pd.DataFrame(out, columns=["k", "segment", "entry", "leave", "cost", "audit"]).assign(first=firsts[0], last=firsts[-1], illegal=illegal)

    solved = rows.select("k", "segment", "at", F.substring("role", 1, 1).alias("role"), "fault").groupBy("k", "segment").applyInPandas(table, "k string, segment long, entry int, leave int, cost long, audit string, first string, last string, illegal long")

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        """Segments in order: the best way to each role so far, and the ways it is made of."""
        best: dict[int, tuple[int, str, tuple]] = {START: (0, "", ())}
        illegal, last = 0, None
        for _, part in pdf.sort_values("segment").groupby("segment"):
            illegal += int(part["illegal"].iloc[0]) + (last is not None and last + part["first"].iloc[0] not in _LEGAL)
            last = part["last"].iloc[0]
            new: dict[int, tuple[int, str, tuple]] = {}
            for entry, leave, cost, audit in zip(part["entry"], part["leave"], part["cost"], part["audit"], strict=True):
                if entry in best:
                    c, a, path = best[entry]
                    way = (c + cost, a + audit, (path, entry, audit))
                    if leave not in new or way[:2] < new[leave][:2]:
                        new[leave] = way
            best = new
        cost, audit, path = min((best[e] for e in (START, ASSISTANT) if e in best), key=lambda w: w[:2])
        parts = []
        while path:
            path, entry, own = path
            parts.append((entry, own))
        parts = parts[::-1]
        k, n = pdf["k"].iloc[0], len(parts)
        return pd.DataFrame({"k": [k] * n, "segment": range(n), "entry": [p[0] for p in parts], "part": [p[1] for p in parts], "cost": [cost] * n, "illegal": [illegal] * n})

    ways = cut(solved.groupBy("k").applyInPandas(whole, "k string, segment long, entry int, part string, cost long, illegal long"), "ways")

    def repaired(texts: pd.DataFrame, way: pd.DataFrame) -> pd.DataFrame:
        texts = texts.sort_values("at")
        kept, _ = _apply(list(zip(texts["role"], texts["text"], strict=True)), way["part"].iloc[0], int(way["entry"].iloc[0]))
        return pd.DataFrame({"k": way["k"].iloc[:1], "segment": way["segment"].iloc[:1], "part": way["part"].iloc[:1], "piece": ["\n".join(kept)], "kept": [len(kept)]})

    pieces = rows.groupBy("k", "segment").cogroup(ways.groupBy("k", "segment")).applyInPandas(repaired, "k string, segment long, part string, piece string, kept long")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, h, any_, audit = None, hashlib.sha256(), False, []

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([k]), pa.array(["".join(audit)]), pa.array([h.hexdigest()])], names=["k", "audit", "repaired_sha256"])

        for batch in batches:
            for key, _, part, piece, kept in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if k is not None and key != k:
                    yield done()
                    h, any_, audit = hashlib.sha256(), False, []
                k = key
                audit.append(part)
                if kept:
                    h.update((("\n" if any_ else "") + piece).encode("utf-8", "surrogatepass"))
                    any_ = True
        if k is not None:
            yield done()

    hashed = pieces.repartition("k").sortWithinPartitions("k", "segment").mapInArrow(digest, "k string, audit string, repaired_sha256 string")
    count = {"blank": "B", "duplicate": "D", "truncated": "T"}
    turns = rows.groupBy("k", "turn").agg(F.first("conv").alias("conv"), *[F.count_if(F.col("fault") == f).alias(c) for c, f in count.items()])
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0).cast("long"))
    totals = turns.groupBy("k").agg(F.first("conv").alias("conv"), gaps.alias("gaps"), *[F.sum(c).alias(c) for c in count])
    paid = ways.where("segment = 0").select("k", "cost", "illegal")
    return totals.join(paid, "k").join(hashed, "k").select("conv", *_COUNTS, "audit", "repaired_sha256")


def repair(conversations: DataFrame, long: int = LONG) -> DataFrame:
    """``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)``, one row per ``conv_id``.

    Rows are those of :func:`damaged`, in order of turn (missing ones first), then
    role and text.  Null ids are one conversation.  Only roles that begin with s, u
    or a can be kept.  Repeated rows are repeated turns.  A conversation without rows after
    damage has zeros, an empty audit and the digest of nothing.  Other columns are
    ignored; an empty table gives no rows.
    """
    session_settings(conversations.sparkSession)
    kind = conversations.schema["conv_id"].dataType.simpleString()
    rows = damaged(conversations)
    many = cut(conversations.groupBy(F.col("conv_id").alias("conv")).agg(F.count("*").alias("n")).where(f"2 * n > {long}").select("conv", F.lit(True).alias("many")), "many")
    if many.isEmpty():
        return _short(rows, kind).withColumnRenamed("conv", "conv_id")
    marked = spread.join_on_keys(rows, many, ["conv"])
    short = _short(marked.where("many is null").drop("many"), kind)
    large = marked.where("many").drop("many")
    found = _segmented(large, kind, long)
    lost = spread.join_on_keys(many, found.select("conv", F.lit(1).alias("there")), ["conv"]).where("there is null")
    nothing = lost.select("conv", *[F.lit(0).cast("long").alias(c) for c in _COUNTS], F.lit("").alias("audit"), F.lit(_EMPTY).alias("repaired_sha256"))
    return short.unionByName(found).unionByName(nothing).withColumnRenamed("conv", "conv_id")
