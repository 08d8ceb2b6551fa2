"""Sequence search by rare k-mers, containment, redundancy clusters by a segment index; exact vector search with pivots."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import windows
from .alignment import global_matches
from .spread import cut as _cut


def _word_runs(col: str | Column, run: int, between: str = " ", inner: bool = False) -> Column:
    """Names of the distinct runs of words of a text; ``inner`` leaves the first and the last word out."""
    w = F.split(col, between)
    if inner:
        w = F.slice(w, 2, F.greatest(F.size(w) - 2, F.lit(0)))
    # the words beside their followers: the text is split a few times, not for each run
    beside = F.arrays_zip(*[F.slice(w, 1 + j, F.greatest(F.size(w) - run + 1, F.lit(0))).alias(f"w{j}") for j in range(run)])
    return F.array_distinct(F.transform(beside, lambda z: F.xxhash64(*[z[f"w{j}"] for j in range(run)])))


def kmer_hits(queries: DataFrame, library: DataFrame, k: int = 4, top: int = 1000) -> DataFrame:
    """``(query, id, shared, identity, rank)``: the ``top`` library rows by the share of the query's word k-grams they hold, ties to the smaller id.

    A query's rarest grams name its first rows, which are scored in full.  A row with
    none of its L rarest grams scores at most n - L; where that is below the score
    of the ``top``-th row found, the commoner grams are never looked up.  Elsewhere the
    grams that are still needed are.  Texts without a whole gram take no part;
    rows of one id are one row with all their grams.
    """
    q = queries.select("query", F.explode(_word_runs(F.lower("seq"), k, r"\s+")).alias("g")).distinct()
    held = library.select("id", F.explode(_word_runs(F.lower("seq"), k, r"\s+")).alias("g")).join(q.select("g").distinct(), "g", "left_semi").distinct()
    held = _cut(held.select("g", "id"))
    often = held.groupBy("g").agg(F.count("*").alias("often"))
    known = q.join(often, "g", "left").select("query", "g", F.coalesce("often", F.lit(0)).alias("often"))
    by_rarity = Window.partitionBy("query").orderBy("often", "g")
    before = F.coalesce(F.sum("often").over(by_rarity.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    known = _cut(known.withColumn("before", before).withColumn("at", F.row_number().over(by_rarity)))
    grams = known.groupBy("query").agg(F.collect_list("g").alias("grams"), F.count("*").alias("n"))
    holds = held.groupBy("id").agg(F.collect_list("g").alias("holds"))
    best = Window.partitionBy("query").orderBy(F.desc("shared"), "id")

    def scored(pairs: DataFrame) -> DataFrame:
        both = pairs.join(holds, "id").join(grams, "query")
        return both.select("query", "id", "n", F.size(F.array_intersect("grams", "holds")).cast("long").alias("shared"))

    rare = (F.col("before") < 2 * top) & (F.col("often") > 0)
    first = _cut(scored(held.join(known.where(rare).select("query", "g"), "g").select("query", "id").distinct()))
    bar = first.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).groupBy("query").agg(F.when(F.count("*") == top, F.min("shared")).otherwise(0).alias("bar"))
    more = known.where(~rare & (F.col("often") > 0)).join(bar, "query", "left").join(grams.select("query", "n"), "query")
    more = more.where(F.col("at") <= F.col("n") - F.coalesce("bar", F.lit(0)) + 1)
    second = held.join(more.select("query", "g"), "g").select("query", "id").distinct().join(first.select("query", "id"), ["query", "id"], "left_anti")
    out = first.unionByName(scored(second)).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return out.select("query", "id", "shared", (F.col("shared") / F.col("n")).alias("identity"), "rank")


#: characters of fragments in one automaton
PART_CHARS = 1 << 22


def _automaton_hits(texts: DataFrame, fragments: DataFrame, part_chars: int) -> DataFrame:
    """``(item, id)`` of texts ``(id, u)`` that hold a fragment ``(item, f)``: one scan of the texts for each automaton of bounded size."""
    spark = texts.sparkSession
    fragments = _cut(fragments.where("f is not null").select("item", "f"))
    chars = fragments.agg(F.sum(F.length("f") + 8)).first()[0] or 0
    parts = -(-chars // part_chars)
    found = []
    for part in range(parts):
        rows = fragments.where(F.pmod(F.xxhash64("item", "f"), F.lit(parts)) == part).collect()
        items: dict[str, list] = {}
        for r in rows:
            items.setdefault(r["f"], []).append(r["item"])
        shared = spark.sparkContext.broadcast(items)
        found.append(texts.where("u is not null").select("id", "u").mapInPandas(_scan_for(shared), _named(texts, fragments)))
    if not found:
        return texts.join(fragments, F.lit(False)).select("item", "id")
    return reduce(DataFrame.unionByName, found)


def _named(texts: DataFrame, fragments: DataFrame) -> str:
    return f"item {fragments.schema['item'].dataType.simpleString()}, id {texts.schema['id'].dataType.simpleString()}"


def _scan_for(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        items = shared.value
        automaton = ahocorasick.Automaton()
        for f in items:
            if f:
                automaton.add_word(f, f)
        automaton.make_automaton()
        for pdf in batches:
            out = []
            for i, text in zip(pdf["id"], pdf["u"], strict=True):
                met = {f for _, f in automaton.iter(text)} if len(automaton) else set()
                met |= {""} & items.keys()
                out += [(item, i) for f in met for item in items[f]]
            yield pd.DataFrame(out, columns=["item", "id"]).astype({"id": pdf["id"].dtype})

    return run


def containing(texts: DataFrame, fragments: DataFrame, run: int = 3, part_chars: int = PART_CHARS) -> DataFrame:
    """``(item, id)``: every text ``(id, u)`` that holds a whole fragment ``(item, f)``, as often as such rows occur.

    The words of a fragment but the first and the last are whole words wherever it
    occurs.  Of its runs of ``run`` such words the one that is in the fewest texts
    names the texts that may hold it; those are compared.  Fragments too short for
    a run are searched all at once, by automata of ``part_chars`` characters.
    """
    words = F.size(F.split("f", " "))
    grams = fragments.where(words >= run + 2).select("item", F.explode(_word_runs("f", run, inner=True)).alias("g")).distinct()
    long_enough = texts.where(F.size(F.split("u", " ")) >= run)
    held = long_enough.select("id", F.explode(_word_runs("u", run)).alias("g")).join(grams.select("g").distinct(), "g", "left_semi")
    held = _cut(held)
    often = held.groupBy("g").agg(F.count("*").alias("n"))
    seed = grams.join(often, "g", "left").groupBy("item").agg(F.min_by("g", F.struct(F.coalesce("n", F.lit(0)), "g")).alias("g"))
    some = held.join(seed, "g").select("item", "id").distinct()
    found = some.join(fragments, "item").join(texts, "id").where("contains(u, f)").select("item", "id")
    return found.unionByName(_automaton_hits(texts, fragments.where(words < run + 2), part_chars).select("item", "id"))


def greedy_clusters(seqs: DataFrame, identity: float = 0.9, k: int = 3, max_rounds: int = 30) -> DataFrame:
    """``(rep, member)``: longest first, a sequence joins the first representative it is similar to."""
    return redundancy_levels(seqs, [(identity, 0.0)], k, max_rounds).select("rep", "member")


#: letters between two offsets that are looked up together
NEARBY = 16


def _edits(length: Column, identity: float) -> Column:
    """Columns without a match that an alignment of such a sequence with a longer one may have."""
    return F.floor(length * (1 - identity) / identity + 1e-9).cast("int")


def similar_candidates(whole: DataFrame, identity: float) -> DataFrame:
    """``(a, b)``: pairs of sequences ``(id, seq, n)``, the better first, that may be similar; none that is gets lost.

    The better is the longer, of equal ones that with the smaller id.  A sequence is
    cut into one piece more than the edits it may have, so a similar longer one
    holds a piece whole, and one at least near its own place: with p pieces before
    it, no more than p letters off, and no more than the pieces behind it from where
    the end would put it.  Pieces are looked up by content and nearby offset among the windows
    of longer sequences.  Their length follows from the identity: 8 letters at
    0.9, 5 at 0.85, 2 at 0.7, where nearly every window is met.
    """
    size = F.floor(F.col("n") / (_edits(F.col("n"), identity) + 1)).cast("int")
    pieces = whole.where("n > 0").select("id", "n", "seq", _edits(F.col("n"), identity).alias("e"), size.alias("k"))
    pieces = pieces.select("*", F.posexplode(F.transform(F.sequence(F.lit(0), "e"), lambda p: F.floor(p * F.col("n") / (F.col("e") + 1)).cast("int"))).alias("p", "i"))
    near = F.sequence(F.floor((F.col("i") - F.least("p", F.col("e") - F.col("p"))) / NEARBY), F.floor((F.col("i") + F.col("p")) / NEARBY))
    pieces = pieces.select("id", "n", "e", "k", "p", "i", F.xxhash64(F.expr("substring(seq, i + 1, k)")).alias("g"), F.explode(near).alias("place"))
    # a longer sequence is cut into windows of every piece length that shorter similar ones have
    lengths = F.sequence(F.ceil(F.col("n") * identity - 1e-9).cast("int"), F.col("n"))
    sizes = F.array_distinct(F.transform(lengths, lambda m: F.floor(m / (_edits(m, identity) + 1)).cast("int")))
    held = whole.where("n > 0").select("id", "n", "seq", F.explode(sizes).alias("k")).where("k > 0 and k <= n")
    held = held.select("id", "n", "k", "seq", F.explode(F.sequence(F.lit(0), F.col("n") - F.col("k"))).alias("j"))
    held = held.select("id", "n", "k", "j", F.xxhash64(F.expr("substring(seq, j + 1, k)")).alias("g"), F.floor(F.col("j") / NEARBY).alias("place"))
    better = F.expr("(a.n > b.n or (a.n = b.n and a.id < b.id))") & (F.col("b.n") >= F.col("a.n") * identity - 1e-9)
    placed = F.expr("abs(a.j - b.i) <= b.p and abs(a.n - b.n - (a.j - b.i)) <= b.e - b.p")
    same = (F.col("a.k") == F.col("b.k")) & (F.col("a.g") == F.col("b.g")) & (F.col("a.place") == F.col("b.place"))
    return held.alias("a").join(pieces.alias("b"), same & better & placed).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()


def redundancy_levels(seqs: DataFrame, levels: list[tuple[float, float]], k: int = 3, max_rounds: int = 30) -> DataFrame:
    """``(identity, coverage, rep, member)``: greedy clusters at each pair of thresholds, candidates found and aligned once.

    Two sequences are similar at a level if the columns of their global alignment
    match in a share of ``identity`` or more (above 0.5), and the residues that
    have a partner are a share of ``coverage`` or more of the longer one.  Equal
    sequences are one; those without text take no part.

    Candidates are those of :func:`similar_candidates` that share as many k-mers as
    their edits leave.  Rounds then take every unassigned sequence without an unassigned better
    neighbour as a representative and assign its neighbours, until none is left:
    the same result as going through all sequences in order.
    """
    lowest = min(identity for identity, _ in levels)
    if lowest <= 0.5:
        raise ValueError("at an identity of 0.5 or less no piece of a sequence need be whole")
    whole = seqs.where("seq is not null").groupBy("seq").agg(F.min("id").alias("id"), F.collect_list("id").alias("same"))
    whole = _cut(whole.withColumn("n", F.length("seq")))
    some = similar_candidates(whole, lowest)
    text = whole.select("id", "seq")
    pairs = some.join(text.select(F.col("id").alias("a"), F.col("seq").alias("x")), "a").join(text.select(F.col("id").alias("b"), F.col("seq").alias("y")), "b")
    shared = F.size(F.array_intersect(windows("x", k), windows("y", k)))
    pairs = pairs.where(shared >= F.size(F.array_distinct(windows("x", k))) - k * _edits(F.length("y"), lowest))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = global_matches(pdf["x"].tolist(), pdf["y"].tolist())
            sizes = [(len(x), len(y)) for x, y in zip(pdf["x"], pdf["y"], strict=True)]
            out = pdf[["a", "b"]].copy()
            out["same"] = [matches / columns for matches, columns in found]
            out["met"] = [(n + m - columns) / max(n, m) for (n, m), (_, columns) in zip(sizes, found, strict=True)]
            yield out[out["same"] >= lowest]

    level = F.explode(F.array(*[F.struct(F.lit(i).alias("identity"), F.lit(c).alias("coverage")) for i, c in sorted(set(levels))]))
    at = ["identity", "coverage"]
    near = pairs.mapInPandas(run, "a long, b long, same double, met double").select("*", level.alias("level")).select("a", "b", "same", "met", "level.*")
    near = _cut(near.where("same >= identity and met >= coverage").drop("same", "met"))
    left, done = _cut(whole.select("id", "n", level.alias("level")).select("id", "n", "level.*")), None
    for _ in range(max_rounds):
        if left.isEmpty():
            break
        alive = near.join(left.select(*at, F.col("id").alias("a"), F.col("n").alias("na")), [*at, "a"]).join(left.select(*at, F.col("id").alias("b")), [*at, "b"])
        reps = _cut(left.join(alive.select(*at, F.col("b").alias("id")).distinct(), [*at, "id"], "left_anti"))
        taken = alive.join(reps.select(*at, F.col("id").alias("a")), [*at, "a"]).groupBy(*at, "b").agg(F.min_by("a", F.struct(-F.col("na"), F.col("a"))).alias("rep")).select(*at, "rep", F.col("b").alias("member"))
        # a sequence is settled once no better unassigned one could still become its representative
        step = _cut(reps.select(*at, F.col("id").alias("rep"), F.col("id").alias("member")).unionByName(taken))
        done = step if done is None else done.unionByName(step)
        left = _cut(left.join(step.select(*at, F.col("member").alias("id")), [*at, "id"], "left_anti"))
    else:
        raise RuntimeError(f"clusters did not settle in {max_rounds} rounds")
    if done is None:
        return seqs.sparkSession.createDataFrame([], "identity double, coverage double, rep long, member long")
    return done.join(whole.select(F.col("id").alias("member"), "same"), "member").select(*at, "rep", F.explode("same").alias("member"))


#: pivots at most; so many vectors and their cells are known to the driver and every task
PIVOTS = 256


def nearest_by_pivots(rows: DataFrame, queries: DataFrame, k: int, block_rows: int = 16384, pivots: int | None = None, report: dict | None = None) -> DataFrame:
    """``(query_id, rank, vec_id, distance)``: the k rows of smallest Euclidean distance to each query but itself, ties to the smaller id.

    Both are ``(id, v)`` of one width.  Rows are dealt to cells, each to its nearest
    pivot.  A query first visits its nearest cells that hold k rows; then, by the
    triangle inequality, only cells that may hold a row within the k-th distance it
    has, and in them only such rows.  Cells are split into blocks of ``block_rows``.
    Rows are shuffled once for each of the two rounds, whatever the number of queries.
    ``report`` takes the numbers of ``pairs`` and of pairs ``compared``.
    """
    spark = rows.sparkSession
    rows, queries = rows.where("v is not null").select("id", "v"), queries.where("v is not null").select("id", "v")
    total = rows.count()
    wanted = max(1, min(PIVOTS, -(-total // 64))) if pivots is None else pivots
    share = min(1.0, 2.0 * wanted / max(1, total))
    drawn = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < max(1, math.ceil(share * (1 << 20)))).limit(wanted) if total > wanted else rows
    centre = np.array([r["v"] for r in drawn.select("v").collect()], float)
    if not len(centre):  # a draw that hit nothing
        centre = np.array([r["v"] for r in rows.select("v").limit(1).collect()], float)
    schema = f"query_id {queries.schema['id'].dataType.simpleString()}, vec_id {rows.schema['id'].dataType.simpleString()}, distance double, met long"
    if not len(centre):
        return spark.createDataFrame([], schema).select("query_id", F.lit(1).cast("long").alias("rank"), "vec_id", "distance")
    shared = spark.sparkContext.broadcast(centre)

    def away(v: np.ndarray) -> np.ndarray:
        return np.stack([np.sqrt(((v - c) ** 2).sum(1)) for c in shared.value], 1)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                d = away(np.stack(pdf["v"]).astype(float))
                yield pdf.assign(cell=d.argmin(1).astype(np.int32), r=d.min(1))

    dealt = rows.mapInPandas(deal, f"id {rows.schema['id'].dataType.simpleString()}, v array<double>, cell int, r double")
    dealt = _cut(dealt)
    cells = {r["cell"]: r for r in dealt.groupBy("cell").agg(F.min("r").alias("lo"), F.max("r").alias("hi"), F.count("*").alias("n")).collect()}
    names = np.array(sorted(cells))
    low, high, size = (np.array([cells[c][x] for c in names], float) for x in ("lo", "hi", "n"))
    split = {int(c): max(1, -(-cells[c]["n"] // block_rows)) for c in names}
    blocks = F.create_map(*[F.lit(x) for c, n in split.items() for x in (c, n)])
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("id"), blocks[F.col("cell")]).cast("int"))

    def visits(first: bool):
        """Cells each query visits: the nearest that hold k rows beside it, or the others that its k-th distance demands."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if not len(pdf):
                    continue
                d = away(np.stack(pdf["v"]).astype(float))
                near = d[:, names]
                order = np.argsort(near, 1, kind="stable")
                held = np.take_along_axis(np.broadcast_to(size, near.shape), order, 1)
                home = np.zeros(near.shape, bool)
                np.put_along_axis(home, order, np.cumsum(held, 1) - held <= k, 1)
                if not first:
                    bound = np.maximum(np.maximum(near - high, low - near), (near - d.min(1)[:, None]) / 2)
                    limit = pdf["limit"].to_numpy(float)[:, None]
                    home = ~home & (bound <= limit + 1e-9 * (1 + np.where(np.isfinite(limit), limit, 0)))
                q, c = np.nonzero(home)
                yield pdf.iloc[q].reset_index(drop=True).assign(cell=names[c].astype(np.int32), own=near[q, c])

        return run

    def meet(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(x):
            x = x.sort_values("r")
            ids, vectors, r = x["id"].to_numpy(), np.stack(x["v"]).astype(float), x["r"].to_numpy()
            for query, v, limit, own in zip(q["id"], q["v"], q["limit"], q["own"], strict=True):
                slack = limit + 1e-9 * (1 + limit) if np.isfinite(limit) else np.inf
                a, b = np.searchsorted(r, own - slack), np.searchsorted(r, own + slack, "right")
                if a == b:
                    continue
                d = np.sqrt(((vectors[a:b] - v) ** 2).sum(1))
                d[ids[a:b] == query] = np.inf
                least = min(k, len(d)) - 1
                some = np.flatnonzero(d <= np.partition(d, least)[least])
                best = some[np.lexsort((ids[a:b][some], d[some]))][:k]
                out += [(query, ids[a + i], d[i], b - a if i == best[0] else 0) for i in best if np.isfinite(d[i]) or i == best[0]]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "distance", "met"])

    kind = f"id {queries.schema['id'].dataType.simpleString()}, v array<double>, limit double, cell int, own double"

    def round_(asked: DataFrame, first: bool) -> DataFrame:
        seen = asked.mapInPandas(visits(first), kind).withColumn("block", F.explode(F.sequence(F.lit(0), blocks[F.col("cell")] - 1)))
        return seen.groupBy("cell", "block").cogroup(dealt.groupBy("cell", "block")).applyInPandas(meet, schema)

    best = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    ranked = F.row_number().over(best).cast("long")
    start = _cut(round_(queries.withColumn("limit", F.lit(float("inf"))), True))
    reached = start.where("distance < double('inf')").withColumn("rank", ranked).where(F.col("rank") <= k).groupBy("query_id").agg(F.max("rank").alias("n"), F.max("distance").alias("far"))
    limit = F.when(F.col("n") == k, F.col("far")).otherwise(float("inf"))
    asked = queries.join(reached.withColumnRenamed("query_id", "id"), "id", "left").select("id", "v", F.coalesce(limit, F.lit(float("inf"))).alias("limit"))
    found = start.unionByName(round_(asked, False))
    if report is not None:
        found = _cut(found)
        report |= {"pairs": total * queries.count(), "compared": found.agg(F.sum("met")).first()[0] or 0}
    return found.where("distance < double('inf')").withColumn("rank", ranked).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "distance")
