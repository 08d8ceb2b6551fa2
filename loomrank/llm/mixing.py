"""Mixing sources to target weights by iterative proportional fitting.

Token totals are aggregated to cells of (source, language, topic).  Raking
scales the cells in turn so that the weighted totals of each source, language
and topic meet their targets, until the largest relative error is small.  The
weighted tokens of a cell over its tokens give each of its documents the same
inclusion rate; rates above one are held at one and the others raised until the
expected total is the budget.  A document is drawn when a hash of its id is
below its rate.  Everything is DataFrame functions: a margin's totals are a grouped
sum, joined back to the cells; documents are touched by one aggregate and one join.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, unit_hash

MARGINS = ("source", "lang", "topic")
#: exponent of the default targets: shares of tokens to this power, so small groups gain
TEMPERATURE = 0.7
ROUNDS, TOLERANCE = 40, 1e-6
BUDGET_SHARE = 0.5


def word_count(text: Column) -> Column:
    """Words between ``[\\x20\\x09-\\x0D]``; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def topic(text: Column, n_tokens: Column) -> Column:
    """A kind of text by its shape: none, capitals, lines (short ones), brief (under 50 words), long (2,000 or more) or prose."""
    lines = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    return (
        F.when(text.isNull() | (n_tokens == 0), "none")
        .when((F.upper(text) == text) & (F.lower(text) != text), "capitals")
        .when((lines > 2) & (n_tokens < 8 * lines), "lines")
        .when(n_tokens < 50, "brief")
        .when(n_tokens >= 2000, "long")
        .otherwise("prose")
    )


def _sum(df: DataFrame, what: Column) -> float:
    return float(df.agg(F.sum(what)).first()[0] or 0)


def rake(cells: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, margins: tuple[str, ...] = MARGINS, temperature: float = TEMPERATURE, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """``cells`` (margins, ``tokens``) with ``weight``: tokens raked to the targets, summing to 1, and ``gap``.

    ``targets[margin][value]`` are wanted shares; values without one, and
    margins that are not given, get the share of tokens to the power
    ``temperature``, and each margin is scaled to 1.  Cells without tokens weigh 0.
    Rounds end when no margin was off by more than ``tolerance`` when its turn came.
    Targets that no weights meet (of sources that share no cell with a language,
    say) never come so far; ``gap`` tells how far, in relative terms, the worst
    margin of a cell was off in the last of ``rounds``, and is below the tolerance otherwise.
    """
    keys = list(margins)
    whole = _sum(cells.where("tokens > 0"), F.col("tokens")) or 1.0
    now = cells.where("tokens > 0").withColumn("weight", F.col("tokens") / whole).withColumn("gap", F.lit(0.0))
    now = cut(now.select(*keys, "tokens", "weight", "gap"), "cells")
    for m in margins:
        share = F.pow(F.sum("weight"), temperature)
        given = (targets or {}).get(m)
        if given:
            flat = [F.lit(x) for pair in given.items() for x in pair]
            share = F.coalesce(F.create_map(*flat)[F.col(m)].cast("double"), share)
        wanted = now.groupBy(m).agg(share.alias("t"))
        total = _sum(wanted, F.col("t")) or 1.0
        now = cut(now.join(wanted.select(m, (F.col("t") / total).alias(f"_target_{m}")), m), f"target_{m}")
    for done in range(rounds):
        now = now.withColumn("gap", F.lit(0.0))
        for m in margins:
            have = now.groupBy(m).agg(F.when(F.sum("weight") > 0, F.max(f"_target_{m}") / F.sum("weight")).otherwise(F.lit(0.0)).alias("_f"))
            now = now.join(have, m).withColumn("weight", F.col("weight") * F.col("_f")).withColumn("gap", F.greatest("gap", F.abs(F.col("_f") - 1))).drop("_f")
        now = cut(now, f"cells{done}")
        if (now.agg(F.max("gap")).first()[0] or 0) <= tolerance:
            break
    kept = now.select(*keys, "tokens", "weight", "gap")
    return kept.unionByName(cells.where("not coalesce(tokens > 0, false)").select(*keys, F.coalesce("tokens", F.lit(0)).alias("tokens"), F.lit(0.0).alias("weight"), F.lit(0.0).alias("gap")))


def rates(cells: DataFrame, budget: float | None = None, share: float = BUDGET_SHARE, rounds: int = 1000) -> DataFrame:
    """Raked cells with ``rate``: the inclusion probability of their documents, 1 at most.

    A rate is the cell's weight over its tokens times one factor, held at 1.  The
    factor makes the expected tokens ``budget`` (by default ``share`` of all); if all
    documents of all weighted cells are fewer, their rates are 1.  A budget of 0
    or less gives rates of 0.
    """
    goal = float(budget) if budget is not None else share * _sum(cells, F.col("tokens"))
    # with one factor more and more cells are full: it grows until no further cell fills
    factor, full = 0.0, F.lit(False)
    for _ in range(rounds):
        r = cells.where("tokens > 0 and weight > 0").agg(F.sum(F.when(full, F.col("tokens")).otherwise(0)).alias("kept"), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("free")).first()
        left, free = goal - float(r["kept"] or 0), float(r["free"] or 0)
        if free <= 0 or left / free <= factor:
            break
        factor = left / free
        full = F.col("weight") * factor >= F.col("tokens")
    else:
        raise RuntimeError(f"rates did not settle in {rounds} rounds")
    rate = F.when(full, 1.0).otherwise(F.col("weight") * factor / F.col("tokens")) if goal > 0 else F.lit(0.0)
    return cells.withColumn("rate", F.when((F.col("tokens") > 0) & (F.col("weight") > 0), rate).otherwise(0.0))


def mix(
    docs: DataFrame,
    targets: Mapping[str, Mapping[str, float]] | None = None,
    budget: float | None = None,
    share: float = BUDGET_SHARE,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    lang_col: str = "lang",
    topic_of=topic,
    seed: int = 10,
) -> DataFrame:
    """``(doc_id, source, lang, topic, n_tokens, rate, selected, gap)``, one row per row of ``docs``.

    Null sources and languages are groups of their own (``(none)``).  Documents
    without tokens have rate 0.  Equal ids are drawn alike, null ids by one number
    as well.  ``topic_of(text, n_tokens)`` gives the third margin.  ``gap`` is that of
    :func:`rake`.  Other columns are ignored, whatever their names; an empty table
    gives no rows.
    """
    none = F.lit("(none)")
    words = word_count(F.col(text_col))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(source_col).cast("string"), none).alias("source"),
        F.coalesce(F.col(lang_col).cast("string"), none).alias("lang"),
        topic_of(F.col(text_col), words).alias("topic"),
        words.alias("n_tokens"),
    )
    rows = cut(rows, "lengths")
    cells = rows.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens"))
    rated = cut(rates(rake(cut(cells, "cells"), targets), budget, share).select(*MARGINS, "rate", "gap"), "rates")
    # a cell may hold a third of all documents: Spark splits such a join, or broadcasts
    # the cells when their size, read from the files, is below its threshold
    out = rows.join(rated, list(MARGINS), "left").withColumn("rate", F.when(F.col("n_tokens") > 0, F.coalesce("rate", F.lit(0.0))).otherwise(0.0))
    return out.select("doc_id", *MARGINS, "n_tokens", "rate", (unit_hash(F.col("doc_id"), F.lit(seed)) < F.col("rate")).alias("selected"), "gap")
