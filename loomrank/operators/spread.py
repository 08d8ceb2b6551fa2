"""Ranks, running values and quantiles within keys that may hold most of the rows.

Rows are range-partitioned by key and order and written once with the number of
their range, so the ranges are the same wherever they are used.  Each range is
worked on by itself; what the ranges before it hold of a key that crosses their
border is at most one row per range and is joined back.  No task holds a key.
"""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch

#: accuracy of the sketch that brackets quantiles: ranks are off by a thousandth of a key's rows at most
SKETCH = 1000
#: rows that one range holds, and rows from which on all cores share the ranges
RANGE, FEW = 250_000, 10_000
_HOW = {"sum": F.sum, "min": F.min, "max": F.max}


def cut(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back: computed once, and lineage ends there."""
    path = scratch(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def widen(df: DataFrame) -> DataFrame:
    """Rows dealt to all cores where the input lies in fewer partitions, as one with few row groups does; else ``df`` itself."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def ranges(df: DataFrame) -> int:
    """How many ranges of bounded size hold the rows; however many rows there are, a task sorts no more of them."""
    rows = df.count()
    return max(1, -(-rows // RANGE), min(df.sparkSession.sparkContext.defaultParallelism, rows // FEW))


def join_on_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join in which missing keys are equal; the columns of ``right`` beside the keys are added."""
    other = right.select(*[F.col(k).alias(f"_key_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = reduce(operator.and_, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys], F.lit(True))
    return left.join(other, on, how).drop(*[f"_key_{k}" for k in keys])


def running(df: DataFrame, keys: list[str], order: list[Column | str], values: dict[str, tuple[str, Column]]) -> DataFrame:
    """Running sums, minima or maxima of each key, the current row included.

    ``values`` gives ``{column: ("sum" | "min" | "max", value)}``; ``order`` must decide
    every tie. Missing keys are keys like others.
    """
    by = [F.col(c) if isinstance(c, str) else c for c in order]
    n = ranges(df)
    parts = df.repartitionByRange(n, *[F.col(k) for k in keys], *by).withColumn("_p", F.spark_partition_id())
    # dealt anew by range and key with as many tasks, or a fixed number of them would hold more ranges the more there are
    parts = cut(parts.select("*", *[v.alias(f"_v_{c}") for c, (_, v) in values.items()])).repartition(n, "_p", *keys)
    here = Window.partitionBy("_p", *keys).orderBy(*by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = parts.groupBy("_p", *keys).agg(*[_HOW[how](f"_v_{c}").alias(c) for c, (how, _) in values.items()])
    # a key's ranges follow each other: few rows, one for each range at most beyond its first
    before = Window.partitionBy(*keys).orderBy("_p")
    past = before.rowsBetween(Window.unboundedPreceding, -1)
    past = sums.select("_p", *keys, F.lag("_p").over(before).alias("_last"), *[_HOW[how](c).over(past).alias(f"_b_{c}") for c, (how, _) in values.items()]).where("_last is not null").drop("_last")
    out = parts.select("*", *[_HOW[how](f"_v_{c}").over(here).alias(c) for c, (how, _) in values.items()])
    out = join_on_keys(out, past, ["_p", *keys])
    merge = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "min": F.least, "max": F.greatest}
    return out.select(*df.columns, *[merge[how](F.col(c), F.col(f"_b_{c}")).alias(c) for c, (how, _) in values.items()])


def beside(df: DataFrame, keys: list[str], order: list[str], columns: list[str], out: str = "next", ahead: bool = True) -> DataFrame:
    """Each row with a struct of ``columns`` of the next (or the previous) row of its key, NULL at the end.

    Ranges exchange one border row for each key they hold; ``order`` must decide every tie.
    """
    n = ranges(df)
    parts = cut(df.repartitionByRange(n, *[F.col(k) for k in keys], *[F.col(c) for c in order]).withColumn("_p", F.spark_partition_id())).repartition(n, "_p", *keys)
    row, shift = F.struct(*columns), F.lead if ahead else F.lag
    here = Window.partitionBy("_p", *keys).orderBy(*order)
    border = (F.min_by if ahead else F.max_by)(row, F.struct(*order))
    edges = parts.groupBy("_p", *keys).agg(border.alias("_own"))
    edges = edges.select("_p", *keys, shift("_own").over(Window.partitionBy(*keys).orderBy("_p")).alias("_far"))
    out_ = join_on_keys(parts.withColumn("_near", shift(row).over(here)), edges, ["_p", *keys])
    return out_.select(*df.columns, F.coalesce("_near", "_far").alias(out))


def number_rows(df: DataFrame, keys: list[str], order: list[Column | str], out: str = "rank", total: str | None = None) -> DataFrame:
    """Rows numbered from 1 within each key; ``total`` names a column for the key's number of rows."""
    found = running(df, keys, order, {out: ("sum", F.lit(1).cast("long"))})
    return with_counts(found, keys, total) if total else found


def with_counts(df: DataFrame, keys: list[str], out: str) -> DataFrame:
    """The number of rows of each key, from partial counts."""
    return join_on_keys(df, df.groupBy(*keys).agg(F.count("*").alias(out)), keys)


def average_ranks(df: DataFrame, keys: list[str], column: str, out: str) -> DataFrame:
    """Average-tie ranks within keys, from counts of distinct values; missing values get no rank."""
    counts = df.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count("*").alias("_n"))
    ranks = running(counts, keys, [column], {"_upto": ("sum", F.col("_n"))})
    return join_on_keys(df, ranks.select(*keys, column, (F.col("_upto") - (F.col("_n") - 1) / 2.0).alias(out)), [*keys, column])


def quantiles(df: DataFrame, keys: list[str], column: str, at: dict[str, float]) -> DataFrame:
    """``keys`` and linearly interpolated quantiles ``{name: share}``, exact.

    A sketch of each key gives a bracket around each quantile. Values inside a bracket are
    counted as they are, all others only by the gap between brackets they lie in, so what is
    shuffled and sorted is a small share of the rows. A quantile that its bracket should miss
    is told by its rank, and then all distinct values are counted. Missing and NaN values do
    not count; keys without values have missing quantiles.
    """
    rows = df.select(*keys, F.nanvl(F.col(column).cast("double"), F.lit(None)).alias("_x"))
    ends = [p for q in at.values() for p in (max(0.0, q - 3 / SKETCH), min(1.0, q + 3 / SKETCH))]
    sketch = cut(rows.groupBy(*keys).agg(F.count("_x").alias("_all"), F.percentile_approx("_x", ends, SKETCH).alias("_at")))
    # a key of few values is one bracket: the sketch's ends lie too close to each other there
    few = F.col("_all") <= SKETCH
    bounds = [(F.when(few, float("-inf")).otherwise(F.col("_at")[i]).alias(f"_low{i}"), F.when(few, float("inf")).otherwise(F.col("_at")[i + 1]).alias(f"_high{i}")) for i in range(0, len(ends), 2)]
    near = join_on_keys(rows.where("_x is not null"), sketch.select(*keys, *[b for pair in bounds for b in pair]), keys)
    inside = reduce(operator.or_, [F.col("_x").between(F.col(f"_low{i}"), F.col(f"_high{i}")) for i in range(0, len(ends), 2)])
    # a row of a gap stands behind the nearest bracket below it
    below = F.greatest(F.lit(float("-inf")), *[F.when(F.col(f"_high{i}") < F.col("_x"), F.col(f"_high{i}")) for i in range(0, len(ends), 2)])
    counts = near.select(*keys, F.when(inside, F.col("_x")).otherwise(below).alias("_x"), (~inside).alias("_gap"))
    found = cut(_interpolated(counts, sketch.select(*keys, "_all"), keys, at))
    missed = reduce(operator.or_, [F.col(name).isNull() for name in at])
    if not found.where(missed & (F.col("_all") > 0)).isEmpty():
        found = _interpolated(rows.where("_x is not null").withColumn("_gap", F.lit(False)), sketch.select(*keys, "_all"), keys, at)
    return found.drop("_all")


def _interpolated(values: DataFrame, totals: DataFrame, keys: list[str], at: dict[str, float]) -> DataFrame:
    """``totals`` with quantiles of ``_x``; ranks of rows marked ``_gap``, which follow their ``_x``, have no value."""
    counts = values.groupBy(*keys, "_x", "_gap").agg(F.count("*").alias("_n"))
    placed = join_on_keys(running(counts, keys, ["_x", "_gap"], {"_upto": ("sum", F.col("_n"))}), totals, keys)

    def value_at(i: Column) -> Column:
        return F.max(F.when((F.col("_upto") - F.col("_n") <= i) & (i < F.col("_upto")) & ~F.col("_gap"), F.col("_x")))

    found = []
    for name, q in at.items():
        h = (F.col("_all") - 1) * q
        found += [value_at(F.floor(h)).alias(f"_lo_{name}"), value_at(F.ceil(h)).alias(f"_hi_{name}"), F.max(h - F.floor(h)).alias(f"_f_{name}")]
    out = join_on_keys(totals, placed.groupBy(*keys).agg(*found), keys)
    return out.select(*keys, "_all", *[(F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_f_{n}")).alias(n) for n in at])
