"""Operators on keyed tables: selection, ranking, reconciling, checks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StructField, StructType

from . import spread


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def pick_columns(df: DataFrame, contains: str = "", prefix: str = "", suffix: str = "") -> list[str]:
    """Column names by substring, prefix and suffix, in table order."""
    return [c for c in df.columns if contains in c and c.startswith(prefix) and c.endswith(suffix)]


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN would compare as the largest number and spoil averages; missing is NULL here."""
    return df.select(*[F.nanvl(c, F.lit(None)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.nullif(F.trim(text), F.lit("")), F.lit("None"))


def first_row(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key; the order must decide every tie."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def best_row(df: DataFrame, keys: list[str], score: str, tie: str) -> DataFrame:
    """The row with the smallest score of each key, ties by ``tie``; missing scores never win.

    One aggregation with partial results per task, no sort of whole groups.
    """
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.when(F.col(score).isNotNull(), F.struct(score, tie)))
    return df.groupBy(*keys).agg(best.alias("_b")).where("_b is not null").select(*keys, "_b.*")


def quantile_cut(df: DataFrame, column: str, q: float) -> DataFrame:
    """Rows at or below the linearly interpolated quantile; the cut is one broadcast row."""
    cut = spread.quantiles(df, [], column, {"_cut": q})
    return df.crossJoin(F.broadcast(cut)).where(F.col(column) <= F.col("_cut")).drop("_cut")


def histogram(df: DataFrame, column: str, fewest: int = 5, most: int = 40) -> DataFrame:
    """``(bin, n)`` of ceil(sqrt(rows)) equal bins, clipped; a constant column has one bin, missing values one of their own (NULL)."""
    s = df.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"), F.least(F.lit(most), F.greatest(F.lit(fewest), F.ceil(F.sqrt(F.count("*"))))).alias("_b"))
    width = (F.col("_hi") - F.col("_lo")) / F.col("_b")
    at = F.least(F.col("_b") - 1, F.floor(F.try_divide(F.col(column) - F.col("_lo"), width)))
    bin_ = F.when(F.col("_hi") == F.col("_lo"), F.when(F.col(column).isNotNull(), 0)).when(F.col(column).isNotNull(), at)
    return df.crossJoin(F.broadcast(s)).groupBy(bin_.cast("long").alias("bin")).agg(F.count("*").alias("n"))  # one row is broadcast


def average_rank(column: str, keys: list[str] | None = None, descending: bool = False) -> Column:
    """Rank with ties averaged; missing values last."""
    by = Window.partitionBy(*(keys or [F.lit(0)]))
    order = F.desc_nulls_last(column) if descending else F.asc_nulls_last(column)
    ties = Window.partitionBy(*(keys or []), column)
    return F.rank().over(by.orderBy(order)) + (F.count(F.lit(1)).over(ties) - 1) / 2.0


def global_average_rank(df: DataFrame, column: str, out: str = "rank") -> DataFrame:
    """Average-tie rank of all rows without one task that holds them all. Missing values get no rank."""
    return spread.average_ranks(df, [], column, out)


def top_k(df: DataFrame, keys: list[str], order: list[Column | str], k: int, rank: str = "rank") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w).cast("long")).where(F.col(rank) <= k)


def assert_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    twice = df.groupBy(*keys).count().where("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"keys {keys} are not unique: {[tuple(r)[:-1] for r in twice]}")
    return df


def checked_join(left: DataFrame, right: DataFrame, on: list[str], kind: str, how: str = "inner") -> DataFrame:
    """Join after checking ``one_to_one``, ``one_to_many`` or ``many_to_one``."""
    if kind in ("one_to_one", "one_to_many"):
        assert_unique(left, on)
    if kind in ("one_to_one", "many_to_one"):
        assert_unique(right, on)
    return left.join(right, on, how)


def join_all(tables: list[DataFrame], on: list[str], how: str = "inner") -> DataFrame:
    return reduce(lambda a, b: a.join(b, on, how), tables)


def collapse_duplicates(df: DataFrame, keys: list[str], order: str, policy: str = "raise") -> DataFrame:
    """Equal rows of a key collapse; rows in conflict raise, or the first or last by ``order`` stays."""
    rest = [c for c in df.columns if c not in [*keys, order]]
    digest = F.xxhash64(*[F.to_json(F.struct(*rest))])
    if policy == "raise":
        bad = df.groupBy(*keys).agg(F.count_distinct(digest).alias("n")).where("n > 1").limit(5).collect()
        if bad:
            raise ValueError(f"conflicting rows: {[tuple(r)[:-1] for r in bad]}")
    return first_row(df, keys, [F.desc(order) if policy == "last" else F.asc(order)])


def _in_lists(rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each ``rows`` rows of a batch as one list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cuts = pa.array([*range(0, batch.num_rows, rows), batch.num_rows], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(cuts, batch.to_struct_array())], ["block"])

    return run


def _blocks(df: DataFrame, rows: int, parts: int, out: str) -> DataFrame:
    """``out``: rows of ``df`` in lists of ``rows`` at most, dealt to ``parts`` partitions whatever is in them."""
    kind = StructType([StructField("block", ArrayType(df.schema))])
    return df.mapInArrow(_in_lists(rows), kind).repartition(parts).withColumnRenamed("block", out)


def every_pair(left: DataFrame, right: DataFrame, other: str = "other", rows: int = 8192) -> DataFrame:
    """Each row of ``left`` with each of ``right``, a struct ``other``.

    Both sides are shuffled once; a task reads one partition of each, some ``rows`` rows. Nothing is broadcast.
    """
    cores = left.sparkSession.sparkContext.defaultParallelism
    n, m = left.count(), right.count()
    blocks = _blocks(right, 512, max(1, -(-m // rows)), "_block")
    # a small table still gives all cores something to do
    parts = max(1, -(-n // rows), min(2 * cores, n // 64))
    return left.repartition(parts).join(blocks.hint("shuffle_replicate_nl"), how="cross").select(*left.columns, F.explode("_block").alias(other))


def meet_in_blocks(left: DataFrame, right: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str, rows: int = 4096, others: int = 512) -> DataFrame:
    """``run(part of left, part of right)`` for all parts of at most ``rows`` and ``others`` rows, so that every row meets every other and no task holds a side.

    Both sides are shuffled once, in parts; a task reads a part or so of each, so what is written grows with the rows and not with their pairs.
    """
    n, m = max(1, -(-left.count() // rows)), max(1, -(-right.count() // others))
    kind = to_arrow_schema(StructType.fromDDL(schema))

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                a, b = (pa.Table.from_struct_array(batch.column(k)[i].values) for k in ("_a", "_b"))
                yield from run(a, b).cast(kind).to_batches()

    pairs = _blocks(left, rows, n, "_a").join(_blocks(right, others, m, "_b").hint("shuffle_replicate_nl"), how="cross")
    return pairs.mapInArrow(one, schema)


def reconcile(left: DataFrame, right: DataFrame, keys: list[str], column: str) -> DataFrame:
    """One row: keys on one side only, keys on both, and the largest absolute difference."""
    a = left.select(*keys, F.col(column).alias("_a"), F.lit(1).alias("_l"))
    b = right.select(*keys, F.col(column).alias("_b"), F.lit(1).alias("_r"))
    both = a.join(b, keys, "full_outer")
    return both.agg(
        F.count_if(F.col("_r").isNull()).alias("left_only"),
        F.count_if(F.col("_l").isNull()).alias("right_only"),
        F.count_if(F.col("_l").isNotNull() & F.col("_r").isNotNull()).alias("matched"),
        F.max(F.abs(F.col("_a") - F.col("_b"))).alias("max_abs_error"),
    )


def merge_intervals(df: DataFrame, keys: list[str], start: str, end: str, gap: int = 0, min_length: int = 1) -> DataFrame:
    """Union of inclusive intervals of a key; pieces up to ``gap`` apart are joined."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    seen = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("_new", F.when(seen.isNull() | (F.col(start) > seen + 1 + gap), 1).otherwise(0))
    islands = marked.withColumn("_i", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = islands.groupBy(*keys, "_i").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_i")
    return out.where(F.col(end) - F.col(start) + 1 >= min_length)
