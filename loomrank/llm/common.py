"""Shared folders, cut points and session settings of the corpus operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import prepare, shared_folder

#: rows of an Arrow batch; a batch of long documents must fit a Python worker
BATCH_ROWS = 1000
#: a word is a run of anything but these
SPACES = r"\x20\x09-\x0D"


def session_settings(spark: SparkSession) -> None:
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """A new folder that the driver and all executors share.

    It lies in ``spark.checkpoint.dir``; only on one machine that may be unset.
    ``session.clean`` removes all of an application's folders.
    """
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "part") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there."""
    path = f"{shared_dir(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unit_hash(*cols: Column | str) -> Column:
    """A number in [0, 1) that depends on the columns alone."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / float(1 << 53)


#: bits of :func:`possibly_in`'s filter: at most ``FILTER_BITS / 64`` rows of one long are broadcast
FILTER_BITS = 1 << 23


def possibly_in(df: DataFrame, key: str, ids: DataFrame, flag: str = "possibly") -> DataFrame:
    """``df`` with a flag that is true for every row whose key is in the one column of ``ids``, and for few others.

    A bitmap of fixed size over hashed ids is broadcast, so rows that are surely
    not in ``ids`` need not be shuffled to a join with it.  With very many ids it
    marks nearly all rows, which costs what the join would cost without it.  Null keys are not marked.
    """

    def place(c: str) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))

    def bit(at: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(64)).cast("int"))

    at = ids.select(place(ids.columns[0]).alias("_at")).select(F.floor(F.col("_at") / 64).alias("_word"), bit(F.col("_at")).alias("_bit"))
    words = at.groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    own = df.withColumn("_word", F.when(F.col(key).isNotNull(), F.floor(place(key) / 64))).join(F.broadcast(words), "_word", "left")
    return own.withColumn(flag, F.coalesce(F.col("_bits").bitwiseAND(bit(place(key))) != 0, F.lit(False))).drop("_word", "_bits")


def without(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows of ``df`` whose key is null or not among ``ids`` (one column of the same name); only rows that may be are shuffled."""
    marked = possibly_in(df, key, ids)
    return marked.where("not possibly").drop("possibly").unionByName(marked.where("possibly").drop("possibly").join(ids, key, "left_anti"))


def within(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows of ``df`` whose key is among ``ids`` (one column of the same name); only rows that may be are shuffled."""
    return possibly_in(df, key, ids).where("possibly").drop("possibly").join(ids, key, "left_semi")


def bounded_sample(df: DataFrame, key: str, rows: int, total: int, seed: int = 7) -> DataFrame:
    """About ``rows`` of ``total`` rows, chosen by a hash of ``key``; the same at every run."""
    share = 1.0 if total <= rows else rows / total
    return df.where(unit_hash(F.col(key), F.lit(seed)) < share)
