"""Registry of queries, the tables they read, and the flagship query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vector as V
from ..operators import tables as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """Lazily read tables of a folder: ``t.orders`` is the DataFrame of orders.parquet."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Register ``f(t)``, t being the tables, under ``name``, with its SQL if there is one."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Tables(spark, sf_dir))

        run.__name__, run.__doc__ = name, f.__doc__
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = run
        if sql:
            ORACLE[name] = sql
        return f

    return add


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank the library by distance to vector 0, keep the best decile, add the third block's distance.

    One broadcast row meets the library; the decile is exact, from counts of values
    that no single task holds.
    """
    emb = Tables(spark, sf_dir).embeddings.select("vec_id", V.doubles(F.col("embedding")).alias("v"))
    donor = emb.where("vec_id = 0").select(F.col("v").alias("q"))
    lib = emb.where("vec_id <> 0").crossJoin(F.broadcast(donor))
    scored = lib.select(
        "vec_id",
        V.euclidean(F.col("v"), F.col("q")).alias("distance"),
        V.euclidean(V.blocks(F.col("v"), 64)[2], V.blocks(F.col("q"), 64)[2]).alias("block3"),
    )
    return T.quantile_cut(scored, "distance", 0.1)


query(
    "flagship_shortlist",
    """
    WITH s AS (
      SELECT e.vec_id, list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS distance,
             list_distance(list_slice(e.embedding::DOUBLE[], 44, 64), list_slice(q.embedding::DOUBLE[], 44, 64)) AS block3
      FROM embeddings e, embeddings q WHERE q.vec_id = 0 AND e.vec_id <> 0)
    SELECT * FROM s WHERE distance <= (SELECT quantile_cont(distance, 0.1) FROM s)""",
)(lambda t: flagship(t.spark, t.dir))
