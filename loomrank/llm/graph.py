"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on edges (u, v) with v < u; see :func:`components`."""
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
    return out.where("u <> v").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 50) -> DataFrame:
    """``(id, component_id)`` of every vertex that has an edge; the id is the component's smallest.

    Alternates large-star and small-star steps (Kiveris et al. 2014) until all
    edges lead to roots; each round is written to the shared folder.  Minima
    are pre-aggregated per task, and the join back to a hub's edges is one that
    Spark can split when the hub is hot.  Self-links and nulls are ignored;
    repeated and reversed edges count once.  An empty table gives an empty one.
    """
    now = edges.where(f"{a} is not null and {b} is not null and {a} <> {b}")
    now = cut(now.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    for _ in range(max_rounds):
        # settled: every vertex has one edge, to a root that has none
        ends = now.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("root")), F.struct(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("root")))).alias("e")).select("e.*")
        if ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("root").alias("root")).where("up > 1 or up + root > 1").isEmpty():
            break
        now = cut(_star(_star(now, large=True), large=False), "edges")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    own = now.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
    return own.unionByName(own.select(F.col("component_id").alias("id"), "component_id")).groupBy("id").agg(F.min("component_id").alias("component_id"))
