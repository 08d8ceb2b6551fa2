"""Set operations (U1-U5)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import tables as T
from .base import query


@query("u1_tagged_union", "SELECT event_type AS class, event_id, value FROM events WHERE event_type IS NOT NULL")
def u1(t):
    """The tables of all classes, each tagged with its class, stacked."""
    classes = ("click", "error", "purchase", "signup", "view")
    known = [t.events.where(F.col("event_type") == k).select(F.lit(k).alias("class"), "event_id", "value") for k in classes]
    rest = t.events.where(~F.col("event_type").isin(*classes)).select(F.col("event_type").alias("class"), "event_id", "value")
    return reduce(DataFrame.unionByName, [*known, rest])


@query(
    "u2_union_keep_first",
    "SELECT o_orderkey, src FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY pri) AS r FROM (SELECT o_orderkey, 'status' AS src, 0 AS pri FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT o_orderkey, 'price', 1 FROM orders WHERE o_totalprice > 100000)) WHERE r = 1",
)
def u2(t):
    a = t.orders.where("o_orderstatus = 'P'").select("o_orderkey", F.lit("status").alias("src"), F.lit(0).alias("pri"))
    b = t.orders.where("o_totalprice > 100000").select("o_orderkey", F.lit("price").alias("src"), F.lit(1).alias("pri"))
    return T.first_row(a.unionByName(b), ["o_orderkey"], ["pri"]).select("o_orderkey", "src")


@query("u3_difference_intersection", "SELECT 'without' AS part, c_custkey AS id FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders) UNION ALL SELECT 'both', c_custkey FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders)")
def u3(t):
    c, o = t.customer.select(F.col("c_custkey").alias("id")), t.orders.select(F.col("o_custkey").alias("id"))
    return c.subtract(o).select(F.lit("without").alias("part"), "id").unionByName(c.intersect(o).select(F.lit("both").alias("part"), "id"))


@query("u4_set_equality", "SELECT (SELECT count(*) FROM (SELECT l_orderkey FROM lineitem EXCEPT SELECT o_orderkey FROM orders)) AS left_only, (SELECT count(*) FROM (SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem)) AS right_only")
def u4(t):
    a, b = t.lineitem.select(F.col("l_orderkey").alias("k")).distinct(), t.orders.select(F.col("o_orderkey").alias("k")).distinct()
    both = a.withColumn("l", F.lit(1)).join(b.withColumn("r", F.lit(1)), "k", "full_outer")
    return both.agg(F.count_if(F.col("r").isNull()).alias("left_only"), F.count_if(F.col("l").isNull()).alias("right_only"))


@query("u5_shard_concat", "SELECT event_id, user_id, value FROM events")
def u5(t):
    """Shards are concatenated, cells checked to be unique, rows range-sorted for the sink."""
    shards = [t.events.where(F.pmod("event_id", F.lit(4)) == i).select("event_id", "user_id", "value") for i in range(4)]
    whole = shards[0]
    for s in shards[1:]:
        whole = whole.unionByName(s)
    return T.assert_unique(whole, ["event_id"]).orderBy("event_id")
