"""Sorts, limits and top-k (O1-O9)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import vector as V
from ..operators import spread
from ..operators import tables as T
from .base import query

DIST = "(SELECT e.vec_id, e.label, list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS d FROM embeddings e, embeddings q WHERE q.vec_id = 0 AND e.vec_id <> 0)"


def _dist(t):
    e = t.embeddings.select("vec_id", "label", V.doubles(F.col("embedding")).alias("v"))
    q = e.where("vec_id = 0").select(F.col("v").alias("q"))
    return e.where("vec_id <> 0").crossJoin(F.broadcast(q)).select("vec_id", "label", V.euclidean(F.col("v"), F.col("q")).alias("d"))


@query("o1_distance_sort", f"SELECT vec_id, round(d, 9) AS d, row_number() OVER (PARTITION BY label ORDER BY d, vec_id) AS place FROM {DIST}")
def o1(t):
    return spread.number_rows(_dist(t), ["label"], ["d", "vec_id"], "place").select("vec_id", F.round("d", 9).alias("d"), "place").orderBy("d")


@query("o2_top_n", f"SELECT vec_id, round(d, 9) AS d FROM (SELECT *, row_number() OVER (PARTITION BY vec_id // 4 ORDER BY d, vec_id) AS r FROM {DIST}) WHERE r = 1 ORDER BY d, vec_id LIMIT 50")
def o2(t):
    one = T.first_row(_dist(t).withColumn("acc", F.expr("vec_id div 4")), ["acc"], ["d", "vec_id"])
    return one.orderBy("d", "vec_id").limit(50).select("vec_id", F.round("d", 9).alias("d"))


@query("o3_first_and_last", "WITH d AS (SELECT DISTINCT l_quantity AS q, l_returnflag AS f FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY q) AS a, row_number() OVER (PARTITION BY f ORDER BY q DESC) AS z FROM d) SELECT f, q, a <= 3 AS is_first FROM r WHERE a <= 3 OR z <= 3")
def o3(t):
    d = t.lineitem.select(F.col("l_quantity").alias("q"), F.col("l_returnflag").alias("f")).distinct()
    w = Window.partitionBy("f")
    r = d.withColumn("a", F.row_number().over(w.orderBy("q"))).withColumn("z", F.row_number().over(w.orderBy(F.desc("q"))))
    return r.where("a <= 3 or z <= 3").select("f", "q", (F.col("a") <= 3).alias("is_first"))


@query("o4_capped_selection", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT least(200, 150)")
def o4(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(min(200, 150))


@query(
    "o5_user_order",
    "SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY p NULLS LAST, c_mktsegment, c_custkey) AS place FROM customer LEFT JOIN (VALUES ('MACHINERY', 0), ('AUTOMOBILE', 1), ('unknown', 2)) o(s, p) ON c_mktsegment = s",
)
def o5(t):
    place = {"MACHINERY": 0, "AUTOMOBILE": 1, "unknown": 2}
    p = F.create_map(*[F.lit(x) for kv in place.items() for x in kv])[F.col("c_mktsegment")]
    c = t.customer.select("c_custkey", "c_nationkey", "c_mktsegment", p.alias("p"))
    return spread.number_rows(c, ["c_nationkey"], [F.asc_nulls_last("p"), "c_mktsegment", "c_custkey"], "place").select("c_custkey", "place")


@query("o6_half_split", "SELECT l_orderkey, l_linenumber, l_tax <= (SELECT quantile_cont(l_tax, 0.5) FROM lineitem) AS lower_half FROM lineitem")
def o6(t):
    m = spread.quantiles(t.lineitem, [], "l_tax", {"m": 0.5})
    return t.lineitem.crossJoin(F.broadcast(m)).select("l_orderkey", "l_linenumber", (F.col("l_tax") <= F.col("m")).alias("lower_half"))


@query("o7_shortlist", "WITH s AS (SELECT event_id, value FROM events WHERE value <= (SELECT quantile_cont(value, 0.1) FROM events)) SELECT event_id, round_even(value, 2) AS score, row_number() OVER (ORDER BY value, event_id) AS place FROM s")
def o7(t):
    """The shortlist is a tenth of the rows: its places are numbered by ranges, not in one sorted task."""
    s = T.quantile_cut(t.events.select("event_id", "value"), "value", 0.1)
    return spread.number_rows(s, [], ["value", "event_id"], "place").select("event_id", F.bround("value", 2).alias("score"), "place")


@query("o8_round_robin", "SELECT c_custkey, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) % 4 AS bucket FROM customer")
def o8(t):
    c = spread.number_rows(t.customer.select("c_custkey", "c_nationkey"), ["c_nationkey"], ["c_custkey"], "r")
    return c.select("c_custkey", F.pmod(F.col("r") - 1, F.lit(4)).alias("bucket"))


@query("o9_top_fraction", "SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS r, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem) WHERE r <= floor(0.05 * n) + 1")
def o9(t):
    li = t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice")
    r = spread.number_rows(li, ["l_returnflag"], [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber"], "r", "n")
    return r.where("r <= floor(0.05 * n) + 1").select("l_orderkey", "l_linenumber")
