"""Window functions (W1-W14)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import vector as V
from ..operators import spread
from ..operators import tables as T
from .base import query

RANK = "(rank() OVER (PARTITION BY user_id ORDER BY value) + (count(*) OVER (PARTITION BY user_id, value) - 1) / 2.0)"


@query("w1_pct_rank", f"SELECT * FROM (SELECT event_id, user_id, 100.0 * {RANK} / count(*) OVER (PARTITION BY user_id) AS pct FROM events) WHERE pct <= 25")
def w1(t):
    pct = 100.0 * T.average_rank("value", ["user_id"]) / F.count("*").over(Window.partitionBy("user_id"))
    return t.events.select("event_id", "user_id", pct.alias("pct")).where("pct <= 25")


@query(
    "w2_fractional_rank",
    """WITH r AS (SELECT o_orderkey, (rank() OVER (ORDER BY a DESC NULLS LAST) + (count(*) OVER (PARTITION BY a) - 1) / 2.0) / count(*) OVER () AS fa,
       (rank() OVER (ORDER BY b DESC NULLS LAST) + (count(*) OVER (PARTITION BY b) - 1) / 2.0) / count(*) OVER () AS fb FROM (SELECT o_orderkey, o_totalprice AS a, CASE WHEN o_custkey % 10 = 0 THEN NULL ELSE o_custkey END AS b FROM orders))
       SELECT o_orderkey, round(fa, 9) AS fa, round(fb, 9) AS fb FROM r WHERE fa <= 0.3 AND fb <= 0.3""",
)
def w2(t):
    """Global fractional ranks through range-partitioned counts; missing values share the bottom rank."""
    o = t.orders.select("o_orderkey", F.col("o_totalprice").alias("a"), F.expr("CASE WHEN o_custkey % 10 = 0 THEN NULL ELSE o_custkey END").alias("b"))
    n = o.agg(F.count("*").alias("n"), F.count("a").alias("na"), F.count("b").alias("nb"))
    for c in ("a", "b"):
        o = T.global_average_rank(o, c, f"r{c}")

    def frac(c):
        have, all_ = F.col(f"n{c}"), F.col("n")
        return F.coalesce(have + 1 - F.col(f"r{c}"), have + (all_ - have + 1) / 2.0) / all_

    return o.crossJoin(F.broadcast(n)).select("o_orderkey", frac("a").alias("fa"), frac("b").alias("fb")).where("fa <= 0.3 and fb <= 0.3").select("o_orderkey", F.round("fa", 9).alias("fa"), F.round("fb", 9).alias("fb"))


@query("w3_sequential_rank", "SELECT o_orderkey, o_orderpriority, row_number() OVER w AS rank, round(100.0 * row_number() OVER w / count(*) OVER (PARTITION BY o_orderpriority), 9) AS percent FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey)")
def w3(t):
    o = spread.number_rows(t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice"), ["o_orderpriority"], ["o_totalprice", "o_orderkey"], "rank", "n")
    return o.select("o_orderkey", "o_orderpriority", "rank", F.round(100.0 * F.col("rank") / F.col("n"), 9).alias("percent"))


@query(
    "w4_top_k",
    """WITH r AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC NULLS LAST, event_id) AS rank FROM events WHERE value >= 1)
       SELECT user_id, event_id, value, rank, (SELECT count(*) FROM events e WHERE e.user_id = r.user_id) - least(3, count(*) OVER (PARTITION BY user_id)) AS dropped FROM r WHERE rank <= 3""",
)
def w4(t):
    """Each user's three highest of 1 or more, and how many of the user's rows are left out, by the minimum or by rank."""
    best = T.top_k(t.events.where("value >= 1").select("user_id", "event_id", "value"), ["user_id"], [F.desc_nulls_last("value"), F.col("event_id")], 3)
    rows = t.events.groupBy("user_id").agg(F.count("*").alias("_all")).join(best.groupBy("user_id").agg(F.count("*").alias("_kept")), "user_id")
    return best.join(rows.select("user_id", (F.col("_all") - F.col("_kept")).alias("dropped")), "user_id")


@query(
    "w5_nested_neighbourhood",
    "SELECT g.p::INT AS p, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value, event_type, event_id) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events) e, (SELECT unnest(generate_series(5, 50, 15)) AS p) g WHERE r <= greatest(1, ceil(g.p * n / 100.0))",
)
def w5(t):
    w = Window.partitionBy("user_id")
    e = t.events.withColumn("r", F.row_number().over(w.orderBy("value", "event_type", "event_id"))).withColumn("n", F.count("*").over(w))
    e = e.withColumn("p", F.explode(F.array(*[F.lit(p) for p in range(5, 51, 15)])))
    return e.where(F.col("r") <= F.greatest(F.lit(1), F.ceil(F.col("p") * F.col("n") / 100.0))).select("p", "event_id")


@query("w6_from_best", "SELECT event_id, round(100.0 * (value - lo) / (q - lo + 1e-8), 6) AS percent FROM events JOIN (SELECT user_id, min(value) AS lo, quantile_cont(value, 0.1) AS q FROM events GROUP BY 1) USING (user_id)")
def w6(t):
    s = t.events.groupBy("user_id").agg(F.min("value").alias("lo"), F.percentile("value", 0.1).alias("q"))
    return t.events.join(s, "user_id").select("event_id", F.round(100.0 * (F.col("value") - F.col("lo")) / (F.col("q") - F.col("lo") + 1e-8), 6).alias("percent"))


@query(
    "w7_bands",
    "SELECT *, row_number() OVER (PARTITION BY band ORDER BY l_extendedprice, l_orderkey, l_linenumber) AS place FROM (SELECT l_orderkey, l_linenumber, l_extendedprice, CASE WHEN l_extendedprice <= p10 THEN 'P10' WHEN l_extendedprice <= p20 THEN 'P20' WHEN l_extendedprice <= p30 THEN 'P30' WHEN l_extendedprice <= p50 THEN 'P50' ELSE 'rest' END AS band FROM lineitem, (SELECT quantile_cont(l_extendedprice, 0.1) AS p10, quantile_cont(l_extendedprice, 0.2) AS p20, quantile_cont(l_extendedprice, 0.3) AS p30, quantile_cont(l_extendedprice, 0.5) AS p50 FROM lineitem))",
)
def w7(t):
    x = F.col("l_extendedprice")
    shares = (10, 20, 30, 50)
    cuts = spread.quantiles(t.lineitem, [], "l_extendedprice", {f"P{p}": p / 100 for p in shares})
    band = F.coalesce(*[F.when(x <= F.col(f"P{p}"), f"P{p}") for p in shares], F.lit("rest"))
    banded = t.lineitem.crossJoin(F.broadcast(cuts)).select("l_orderkey", "l_linenumber", "l_extendedprice", band.alias("band"))  # one row is broadcast
    return spread.number_rows(banded, ["band"], ["l_extendedprice", "l_orderkey", "l_linenumber"], "place")


@query(
    "w8_strata",
    "SELECT l_orderkey, l_linenumber, round(1 - (r - 0.5) / n, 9) AS height, CASE WHEN r <= 0.1 * n THEN 'top' WHEN r <= 0.5 * n THEN 'middle' ELSE 'low' END AS stratum FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice, l_orderkey, l_linenumber) AS r, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)",
)
def w8(t):
    order = ["l_extendedprice", "l_orderkey", "l_linenumber"]
    li = spread.number_rows(t.lineitem.select("l_returnflag", *order), ["l_returnflag"], order, "r", "n")
    part = F.when(F.col("r") <= 0.1 * F.col("n"), "top").when(F.col("r") <= 0.5 * F.col("n"), "middle").otherwise("low")
    return li.select("l_orderkey", "l_linenumber", F.round(1 - (F.col("r") - 0.5) / F.col("n"), 9).alias("height"), part.alias("stratum"))


@query("w9_global_rank", "SELECT l_orderkey, l_linenumber, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS rank FROM lineitem")
def w9(t):
    return T.global_average_rank(t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice"), "l_extendedprice").drop("l_extendedprice")


@query("w10_first_row", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS r FROM orders) WHERE r = 1")
def w10(t):
    return T.first_row(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], ["o_totalprice", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query(
    "w11_merge_intervals",
    """WITH i AS (SELECT user_id, event_type, (event_id % 997) AS s, (event_id % 997) + (user_id + event_id) % 9 AS e FROM events),
       m AS (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY user_id, event_type ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 + 2 OR row_number() OVER (PARTITION BY user_id, event_type ORDER BY s, e) = 1 THEN 1 ELSE 0 END AS new FROM i),
       g AS (SELECT *, sum(new) OVER (PARTITION BY user_id, event_type ORDER BY s, e, new DESC ROWS UNBOUNDED PRECEDING) AS g FROM m)
       SELECT user_id, event_type, min(s) AS s, max(e) AS e FROM g GROUP BY user_id, event_type, g HAVING max(e) - min(s) + 1 >= 3""",
)
def w11(t):
    i = t.events.selectExpr("user_id", "event_type", "event_id % 997 AS s", "event_id % 997 + (user_id + event_id) % 9 AS e")
    return T.merge_intervals(i, ["user_id", "event_type"], "s", "e", gap=2, min_length=3)


@query(
    "w12_runs",
    """WITH p AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, event_id, ts FROM events),
       g AS (SELECT *, pos - row_number() OVER (PARTITION BY user_id, event_type ORDER BY pos) AS g FROM p)
       SELECT user_id, event_type, min(pos) AS s, max(pos) AS e FROM g GROUP BY user_id, event_type, g""",
)
def w12(t):
    p = t.events.withColumn("pos", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long"))
    g = p.withColumn("g", F.col("pos") - F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("pos")))
    return g.groupBy("user_id", "event_type", "g").agg(F.min("pos").alias("s"), F.max("pos").alias("e")).drop("g")


@query(
    "w13_weighted_ranks",
    """WITH v AS (SELECT l_returnflag AS f, l_extendedprice AS x, sum(l_quantity) AS w FROM lineitem GROUP BY 1, 2)
       SELECT f, x, round(sum(w) OVER (PARTITION BY f ORDER BY x) - w + (w + 1) / 2.0, 4) AS rank FROM v""",
)
def w13(t):
    v = t.lineitem.groupBy(F.col("l_returnflag").alias("f"), F.col("l_extendedprice").alias("x")).agg(F.sum("l_quantity").alias("w"))
    v = spread.running(v, ["f"], ["x"], {"upto": ("sum", F.col("w"))})
    return v.select("f", "x", F.round(F.col("upto") - F.col("w") + (F.col("w") + 1) / 2.0, 4).alias("rank"))


@query("w14_torsions")
def w14(t):
    """Torsion angles over consecutive points; a vector's triples are the points of a chain."""
    p = t.embeddings.select("vec_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: F.slice(V.doubles(F.col("embedding")), i * 3 + 1, 3))).alias("i", "p"))
    w = Window.partitionBy("vec_id").orderBy("i")
    q = p.select("vec_id", "i", F.lag("p").over(w).alias("a"), F.col("p").alias("b"), F.lead("p").over(w).alias("c"), F.lead("p", 2).over(w).alias("d")).where("a is not null and d is not null")
    return q.select("vec_id", "i", V.torsion(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("angle"))
