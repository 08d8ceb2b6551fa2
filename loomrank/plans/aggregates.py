"""Aggregations (A1-A28)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import vector as V
from ..operators import spread
from ..operators import tables as T
from .base import query
from .projections import KQ, K


def _ev(t):
    return t.events.selectExpr("event_id", "user_id", "event_type", "value", f"{K} AS k")


@query(
    "a1_dedup_members",
    "SELECT c_nationkey, c_mktsegment, min(c_custkey) AS c_custkey, arg_min(c_acctbal, c_custkey) AS c_acctbal, string_agg(c_custkey::VARCHAR, ',' ORDER BY c_custkey) AS members FROM customer GROUP BY 1, 2",
)
def a1(t):
    g = t.customer.groupBy("c_nationkey", "c_mktsegment")
    ids = F.array_join(F.array_sort(F.collect_list("c_custkey")).cast("array<string>"), ",")
    return g.agg(F.min("c_custkey").alias("c_custkey"), F.min_by("c_acctbal", "c_custkey").alias("c_acctbal"), ids.alias("members"))


@query(
    "a2_groups_of_two",
    "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey // 4 ORDER BY c_custkey) AS r FROM customer) WHERE r = 1 GROUP BY 1, 2 HAVING count(*) >= 2",
)
def a2(t):
    c = T.first_row(t.customer.withColumn("acc", F.expr("c_custkey div 4")), ["acc"], ["c_custkey"])
    return c.groupBy("c_mktsegment", "c_nationkey").agg(F.count("*").alias("n")).where("n >= 2")


@query("a3_entity_means", f"SELECT user_id, round(avg(value), 6) AS value, round(avg({KQ}), 6) AS k FROM events GROUP BY user_id")
def a3(t):
    return _ev(t).groupBy("user_id").agg(F.round(F.avg("value"), 6).alias("value"), F.round(F.avg("k"), 6).alias("k"))


@query("a4_min_summary", f"SELECT user_id, min(value) AS value, min({KQ}) AS k FROM events GROUP BY user_id")
def a4(t):
    """Column-wise minima: values of one result row may come from different rows."""
    return _ev(t).groupBy("user_id").agg(F.min("value").alias("value"), F.min("k").alias("k"))


@query("a5_best_row", f"SELECT user_id, event_type, event_id, value, k FROM (SELECT *, {KQ} AS k, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value, event_id) AS r FROM events WHERE value IS NOT NULL) WHERE r = 1")
def a5(t):
    return T.best_row(_ev(t), ["user_id", "event_type"], "value", "event_id").select("user_id", "event_type", "event_id", "value", "k")


@query(
    "a6_best_per_metric",
    f"WITH e AS (SELECT *, {KQ} AS k FROM events) SELECT user_id, max(value) AS best_value, min(event_id) FILTER (value = mv) AS value_event, max(k) AS best_k, min(event_id) FILTER (k = mk) AS k_event FROM (SELECT *, max(value) OVER (PARTITION BY user_id) AS mv, max(k) OVER (PARTITION BY user_id) AS mk FROM e) GROUP BY user_id",
)
def a6(t):
    def best(c):
        return F.max_by("event_id", F.when(F.col(c).isNotNull(), F.struct(c, -F.col("event_id"))))

    return _ev(t).groupBy("user_id").agg(F.max("value").alias("best_value"), best("value").alias("value_event"), F.max("k").alias("best_k"), best("k").alias("k_event"))


@query("a7_quantile_cut", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_extendedprice <= (SELECT quantile_cont(l_extendedprice, 0.1) FROM lineitem)")
def a7(t):
    return T.quantile_cut(t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice"), "l_extendedprice", 0.1)


@query(
    "a8_descriptive",
    "SELECT l_returnflag, l_linestatus, count(l_extendedprice) AS n, round(avg(l_extendedprice), 4) AS mean, round(stddev_samp(l_extendedprice), 4) AS sd, round(quantile_cont(l_extendedprice, 0.5), 4) AS median, round(quantile_cont(l_extendedprice, 0.25), 4) AS q1, round(quantile_cont(l_extendedprice, 0.75), 4) AS q3, min(l_extendedprice) AS low, max(l_extendedprice) AS high FROM lineitem GROUP BY 1, 2",
)
def a8(t):
    x = "l_extendedprice"
    keys = ["l_returnflag", "l_linestatus"]
    out = t.lineitem.groupBy(*keys).agg(F.count(x).alias("n"), F.round(F.avg(x), 4).alias("mean"), F.round(F.stddev_samp(x), 4).alias("sd"), F.min(x).alias("low"), F.max(x).alias("high"))
    out = spread.join_on_keys(out, spread.quantiles(t.lineitem, keys, x, {"median": 0.5, "q1": 0.25, "q3": 0.75}), keys)
    return out.select(*keys, "n", "mean", "sd", *[F.round(n, 4).alias(n) for n in ("median", "q1", "q3")], "low", "high")


@query("a9_two_level", "SELECT event_type, count(*) AS n, round(avg(m), 6) AS mean, round(stddev_samp(m), 6) AS sd FROM (SELECT event_type, user_id, avg(value) AS m FROM events GROUP BY 1, 2) GROUP BY 1")
def a9(t):
    per = t.events.groupBy("event_type", "user_id").agg(F.avg("value").alias("m"))
    return per.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("m"), 6).alias("mean"), F.round(F.stddev_samp("m"), 6).alias("sd"))


@query("a10_value_counts", "SELECT coalesce(CASE WHEN event_type = 'error' THEN NULL ELSE event_type END, '(missing)') AS status, count(*) AS n FROM events GROUP BY 1")
def a10(t):
    status = F.coalesce(F.nullif("event_type", F.lit("error")), F.lit("(missing)"))
    return t.events.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query("a11_cluster_summary", "SELECT sum(n)::BIGINT AS inputs, count(*) AS clusters, max(n) AS largest, count(*) FILTER (n = 1) AS singletons FROM (SELECT c_nationkey, c_mktsegment, c_custkey % 5 AS m, count(*) AS n FROM customer GROUP BY 1, 2, 3)")
def a11(t):
    sizes = t.customer.groupBy("c_nationkey", "c_mktsegment", F.expr("c_custkey % 5").alias("m")).agg(F.count("*").alias("n"))
    return sizes.agg(F.sum("n").alias("inputs"), F.count("*").alias("clusters"), F.max("n").alias("largest"), F.count_if(F.col("n") == 1).alias("singletons"))


@query(
    "a12_retention_curve",
    "SELECT g.t::DOUBLE AS t, count(*) FILTER (l_quantity <= g.t) AS n, round(100.0 * count(*) FILTER (l_quantity <= g.t) / count(*), 6) AS percent FROM lineitem, (SELECT unnest(generate_series(0, 50, 5)) AS t) g GROUP BY 1",
)
def a12(t):
    """Counts per grid cell, then a running sum over the few cells: rows are never multiplied by the grid."""
    cell = F.least(F.greatest(F.ceil(F.col("l_quantity") / 5) * 5, F.lit(0)), F.lit(55)).cast("double")
    counts = t.lineitem.groupBy(cell.alias("t")).agg(F.count("*").alias("c"))
    grid = t.spark.range(0, 60, 5).select(F.col("id").cast("double").alias("t"))
    run = F.sum(F.coalesce("c", F.lit(0))).over(Window.orderBy("t"))
    whole = F.sum("c").over(Window.partitionBy())
    return grid.join(counts, "t", "left").select("t", run.alias("n"), F.round(100.0 * run / whole, 6).alias("percent")).where("t <= 50")


@query("a13_row_mean", "SELECT l_orderkey, l_linenumber, round((l_quantity + l_discount + l_tax) / 3, 9) AS mean FROM lineitem")
def a13(t):
    cols = T.pick_columns(t.lineitem.select("l_quantity", "l_discount", "l_tax"), prefix="l_")
    have = sum((F.col(c).isNotNull().cast("int") for c in cols), F.lit(0))
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in cols), F.lit(0.0))
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(F.try_divide(total, have), 9).alias("mean"))


@query("a14_retention_by_donor", "SELECT round(min(p), 6) AS low, round(quantile_cont(p, 0.5), 6) AS median, round(max(p), 6) AS high FROM (SELECT user_id, 100.0 * count(*) FILTER (value <= 10) / count(*) AS p FROM events GROUP BY 1)")
def a14(t):
    per = t.events.groupBy("user_id").agg((100.0 * F.count_if(F.col("value") <= 10) / F.count("*")).alias("p"))
    ends = per.agg(F.round(F.min("p"), 6).alias("low"), F.round(F.max("p"), 6).alias("high"))
    return ends.crossJoin(spread.quantiles(per, [], "p", {"median": 0.5})).select("low", F.round("median", 6).alias("median"), "high")


@query(
    "a15_pass_rates",
    f"SELECT g.t::DOUBLE AS t, count(*) AS n, round(avg(CASE WHEN {KQ} > 50 THEN 1.0 ELSE 0.0 END), 6) AS pass_k, count(DISTINCT user_id) AS donors, count(DISTINCT event_type) AS carriers FROM events, (SELECT unnest([2, 5, 10, 20, 40]) AS t) g WHERE value <= g.t GROUP BY 1",
)
def a15(t):
    """Rows join only thresholds they pass; the grid is a literal of five values."""
    e = _ev(t).withColumn("t", F.explode(F.array(*[F.lit(float(x)) for x in (2, 5, 10, 20, 40)]))).where("value <= t")
    return e.groupBy("t").agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("k") > 50, 1.0).otherwise(0.0)), 6).alias("pass_k"), F.count_distinct("user_id").alias("donors"), F.count_distinct("event_type").alias("carriers"))


@query("a16_position_grid", "SELECT i, j, round(avg(m), 6) AS mean FROM (SELECT event_type, user_id % 10 AS i, event_id % 10 AS j, avg(value) AS m FROM events GROUP BY 1, 2, 3) GROUP BY 1, 2")
def a16(t):
    per = t.events.groupBy("event_type", F.expr("user_id % 10").alias("i"), F.expr("event_id % 10").alias("j")).agg(F.avg("value").alias("m"))
    return per.groupBy("i", "j").agg(F.round(F.avg("m"), 6).alias("mean"))


@query("a17_task_overview", "SELECT event_type, min(value) AS low, round(quantile_cont(value, 0.5), 6) AS median, max(value) AS high, round(avg(value), 6) AS mean, round(sum(value), 4) AS total FROM events GROUP BY 1")
def a17(t):
    out = t.events.groupBy("event_type").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.sum("value"), 4).alias("total"))
    return spread.join_on_keys(out, spread.quantiles(t.events, ["event_type"], "value", {"median": 0.5}), ["event_type"]).withColumn("median", F.round("median", 6))


@query("a18_pair_count", "SELECT sum(n * (n - 1) / 2)::BIGINT AS pairs FROM (SELECT count(*) AS n FROM customer GROUP BY c_nationkey, c_mktsegment)")
def a18(t):
    n = t.customer.groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    return n.agg(F.sum(F.expr("n * (n - 1) div 2")).alias("pairs"))


@query(
    "a19_paired_2x2",
    "WITH p AS (SELECT user_id, avg(value) FILTER (event_type = 'click') AS a, avg(value) FILTER (event_type = 'view') AS b FROM events GROUP BY 1) SELECT t::DOUBLE AS t, count(*) FILTER (a < t AND b < t) AS both_pass, count(*) FILTER (a >= t AND b >= t) AS neither, count(*) FILTER (a < t AND b >= t) AS only_a, count(*) FILTER (a >= t AND b < t) AS only_b FROM p, (SELECT unnest([5, 8, 12]) AS t) WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1",
)
def a19(t):
    wide = t.events.groupBy("user_id").pivot("event_type", ["click", "view"]).agg(F.avg("value")).where("click is not null and view is not null")
    rows = wide.withColumn("t", F.explode(F.array(*[F.lit(float(x)) for x in (5, 8, 12)])))
    tests = {"both_pass": "click < t and view < t", "neither": "click >= t and view >= t", "only_a": "click < t and view >= t", "only_b": "click >= t and view < t"}
    return rows.groupBy("t").agg(*[F.count_if(F.expr(e)).alias(n) for n, e in tests.items()])


@query("a20_all_below", "SELECT l_orderkey, l_linenumber, l_discount < 0.06 AND l_tax < 0.06 AND l_quantity < 30 AS all_below FROM lineitem")
def a20(t):
    below = F.greatest(F.col("l_discount") / 0.06, F.col("l_tax") / 0.06, F.col("l_quantity") / 30) < 1
    exact = (F.col("l_discount") < 0.06) & (F.col("l_tax") < 0.06) & (F.col("l_quantity") < 30)
    return t.lineitem.select("l_orderkey", "l_linenumber", (exact & (below | exact)).alias("all_below"))


@query("a21_min_max", "SELECT l_orderkey, l_linenumber, round((l_quantity - lo) / (hi - lo), 9) AS scaled, round(1 - (l_quantity - lo) / (hi - lo), 9) AS inverted FROM lineitem, (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem)")
def a21(t):
    ends = t.lineitem.agg(F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"))
    x = F.try_divide(F.col("l_quantity") - F.col("lo"), F.col("hi") - F.col("lo"))
    return t.lineitem.crossJoin(F.broadcast(ends)).select("l_orderkey", "l_linenumber", F.round(x, 9).alias("scaled"), F.round(1 - x, 9).alias("inverted"))


@query(
    "a22_z_scores",
    """WITH e AS (SELECT vec_id, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
       s AS (SELECT i, avg(x) AS m, stddev_pop(x) AS s0, stddev_samp(x) AS s1 FROM e GROUP BY i)
       SELECT vec_id, round(sum((x - m) / s0), 6) AS scaled_sum, round(sum((x - m) / s1), 6) AS z_sum FROM e JOIN s USING (i) GROUP BY vec_id""",
)
def a22(t):
    e = t.embeddings.select("vec_id", F.posexplode(V.doubles(F.col("embedding"))).alias("i", "x"))
    s = e.groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s0"), F.stddev_samp("x").alias("s1"))
    z = e.join(F.broadcast(s), "i")
    d = F.col("x") - F.col("m")
    return z.groupBy("vec_id").agg(F.round(F.sum(F.try_divide(d, F.col("s0"))), 6).alias("scaled_sum"), F.round(F.sum(F.try_divide(d, F.col("s1"))), 6).alias("z_sum"))


@query("a23_order_by_median", "SELECT event_type, median, row_number() OVER (ORDER BY median NULLS LAST, event_type) AS place FROM (SELECT event_type, round(quantile_cont(value, 0.5) FILTER (event_type <> 'error'), 6) AS median FROM events GROUP BY 1)")
def a23(t):
    some = t.events.select("event_type", F.when(F.col("event_type") != "error", F.col("value")).alias("value"))
    m = spread.quantiles(some, ["event_type"], "value", {"median": 0.5}).withColumn("median", F.round("median", 6))
    return m.withColumn("place", F.row_number().over(Window.orderBy(F.asc_nulls_last("median"), "event_type")).cast("long"))


@query(
    "a24_task_counts",
    "SELECT event_type, count(DISTINCT user_id) AS candidates, count(DISTINCT user_id) FILTER (value <= 10) AS filtered, count(DISTINCT user_id) FILTER (value <= 0.5) AS best, string_agg(DISTINCT user_id::VARCHAR, ',' ORDER BY user_id::VARCHAR) FILTER (value <= 0.5) AS best_ids FROM events GROUP BY 1",
)
def a24(t):
    best = F.when(F.col("value") <= 0.5, F.col("user_id"))
    ids = F.array_join(F.sort_array(F.collect_set(best.cast("string"))), ",")
    return t.events.groupBy("event_type").agg(
        F.count_distinct("user_id").alias("candidates"), F.count_distinct(F.when(F.col("value") <= 10, F.col("user_id"))).alias("filtered"), F.count_distinct(best).alias("best"), F.nullif(ids, F.lit("")).alias("best_ids")
    )


@query(
    "a25_histogram",
    """WITH s AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, least(40, greatest(5, ceil(sqrt(count(*))))) AS b FROM lineitem)
       SELECT CASE WHEN hi = lo THEN 0 ELSE least(b - 1, floor((l_extendedprice - lo) / ((hi - lo) / b))) END::BIGINT AS bin, count(*) AS n FROM lineitem, s GROUP BY 1""",
)
def a25(t):
    return T.histogram(t.lineitem, "l_extendedprice")


@query("a26_run_metadata", "SELECT min(n) AS fewest, max(n) AS most, count(DISTINCT user_id) AS donors, count(DISTINCT event_type) AS carriers FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)")
def a26(t):
    n = t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return n.agg(F.min("n").alias("fewest"), F.max("n").alias("most"), F.count_distinct("user_id").alias("donors"), F.count_distinct("event_type").alias("carriers"))


@query("a27_member_union", "SELECT conv_id, string_agg(role, ',' ORDER BY o) AS roles FROM (SELECT conv_id, role, min(turn) AS o FROM conversations GROUP BY 1, 2) GROUP BY 1")
def a27(t):
    first = t.conversations.groupBy("conv_id", "role").agg(F.min("turn").alias("o"))
    ordered = F.array_sort(F.collect_list(F.struct("o", "role")))
    return first.groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda x: x["role"]), ",").alias("roles"))


@query("a28_class_fraction", "SELECT label, count(*) FILTER (vec_id % 3 = 0) / count(*)::DOUBLE AS fraction FROM embeddings GROUP BY 1")
def a28(t):
    return t.embeddings.groupBy("label").agg((F.count_if(F.col("vec_id") % 3 == 0) / F.count("*")).alias("fraction"))
