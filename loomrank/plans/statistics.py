"""Statistics (T1-T20)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import spread
from ..operators import statistics as S
from ..operators import tables as T
from .base import query
from .projections import KQ, K

E = f"(SELECT event_id, user_id, event_type, value AS x, ({KQ})::DOUBLE AS y FROM events)"
#: replicates of every resampling
B = 10_000


def _ev(t):
    return t.events.selectExpr("event_id", "user_id", "event_type", "value AS x", f"CAST({K} AS DOUBLE) AS y")


def _ranked_sql(src, keys):
    return f"(SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY x) + (count(*) OVER (PARTITION BY {keys}, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY {keys} ORDER BY y) + (count(*) OVER (PARTITION BY {keys}, y) - 1) / 2.0 AS ry FROM {src})"


@query("t1_correlation", f"SELECT event_type, round(corr(x, y), 9) AS pearson, round(corr(rx, ry), 9) AS spearman, count(*) AS n FROM {_ranked_sql(E, 'event_type')} GROUP BY 1")
def t1(t):
    r = S.with_ranks(_ev(t), ["event_type"], ["x", "y"])
    return r.groupBy("event_type").agg(F.round(S.pearson("x", "y"), 9).alias("pearson"), F.round(S.pearson("r_x", "r_y"), 9).alias("spearman"), F.count("*").alias("n"))


@query("t2_p_value")
def t2(t):
    r = t.lineitem.groupBy("l_returnflag").agg(S.pearson("l_quantity", "l_extendedprice").alias("r"), F.count("*").alias("n"))
    return r.select("l_returnflag", "r", "n", S.correlation_p("r", F.col("n").cast("double")).alias("p"))


@query("t3_correlation_table", f"SELECT event_type, metric, round(corr(x, v), 9) AS r, count(*) AS n FROM (UNPIVOT (SELECT event_type, x, y, user_id::DOUBLE AS u FROM {E}) ON y, u INTO NAME metric VALUE v) GROUP BY 1, 2")
def t3(t):
    long = _ev(t).withColumn("u", F.col("user_id").cast("double")).unpivot(["event_type", "x"], ["y", "u"], "metric", "v")
    return long.groupBy("event_type", "metric").agg(F.round(S.pearson("x", "v"), 9).alias("r"), F.count("*").alias("n"))


_GRID = "(SELECT unnest(range(31)) AS t)"
_SWEEP = f"(SELECT e.*, g.t::DOUBLE AS t FROM {E} e, {_GRID} g WHERE x <= g.t)"


@query(
    "t4_threshold_sweep",
    f"""SELECT t, event_type, round(CASE WHEN count(*) >= 3 THEN corr(rx, ry) END, 9) AS rho, count(*) AS n, round(100.0 * count(*) / any_value(al), 9) AS retained
        FROM {_ranked_sql(_SWEEP, 't, event_type')} JOIN (SELECT event_type, count(*) AS al FROM events GROUP BY 1) USING (event_type) GROUP BY 1, 2""",
)
def t4(t):
    """Thresholds 0 to 30 on x; each subset lies in the next, so values are counted once and ranked for all of them together."""
    found = S.nested_spearman(_ev(t), ["event_type"], "x", "y", "x", list(range(31)))
    return found.select(F.col("threshold").alias("t"), "event_type", F.round("rho", 9).alias("rho"), "n", F.round("retained", 9).alias("retained"))


_PCT = f"""(SELECT *, 100.0 * (rank() OVER (PARTITION BY user_id ORDER BY x) + (count(*) OVER (PARTITION BY user_id, x) - 1) / 2.0) / count(*) OVER (PARTITION BY user_id) AS pct,
    100.0 * (x - min(x) OVER (PARTITION BY user_id)) / (quantile_cont(x, 0.1) OVER (PARTITION BY user_id) - min(x) OVER (PARTITION BY user_id) + 1e-8) AS diff FROM {E})"""
_SWEEP5 = f"""(SELECT e.*, 'rank' AS measure, g.p::DOUBLE AS p FROM {_PCT} e, (SELECT unnest(range(5, 100, 5)) AS p) g WHERE pct <= g.p
    UNION ALL SELECT e.*, 'best', g.p::DOUBLE FROM {_PCT} e, (SELECT unnest(range(5, 55, 5)) AS p) g WHERE diff <= g.p)"""


@query("t5_percent_sweep", f"SELECT measure, p, round(CASE WHEN count(*) >= 3 THEN corr(rx, ry) END, 9) AS rho, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM events), 9) AS retained FROM {_ranked_sql(_SWEEP5, 'measure, p')} GROUP BY 1, 2")
def t5(t):
    """Two nested sweeps: a user's rows up to a percent of them, and rows up to a difference from the user's best.

    The difference is in percent of that between the best and the lowest decile.
    """
    e = spread.cut(_ev(t).select("user_id", "x", "y"))
    counts = e.groupBy("user_id").agg(F.count("x").alias("k"), F.min("x").alias("best"))
    ranked = spread.average_ranks(e, ["user_id"], "x", "r")
    ranked = spread.join_on_keys(ranked, spread.join_on_keys(counts, spread.quantiles(e, ["user_id"], "x", {"decile": 0.1}), ["user_id"]), ["user_id"])
    both = spread.cut(ranked.select("x", "y", (100.0 * F.col("r") / F.col("k")).alias("pct"), (100.0 * (F.col("x") - F.col("best")) / (F.col("decile") - F.col("best") + 1e-8)).alias("diff")))
    found = [
        S.nested_spearman(both, [], "x", "y", by, list(range(5, end, 5))).select(F.lit(measure).alias("measure"), F.col("threshold").alias("p"), F.round("rho", 9).alias("rho"), "n", F.round("retained", 9).alias("retained"))
        for measure, by, end in (("rank", "pct", 100), ("best", "diff", 55))
    ]
    return found[0].unionByName(found[1])


_CL = f"(SELECT *, row_number() OVER (ORDER BY user_id) - 1 AS c FROM (SELECT user_id, count(*) AS n, sum(rx) AS sx, sum(ry) AS sy, sum(rx * rx) AS sxx, sum(ry * ry) AS syy, sum(rx * ry) AS sxy FROM {_ranked_sql(E, '1=1')} GROUP BY 1))"
_DRAW = "(('0x' || substr(md5(b || ':' || i), 1, 8))::BIGINT % k)"


def _boot_sql(replicates):
    return f"""cl AS {_CL}, k AS (SELECT count(*) AS k FROM cl), d AS (SELECT b, {_DRAW} AS c FROM (SELECT unnest(range({replicates})) AS b), k, (SELECT unnest(range((SELECT k FROM k))) AS i)),
        s AS (SELECT b, sum(n) AS n, sum(sx) AS sx, sum(sy) AS sy, sum(sxx) AS sxx, sum(syy) AS syy, sum(sxy) AS sxy FROM d JOIN cl USING (c) GROUP BY 1), r AS (SELECT b, (n * sxy - sx * sy) / (sqrt(n * sxx - sx * sx) * sqrt(n * syy - sy * sy)) AS r FROM s)"""


def _sums(t):
    r = T.global_average_rank(_ev(t), "x", "rx")
    return S.cluster_sums(T.global_average_rank(r, "y", "ry"), "user_id", "rx", "ry")


@query("t6_cluster_bootstrap", f"WITH {_boot_sql(B)} SELECT round(quantile_cont(r, 0.025), 6) AS low, round(quantile_cont(r, 0.975), 6) AS high, round(quantile_cont(abs(r), 0.975), 6) AS abs_high, count(*) AS n FROM r")
def t6(t):
    r = S.bootstrap_replicates(_sums(t), B)
    return r.agg(F.round(F.percentile("r", 0.025), 6).alias("low"), F.round(F.percentile("r", 0.975), 6).alias("high"), F.round(F.percentile(F.abs("r"), 0.975), 6).alias("abs_high"), F.count("*").alias("n"))


@query(
    "t7_sign_flip",
    f"""WITH cl AS {_CL}, m AS (SELECT sum(sx) / sum(n) AS mx, sum(sy) / sum(n) AS my FROM cl), z AS (SELECT c, sxy - mx * sy - my * sx + n * mx * my AS z FROM cl, m),
        f AS (SELECT b, sum(z * CASE WHEN ('0x' || substr(md5(b || ':' || c), 1, 8))::BIGINT % 2 = 0 THEN 1 ELSE -1 END) AS s FROM z, (SELECT unnest(range({B})) AS b) GROUP BY b)
        SELECT (1 + count(*) FILTER (abs(s) >= (SELECT abs(sum(z)) - 1e-12 * sum(abs(z)) FROM z))) / ({B} + 1.0)::DOUBLE AS p FROM f""",
)
def t7(t):
    return S.sign_flip(_sums(t), B)


_CL2 = _CL.replace("rank() OVER (PARTITION BY 1=1 ORDER BY y) + (count(*) OVER (PARTITION BY 1=1, y) - 1) / 2.0", "rank() OVER (ORDER BY event_id)")


@query(
    "t8_bootstrap_difference",
    f"WITH {_boot_sql(B)}, cl2 AS {_CL2}, s2 AS (SELECT b, sum(n) AS n, sum(sx) AS sx, sum(sy) AS sy, sum(sxx) AS sxx, sum(syy) AS syy, sum(sxy) AS sxy FROM d JOIN cl2 USING (c) GROUP BY 1), r2 AS (SELECT b, (n * sxy - sx * sy) / (sqrt(n * sxx - sx * sx) * sqrt(n * syy - sy * sy)) AS r2 FROM s2), x AS (SELECT abs(r) - abs(r2) AS d FROM r JOIN r2 USING (b)) SELECT round(quantile_cont(d, 0.025), 6) AS low, round(quantile_cont(d, 0.975), 6) AS high, least(1.0, 2 * least((1 + count(*) FILTER (d <= 0)) / (count(*) + 1.0)::DOUBLE, (1 + count(*) FILTER (d >= 0)) / (count(*) + 1.0)::DOUBLE)) AS p FROM x",
)
def t8(t):
    """Two correlations on the same draws: clusters are numbered alike, so draws agree."""
    r2 = T.global_average_rank(T.global_average_rank(_ev(t), "x", "rx"), "event_id", "re")
    other = S.bootstrap_replicates(S.cluster_sums(r2, "user_id", "rx", "re"), B).withColumnRenamed("r", "r2")
    d = S.bootstrap_replicates(_sums(t), B).join(other, "b").select((F.abs("r") - F.abs("r2")).alias("d"))
    n = F.count("*") + 1.0
    p = 2 * F.least((1 + F.count_if(F.col("d") <= 0)) / n, (1 + F.count_if(F.col("d") >= 0)) / n)
    return d.agg(F.round(F.percentile("d", 0.025), 6).alias("low"), F.round(F.percentile("d", 0.975), 6).alias("high"), F.least(F.lit(1.0), p).alias("p"))


def _cells(t):
    return _ev(t).groupBy(F.col("user_id").alias("donor"), F.col("event_type").alias("carrier")).agg(F.min("x").alias("x"), F.avg("y").alias("y"))


@query("t9_crossed_bootstrap")
def t9(t):
    return S.crossed_bootstrap(_cells(t), B).agg(F.percentile("r", 0.025).alias("low"), F.percentile("r", 0.975).alias("high"), F.count("r").alias("n"))


def subset_statistics(rows, replicates: int):
    """Rank correlation of each (subset, region) with its p, q, cluster bootstrap and sign flip, and the subset's crossed bootstrap.

    ``rows`` is ``(subset, region, cluster, x, y)``, a row once for each subset that
    holds it, so all subsets run as one grouped job; rows are worked out once and written. q is adjusted over the subsets of
    a region. A statistic that does not exist (fewer than three rows, no spread) is NULL.
    """
    keys, rows = ["subset", "region"], spread.cut(rows)
    ranked = S.with_ranks(rows.where("x is not null and y is not null"), keys, ["x", "y"])
    rho = ranked.groupBy(*keys).agg(F.count("*").alias("n"), S.pearson("r_x", "r_y").alias("rho"))
    rho = spread.cut(rho.withColumn("p", S.correlation_p("rho", F.col("n").cast("double"))))
    q = S.benjamini_hochberg(rho.where("p is not null"), "p", "subset", ["region"]).select(*keys, "q")
    sums = spread.cut(S.cluster_sums(ranked, "cluster", "r_x", "r_y", keys))
    one_way = spread.quantiles(spread.cut(S.bootstrap_replicates(sums, replicates, keys)), keys, "r", {"low": 0.025, "high": 0.975})
    flips = S.sign_flip(sums, replicates, keys).withColumnRenamed("p", "flip_p")
    cells = rows.groupBy("subset", F.col("cluster").alias("donor"), F.col("region").alias("carrier")).agg(F.min("x").alias("x"), F.avg("y").alias("y"))
    crossed = spread.quantiles(spread.cut(S.crossed_bootstrap(cells, replicates, ["subset"])), ["subset"], "r", {"crossed_low": 0.025, "crossed_high": 0.975})
    return rho.join(q, keys, "left").join(one_way, keys, "left").join(flips, keys, "left").join(crossed, "subset", "left")


@query("t10_subset_statistics")
def t10(t):
    """Anchor thresholds on x, and nested neighbourhoods: each user's rows up to a percentile of x."""
    pct = 100.0 * T.average_rank("x", ["user_id"]) / F.count("*").over(Window.partitionBy("user_id"))
    anchors = [F.when(F.col("x") <= a, F.lit(f"x<={a}")) for a in (5, 10, 30)]
    nested = [F.when(F.col("pct") <= c, F.lit(f"nearest {c}%")) for c in (25, 50, 100)]
    e = _ev(t).withColumn("pct", pct).withColumn("subset", F.explode(F.array_compact(F.array(*anchors, *nested))))
    return subset_statistics(e.select("subset", F.col("event_type").alias("region"), F.col("user_id").alias("cluster"), "x", "y"), B)


@query("t11_bh", "WITH r AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_tax AS p, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_tax, l_orderkey * 10 + l_linenumber) AS r, count(*) OVER (PARTITION BY l_returnflag) AS n FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag, l_tax FROM lineitem)) SELECT DISTINCT l_returnflag, p, round(least(1.0, min(p * n / r) OVER (PARTITION BY l_returnflag ORDER BY r DESC ROWS UNBOUNDED PRECEDING)), 9) AS q FROM r")
def t11(t):
    d = t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag", F.col("l_tax").alias("p")).distinct().withColumn("k", F.expr("l_orderkey * 10 + l_linenumber"))
    return S.benjamini_hochberg(d, "p", "k", ["l_returnflag"]).select("l_returnflag", "p", F.round("q", 9).alias("q")).distinct()


@query("t12_holm", "WITH r AS (SELECT o_orderkey, o_orderpriority, (o_totalprice / 1e9) AS p, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice / 1e9, o_orderkey) AS r, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders) SELECT o_orderkey, round(least(1.0, max((n - r + 1) * p) OVER (PARTITION BY o_orderpriority ORDER BY r ROWS UNBOUNDED PRECEDING)), 6) AS adjusted FROM r")
def t12(t):
    o = t.orders.select("o_orderkey", "o_orderpriority", (F.col("o_totalprice") / 1e9).alias("p"))
    return S.holm(o, "p", "o_orderkey", ["o_orderpriority"]).select("o_orderkey", F.round("adjusted", 6).alias("adjusted"))


@query(
    "t13_mcnemar",
    """WITH u AS (SELECT user_id, avg(value) FILTER (event_type = 'click') < 50 AS a, avg(value) FILTER (event_type = 'view') < 50 AS b FROM events GROUP BY 1), c AS (SELECT count(*) FILTER (a AND NOT b) AS x, count(*) FILTER (b AND NOT a) AS y FROM u),
       k AS (SELECT x, y, unnest(range(least(x, y) + 1)) AS i FROM c) SELECT x, y, round(least(1.0, 2 * sum(exp(lgamma(x + y + 1) - lgamma(i + 1) - lgamma(x + y - i + 1) - (x + y) * ln(2)))), 9) AS p FROM k GROUP BY 1, 2""",
)
def t13(t):
    u = t.events.groupBy("user_id").pivot("event_type", ["click", "view"]).agg(F.avg("value"))
    c = u.agg(F.count_if(F.expr("click < 50 and not view < 50")).alias("x"), F.count_if(F.expr("view < 50 and not click < 50")).alias("y"))
    return c.select("x", "y", F.round(S.mcnemar_exact(F.col("x"), F.col("y")), 9).alias("p"))


@query("t14_wilcoxon")
def t14(t):
    """Signed-rank sums without zeros, tie correction, and the normal tail."""
    u = t.events.groupBy("user_id").pivot("event_type", ["click", "view"]).agg(F.avg("value"))
    both = u.select((F.col("click") - F.col("view")).alias("d"))
    tied = both.agg(F.count_if(F.col("d") == 0).alias("tied"))
    d = both.where("d <> 0").withColumn("a", F.abs("d"))
    ties = d.groupBy("a").agg(F.count("*").alias("m")).agg(F.sum(F.expr("m * m * m - m")).alias("ties"))
    r = T.global_average_rank(d, "a")
    s = r.agg(F.count("*").alias("n"), F.sum(F.when(F.col("d") > 0, F.col("rank")).otherwise(0)).alias("w_plus"), F.sum(F.when(F.col("d") < 0, F.col("rank")).otherwise(0)).alias("w_minus"), F.count_if(F.col("d") > 0).alias("higher"), F.count_if(F.col("d") < 0).alias("lower")).crossJoin(ties).crossJoin(tied)
    mean, var = F.expr("n * (n + 1) / 4"), F.expr("n * (n + 1) * (2 * n + 1) / 24 - ties / 48")
    return s.select("n", "w_plus", "w_minus", "higher", "lower", "tied", S.normal_two_sided(F.try_divide(F.col("w_plus") - mean, F.sqrt(var))).alias("p"))


@query("t15_auc", "WITH r AS (SELECT toxic, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0 AS r FROM labels JOIN documents USING (doc_id)), s AS (SELECT sum(r) FILTER (toxic = 1) AS s, count(*) FILTER (toxic = 1) AS a, count(*) FILTER (toxic = 0) AS b FROM r) SELECT round((s - a * (a + 1) / 2.0) / (a * b), 9) AS auc FROM s")
def t15(t):
    d = T.global_average_rank(t.labels.select("doc_id", "toxic").join(t.documents.select("doc_id", "n_chars"), "doc_id"), "n_chars")
    s = d.agg(F.sum(F.when(F.col("toxic") == 1, F.col("rank"))).alias("s"), F.count_if(F.col("toxic") == 1).alias("a"), F.count_if(F.col("toxic") == 0).alias("b"))
    return s.select(F.round(F.try_divide(F.col("s") - F.col("a") * (F.col("a") + 1) / 2.0, F.col("a") * F.col("b")), 9).alias("auc"))


@query(
    "t16_mean_difference",
    f"""WITH u AS (SELECT event_type AS g, user_id, avg(value) AS v FROM events WHERE event_type IN ('click', 'view') GROUP BY 1, 2), x AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY user_id) - 1 AS i, count(*) OVER (PARTITION BY g) AS k FROM u),
        d AS (SELECT b, g, ('0x' || substr(md5(b || ':' || (g || i)), 1, 8))::BIGINT % k AS j FROM x, (SELECT unnest(range({B})) AS b)), m AS (SELECT b, d.g, avg(v) AS m FROM d JOIN x ON x.g = d.g AND x.i = d.j GROUP BY 1, 2),
        r AS (SELECT b, max(m) FILTER (g = 'click') - max(m) FILTER (g = 'view') AS r FROM m GROUP BY 1) SELECT round(quantile_cont(r, 0.025), 6) AS low, round(quantile_cont(r, 0.975), 6) AS high FROM r""",
)
def t16(t):
    u = t.events.where(F.col("event_type").isin("click", "view")).groupBy(F.col("event_type").alias("g"), "user_id").agg(F.avg("value").alias("v"))
    m = S.bootstrap_means(u, B, "g", "user_id", "v").groupBy("b").agg((F.max(F.when(F.col("g") == "click", F.col("m"))) - F.max(F.when(F.col("g") == "view", F.col("m")))).alias("r"))
    return m.agg(F.round(F.percentile("r", 0.025), 6).alias("low"), F.round(F.percentile("r", 0.975), 6).alias("high"))


# a Student quantile by its expansion around the normal one, exact to 1e-9 from 500 degrees of freedom on
_T975 = "(z + (z ** 3 + z) / (4 * v) + (5 * z ** 5 + 16 * z ** 3 + 3 * z) / (96 * v ** 2) + (3 * z ** 7 + 19 * z ** 5 + 17 * z ** 3 - 15 * z) / (384 * v ** 3))"


@query(
    "t17_line_fit",
    f"""WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a, min(l_quantity) AS lo, max(l_quantity) AS hi, regr_count(l_extendedprice, l_quantity)::DOUBLE AS n,
        regr_avgx(l_extendedprice, l_quantity) AS m, regr_sxx(l_extendedprice, l_quantity) AS sxx, regr_syy(l_extendedprice, l_quantity) AS syy, regr_sxy(l_extendedprice, l_quantity) AS sxy FROM lineitem),
        c AS (SELECT *, greatest(0, (syy - sxy * sxy / sxx) / (n - 2)) AS s2, {_T975.replace('z', '1.959963984540054').replace('v', '(n - 2)')} AS t FROM f), g AS (SELECT *, lo + (hi - lo) * i / 199.0 AS x FROM c, (SELECT unnest(range(200)) AS i))
        SELECT i, round(x, 6) AS x, round(a + b * x, 4) AS y, round(a + b * x - t * sqrt(s2 * (1 / n + (x - m) ** 2 / sxx)), 2) AS low, round(a + b * x + t * sqrt(s2 * (1 / n + (x - m) ** 2 / sxx)), 2) AS high, round(sqrt(s2), 4) AS residual_sd FROM g""",
)
def t17(t):
    """Line, mean confidence band of 95 % and the residuals' deviation; NULL band below three rows or without spread."""
    x, y = F.col("l_quantity"), F.col("l_extendedprice")
    f = t.lineitem.agg(
        F.regr_slope(y, x).alias("b"), F.regr_intercept(y, x).alias("a"), F.min(x).alias("lo"), F.max(x).alias("hi"), F.regr_count(y, x).alias("n"),
        F.regr_avgx(y, x).alias("m"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy"),
    )
    f = f.withColumn("s2", F.greatest(F.lit(0.0), F.try_divide(F.expr("syy - sxy * sxy / nullif(sxx, 0)"), F.expr("nullif(greatest(n - 2, 0), 0)"))))
    f = f.withColumn("t", S.t_quantile(F.col("n") - 2))
    g = f.select("*", F.explode(F.expr("sequence(0L, 199L)")).alias("i")).withColumn("x", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / 199.0)
    mid, wide = F.col("a") + F.col("b") * F.col("x"), F.col("t") * F.expr("sqrt(s2 * (1 / n + (x - m) * (x - m) / nullif(sxx, 0)))")
    return g.select("i", F.round("x", 6).alias("x"), F.round(mid, 4).alias("y"), F.round(mid - wide, 2).alias("low"), F.round(mid + wide, 2).alias("high"), F.round(F.sqrt("s2"), 4).alias("residual_sd"))


@query("t17_residuals", "SELECT l_orderkey, l_linenumber, round(l_extendedprice - (a + b * l_quantity), 1) AS residual FROM lineitem, (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem)")
def t17_residuals(t):
    """What the line leaves of every row; NULL where a side is missing."""
    x, y = F.col("l_quantity").cast("double"), F.col("l_extendedprice").cast("double")
    line = t.lineitem.agg(F.regr_slope(y, x).alias("b"), F.regr_intercept(y, x).alias("a"))
    rows = t.lineitem.crossJoin(F.broadcast(line))  # one row
    return rows.select("l_orderkey", "l_linenumber", F.round(y - (F.col("a") + F.col("b") * x), 1).alias("residual"))


@query("t18_scatter_summary", "SELECT 'l_quantity' AS metric, count(*) AS n, count(*) FILTER (l_quantity > 10) AS kept, CASE WHEN count(*) FILTER (l_quantity > 10) < 3 THEN 'too_few' ELSE 'ok' END AS reason FROM lineitem UNION ALL SELECT 'l_tax', count(*), count(*) FILTER (l_tax > 10), CASE WHEN count(*) FILTER (l_tax > 10) < 3 THEN 'too_few' ELSE 'ok' END FROM lineitem")
def t18(t):
    long = t.lineitem.unpivot([], ["l_quantity", "l_tax"], "metric", "v")
    kept = F.count_if(F.col("v") > 10)
    return long.groupBy("metric").agg(F.count("*").alias("n"), kept.alias("kept"), F.when(kept < 3, "too_few").otherwise("ok").alias("reason"))


@query("t19_depth_correlation", f"SELECT d, round(corr(m, y), 9) AS r, count(*) AS n FROM (SELECT g.d AS d, user_id, min(x) AS m, avg(y) AS y FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM {E}) e, (SELECT unnest([5, 20, 80]) AS d) g WHERE r <= g.d GROUP BY 1, 2) GROUP BY 1")
def t19(t):
    e = _ev(t).withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))).withColumn("d", F.explode(F.array(F.lit(5), F.lit(20), F.lit(80)))).where("r <= d")
    m = e.groupBy("d", "user_id").agg(F.min("x").alias("m"), F.avg("y").alias("y"))
    return m.groupBy("d").agg(F.round(S.pearson("m", "y"), 9).alias("r"), F.count("*").alias("n"))


@query("t20_outliers", "SELECT l_orderkey, l_linenumber, metric, value FROM (UNPIVOT (SELECT l_orderkey, l_linenumber, l_discount, l_tax FROM lineitem) ON l_discount, l_tax INTO NAME metric VALUE value) WHERE value > 0.07")
def t20(t):
    return t.lineitem.unpivot(["l_orderkey", "l_linenumber"], ["l_discount", "l_tax"], "metric", "value").where("value > 0.07")
