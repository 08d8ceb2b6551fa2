"""Projections, filters and validation (P1-P21)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tables as T
from .base import query

K = "CAST(get_json_object(props, '$.k') AS BIGINT)"
KQ = "CAST(json_extract_string(props, '$.k') AS BIGINT)"


@query("p1_project", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net, l_quantity AS quantity FROM lineitem")
def p1(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("net"), F.col("l_quantity").alias("quantity"))


@query("p2_pick_columns", "SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem")
def p2(t):
    li = t.lineitem
    names = [*T.pick_columns(li, suffix="orderkey"), *T.pick_columns(li, contains="linenum"), *T.pick_columns(li, prefix="l_ship")]
    return li.select(*names)


@query(
    "p3_complete_vectors",
    "SELECT vec_id, CASE WHEN vec_id % 9 <> 4 AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0 THEN len(embedding) END AS dim, dim IS NULL AS dropped FROM embeddings",
)
def p3(t):
    """Whole vectors with their width, and the ids of those with a missing element (here also ids 4 of 9)."""
    first = F.when(F.col("vec_id") % 9 != 4, F.element_at("embedding", 1))
    e = t.embeddings.withColumn("embedding", F.concat(F.array(first), F.slice("embedding", 2, F.size("embedding"))))
    whole = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x))
    return e.select("vec_id", F.when(whole, F.size("embedding")).cast("long").alias("dim"), (~whole).alias("dropped"))


@query(
    "p4_change_limit",
    """SELECT a.vec_id, round(abs(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(12) - 0.4), 9) AS change
       FROM embeddings a, embeddings b WHERE b.vec_id = 0
       AND abs(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(12) - 0.4) <= 0.02""",
)
def p4(t):
    from ..functions import vector as V

    e = t.embeddings.select("vec_id", V.doubles(F.col("embedding")).alias("v"))
    q = e.where("vec_id = 0").select(F.col("v").alias("q"))
    change = F.abs(V.length_norm(V.euclidean(F.col("v"), F.col("q")), 12) - 0.4)
    return e.crossJoin(F.broadcast(q)).select("vec_id", change.alias("change")).where("change <= 0.02").withColumn("change", F.round("change", 9))


@query("p5_strict_gate", f"SELECT event_id, value < 15 AS low_value, {KQ} > 50 AS high_k, value < 15 AND {KQ} > 50 AS passed FROM events")
def p5(t):
    return t.events.selectExpr("event_id", "value < 15 AS low_value", f"{K} > 50 AS high_k", f"value < 15 AND {K} > 50 AS passed")


@query("p6_inclusive_gate", f"SELECT count(*) AS n, count(*) FILTER (value > 15) AS dropped_value, count(*) FILTER ({KQ} < 50) AS dropped_k, count(*) FILTER (value <= 15 AND {KQ} >= 50) AS kept FROM events")
def p6(t):
    e = t.events.selectExpr("value", f"{K} AS k")
    return e.agg(F.count("*").alias("n"), F.count_if(F.expr("value > 15")).alias("dropped_value"), F.count_if(F.expr("k < 50")).alias("dropped_k"), F.count_if(F.expr("value <= 15 AND k >= 50")).alias("kept"))


@query("p7_exclude_ids", "SELECT doc_id, source FROM documents WHERE doc_id::VARCHAR NOT IN (SELECT doc_id::VARCHAR FROM labels WHERE toxic = 1) AND split_part(source || '_x', '_', 1) NOT IN ('src3', 'src7')")
def p7(t):
    bad = t.labels.where("toxic = 1").select("doc_id").distinct()
    return t.documents.select("doc_id", "source").join(bad, "doc_id", "left_anti").where(~F.split(F.concat("source", F.lit("_x")), "_")[0].isin("src3", "src7"))


@query("p8_max_length", "SELECT doc_id, length(text) AS n FROM documents WHERE length(text) <= 500 + 2")
def p8(t):
    return t.documents.select("doc_id", F.length("text").cast("long").alias("n")).where("n <= 500 + 2")


@query("p9_normalise_ids", "SELECT page_id, upper(left(regexp_replace(regexp_replace(url, '[?#].*$', ''), '\\.html$', ''), 4)) AS code, split_part(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', ''), '/', -1) AS last FROM pages")
def p9(t):
    bare = F.regexp_replace("url", r"[?#].*$", "")
    return t.pages.select("page_id", F.upper(F.left(F.regexp_replace(bare, r"\.html$", ""), F.lit(4))).alias("code"), F.substring_index(F.regexp_replace(bare, "/+$", ""), "/", -1).alias("last"))


@query("p10_blank_to_null", "SELECT o_orderkey, nullif(nullif(trim(CASE o_orderstatus WHEN 'P' THEN ' ' WHEN 'F' THEN 'None' ELSE o_orderstatus END), ''), 'None') AS status, coalesce(nullif(nullif(trim(CASE o_orderstatus WHEN 'P' THEN ' ' WHEN 'F' THEN 'None' ELSE o_orderstatus END), ''), 'None'), '') AS restored FROM orders")
def p10(t):
    raw = F.expr("CASE o_orderstatus WHEN 'P' THEN ' ' WHEN 'F' THEN 'None' ELSE o_orderstatus END")
    return t.orders.select("o_orderkey", T.blank_to_null(raw).alias("status")).withColumn("restored", F.coalesce("status", F.lit("")))


@query("p11_numeric_coercion", "SELECT event_id, TRY_CAST(CASE WHEN event_id % 7 = 0 THEN 'bad' ELSE value::VARCHAR END AS DOUBLE) AS number, TRY_CAST(CASE WHEN event_id % 7 = 0 THEN 'bad' ELSE value::VARCHAR END AS DOUBLE) IS NOT NULL AS finite FROM events")
def p11(t):
    text = F.when(F.col("event_id") % 7 == 0, "bad").otherwise(F.col("value").cast("string"))
    e = t.events.select("event_id", F.nanvl(text.try_cast("double"), F.lit(None)).alias("number"))
    return e.withColumn("finite", F.col("number").isNotNull() & (F.abs("number") < float("inf")))


@query("p12_ordered_rules", "SELECT event_id, CASE WHEN value IS NULL THEN 'missing' WHEN value < 5 AND event_type = 'click' THEN 'early' WHEN value < 10 THEN 'low' WHEN value < 50 THEN 'middle' ELSE 'high' END AS class FROM events")
def p12(t):
    v = F.col("value")
    return t.events.select("event_id", F.when(v.isNull(), "missing").when((v < 5) & (F.col("event_type") == "click"), "early").when(v < 10, "low").when(v < 50, "middle").otherwise("high").alias("class"))


@query(
    "p13_resume_filter",
    """WITH log AS (SELECT user_id, CASE WHEN event_type = 'purchase' THEN 'Finished processing ID: ' ELSE 'Failed ID: ' END || user_id AS line FROM events WHERE event_type IN ('purchase', 'error', 'signup')),
       done AS (SELECT regexp_extract(line, 'Finished processing ID: (.+)$', 1) AS id FROM log), bad AS (SELECT regexp_extract(line, 'Failed ID: (.+)$', 1) AS id FROM log)
       SELECT DISTINCT user_id FROM events WHERE user_id::VARCHAR NOT IN (SELECT id FROM done WHERE id <> '' AND id NOT IN (SELECT id FROM bad WHERE id <> ''))""",
)
def p13(t):
    e = t.events
    line = F.concat(F.when(F.col("event_type") == "purchase", "Finished processing ID: ").otherwise("Failed ID: "), F.col("user_id").cast("string"))
    log = e.where(F.col("event_type").isin("purchase", "error", "signup")).select(line.alias("line"))
    done = log.select(F.regexp_extract("line", "Finished processing ID: (.+)$", 1).alias("id")).where("id <> ''").distinct()
    bad = log.select(F.regexp_extract("line", "Failed ID: (.+)$", 1).alias("id")).where("id <> ''").distinct()
    finished = done.join(bad, "id", "left_anti").select(F.col("id").cast("long").alias("user_id"))
    return e.select("user_id").distinct().join(finished, "user_id", "left_anti")


@query("p14_assertions", "SELECT count(*) AS n, count(*) - count(DISTINCT o_orderkey) AS repeated_keys, count(*) FILTER (o_totalprice IS NULL OR isnan(o_totalprice)) AS not_finite, count(*) FILTER (abs(o_totalprice - o_totalprice) > 1e-10) AS off FROM orders")
def p14(t):
    return t.orders.agg(
        F.count("*").alias("n"),
        (F.count("*") - F.count_distinct("o_orderkey")).alias("repeated_keys"),
        F.count_if(F.expr("o_totalprice is null or isnan(o_totalprice)")).alias("not_finite"),
        F.count_if(F.expr("abs(o_totalprice - o_totalprice) > 1e-10")).alias("off"),
    )


@query("p15_duplicate_policy", "SELECT label, max(vec_id) AS vec_id FROM embeddings GROUP BY label")
def p15(t):
    return T.collapse_duplicates(t.embeddings.select("label", "vec_id", "embedding"), ["label"], "vec_id", "last").select("label", "vec_id")


@query("p16_fallback_row", "SELECT c.c_custkey, coalesce(o.price, c.c_acctbal) AS amount, o.price IS NULL AS fallback FROM customer c LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS price FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) o ON o.o_custkey = c.c_custkey")
def p16(t):
    main = t.orders.where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("price"))
    return t.customer.select("c_custkey", "c_acctbal").join(main, "c_custkey", "left").select("c_custkey", F.coalesce("price", "c_acctbal").alias("amount"), F.col("price").isNull().alias("fallback"))


@query("p17_append_suffix", "SELECT lang || '-' || split_part(source, 'c', 2) || '_' || doc_id AS id, text || 'WGQGTLVTVSS' AS seq FROM documents WHERE NOT contains(text, '*')")
def p17(t):
    d = t.documents.where(~F.contains("text", F.lit("*")))
    return d.select(F.concat("lang", F.lit("-"), F.split("source", "c")[1], F.lit("_"), F.col("doc_id").cast("string")).alias("id"), F.concat("text", F.lit("WGQGTLVTVSS")).alias("seq"))


@query("p18_scaled_json", f"SELECT event_id, {KQ} / 100.0 AS scaled FROM events")
def p18(t):
    return t.events.selectExpr("event_id", f"CAST({K} AS DOUBLE) / 100.0 AS scaled")


LEVELS = {"click": 1.0, "view": 2.0, "purchase": 8.3, "signup": 4.2, "error": 0.5}


@query("p19_constant_lookup", "SELECT e.event_id, m.level FROM events e JOIN (VALUES ('click', 1.0), ('view', 2.0), ('purchase', 8.3), ('signup', 4.2), ('error', 0.5)) m(name, level) ON e.event_type = m.name")
def p19(t):
    level = F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv])[F.col("event_type")]
    return t.events.select("event_id", level.alias("level")).where("level is not null")


@query("p20_coverage_gate", "SELECT d.source, count(l.doc_id) AS shared, count(*) AS n, count(l.doc_id) / count(*)::DOUBLE AS coverage FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1 HAVING count(l.doc_id) >= 3 AND count(l.doc_id) / count(*)::DOUBLE >= 0.35")
def p20(t):
    both = t.documents.select("doc_id", "source").join(t.labels.select("doc_id", F.lit(1).alias("hit")), "doc_id", "left")
    return both.groupBy("source").agg(F.count("hit").alias("shared"), F.count("*").alias("n")).withColumn("coverage", F.col("shared") / F.col("n")).where("shared >= 3 and coverage >= 0.35")


@query("p21_to_long", "SELECT l_orderkey, l_linenumber, CASE region WHEN 'l_discount' THEN 'region 1' WHEN 'l_tax' THEN 'region 2' ELSE 'region 3' END AS region, value FROM (UNPIVOT (SELECT l_orderkey, l_linenumber, l_discount, l_tax, l_quantity FROM lineitem) ON l_discount, l_tax, l_quantity INTO NAME region VALUE value)")
def p21(t):
    long = t.lineitem.unpivot(["l_orderkey", "l_linenumber"], ["l_discount", "l_tax", "l_quantity"], "region", "value")
    return long.withColumn("region", F.when(F.col("region") == "l_discount", "region 1").when(F.col("region") == "l_tax", "region 2").otherwise("region 3"))
