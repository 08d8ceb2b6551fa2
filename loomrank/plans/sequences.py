"""String and sequence functions (F1-F30). Short sequences are part names and types; texts are documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import spread
from ..operators import tables as T
from ..operators.terms import tfidf
from .base import query


@query("f1_locate", "SELECT p_partkey, nullif(instr(p_type, p_size::VARCHAR), 0) IS NOT NULL AS has_size, CASE WHEN instr(p_type, 'SMALL') > 0 THEN instr(p_type, 'SMALL') - 1 END AS s, CASE WHEN instr(p_type, 'SMALL') > 0 THEN instr(p_type, 'SMALL') + 4 END AS e FROM part")
def f1(t):
    at = F.instr("p_type", "SMALL")
    return t.part.select("p_partkey", F.contains("p_type", F.col("p_size").cast("string")).alias("has_size"), F.when(at > 0, at - 1).cast("long").alias("s"), F.when(at > 0, at + 4).cast("long").alias("e"))


@query("f2_ordered_locate", "SELECT p_partkey, instr(p_name, ' ') AS a, CASE WHEN instr(substring(p_name, instr(p_name, ' ') + 1), ' ') > 0 AND instr(p_name, ' ') > 0 THEN instr(p_name, ' ') + instr(substring(p_name, instr(p_name, ' ') + 1), ' ') ELSE 0 END AS b FROM part")
def f2(t):
    return t.part.selectExpr("p_partkey", "CAST(locate(' ', p_name) AS BIGINT) AS a", "CAST(CASE WHEN locate(' ', p_name) > 0 THEN locate(' ', p_name, locate(' ', p_name) + 1) ELSE 0 END AS BIGINT) AS b")


@query("f3_occurrences", "SELECT p_partkey, list_filter(range(1, length(p_type) + 1), lambda p: substring(p_type, p, 1) = 'A') AS at, len(list_filter(range(1, length(p_type) + 1), lambda p: substring(p_type, p, 1) = 'A')) = 1 AS once FROM part")
def f3(t):
    at = X.occurrences("p_type", F.lit("A"), 1)
    return t.part.select("p_partkey", at.cast("array<long>").alias("at"), (F.size(at) == 1).alias("once"))


@query("f4_windows", "SELECT p_partkey, unnest(list_transform(range(1, length(p_type) - 4 + 2), lambda p: substring(p_type, p, 4))) AS w FROM part")
def f4(t):
    return t.part.select("p_partkey", F.explode(X.windows("p_type", 4)).alias("w"))


@query(
    "f5_window_product",
    """WITH w AS (SELECT p_partkey, p_brand, p_name, unnest(list_transform(range(1, length(p_brand) - 6 + 2), lambda p: substring(p_brand, p, 6))) AS a FROM part),
       x AS (SELECT *, unnest(list_transform(range(1, length(p_name) - 4 + 2), lambda p: substring(p_name, p, 4))) AS b FROM w)
       SELECT p_partkey, 'CDR1-' || a || '_CDR2-' || b AS name, a || '/' || b AS seq FROM x""",
)
def f5(t):
    p = t.part.select("p_partkey", "p_name", F.explode(X.windows("p_brand", 6)).alias("a")).select("p_partkey", "a", F.explode(X.windows("p_name", 4)).alias("b"))
    return p.select("p_partkey", F.concat(F.lit("CDR1-"), "a", F.lit("_CDR2-"), "b").alias("name"), F.concat_ws("/", "a", "b").alias("seq"))


@query("f6_flanks", "SELECT p_partkey, substring(p_name, greatest(1, instr(p_name, ' ') - 4), instr(p_name, ' ') - greatest(1, instr(p_name, ' ') - 4)) AS before, substring(p_name, instr(p_name, ' ') + 1, 4) AS after FROM part WHERE instr(p_name, ' ') > 0")
def f6(t):
    return t.part.where("instr(p_name, ' ') > 0").selectExpr("p_partkey", "substring(p_name, greatest(1, instr(p_name, ' ') - 4), instr(p_name, ' ') - greatest(1, instr(p_name, ' ') - 4)) AS before", "substring(p_name, instr(p_name, ' ') + 1, 4) AS after")


@query("f7_replace_window", "SELECT p_partkey, left(p_name, 2) || 'XY' || substring(p_name, 5) AS seq, substring(left(p_name, 2) || 'XY' || substring(p_name, 5), 3, 2) = 'XY' AS ok FROM part")
def f7(t):
    seq = F.overlay("p_name", F.lit("XY"), F.lit(3))
    return t.part.select("p_partkey", seq.alias("seq"), (F.substring(seq, 3, 2) == "XY").alias("ok"))


REGIONS = [("FR1", 1, 2), ("FR2", 3, 4), ("FR3", 5, 6), ("FR4", 7, 99)]


@query(
    "f8_region_slices",
    "SELECT l_orderkey, r.name AS region, string_agg(l_returnflag, '' ORDER BY l_linenumber, l_returnflag) AS seq FROM lineitem JOIN (VALUES ('FR1', 1, 2), ('FR2', 3, 4), ('FR3', 5, 6), ('FR4', 7, 99)) r(name, lo, hi) ON l_linenumber BETWEEN lo AND hi GROUP BY 1, 2",
)
def f8(t):
    region = F.coalesce(*[F.when(F.col("l_linenumber").between(lo, hi), n) for n, lo, hi in REGIONS])
    g = t.lineitem.select("l_orderkey", region.alias("region"), "l_linenumber", "l_returnflag").where("region is not null").groupBy("l_orderkey", "region")
    return g.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag"))), lambda x: x["l_returnflag"]), "").alias("seq"))


@query("f9_position_labels", "SELECT label, regexp_extract(label, '^([0-9]+)', 1)::BIGINT AS n, nullif(regexp_extract(label, '^[0-9]+([A-Z]*)$', 1), '') AS code FROM (SELECT DISTINCT l_linenumber || (CASE WHEN l_returnflag = 'N' THEN '' ELSE l_returnflag END) AS label FROM lineitem)")
def f9(t):
    label = F.concat(F.col("l_linenumber").cast("string"), F.when(F.col("l_returnflag") == "N", "").otherwise(F.col("l_returnflag")))
    return t.lineitem.select(label.alias("label")).distinct().select("label", F.regexp_extract("label", "^([0-9]+)", 1).cast("long").alias("n"), F.nullif(F.regexp_extract("label", "^[0-9]+([A-Z]*)$", 1), F.lit("")).alias("code"))


@query("f10_chain_type", "SELECT l_orderkey, CASE WHEN bool_or(l_linenumber > 6) THEN 'heavy' WHEN bool_or(l_linenumber > 3) THEN 'light' ELSE 'unknown' END AS chain FROM lineitem GROUP BY 1")
def f10(t):
    n = F.col("l_linenumber")
    return t.lineitem.groupBy("l_orderkey").agg(F.when(F.bool_or(n > 6), "heavy").when(F.bool_or(n > 3), "light").otherwise("unknown").alias("chain"))


@query("f11_substitutions", "SELECT l_orderkey, l_linenumber, coalesce(aa, l_returnflag) AS residue FROM lineitem LEFT JOIN (VALUES (2, 'W'), (4, 'Y'), (12, 'K')) m(pos, aa) ON l_linenumber = pos")
def f11(t):
    aa = F.try_element_at(X.literal_map({2: "W", 4: "Y", 12: "K"}), F.col("l_linenumber"))
    return t.lineitem.select("l_orderkey", "l_linenumber", F.coalesce(aa, "l_returnflag").alias("residue"))


@query(
    "f12_numbering_wide",
    "SELECT l_orderkey, " + ", ".join(f"coalesce(max(l_returnflag) FILTER (l_linenumber = {i}), '-') AS p{i}" for i in range(1, 8)) + " FROM lineitem GROUP BY 1",
)
def f12(t):
    wide = t.lineitem.groupBy("l_orderkey").pivot("l_linenumber", list(range(1, 8))).agg(F.max("l_returnflag"))
    return wide.select("l_orderkey", *[F.coalesce(F.col(f"`{i}`"), F.lit("-")).alias(f"p{i}") for i in range(1, 8)])


_CODES = ["MET", "PRO", "SEC", "THR", "UNK", "PYL", "SAR"]


@query("f13_one_letter", f"SELECT p_partkey, code, ['M', 'P', 'U', 'T', 'X', 'O', 'G'][p_size % 7 + 1] AS aa FROM (SELECT p_partkey, p_size, {_CODES}[p_size % 7 + 1] AS code FROM part)")
def f13(t):
    code = F.element_at(F.array(*[F.lit(c) for c in _CODES]), F.col("p_size") % 7 + 1)
    return t.part.select("p_partkey", code.alias("code")).withColumn("aa", X.one_letter(F.col("code")))


@query(
    "f14_differences",
    "SELECT a.s_name AS a, b.s_name AS b, len(list_filter(range(1, least(length(a.s_name), length(b.s_name)) + 1), lambda i: substring(a.s_name, i, 1) <> substring(b.s_name, i, 1))) + abs(length(a.s_name) - length(b.s_name)) AS d FROM supplier a, supplier b",
)
def f14(t):
    """Full symmetric matrix of a cohort: all pairs are its stated result, so they are as many as its square."""
    s, bits, size = X.packed(t.supplier.select("s_name"), "s_name", "codes")
    return T.every_pair(s, s).select(F.col("s_name").alias("a"), F.col("other.s_name").alias("b"), X.differences(F.col("codes"), F.col("other.codes"), bits, size).alias("d"))


@query("f15_simple_labels", "SELECT label, count(*) > 1 AS repeated, count(*) AS n FROM (SELECT split_part(p_brand || '_' || p_size, '_', 1) AS label FROM part) GROUP BY 1")
def f15(t):
    label = F.split(F.concat("p_brand", F.lit("_"), F.col("p_size").cast("string")), "_")[0]
    return t.part.groupBy(label.alias("label")).agg((F.count("*") > 1).alias("repeated"), F.count("*").alias("n"))


_HYDRO = "map {" + ", ".join(f"'{k}': {v}" for k, v in X.HYDROPATHY.items()) + "}"


@query(
    "f16_hydropathy",
    f"WITH c AS (SELECT p_partkey, unnest(string_split(p_type, '')) AS c FROM part), m AS (SELECT {_HYDRO} AS m) SELECT p_partkey, round(avg(coalesce(m[c], 0)), 9) AS h FROM c, m GROUP BY 1",
)
def f16(t):
    return t.part.select("p_partkey", F.round(X.mean_hydropathy("p_type"), 9).alias("h"))


@query(
    "f17_moment",
    f"WITH c AS (SELECT p_partkey, unnest(string_split(p_type, '')) AS c, generate_subscripts(string_split(p_type, ''), 1) - 1 AS i FROM part), m AS (SELECT {_HYDRO} AS m) SELECT p_partkey, round(sqrt(sum(coalesce(m[c], 0) * cos(i * radians(100))) ** 2 + sum(coalesce(m[c], 0) * sin(i * radians(100))) ** 2) / count(*), 6) AS moment FROM c, m GROUP BY 1",
)
def f17(t):
    return t.part.select("p_partkey", F.round(X.hydrophobic_moment("p_type"), 6).alias("moment"))


def _charge_sql(ph):
    """Net charge of the sequence s at a pH, as SQL."""

    def end(residue, special, usual):
        return f"CASE {residue} " + " ".join(f"WHEN '{c}' THEN {pk}" for c, pk in special.items()) + f" ELSE {usual} END"

    def side(pks, sign):
        return " + ".join(f"(length(s) - length(replace(s, '{c}', ''))) / (1 + pow(10.0::DOUBLE, {sign} * ({ph} - {pk})))" for c, pk in pks.items())

    plus = f"1 / (1 + pow(10.0::DOUBLE, {ph} - {end('left(s, 1)', X.PK_N_TERM_OF, X.PK_N_TERM)})) + {side(X.PK_POSITIVE, 1)}"
    return f"({plus} - (1 / (1 + pow(10.0::DOUBLE, {end('right(s, 1)', X.PK_C_TERM_OF, X.PK_C_TERM)} - {ph})) + {side(X.PK_NEGATIVE, -1)}))"


@query(
    "f18_charge",
    f"""WITH RECURSIVE p AS (SELECT p_partkey, upper(p_type) AS s FROM part), h AS (SELECT p_partkey, s, 4.05::DOUBLE AS lo, 12.0::DOUBLE AS hi, 7.775::DOUBLE AS ph, 0 AS i FROM p
        UNION ALL SELECT p_partkey, s, lo, hi, (lo + hi) / 2, i FROM (SELECT p_partkey, s, CASE WHEN {_charge_sql('ph')} > 0 THEN ph ELSE lo END AS lo, CASE WHEN {_charge_sql('ph')} > 0 THEN hi ELSE ph END AS hi, i + 1 AS i FROM h WHERE hi - lo > 1e-4))
        SELECT p_partkey, round({_charge_sql('7.4::DOUBLE')}, 9) AS charge, round(ph, 6) AS pi FROM h WHERE hi - lo <= 1e-4""",
)
def f18(t):
    return t.part.select("p_partkey", F.round(X.net_charge("p_type", F.lit(7.4)), 9).alias("charge"), F.round(X.isoelectric_point("p_type"), 6).alias("pi"))


@query("f19_hit_identity", "WITH h AS (SELECT user_id AS q, event_id AS target, CAST(json_extract_string(props, '$.k') AS BIGINT) AS nident FROM events), l AS (SELECT q, max(nident) + 20 AS len FROM h GROUP BY 1) SELECT q, target, round_even(sqrt(nident / len::DOUBLE), 3) AS identity FROM h JOIN l USING (q)")
def f19(t):
    h = t.events.selectExpr("user_id AS q", "event_id AS target", "CAST(get_json_object(props, '$.k') AS BIGINT) AS nident")
    n = h.groupBy("q").agg((F.max("nident") + 20).alias("len"))
    return h.join(n, "q").select("q", "target", F.bround(F.sqrt(F.col("nident") / F.col("len")), 3).alias("identity"))


_FRAGMENTS = "regexp_extract_all(id, 'CDR(\\d+)-([A-Za-z]+)', 2)"


@query(
    "f20_fragments",
    f"""SELECT p_partkey, regexp_extract_all(id, 'CDR(\\d+)-([A-Za-z]+)', 1) AS regions, {_FRAGMENTS} AS fragments,
        list_transform({_FRAGMENTS}, lambda f: CASE WHEN strpos(seq, upper(f)) > 0 THEN greatest(0, least(2 * (strpos(seq, upper(f)) - 1) + length(f) - 1, 2 * length(seq) - 1)) END) AS centres
        FROM (SELECT p_partkey, 'CDR' || p_size || '-' || replace(p_type, ' ', '_CDR2-') AS id, upper(replace(p_type, ' ', '') || 'X') AS seq FROM part)""",
)
def f20(t):
    """Fragments of an id and, in half residues, where the middle of each lies in its sequence."""
    p = t.part.select("p_partkey", F.concat(F.lit("CDR"), F.col("p_size").cast("string"), F.lit("-"), F.replace("p_type", F.lit(" "), F.lit("_CDR2-"))).alias("id"), F.concat(F.replace("p_type", F.lit(" "), F.lit("")), F.lit("X")).alias("seq"))
    found = p.select("p_partkey", "seq", *[F.regexp_extract_all("id", F.lit(r"CDR(\d+)-([A-Za-z]+)"), F.lit(i)).alias(n) for i, n in ((1, "regions"), (2, "fragments"))])
    return found.select("p_partkey", "regions", "fragments", F.transform("fragments", lambda f: X.centre(F.col("seq"), f, 2 * F.length("seq"))).alias("centres"))


@query(
    "f21_stable_ids",
    """SELECT c_custkey, left(sha256(c_name || chr(0) || c_mktsegment), 16) AS id,
       sha256('{"balance":' || printf('%.9f', c_acctbal::DOUBLE) || ',"key":' || c_custkey || ',"names":["' || c_name || '","' || c_mktsegment || '"],"parent":{"a":null,"b":' || c_nationkey || '}}') AS fingerprint FROM customer""",
)
def f21(t):
    """A prefix of the digest of a key pair, and the digest of a nested record as canonical JSON."""
    record = F.struct(
        F.array("c_name", "c_mktsegment").alias("names"), F.struct(F.col("c_nationkey").alias("b"), F.lit(None).cast("string").alias("a")).alias("parent"), F.col("c_custkey").alias("key"), F.col("c_acctbal").cast("double").alias("balance")
    )
    rows = t.customer.select("c_custkey", F.left(F.sha2(F.concat_ws("\0", "c_name", "c_mktsegment"), 256), F.lit(16)).alias("id"), record.alias("record"))
    return rows.select("c_custkey", "id", F.sha2(X.canonical_json(F.col("record"), rows.schema["record"].dataType), 256).alias("fingerprint"))


@query("f22_stars", "SELECT l_orderkey, l_linenumber, CASE WHEN l_tax < 0.001 THEN '***' WHEN l_tax < 0.01 THEN '**' WHEN l_tax < 0.05 THEN '*' ELSE 'ns' END AS stars FROM lineitem")
def f22(t):
    p = F.col("l_tax")
    return t.lineitem.select("l_orderkey", "l_linenumber", F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns").alias("stars"))


# words of an element, then its pairs; _TERMS gives the kept terms of a document
_WORDS = "regexp_extract_all(lower(regexp_replace(replace(e, '-', ' '), '[!-/:-@\\[-`{-~]', '', 'g')), '[^\\x20\\x09-\\x0D]+')"
_TERMS = f"list_filter(flatten(list_transform(list_transform(string_split(text, ', '), lambda e: {_WORDS}), lambda w: list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])))), lambda x: length(x) > 1 AND NOT list_contains({X.EXCLUDED_TERMS}, x))"


@query("f23_keywords", f"SELECT doc_id, k AS terms, len(k) AS n_terms, len(list_distinct(k)) AS n_distinct FROM (SELECT doc_id, {_TERMS} AS k FROM documents)")
def f23(t):
    k = t.documents.select("doc_id", X.keywords(F.col("text")).alias("terms"))
    return k.select("doc_id", "terms", F.size("terms").cast("long").alias("n_terms"), F.size(F.array_distinct("terms")).cast("long").alias("n_distinct"))


@query(
    "f24_tfidf",
    f"""WITH t AS (SELECT doc_id, unnest({_TERMS}) AS term FROM documents), c AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2),
        i AS (SELECT term, ln((SELECT count(*) FROM documents) / count(*)::DOUBLE) + 1 AS idf FROM c GROUP BY 1 HAVING count(*) >= 2),
        w AS (SELECT doc_id, term, (1 + ln(tf)) * idf AS w FROM c JOIN i USING (term)), n AS (SELECT doc_id, sqrt(sum(w * w)) AS n FROM w GROUP BY 1)
        SELECT doc_id, term, round(w / n, 6) AS w FROM w JOIN n USING (doc_id)""",
)
def f24(t):
    return tfidf(t.documents.select(F.col("doc_id").alias("id"), "text"), X.EXCLUDED_TERMS, words=X.element_words).select(F.col("id").alias("doc_id"), "term", F.round("w", 6).alias("w"))


@query(
    "f25_position_labels",
    """WITH r AS (SELECT user_id, event_type, event_id % 20 + 1 AS s, event_id % 20 + 1 + event_id % 5 AS e FROM events), x AS (SELECT user_id, event_type, unnest(generate_series(s, e)) AS pos FROM r),
       g AS (SELECT user_id, pos, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS labels FROM x GROUP BY 1, 2), a AS (SELECT DISTINCT user_id, unnest(generate_series(1, 24)) AS pos FROM events)
       SELECT a.user_id, a.pos, CASE WHEN a.pos > 20 + a.user_id % 5 THEN '<pad>' ELSE coalesce(labels, '<none>') END AS labels FROM a LEFT JOIN g USING (user_id, pos)""",
)
def f25(t):
    """A user has 20 to 24 positions: labels of each, ``<none>`` without any, and ``<pad>`` up to the common length."""
    r = t.events.selectExpr("user_id", "event_type", "explode(sequence(event_id % 20 + 1, event_id % 20 + 1 + event_id % 5)) AS pos")
    g = r.groupBy("user_id", "pos").agg(F.array_join(F.sort_array(F.collect_set("event_type")), ",").alias("labels"))
    every = t.events.select("user_id").distinct().select("user_id", F.explode(F.expr("sequence(1L, 24L)")).alias("pos"))
    return every.join(g, ["user_id", "pos"], "left").select("user_id", "pos", F.when(F.col("pos") > 20 + F.col("user_id") % 5, "<pad>").otherwise(F.coalesce("labels", F.lit("<none>"))).alias("labels"))


@query("f26_valid_annotations", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45 OR l_linenumber > 6)")
def f26(t):
    bad = F.bool_or((F.col("l_quantity") > 45) | (F.col("l_linenumber") > 6)).over(Window.partitionBy("l_orderkey"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity").withColumn("bad", bad).where("not bad").select("l_orderkey", "l_linenumber")


@query("f27_half_open", "SELECT l_orderkey, l_linenumber - 1 AS s, l_linenumber + l_suppkey % 5 AS e FROM lineitem WHERE l_linestatus <> 'F'")
def f27(t):
    return t.lineitem.where("l_linestatus <> 'F'").select("l_orderkey", (F.col("l_linenumber") - 1).alias("s"), (F.col("l_linenumber") + F.col("l_suppkey") % 5).alias("e"))


@query("f28_buckets", "SELECT l_orderkey, l_linenumber, b, CASE b WHEN 0 THEN 2.5 WHEN 1 THEN 10.0 WHEN 2 THEN 27.5 ELSE 60.0 END AS mid FROM (SELECT *, CASE WHEN l_quantity <= 5 THEN 0 WHEN l_quantity <= 15 THEN 1 WHEN l_quantity <= 40 THEN 2 ELSE 3 END AS b FROM lineitem)")
def f28(t):
    q = F.col("l_quantity")
    b = F.when(q <= 5, 0).when(q <= 15, 1).when(q <= 40, 2).otherwise(3)
    mids = F.array(*[F.lit(x) for x in (2.5, 10.0, 27.5, 60.0)])
    return t.lineitem.select("l_orderkey", "l_linenumber", b.alias("b")).withColumn("mid", F.element_at(mids, F.col("b") + 1))


@query("f29_selection", "SELECT sel, split_part(sel, '/', 1) AS chain, split_part(split_part(sel, '/', 3), '-', 1)::BIGINT AS s, split_part(split_part(sel, '/', 3), '-', 2)::BIGINT AS e FROM (SELECT DISTINCT l_returnflag || '/*/' || l_linenumber || '-' || (l_linenumber + 7) AS sel FROM lineitem)")
def f29(t):
    sel = F.format_string("%s/*/%d-%d", "l_returnflag", "l_linenumber", F.col("l_linenumber") + 7)
    rx = r"^(.*?)/\*/(\d+)-(\d+)$"
    return t.lineitem.select(sel.alias("sel")).distinct().select("sel", F.regexp_extract("sel", rx, 1).alias("chain"), F.regexp_extract("sel", rx, 2).cast("long").alias("s"), F.regexp_extract("sel", rx, 3).cast("long").alias("e"))


@query("f30_half_even", "SELECT l_orderkey, l_linenumber, round_even(l_extendedprice, 1) AS r FROM lineitem")
def f30(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", F.bround("l_extendedprice", 1).alias("r"))
