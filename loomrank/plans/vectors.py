"""Vector functions (V1-V13)."""

from __future__ import annotations

import string

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import vector as V
from ..operators import spread
from ..operators import tables as T
from ..operators.hashing import hyperplane_tokens
from ..operators.search import nearest_by_pivots
from ..sources import files as R
from .base import query


def _with_query(t, dim=None):
    e = t.embeddings.select("vec_id", "label", V.doubles(F.col("embedding")).alias("v"))
    if dim:
        e = e.withColumn("v", F.slice("v", 1, dim))
    q = e.where("vec_id = 0").select(F.col("v").alias("q"))
    return e.crossJoin(F.broadcast(q))


def _sql(cols, dim=64):
    return f"WITH e AS (SELECT vec_id, label, list_slice(embedding::DOUBLE[], 1, {dim}) AS v FROM embeddings), q AS (SELECT v AS q FROM e WHERE vec_id = 0) SELECT vec_id, {cols} FROM e, q"


def _d(a, b):
    return f"list_distance(list_slice(v, {a}, {b}), list_slice(q, {a}, {b}))"


@query("v1_euclidean", _sql("round(list_distance(v, q), 9) AS d"))
def v1(t):
    return _with_query(t).select("vec_id", F.round(V.euclidean(F.col("v"), F.col("q")), 9).alias("d"))


@query("v2_cosine", _sql("round(list_cosine_similarity(v, q), 9) AS c"))
def v2(t):
    return _with_query(t).select("vec_id", F.round(V.cosine(F.col("v"), F.col("q")), 9).alias("c"))


@query("v3_blocks", "SELECT vec_id, list_slice(embedding::DOUBLE[], 1, 21) AS b1, list_slice(embedding::DOUBLE[], 22, 42) AS b2, list_slice(embedding::DOUBLE[], 44, 64) AS b3 FROM embeddings")
def v3(t):
    b = V.blocks(V.doubles(F.col("embedding")), 64)
    return t.embeddings.select("vec_id", *[x.alias(f"b{i + 1}") for i, x in enumerate(b)])


@query("v4_weighted_blocks", _sql(f"round(0.2 * {_d(1, 21)} + 0.3 * {_d(22, 42)} + 0.5 * {_d(44, 64)}, 9) AS d"))
def v4(t):
    d = V.weighted(V.blocks(F.col("v"), 64), V.blocks(F.col("q"), 64), (0.2, 0.3, 0.5), V.euclidean)
    return _with_query(t).select("vec_id", F.round(d, 9).alias("d"))


@query("v5_length_norm", _sql(f"round(list_distance(v, q) / sqrt(12), 9) AS whole, round({_d(1, 21)} / sqrt(4), 9) AS block1"))
def v5(t):
    a, b = V.blocks(F.col("v"), 64)[0], V.blocks(F.col("q"), 64)[0]
    return _with_query(t).select("vec_id", F.round(V.length_norm(V.euclidean(F.col("v"), F.col("q")), 12), 9).alias("whole"), F.round(V.length_norm(V.euclidean(a, b), 4), 9).alias("block1"))


@query("v6_change", _sql(f"round(abs({_d(1, 21)} / 2 - {_d(44, 64)} / 2), 9) AS change"))
def v6(t):
    a, b = V.blocks(F.col("v"), 64), V.blocks(F.col("q"), 64)
    return _with_query(t).select("vec_id", F.round(F.abs(V.length_norm(V.euclidean(a[0], b[0]), 4) - V.length_norm(V.euclidean(a[2], b[2]), 4)), 9).alias("change"))


@query("v7_direct_difference", _sql(f"round(list_distance(v, q) / sqrt(12), 9) AS overall, round({_d(1, 20)} / 2, 9) AS b1, round({_d(21, 40)} / 2, 9) AS b2, round({_d(41, 60)} / 2, 9) AS b3", 60))
def v7(t):
    """The overall norm is the root mean square of the block norms; sizes must divide by 12."""
    parts = zip(V.blocks(F.col("v"), 60), V.blocks(F.col("q"), 60), strict=True)
    out = _with_query(t, 60).select("vec_id", F.size("v").alias("n"), V.length_norm(V.euclidean(F.col("v"), F.col("q")), 12).alias("o"), *[V.length_norm(V.euclidean(a, b), 4).alias(f"x{i + 1}") for i, (a, b) in enumerate(parts)])
    rms = F.sqrt((F.col("x1") ** 2 + F.col("x2") ** 2 + F.col("x3") ** 2) / 3)
    sound = (F.col("n") % 12 == 0) & (F.abs(rms - F.col("o")) <= 1e-7)
    checked = F.when(sound, F.col("o")).otherwise(F.raise_error(F.lit("block norms do not add up")).cast("double"))
    return out.select("vec_id", F.round(checked, 9).alias("overall"), *[F.round(f"x{i}", 9).alias(f"b{i}") for i in (1, 2, 3)])


@query(
    "v8_recompute",
    """WITH d AS (SELECT e.vec_id, list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS whole, list_distance(list_slice(e.embedding::DOUBLE[], 44, 64), list_slice(q.embedding::DOUBLE[], 44, 64)) AS block3
       FROM embeddings e, embeddings q WHERE q.vec_id = 0), s AS (SELECT 'whole' AS measure, vec_id, whole AS d FROM d UNION ALL SELECT 'block3', vec_id, block3 FROM d)
       SELECT measure, count(*) FILTER (vec_id % 17 = 5) AS left_only, 0::BIGINT AS right_only, count(*) FILTER (vec_id % 17 <> 5) AS matched, round(max(abs(d - round(d, 3))) FILTER (vec_id % 17 <> 5), 9) AS max_abs_error FROM s GROUP BY 1""",
)
def v8(t):
    """Distances to the query, whole and of the third block, against a stored table that rounds them and lacks some ids."""
    q = _with_query(t)
    d = q.select("vec_id", V.euclidean(F.col("v"), F.col("q")).alias("whole"), V.euclidean(V.blocks(F.col("v"), 64)[2], V.blocks(F.col("q"), 64)[2]).alias("block3"))
    path = R.scratch(t.spark, "stored")
    d.where("vec_id % 17 <> 5").select("vec_id", F.round("whole", 3).alias("whole"), F.round("block3", 3).alias("block3")).write.parquet(path)
    stored = t.spark.read.schema("vec_id long, whole double, block3 double").parquet(path)
    found = [T.reconcile(d, stored, ["vec_id"], m).select(F.lit(m).alias("measure"), "left_only", "right_only", "matched", F.round("max_abs_error", 9).alias("max_abs_error")) for m in ("whole", "block3")]
    return found[0].unionByName(found[1])


@query(
    "v9_stage_table",
    _sql("descriptor, round(value, 9) AS value").replace("SELECT vec_id, descriptor", "SELECT vec_id, descriptor")
    .replace("FROM e, q", f"FROM (UNPIVOT (SELECT vec_id, list_distance(v, q) / sqrt(12) AS whole, {_d(1, 21)} / 2 AS block1 FROM e, q) ON whole, block1 INTO NAME descriptor VALUE value)"),
)
def v9(t):
    a, b = V.blocks(F.col("v"), 64)[0], V.blocks(F.col("q"), 64)[0]
    wide = _with_query(t).select("vec_id", V.length_norm(V.euclidean(F.col("v"), F.col("q")), 12).alias("whole"), V.length_norm(V.euclidean(a, b), 4).alias("block1"))
    return wide.unpivot(["vec_id"], ["whole", "block1"], "descriptor", "value").withColumn("value", F.round("value", 9))


@query("v10_hyperplane_hash")
def v10(t):
    return hyperplane_tokens(t.embeddings.select("vec_id", V.doubles(F.col("embedding")).alias("v")), "vec_id", "v", 64, bits=8, tables=4)


@query("v11_sparse_max", "SELECT source, lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS term, max(length(text)) AS weight FROM documents GROUP BY 1, 2")
def v11(t):
    """A term weighs the same wherever it stands in a document, so each is sent once for it."""
    terms = F.explode(F.array_distinct(F.regexp_extract_all(F.translate("text", string.ascii_uppercase, string.ascii_lowercase), F.lit("[a-z]+"), F.lit(0))))
    return spread.widen(t.documents.select("source", "text")).select("source", F.length("text").cast("long").alias("w"), terms.alias("term")).groupBy("source", "term").agg(F.max("w").alias("weight"))


@query(
    "v12_nearest_to_centre",
    """WITH e AS (SELECT vec_id, label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label, i, avg(x) AS m FROM e GROUP BY 1, 2),
       d AS (SELECT vec_id, label, round(sqrt(sum((x - m) * (x - m))), 9) AS d FROM e JOIN c USING (label, i) GROUP BY 1, 2)
       SELECT label, arg_min(vec_id, (d, vec_id)) AS vec_id, min(d) AS d FROM d GROUP BY 1""",
)
def v12(t):
    e = t.embeddings.select("vec_id", "label", F.posexplode(V.doubles(F.col("embedding"))).alias("i", "x"))
    c = e.groupBy("label", "i").agg(F.avg("x").alias("m"))
    d = e.join(c, ["label", "i"]).groupBy("label", "vec_id").agg(F.round(F.sqrt(F.sum((F.col("x") - F.col("m")) ** 2)), 9).alias("d"))
    return d.groupBy("label").agg(F.min_by("vec_id", F.struct("d", "vec_id")).alias("vec_id"), F.min("d").alias("d"))


@query(
    "v13_top_similar",
    "SELECT query_id, vec_id, rank FROM (SELECT q.vec_id AS query_id, e.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), e.vec_id) AS rank FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 50 = 0) WHERE rank <= 10",
)
def v13(t):
    e = t.embeddings.select(F.col("vec_id").alias("id"), V.doubles(F.col("embedding")).alias("v")).where(V.usable(F.col("v")))
    return nearest_by_pivots(e, e.where("id % 50 = 0"), 10).select("query_id", "vec_id", "rank")
