"""Geometry over pairs (G1-G13). A vector's triples are the points of a chain of 21 residues."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import vector as V
from ..operators import geometry as G
from ..operators import spread
from ..operators.alignment import global_identities
from .base import query

PTS = "p AS (SELECT vec_id, i, list_slice(embedding::DOUBLE[], i * 3 + 1, i * 3 + 3) AS p FROM embeddings, (SELECT unnest(range(21)) AS i))"


def points(t):
    e = t.embeddings.select("vec_id", V.doubles(F.col("embedding")).alias("v"))
    return e.select("vec_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: F.slice("v", i * 3 + 1, 3))).alias("i", "p"))


def chain_pairs(t):
    """Each chain with its neighbour by id, residue by residue."""
    p = points(t)
    return p.join(p.select((F.col("vec_id") - 1).alias("vec_id"), "i", F.col("p").alias("q")), ["vec_id", "i"])


@query("g1_upper_triangle", f"WITH {PTS} SELECT a.vec_id, a.i // 7 AS region, list(round(list_distance(a.p, b.p), 9) ORDER BY a.i, b.i) AS d FROM p a JOIN p b ON a.vec_id = b.vec_id AND a.i // 7 = b.i // 7 AND a.i < b.i GROUP BY 1, 2")
def g1(t):
    p = points(t).withColumn("region", F.expr("i div 7"))
    both = p.alias("a").join(p.alias("b"), F.expr("a.vec_id = b.vec_id and a.region = b.region and a.i < b.i"))
    d = both.select("a.vec_id", "a.region", F.col("a.i").alias("x"), F.col("b.i").alias("y"), F.round(G.distance(F.col("a.p"), F.col("b.p")), 9).alias("d"))
    return d.groupBy("vec_id", "region").agg(F.transform(F.array_sort(F.collect_list(F.struct("x", "y", "d"))), lambda s: s["d"]).alias("d"))


@query("g2_superposed_rmsd")
def g2(t):
    return G.fit_pairs(chain_pairs(t), ["vec_id"]).select("vec_id", "n", "rmsd")


@query("g3_tm_score")
def g3(t):
    pairs = chain_pairs(t)
    d = G.distance(G.moved(F.col("p"), F.col("rotation"), F.col("shift")), F.col("q"))
    d0 = F.greatest(F.lit(0.5), 1.24 * F.cbrt(F.greatest(F.col("n"), F.lit(16)) - 15.0) - 1.8)
    fitted = pairs.join(G.fit_pairs(pairs, ["vec_id"]), "vec_id").where("rotation is not null")
    return fitted.select("vec_id", "n", d.alias("d"), d0.alias("d0")).groupBy("vec_id").agg(F.avg(1 / (1 + (F.col("d") / F.col("d0")) ** 2)).alias("tm"))


@query(
    "g4_direct_rmsd",
    f"""WITH {PTS}, q AS (SELECT a.vec_id, a.i, a.p AS p, b.p AS q, b.vec_id % 2 = 1 AND a.i % 7 = 3 AS lost FROM p a JOIN p b ON b.vec_id = a.vec_id + 1 AND a.i = b.i)
        SELECT vec_id, round(sqrt(avg(list_distance(p, q) ** 2) FILTER (NOT lost)), 9) AS rmsd, round(sqrt(avg(list_distance([0.1 - p[2], p[1], p[3] - 0.2], q) ** 2) FILTER (NOT lost)), 9) AS moved_rmsd, count(*) FILTER (NOT lost) AS n,
               count(*) FILTER (lost) AS n_missing, coalesce(string_agg(i::VARCHAR, ',' ORDER BY i) FILTER (lost), '') AS missing FROM q GROUP BY 1""",
)
def g4(t):
    """Chains as they lie, and under a given quarter turn and shift; residues without a partner are listed, not counted.

    Every seventh residue of chains with an odd id is missing.
    """
    turn, shift = [0.0, -1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0], [0.1, 0.0, -0.2]
    q = F.when((F.col("vec_id") % 2 == 1) | (F.col("i") % 7 != 3), F.col("q"))
    pairs = chain_pairs(t).withColumn("q", q)
    after = G.moved(F.col("p"), F.array(*map(F.lit, turn)), F.array(*map(F.lit, shift)))
    d2 = {"rmsd": G.square_distance(F.col("p"), F.col("q")), "moved_rmsd": G.square_distance(after, F.col("q"))}
    lost = F.sort_array(F.collect_list(F.when(F.col("q").isNull(), F.col("i"))))
    return pairs.groupBy("vec_id").agg(
        *[F.round(F.sqrt(F.avg(d)), 9).alias(n) for n, d in d2.items()], F.count("q").alias("n"), F.count_if(F.col("q").isNull()).alias("n_missing"), F.array_join(lost.cast("array<string>"), ",").alias("missing")
    )


@query(
    "g5_combined_rmsd",
    "WITH p AS (SELECT a.l_orderkey AS k, a.l_linenumber % 3 AS region, a.l_quantity - b.l_quantity AS d FROM lineitem a JOIN lineitem b ON a.l_orderkey + 1 = b.l_orderkey AND a.l_linenumber = b.l_linenumber), r AS (SELECT k, region, count(*) AS n, sum(d * d) AS s FROM p GROUP BY 1, 2) SELECT k, count(*) AS regions, CASE WHEN bool_and(n >= 2) THEN round(sqrt(sum(s) / sum(n)), 9) END AS combined, CASE WHEN bool_and(n >= 2) THEN 'ok' ELSE 'too_few_atoms' END AS status FROM r GROUP BY 1",
)
def g5(t):
    a = t.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("i"), F.col("l_quantity").alias("x"))
    b = a.select((F.col("k") - 1).alias("k"), "i", F.col("x").alias("y"))
    d = F.col("x") - F.col("y")
    r = a.join(b, ["k", "i"]).groupBy("k", F.expr("i % 3").alias("region")).agg(F.count("*").alias("n"), F.sum(d * d).alias("s"))
    ok = F.bool_and(F.col("n") >= 2)
    return r.groupBy("k").agg(F.count("*").alias("regions"), F.when(ok, F.round(F.sqrt(F.sum("s") / F.sum("n")), 9)).alias("combined"), F.when(ok, "ok").otherwise("too_few_atoms").alias("status"))


@query(
    "g6_lddt",
    f"""WITH {PTS}, d AS (SELECT a.vec_id, a.i, b.i AS j, list_distance(a.p, b.p) AS d FROM p a JOIN p b ON a.vec_id = b.vec_id AND a.i <> b.i),
        x AS (SELECT r.vec_id, abs(r.d - m.d) AS e FROM d r JOIN d m ON m.vec_id = r.vec_id + 1 AND m.i = r.i AND m.j = r.j WHERE r.d < 15)
        SELECT vec_id, round(avg(((e < 0.05)::INT + (e < 0.1)::INT + (e < 0.2)::INT + (e < 0.4)::INT) / 4.0), 9) AS lddt FROM x GROUP BY 1""",
)
def g6(t):
    """Tolerances are scaled to unit vectors: 0.05, 0.1, 0.2 and 0.4."""
    p = points(t)
    both = p.alias("a").join(p.alias("b"), F.expr("a.vec_id = b.vec_id and a.i <> b.i"))
    d = both.select("a.vec_id", F.col("a.i").alias("i"), F.col("b.i").alias("j"), G.distance(F.col("a.p"), F.col("b.p")).alias("d"))
    m = d.select((F.col("vec_id") - 1).alias("vec_id"), "i", "j", F.col("d").alias("m"))
    e = F.abs(F.col("d") - F.col("m"))
    hit = sum((F.when(e < x, 1.0).otherwise(0.0) for x in (0.05, 0.1, 0.2, 0.4)), F.lit(0.0)) / 4
    return d.where("d < 15").join(m, ["vec_id", "i", "j"]).groupBy("vec_id").agg(F.round(F.avg(hit), 9).alias("lddt"))


@query(
    "g7_contacts",
    f"""WITH {PTS}, c AS (SELECT a.vec_id, CASE WHEN a.i % 7 = 6 OR b.i % 7 = 6 THEN -1 WHEN list_distance(a.p, b.p) < 0.15 THEN 1 ELSE 0 END AS c, a.i, b.i AS j FROM p a JOIN p b ON a.vec_id = b.vec_id AND a.i < b.i)
        SELECT vec_id, count(*) FILTER (c = 1) AS contacts, count(*) FILTER (c = -1) AS missing, count(*) AS pairs, string_agg(c::VARCHAR, ',' ORDER BY i, j) AS map FROM c GROUP BY 1""",
)
def g7(t):
    """The map of each chain: 1 in contact, 0 apart, -1 where a residue (every seventh here) is missing."""
    p = points(t).withColumn("p", F.when(F.col("i") % 7 != 6, F.col("p")))
    both = p.alias("a").join(p.alias("b"), F.expr("a.vec_id = b.vec_id and a.i < b.i"))
    near = G.distance(F.col("a.p"), F.col("b.p")) < 0.15
    c = F.when(F.col("a.p").isNull() | F.col("b.p").isNull(), -1).when(near, 1).otherwise(0)
    rows = both.select("a.vec_id", F.col("a.i").alias("i"), F.col("b.i").alias("j"), c.alias("c"))
    order = F.array_sort(F.collect_list(F.struct("i", "j", "c")))
    return rows.groupBy("vec_id").agg(
        F.count_if(F.col("c") == 1).alias("contacts"), F.count_if(F.col("c") == -1).alias("missing"), F.count("*").alias("pairs"), F.array_join(F.transform(order, lambda x: x["c"].cast("string")), ",").alias("map")
    )


@query(
    "g8_neighbours",
    f"WITH {PTS} SELECT * FROM (SELECT a.vec_id, a.i, b.i AS j, row_number() OVER (PARTITION BY a.vec_id, a.i ORDER BY CASE WHEN a.i % 7 = 0 THEN 1000 + 100 * abs(a.i - b.i) ELSE list_distance(a.p, b.p) END, b.i) AS rank FROM p a JOIN p b ON a.vec_id = b.vec_id AND a.i <> b.i) WHERE rank <= 3",
)
def g8(t):
    """Every seventh point counts as missing and falls back to distance along the chain."""
    p = points(t).withColumn("p", F.when(F.col("i") % 7 != 0, F.col("p")))
    p0 = points(t)
    both = p.alias("a").join(p0.alias("b"), F.expr("a.vec_id = b.vec_id and a.i <> b.i"))
    d = F.coalesce(G.distance(F.col("a.p"), F.col("b.p")), 1000 + 100 * F.abs(F.col("a.i") - F.col("b.i")))
    e = both.select("a.vec_id", F.col("a.i").alias("i"), F.col("b.i").alias("j"), d.alias("d"))
    w = Window.partitionBy("vec_id", "i").orderBy("d", "j")
    return e.withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 3").drop("d")


@query("g9_max_difference", f"WITH {PTS} SELECT a.vec_id, max(greatest(abs(a.p[1] - b.p[1]), abs(a.p[2] - b.p[2]), abs(a.p[3] - b.p[3]))) AS d FROM p a JOIN p b ON b.vec_id = a.vec_id + 1 AND a.i = b.i GROUP BY 1")
def g9(t):
    d = F.greatest(*[F.abs(F.col("p")[i] - F.col("q")[i]) for i in range(3)])
    return chain_pairs(t).groupBy("vec_id").agg(F.max(d).alias("d"))


@query("g10_pair_run")
def g10(t):
    """Neighbouring chains of a label: distance and fit of each pair, with a status; equal vectors are skipped."""
    e = t.embeddings.select("vec_id", "label", V.doubles(F.col("embedding")).alias("v"))
    pairs = spread.beside(e, ["label"], ["vec_id"], ["vec_id", "v"], "n").withColumnRenamed("vec_id", "a").where("n is not null").select("label", "a", F.col("n.vec_id").alias("b"), "v", F.col("n.v").alias("w"))
    todo = pairs.where("v <> w")
    p, q = F.slice("v", F.col("i") * 3 + 1, F.lit(3)), F.slice("w", F.col("i") * 3 + 1, F.lit(3))
    fit = G.fit_pairs(todo.select("a", "b", "v", "w", F.explode(F.sequence(F.lit(0), F.lit(20))).alias("i")).select("a", "b", p.alias("p"), q.alias("q")), ["a", "b"])
    out = pairs.join(fit.select("a", "b", "rmsd"), ["a", "b"], "left")
    status = F.when(F.col("v") == F.col("w"), "skipped_identical").when(F.col("rmsd").isNull(), "failed").otherwise("ok")
    return out.select("label", "a", "b", V.euclidean(F.col("v"), F.col("w")).alias("distance"), "rmsd", status.alias("status"))


@query("g11_alignment_identity")
def g11(t):
    """Global alignment of part names that are neighbours within their brand."""
    pairs = spread.beside(t.part.select("p_brand", "p_partkey", "p_name"), ["p_brand"], ["p_partkey"], ["p_name"])
    pairs = pairs.where("next is not null").select("p_partkey", F.col("p_name").alias("a"), F.col("next.p_name").alias("b"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"p_partkey": pdf["p_partkey"], "identity": global_identities(pdf["a"].tolist(), pdf["b"].tolist())})

    return pairs.mapInPandas(run, "p_partkey long, identity double")


@query("g12_pair_scores", "SELECT l_orderkey, l_linenumber, round((l_discount + l_tax) / 2, 9) AS score FROM lineitem")
def g12(t):
    """Scores come as one tab-separated line of an alignment report."""
    line = F.concat_ws("\t", F.col("l_discount").cast("string"), F.col("l_tax").cast("string"))
    parts = F.split(line, "\t")
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round((parts[0].try_cast("double") + parts[1].try_cast("double")) / 2, 9).alias("score"))


@query("g13_framework_fit")
def g13(t):
    """Fit on the framework, measure the regions under that transform; coverage of at least 0.8."""
    pairs = chain_pairs(t).withColumn("region", F.when(F.col("i").between(5, 8), 1).when(F.col("i").between(13, 16), 2).otherwise(0))
    fit = G.fit_pairs(pairs.where("region = 0"), ["vec_id"]).where("n >= 0.8 * 13")
    d2 = G.square_distance(G.moved(F.col("p"), F.col("rotation"), F.col("shift")), F.col("q"))
    return pairs.where("region > 0").join(fit, "vec_id").groupBy("vec_id", "region").agg(F.sqrt(F.avg(d2)).alias("rmsd"))
