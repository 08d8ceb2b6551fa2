"""Clustering and search over libraries (M1-M7)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vector as V
from ..operators import spread
from ..operators import tables as T
from ..operators.alignment import best_fits, fit_targets
from ..operators.search import kmer_hits, redundancy_levels
from .base import query


def _seqs(t):
    return t.part.select(F.col("p_partkey").alias("id"), F.concat_ws("-", "p_name", "p_brand", "p_type").alias("seq"))


#: identity and coverage thresholds of the redundancy clusters
LEVELS = [(0.85, 0.8), (0.9, 0.8), (0.9, 0.95), (0.95, 0.8), (0.98, 0.0)]


@query("m1_redundancy_clusters")
def m1(t):
    return redundancy_levels(_seqs(t), LEVELS)


@query("m2_cluster_ingest", "SELECT c_nationkey AS cluster, min(c_custkey) AS rep, count(*) AS n FROM customer GROUP BY 1")
def m2(t):
    return t.customer.groupBy(F.col("c_nationkey").alias("cluster")).agg(F.min("c_custkey").alias("rep"), F.count("*").alias("n"))


@query("m3_representatives", "SELECT r.rep, c.c_name, r.n FROM (SELECT c_nationkey, min(c_custkey) AS rep, count(*) AS n FROM customer GROUP BY 1) r JOIN customer c ON c.c_custkey = r.rep")
def m3(t):
    reps = t.customer.groupBy("c_nationkey").agg(F.min("c_custkey").alias("rep"), F.count("*").alias("n"))
    return T.checked_join(reps, t.customer.select(F.col("c_custkey").alias("rep"), "c_name"), ["rep"], "one_to_one").select("rep", "c_name", "n")


@query("m4_kmeans")
def m4(t):
    rows = t.embeddings.select("vec_id", array_to_vector(V.doubles(F.col("embedding"))).alias("features"))
    model = KMeans(k=15, seed=42, maxIter=20).fit(rows)
    centres = t.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(model.clusterCenters())], "prediction int, centre array<double>")
    out = model.transform(rows).select("vec_id", "prediction").join(t.embeddings.select("vec_id", V.doubles(F.col("embedding")).alias("v")), "vec_id")
    return out.join(F.broadcast(centres), "prediction").select("vec_id", F.col("prediction").alias("cluster"), V.euclidean(F.col("v"), F.col("centre")).alias("distance"))


@query("m5_sequence_search")
def m5(t):
    queries = t.benchmark.select(F.col("item_id").alias("query"), F.col("text").alias("seq"))
    return kmer_hits(queries, t.documents.select(F.col("doc_id").alias("id"), F.col("text").alias("seq")), k=4, top=1000)


_WORDS = r"regexp_split_to_array(lower(text), '[ \t\n\x0B\f\r]+')"


def _grams(name: str, source: str) -> str:
    return f"{name} AS (SELECT DISTINCT id, unnest(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) AS g FROM (SELECT id, {_WORDS} AS w FROM ({source})))"


@query(
    "m6_candidates",
    f"""WITH {_grams("q", "SELECT item_id AS id, text FROM benchmark WHERE item_id = 0")}, {_grams("l", "SELECT doc_id AS id, text FROM documents")},
        tab AS (SELECT doc_id AS id FROM labels WHERE quality = 1),
        dist AS (SELECT e.vec_id AS id FROM embeddings e, embeddings q WHERE q.vec_id = 0 AND e.vec_id <> 0 ORDER BY list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), e.vec_id LIMIT 100),
        hits AS (SELECT l.id, count(*) AS shared FROM l JOIN q USING (g) GROUP BY 1 ORDER BY shared DESC, l.id LIMIT 100),
        u AS (SELECT id, 'table' AS mode, 0 AS pri FROM tab UNION ALL SELECT id, 'distance', 1 FROM dist UNION ALL SELECT id, 'sequence', 2 FROM hits)
        SELECT id, min_by(mode, pri) AS mode FROM u GROUP BY 1""",
)
def m6(t):
    """Rows of a table, the nearest vectors and the best sequence hits of one query; an id in several goes to the first."""
    table = t.labels.where("quality = 1").select(F.col("doc_id").alias("id"), F.lit("table").alias("mode"), F.lit(0).alias("pri"))
    e = t.embeddings.select("vec_id", V.doubles(F.col("embedding")).alias("v"))
    q = e.where("vec_id = 0").select(F.col("v").alias("q"))
    near = e.where("vec_id <> 0").crossJoin(F.broadcast(q)).select("vec_id", V.euclidean(F.col("v"), F.col("q")).alias("d")).orderBy("d", "vec_id").limit(100)
    item = t.benchmark.where("item_id = 0").select(F.col("item_id").alias("query"), F.col("text").alias("seq"))
    hits = kmer_hits(item, t.documents.select(F.col("doc_id").alias("id"), F.col("text").alias("seq")), k=4, top=100)
    both = table.unionByName(near.select(F.col("vec_id").alias("id"), F.lit("distance").alias("mode"), F.lit(1).alias("pri")))
    both = both.unionByName(hits.select("id", F.lit("sequence").alias("mode"), F.lit(2).alias("pri")))
    return T.first_row(both, ["id"], ["pri"]).select("id", "mode")


#: chains and targets that one task compares
CHAINS, TARGETS = 8192, 1024


@query("m7_best_chain")
def m7(t):
    """Each supplier name as a target, the names of its nation's customers as chains: the best chain and how the target lies in it.

    Equal names of a nation are compared once. Blocks of chains, in order so that they
    begin alike, meet blocks of targets; each gives its best chain, and the
    places are traced for the best of all.
    """
    targets = t.supplier.select("s_suppkey", F.upper(F.regexp_replace("s_name", r"\s", "")).alias("target"), F.col("s_nationkey").alias("n")).where("target <> ''")
    chains = t.customer.select("c_custkey", F.upper("c_name").alias("chain"), F.col("c_nationkey").alias("n"))
    return best_chains(targets, chains)


def best_chains(targets: DataFrame, chains: DataFrame, n_chains: int = CHAINS, n_targets: int = TARGETS) -> DataFrame:
    """The best of the ``chains`` ``(c_custkey, chain, n)`` for each of the ``targets`` ``(s_suppkey, target, n)`` of the same ``n``."""
    names = chains.where("chain is not null and n is not null").groupBy("n", "chain").agg(F.min("c_custkey").alias("c_custkey"))
    asked = targets.where("target is not null and n is not null").select("n", "target").distinct()
    names = spread.number_rows(names, ["n"], ["chain"], "r", "k").select("n", F.floor((F.col("r") - 1) / n_chains).alias("c"), "chain", "c_custkey", F.ceil(F.col("k") / n_chains).alias("cs"))
    asked = spread.number_rows(asked, ["n"], ["target"], "r", "k").select("n", F.floor((F.col("r") - 1) / n_targets).alias("b"), "target", F.ceil(F.col("k") / n_targets).alias("bs"))
    # blocks of one side are sent once for each block of the other
    names, asked = spread.cut(names), spread.cut(asked)
    sizes = spread.cut(names.select("n", "cs").distinct().join(asked.select("n", "bs").distinct(), "n"))
    tasks = max(1, sizes.agg(F.sum(F.col("cs") * F.col("bs"))).first()[0] or 0)
    names = names.select("n", "c", "chain", "c_custkey").join(sizes, "n").withColumn("b", F.explode(F.expr("sequence(0L, bs - 1)"))).drop("bs", "cs")
    asked = asked.select("n", "b", "target").join(sizes, "n").withColumn("c", F.explode(F.expr("sequence(0L, cs - 1)"))).drop("bs", "cs")

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"n": [], "target": [], "score": [], "matches": [], "c_custkey": []}).astype({"n": "int64", "matches": "int64", "c_custkey": "int64", "score": "float64", "target": "object"})
        found = best_fits(left["chain"].tolist(), left["c_custkey"].tolist(), right["target"].tolist())
        score, matches, key = zip(*found, strict=True)
        return pd.DataFrame({"n": right["n"], "target": right["target"], "score": score, "matches": matches, "c_custkey": key})

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = fit_targets(pdf["chain"].tolist(), pdf["target"].tolist(), places=True)
            lost = [[f"{i + 1}:{c}" for i, c in enumerate(s) if i not in set(f[2])] for s, f in zip(pdf["target"], found, strict=True)]
            out = pdf[["s_suppkey", "c_custkey"]].assign(score=[f[0] for f in found], matches=[f[1] for f in found])
            yield out.assign(missing=[len(x) for x in lost], identity=[f[1] / len(s) for f, s in zip(found, pdf["target"], strict=True)], missing_positions=[",".join(x) for x in lost])

    keys = ["n", "b", "c"]
    names, asked = names.repartition(tasks, *keys), asked.repartition(tasks, *keys)
    scored = names.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(best, "n long, target string, score double, matches long, c_custkey long")
    top = spread.cut(scored.groupBy("n", "target").agg(F.max_by("c_custkey", F.struct("score", "matches", -F.col("c_custkey"))).alias("c_custkey")))
    named = targets.join(top, ["n", "target"]).join(chains.select("c_custkey", "chain"), "c_custkey").select("s_suppkey", "c_custkey", "target", "chain")
    return spread.widen(named).mapInPandas(place, "s_suppkey long, c_custkey long, score double, matches long, missing long, identity double, missing_positions string")
