"""Approximate nearest neighbours by multi-index hashing of learned codes.

Learning, on a bounded sample: vectors are centred and rotated, the rotation is
refined (iterative quantisation) so that signs lose little, and several such
rotations are stacked to ``bits`` bits.  The Hamming radius is calibrated on the
sample: the one within which ``cover`` of its true neighbour pairs lie.  In a
larger table true neighbours lie closer than in the sample, so this errs on the
side of more candidates.

Search: every vector is indexed.  Blocks of vectors meet blocks of queries; in a
block each of the ``m`` substrings of the code has its own table from substring
value to rows.  Codes within radius r agree with the query to floor(r/m) bits in
some substring, so probing the values within that distance retrieves every code
within the radius; those are ranked by exact Euclidean distance.  A query that
finds fewer than k neighbours within the radius is searched again without one.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_sample, cut, session_settings

SAMPLE_ROWS = 4096
BITS, SUB_BITS = 256, 16
#: rows and queries of a block, for vectors of up to 256 components; wider ones come in smaller blocks
BLOCK_ROWS, BLOCK_QUERIES, BLOCK_WIDTH = 8192, 4096, 256


class CodeModel:
    """Rotations and the search radius, fitted on a bounded sample."""

    def __init__(self, sample: np.ndarray, k: int, bits: int = BITS, cover: float = 0.97, seed: int = 5) -> None:
        self.dim = sample.shape[1]
        self.mean = sample.mean(0)
        rng = np.random.default_rng(seed)
        x = sample - self.mean
        parts = []
        for _ in range(math.ceil(bits / self.dim)):
            r = np.linalg.qr(rng.standard_normal((self.dim, self.dim)))[0]
            for _ in range(20):
                u, _, v = np.linalg.svd(np.where(x @ r > 0, 1.0, -1.0).T @ x)
                r = (u @ v).T
            parts.append(r)
        self.rotation = np.concatenate(parts, 1)[:, :bits]
        self.bits = self.rotation.shape[1]
        some = rng.permutation(len(x))[:256]
        code = self.codes(sample)
        near = []
        square = (sample * sample).sum(1)
        for i in some:
            d = square - 2 * sample @ sample[i]
            d[i] = np.inf
            best = np.argsort(d)[: min(k, len(x) - 1)]
            near.append(np.bitwise_count(code[best] ^ code[i]).sum(1))
        near = np.concatenate(near) if near else np.zeros(0)
        self.radius = int(np.quantile(near, cover)) if len(near) else self.bits

    def codes(self, x: np.ndarray) -> np.ndarray:
        """``rows x substrings`` of 16 bits."""
        sign = (x - self.mean) @ self.rotation > 0
        pad = -sign.shape[1] % SUB_BITS
        return np.packbits(np.pad(sign, ((0, 0), (0, pad))), axis=1).view(np.uint16)


def search_block(model: CodeModel, q_ids, queries, ids, x, k: int, radius: int):
    """The k nearest of a block within the radius, for each query: ``(query, vec, distance)`` rows."""
    code, q_code = model.codes(x), model.codes(queries)
    m = code.shape[1]
    reach = radius // m
    tables = []
    for j in range(m):  # substring table: values, and the rows that have each
        order = np.argsort(code[:, j], kind="stable")
        values, start = np.unique(code[order, j], return_index=True)
        tables.append((values, np.append(start, len(order)), order))
    square = (x * x).sum(1)
    for i in range(len(q_ids)):
        found = np.zeros(len(x), bool)
        for j, (values, start, order) in enumerate(tables):
            hit = np.bitwise_count(values ^ q_code[i, j]) <= reach
            if hit.all():
                found[:] = True
                break
            found[order[np.repeat(hit, np.diff(start))]] = True
        rows = np.flatnonzero(found)
        rows = rows[np.bitwise_count(code[rows] ^ q_code[i]).sum(1) <= radius]
        rows = rows[ids[rows] != q_ids[i]]
        if len(rows) > 4 * k:  # a cheap cut by the expanded form: goes only what lies beyond the k-th by more than rounding
            rough = square[rows] - 2 * (x[rows] @ queries[i])
            slack = 4 * (x.shape[1] + 4) * np.finfo(float).eps * (np.sqrt(square[rows]) + np.sqrt(queries[i] @ queries[i])) ** 2
            rows = rows[~(rough - slack > np.partition(rough + slack, k - 1)[k - 1])]
        d = np.sqrt(((x[rows] - queries[i]) ** 2).sum(1))
        best = np.lexsort((ids[rows], d))[:k]
        for r in best:
            yield q_ids[i], ids[rows[r]], d[r]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: k nearest rows of ``vectors`` of each query, its own id left out.

    ``score`` is the Euclidean distance in double precision; ties go to the
    smaller id.  Null, zero or non-finite vectors and null ids take no part; vectors
    of unequal width are not compared, and each width has a model of its own.
    Repeated rows are candidates each; of equal queries the rows are found once each.
    Other columns are ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    session_settings(spark)

    def usable(df: DataFrame, dim: int | None = None) -> DataFrame:
        # single floats are shuffled as such; all reckoning is in double
        vector = F.col(vec_col) if df.schema[vec_col].dataType.simpleString() == "array<float>" else F.col(vec_col).cast("array<double>")
        out = df.select(F.col(id_col).cast("long").alias("id"), vector.alias("v"))
        out = out.where("id is not null and size(v) > 0 and coalesce(not exists(v, x -> x is null or isnan(x) or abs(x) = double('Infinity')) and exists(v, x -> x <> 0), false)")
        return out.where(F.size("v") == dim) if dim else out

    found = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for width in usable(vectors).groupBy(F.size("v").alias("d")).count().orderBy("d").collect():
        found = found.unionByName(_nearest(usable(vectors, width["d"]), usable(queries, width["d"]).distinct(), width["count"], k, sample_rows))
    return found


def _nearest(rows: DataFrame, asked: DataFrame, total: int, k: int, sample_rows: int) -> DataFrame:
    """:func:`nearest` of ``(id, v)`` rows of one width."""
    sample = bounded_sample(rows, "id", sample_rows, total).orderBy("id").limit(2 * sample_rows)
    model = CodeModel(np.array([r["v"] for r in sample.select("v").collect()]), k)
    size = max(1, math.ceil(model.dim / BLOCK_WIDTH))
    n_blocks = math.ceil(total * size / BLOCK_ROWS)

    def search(asked: DataFrame, radius: int) -> DataFrame:
        q_blocks = math.ceil(max(1, asked.count()) * size / BLOCK_QUERIES)
        left = asked.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(q_blocks)).cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("vb"))
        right = rows.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int").alias("vb"), F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("qb"))

        def run(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
            if not len(q) or not len(x):
                return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
            found = search_block(model, q["id"].to_numpy(), np.stack(q["v"]).astype(float), x["id"].to_numpy(), np.stack(x["v"]).astype(float), k, radius)
            return pd.DataFrame(list(found), columns=["query_id", "vec_id", "score"])

        near = left.groupBy("qb", "vb").cogroup(right.groupBy("qb", "vb")).applyInPandas(run, "query_id long, vec_id long, score double")
        best = Window.partitionBy("query_id").orderBy("score", "vec_id")
        return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    first = cut(search(asked, model.radius), "found")
    want = min(k, total - 1)
    short = asked.join(first.groupBy("query_id").count().where(F.col("count") >= want), F.col("id") == F.col("query_id"), "left_anti")
    short = cut(short, "short")
    if short.isEmpty():
        return first
    again = search(short, model.bits)
    return first.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(again)
