"""Near-duplicate vectors by cross-polytope hashing.

A table rotates unit vectors by three rounds of random signs and a fast Hadamard
transform; the hash is the nearest signed axis.  A bucket joins ``k`` such
hashes, k growing with the logarithm of the number of vectors, and the number of
tables follows from k.  Each vector is indexed in its own bucket and probes that
bucket and those in which one of the k hashes is replaced by its runner-up.

Equal vectors are collapsed to one with a multiplicity before hashing, so a
large group of copies costs one row.  Candidates carry a 64-bit sign code; pairs
whose codes differ in more places than 1e-7 of the pairs at the threshold
(:func:`code_bits`) are dropped inside the join, the rest is verified by cosine in double precision.  All labels are compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, session_settings
from .graph import components
from .textops import U, mix
from .vectors import matrix

THRESHOLD = 0.95


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, orthonormal; the width is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(n, d)
        h *= 2
    return x / math.sqrt(d)


def rotate(x: np.ndarray, seed: int, rounds: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        x = hadamard(x * rng.choice([-1.0, 1.0], x.shape[1]))
    return x


def padded(dim: int) -> int:
    """Width of the rotations: the next power of two."""
    return 1 << max(1, (dim - 1).bit_length())


@lru_cache
def hit_chance(wide: int, threshold: float, k: int, pairs: int = 4000) -> float:
    """The chance that a table finds a pair at the threshold, from drawn pairs: all k hashes agree, or all but one, which is the runner-up.

    Both chances of one hash are taken at the lower end of three standard deviations.
    """
    rng = np.random.default_rng(wide)
    x, y = rng.standard_normal((2, pairs, wide))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(1, keepdims=True) * x
    y = threshold * x + math.sqrt(1 - threshold * threshold) * y / np.linalg.norm(y, axis=1, keepdims=True)
    rows = np.arange(pairs)
    top = np.argsort(-np.abs(x), axis=1)[:, :2]
    other = np.abs(y).argmax(1)
    same, second = ((top[:, i] == other) & (np.sign(x[rows, top[:, i]]) == np.sign(y[rows, other])) for i in (0, 1))
    one, two = (max(0.01, p - 3 * math.sqrt(p * (1 - p) / pairs)) for p in (same.mean(), second.mean()))
    return one**k + k * one ** (k - 1) * two


def plan_tables(n: int, dim: int, threshold: float = THRESHOLD, miss: float = 1e-5) -> tuple[int, int]:
    """``(k, tables)``: buckets hold a few vectors each; a pair at the threshold is missed in all tables with chance ``miss`` at most."""
    wide = padded(dim)
    k = max(1, math.ceil(math.log(max(n, 2) / 8) / math.log(2 * wide)))
    return k, math.ceil(math.log(miss) / math.log(1 - hit_chance(wide, threshold, k)))


def buckets(unit: np.ndarray, k: int, table: int) -> np.ndarray:
    """Bucket numbers of one table: the own bucket, then one probe per hash."""
    own, second = [], []
    for i in range(k):
        r = rotate(unit, 7919 * table + i)
        a = np.abs(r)
        top = np.argpartition(-a, 1, axis=1)[:, :2] if r.shape[1] > 1 else np.zeros((len(r), 2), int)
        rows = np.arange(len(r))
        swap = a[rows, top[:, 0]] < a[rows, top[:, 1]]
        top[swap] = top[swap][:, ::-1]
        code = 2 * top + (r[rows[:, None], top] < 0)
        own.append(code[:, 0])
        second.append(code[:, 1])
    width = 2 * unit.shape[1]

    def number(parts):
        out = np.full(len(unit), table, np.int64)
        for p in parts:
            out = out * width + p
        return out

    return np.stack([number(own)] + [number([*own[:i], second[i], *own[i + 1 :]]) for i in range(k)], 1)


def _by_width(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """``(width, its rows)`` of a column of vectors."""
    length = np.asarray(pc.fill_null(pc.list_value_length(column), 0))
    for dim in np.unique(length[length > 0]).tolist():
        yield dim, np.flatnonzero(length == dim)


def _hash(n: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, rows in _by_width(batch.column(1)):
                x, good = matrix(batch.column(1).take(pa.array(rows)), dim)
                ids, wide = np.asarray(batch.column(0))[rows[good]], padded(dim)
                unit = np.zeros((len(ids), wide))
                unit[:, :dim] = x[good]
                unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                planes = np.random.default_rng(64).standard_normal((wide, 64))
                code = np.packbits(unit @ planes > 0, axis=1).view(np.int64)[:, 0] if len(ids) else np.zeros(0, np.int64)
                k, tables = plan_tables(n, dim, threshold)
                for t in range(tables):
                    b = mix(buckets(unit, k, t).view(U) ^ mix(np.array([dim], U))).view(np.int64)  # widths do not meet
                    rest = b.shape[1]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(b.T.reshape(-1)), pa.array(np.tile(ids, rest)), pa.array(np.tile(code, rest)), pa.array(np.repeat(np.arange(rest) == 0, len(ids)))], names=["bucket", "rep", "code", "own"]
                    )

    return run


def _cosine(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for dim, rows in _by_width(batch.column(2)):
                x, left = matrix(batch.column(2).take(pa.array(rows)), dim)
                y, right = matrix(batch.column(3).take(pa.array(rows)), dim)
                both = left & right
                cos = (x * y)[both].sum(1) / (np.sqrt((x * x)[both].sum(1)) * np.sqrt((y * y)[both].sum(1)))
                keep[rows[both]] = cos >= threshold
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    return run


def code_bits(threshold: float, miss: float = 1e-7) -> int:
    """Places in which the sign codes of a pair at the threshold may differ, so that no more than ``miss`` of such pairs are dropped."""
    p = math.acos(min(1.0, max(-1.0, threshold))) / math.pi
    tail, m = 1.0, -1
    while tail > miss and m < 64:
        m += 1
        tail -= math.comb(64, m) * p**m * (1 - p) ** (64 - m)
    return m


def embedding_dedup(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row per vector.

    Vectors that are null, zero, or hold a null or non-finite component link with
    nothing.  Vectors of unequal width are not compared; equal ones always link.
    Rows with equal ids are one vector, the greatest in the order of arrays, and have
    one result each; a null id keeps a null component and ``kept`` null.  Other
    columns are ignored, whatever their names; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    session_settings(spark)
    base = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    bad = "v is null or size(v) = 0 or exists(v, x -> x is null or isnan(x) or abs(x) = double('Infinity')) or not exists(v, x -> x <> 0)"
    one = base.where("id is not null")
    if not one.groupBy("id").count().where("count > 1").isEmpty():
        one = one.groupBy("id").agg(F.max("v").alias("v"))
    usable = one.where(f"not coalesce({bad}, true)")
    # -0.0 and 0.0 are one value: Spark groups doubles that way
    reps = cut(usable.groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("m")), "vectors")
    member = usable.join(reps, "v").select("id", "rep", "m")
    hashed = reps.select("rep", "v").mapInArrow(_hash(reps.count(), threshold), "bucket long, rep long, code long, own boolean")
    index, probe = hashed.where("own").select("bucket", F.col("rep").alias("b"), F.col("code").alias("cb")), hashed.select("bucket", F.col("rep").alias("a"), F.col("code").alias("ca"))
    near = probe.join(index, "bucket").where(f"a <> b and bit_count(ca ^ cb) <= {code_bits(threshold)}")
    pairs = near.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    left, right = reps.select(F.col("rep").alias("a"), F.col("v").alias("va")), reps.select(F.col("rep").alias("b"), F.col("v").alias("vb"))
    links = cut(pairs.join(left, "a").join(right, "b").select("a", "b", "va", "vb").mapInArrow(_cosine(threshold), "a long, b long"), "links")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.join(reps.select(F.col("rep").alias("b"), "m"), "b").groupBy("a").agg(F.sum("m").alias("d"))
    classes = components(links)
    found = member.join(degree, F.col("rep") == F.col("a"), "left").join(classes.withColumnRenamed("id", "cid"), F.col("rep") == F.col("cid"), "left")
    found = found.select("id", (F.col("m") - 1 + F.coalesce("d", F.lit(0))).alias("n"), F.coalesce("component_id", "rep").alias("c"))
    out = base.select(F.col("id").alias("vec_id")).join(found, F.col("vec_id") == F.col("id"), "left")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "vec_id").alias("component_id"), (F.coalesce("c", "vec_id") == F.col("vec_id")).alias("kept"))
