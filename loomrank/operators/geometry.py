"""Superposition of paired points from sufficient statistics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIT = "rmsd double, rotation array<double>, shift array<double>"


def _solve(n, sp, sq, cross, ss, origin_p, origin_q):
    """Proper rotation r and shift with r p + shift closest to q, and the RMSD."""
    mp, mq = sp / n, sq / n
    h = cross - n * np.outer(mp, mq)
    u, s, vt = np.linalg.svd(h)
    d = np.sign(np.linalg.det(u @ vt)) or 1.0
    r = vt.T @ np.diag([1, 1, d]) @ u.T
    e0 = ss - n * (mp @ mp + mq @ mq)
    rmsd = np.sqrt(max(0.0, (e0 - 2 * (s[0] + s[1] + d * s[2])) / n))
    shift = (mq + origin_q) - r @ (mp + origin_p)
    return rmsd, r.reshape(-1), shift


def fit_pairs(pairs: DataFrame, keys: list[str], p: str = "p", q: str = "q") -> DataFrame:
    """``keys, n, rmsd, rotation, shift`` of the rigid fit of points p onto q per key; no reflection.

    Only sums travel: one count, sums, cross sums and squares per key, taken
    about a provisional origin so that they do not cancel.  The 3x3 problem is
    solved on the one aggregated row of a key.  Fewer than 3 points give NULL.
    """
    first = pairs.groupBy(*keys).agg(F.min(p).alias("_op"), F.min(q).alias("_oq"))
    at = pairs.join(first, keys)
    x = [F.col(p)[i] - F.col("_op")[i] for i in range(3)]
    y = [F.col(q)[i] - F.col("_oq")[i] for i in range(3)]
    sums = [F.count(F.lit(1)).cast("double"), *map(F.sum, x), *map(F.sum, y), *[F.sum(a * b) for a in x for b in y], F.sum(sum((c * c for c in x + y), F.lit(0.0)))]
    stats = at.groupBy(*keys).agg(F.array(*sums).alias("_s"), F.first("_op").alias("_op"), F.first("_oq").alias("_oq"))

    @F.pandas_udf(FIT)
    def solve(s: pd.Series, op: pd.Series, oq: pd.Series) -> pd.DataFrame:
        out = []
        for v, a, b in zip(s, op, oq, strict=True):
            v = np.asarray(v, float)
            if v[0] < 3:
                out.append((None, None, None))
                continue
            rmsd, r, t = _solve(v[0], v[1:4], v[4:7], v[7:16].reshape(3, 3), v[16], np.asarray(a, float), np.asarray(b, float))
            out.append((float(rmsd), r.tolist(), t.tolist()))
        return pd.DataFrame(out, columns=["rmsd", "rotation", "shift"])

    return stats.select(*keys, F.col("_s")[0].cast("long").alias("n"), solve("_s", "_op", "_oq").alias("f")).select(*keys, "n", "f.*")


def moved(p: Column, rotation: Column, shift: Column) -> Column:
    return F.array(*[rotation[3 * i] * p[0] + rotation[3 * i + 1] * p[1] + rotation[3 * i + 2] * p[2] + shift[i] for i in range(3)])


def square_distance(p: Column, q: Column) -> Column:
    return sum(((p[i] - q[i]) * (p[i] - q[i]) for i in range(3)), F.lit(0.0))


def distance(p: Column, q: Column) -> Column:
    return F.sqrt(square_distance(p, q))
