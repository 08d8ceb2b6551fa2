"""Random-hyperplane hashing with literal planes, inside the JVM."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hyperplane_tokens(df: DataFrame, id_col: str, vec_col: str, dim: int, bits: int = 8, tables: int = 4, seed: int = 1) -> DataFrame:
    """``(id, token_0 ..)``: per table, the sign bits of ``bits`` projections as one integer."""
    rng = random.Random(seed)
    planes = [[[rng.gauss(0, 1) for _ in range(dim)] for _ in range(bits)] for _ in range(tables)]
    rows = [(t, b, planes[t][b]) for t in range(tables) for b in range(bits)]
    table = df.sparkSession.createDataFrame(rows, "t int, b int, p array<double>")
    dot = F.aggregate(F.zip_with(vec_col, "p", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    signs = df.crossJoin(F.broadcast(table)).select(id_col, "t", F.when(dot >= 0, F.expr("shiftleft(1, b)")).otherwise(0).alias("s"))
    return signs.groupBy(id_col).pivot("t", list(range(tables))).agg(F.sum("s")).toDF(id_col, *[f"token_{t}" for t in range(tables)])
