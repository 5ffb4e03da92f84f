"""Linear transforms as joins with a basis table (bounded: n^2 rows), summed per coefficient."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dct(n: int) -> list[list[float]]:
    """Orthonormal DCT-II."""
    return [[math.sqrt((1 if k == 0 else 2) / n) * math.cos(math.pi * (2 * i + 1) * k / (2 * n)) for i in range(n)] for k in range(n)]


def haar(n: int) -> list[list[float]]:
    """Orthonormal Haar, coarse coefficients first, the finest level's details last."""
    if n == 1:
        return [[1.0]]
    half, r = haar(n // 2), math.sqrt(0.5)
    return [[v * r for v in row for _ in (0, 1)] for row in half] + [[(r if i == 2 * k else -r) if i // 2 == k else 0.0 for i in range(n)] for k in range(n // 2)]


def interleaved(n: int) -> list[list[float]]:
    """The same basis in in-place order: level h has its details at the odd multiples of h."""
    rows, out, h = haar(n), [[]] * n, n // 2
    out[0] = rows[0]
    level = 1
    while level < n:
        for k in range(level):
            out[(2 * k + 1) * h] = rows[level + k]
        level, h = 2 * level, h // 2
    return out


def apply(df: DataFrame, basis: list[list[float]], keys: list[str], index: str, value: str = "v") -> DataFrame:
    """Coefficients over index: keys, index, value. Zero entries of the basis make no rows."""
    rows = [(k, i, float(b)) for k, row in enumerate(basis) for i, b in enumerate(row) if b]
    table = df.sparkSession.createDataFrame(rows, "_k int, _i int, _b double")
    return df.join(F.broadcast(table), F.col(index) == F.col("_i")).groupBy(*keys, F.col("_k").alias(index)).agg(F.sum(F.col("_b") * F.col(value)).alias(value))


def apply_2d(df: DataFrame, basis: list[list[float]], keys: list[str], n: int, value: str = "v") -> DataFrame:
    """Separable transform of blocks in raster order i = n y + x, as two one-dimensional joins."""
    d = df.withColumn("_y", F.expr(f"CAST(i div {n} AS INT)")).withColumn("_x", (F.col("i") % n).cast("int"))
    d = apply(d, basis, [*keys, "_y"], "_x", value)
    d = apply(d, basis, [*keys, "_x"], "_y", value)
    return d.select(*keys, (F.col("_y") * n + F.col("_x")).alias("i"), value)


def basis_sql(name: str, basis: list[list[float]]) -> str:
    return f"{name}(k, i, b) AS (VALUES " + ", ".join(f"({k}, {i}, CAST({b!r} AS DOUBLE))" for k, row in enumerate(basis) for i, b in enumerate(row)) + ")"
