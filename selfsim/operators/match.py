"""Candidate search: offsets are exploded and joined by equality, then ranked by a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from selfsim.operators.grid import spread


def ssd(a: Column, b: Column) -> Column:
    """Sum of squared differences of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0).cast("long"), lambda s, d: s + d)


def ssd_double(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, d: s + d)


def candidates(refs: DataFrame, blocks: DataFrame, lo: int, hi: int, guide: DataFrame | None = None) -> DataFrame:
    """(n, ref_id, ry, rx, my, mx, dist) over the window [-lo, hi] around each reference, itself included."""
    blocks = guide if guide is not None else blocks
    own = blocks.select(F.col("n").alias("_n"), F.col("y").alias("_y"), F.col("x").alias("_x"), F.col("p").alias("rp"))
    at = refs.join(own, (refs.n == own._n) & (refs.ry == own._y) & (refs.rx == own._x)).drop("_n", "_y", "_x")
    at = spread(spread(at, "oy", range(-lo, hi + 1)), "ox", range(-lo, hi + 1)).withColumn("my", F.col("ry") + F.col("oy")).withColumn("mx", F.col("rx") + F.col("ox"))
    other = blocks.select(F.col("n").alias("_n"), F.col("y").alias("_y"), F.col("x").alias("_x"), F.col("p").alias("cp"))
    pairs = at.join(other, (at.n == other._n) & (at.my == other._y) & (at.mx == other._x))
    whole = blocks.schema["p"].dataType.elementType.typeName() == "long"
    return pairs.select("n", "ref_id", "ry", "rx", "my", "mx", (ssd if whole else ssd_double)(F.col("rp"), F.col("cp")).alias("dist"))


def top(pairs: DataFrame, k: int, keys: tuple[str, ...] = ("n", "ref_id")) -> DataFrame:
    """The k nearest of each reference, itself first (rank 0), finite distances before others, ties by row then column: adds k."""
    own = ((F.col("my") == F.col("ry")) & (F.col("mx") == F.col("rx"))).cast("int")
    ranks = [F.col("dist")] if pairs.schema["dist"].dataType.typeName() == "long" else finite_first(F.col("dist"))
    order = Window.partitionBy(*keys).orderBy(own.desc(), *ranks, "my", "mx")
    return pairs.withColumn("k", F.row_number().over(order) - 1).where(F.col("k") < k)


def finite_first(value: Column) -> list[Column]:
    """Sort keys of a distance: finite values in order, then all others alike."""
    odd = F.isnan(value) | (F.abs(value) == float("inf"))
    return [odd.cast("int"), F.when(odd, F.lit(0.0)).otherwise(value)]
