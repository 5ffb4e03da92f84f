"""Reference grids, patches and windows as explode + equi-join plans (never a band condition)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def positions(length: int, block: int, step: int) -> list[int]:
    """0, step, 2 step, ..., and always the last position that fits."""
    last = length - block
    return [*range(0, last, step), last] if last >= 0 else []


def spread(df: DataFrame, name: str, values: list[int] | range) -> DataFrame:
    return df.select("*", F.explode(F.array(*[F.lit(int(v)) for v in values])).alias(name))


def references(frames: DataFrame, h: int, w: int, block: int, step: int) -> DataFrame:
    """(n, ref_id, ry, rx) of each frame n, ref_id in raster order."""
    ys, xs = positions(h, block, step), positions(w, block, step)
    at = [F.struct(F.lit(i * len(xs) + j).alias("ref_id"), F.lit(y).alias("ry"), F.lit(x).alias("rx")) for i, y in enumerate(ys) for j, x in enumerate(xs)]
    return frames.select("n", F.explode(F.array(*at)).alias("r")).select("n", "r.*")


def clamped(value: Column, length: int | Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(length) - 1, value))


def patches(refs: DataFrame, pixels: DataFrame, h: int, w: int, block: int, y: str = "ry", x: str = "rx") -> DataFrame:
    """Each reference with (i, c) of its block, the border replicated; i = block py + px."""
    out = spread(refs, "i", range(block * block))
    out = out.withColumn("_y", clamped(F.col(y) + F.expr(f"i div {block}").cast("int"), h)).withColumn("_x", clamped(F.col(x) + F.col("i") % block, w))
    p = pixels.select(F.col("n").alias("_n"), F.col("y").alias("_py"), F.col("x").alias("_px"), "c")
    return out.join(p, (out.n == p._n) & (out._y == p._py) & (out._x == p._px)).drop("_n", "_py", "_px", "_y", "_x")


def blocks(pixels: DataFrame, h: int, w: int, block: int) -> DataFrame:
    """(n, y, x, p): the block of every position as an array, so that a distance reads two rows only."""
    out = spread(spread(pixels, "py", range(block)), "px", range(block))
    out = out.select("n", (F.col("y") - F.col("py")).alias("y"), (F.col("x") - F.col("px")).alias("x"), F.struct((F.col("py") * block + F.col("px")).alias("i"), "c").alias("s"))
    out = out.where((F.col("y") >= 0) & (F.col("x") >= 0) & (F.col("y") <= h - block) & (F.col("x") <= w - block))
    return out.groupBy("n", "y", "x").agg(F.transform(F.sort_array(F.collect_list("s")), lambda s: s["c"]).alias("p"))
