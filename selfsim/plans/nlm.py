"""Pixel-wise means over tiles, and as a relational plan (every offset an equi-join), with the SQL that gives the same rows.

Of two opposite offsets one weight map is made. A pixel reads it at its own place, and the
mirrored neighbour's weight at its place minus the offset, clamped to the plane; near the
border the two differ. Frames beyond the ends repeat.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from selfsim.filters import numeric as N
from selfsim.filters.numeric import half
from selfsim.functions import scalars as S
from selfsim.operators import framewise
from selfsim.operators.grid import clamped
from selfsim.plans.registry import query
from selfsim.plans.relational import box
from selfsim.sources.clips import CLIP_SQL, HEIGHT, SCALE, WIDTH, colour, colour_sql, events_clip, frames_of

#: Distance of samples a and b by channel mode, as SQL of both engines; s0 .. are the planes of the mode.
DISTANCE = {
    "Y": "3 * pow(a.s0 - b.s0, 2)",
    "UV": "1.5 * (pow(a.s0 - b.s0, 2) + pow(a.s1 - b.s1, 2))",
    "YUV": "pow(a.s0 - b.s0, 2) + pow(a.s1 - b.s1, 2) + pow(a.s2 - b.s2, 2)",
    "RGB": "(2 / 3e0 + (a.s0 + b.s0) / 6) * pow(a.s0 - b.s0, 2) + 4 / 3e0 * pow(a.s1 - b.s1, 2) + (1 - (a.s0 + b.s0) / 6) * pow(a.s2 - b.s2, 2)",
}


def planes_of(channels: str) -> list[str]:
    return [f"s{k}" for k in range({"Y": 1, "UV": 2}.get(channels, 3))]


def plan(px: DataFrame, channels: str, a: int, s: int, h: float, wmode: int, d: int, wref: float = 1.0) -> DataFrame:
    """px (n, y, x, s0 ..) to the same columns, filtered; J9, D4 to D8, W1 to W5, A5."""
    names = planes_of(channels)
    offsets = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(("od", "oy", "ox"), o, strict=True)]) for o in half(d, a)])
    spread = px.crossJoin(F.broadcast(frames_of(px))).select("n", "y", "x", "frames", F.explode(offsets).alias("o")).select("n", "y", "x", "frames", "o.*")
    both = spread.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("ahead"))
    there = lambda side: F.when(F.col("ahead") == side, F.col("n")).otherwise(clamped(F.col("n") + (1 - 2 * F.col("ahead")) * F.col("od"), F.col("frames")))
    here = px.select(F.col("n").alias("_f"), F.col("y").alias("_y"), F.col("x").alias("_x"), F.struct(*names).alias("a"))
    other = here.select("_f", F.col("_y").alias("_qy"), F.col("_x").alias("_qx"), F.col("a").alias("b")).withColumnRenamed("_f", "_g")
    at = both.withColumn("fa", there(0)).withColumn("fb", there(1)).withColumn("qy", clamped(F.col("y") + F.col("oy"), HEIGHT)).withColumn("qx", clamped(F.col("x") + F.col("ox"), WIDTH))
    at = at.join(here, (F.col("fa") == here._f) & (F.col("y") == here._y) & (F.col("x") == here._x)).join(other, (F.col("fb") == other._g) & (F.col("qy") == other._qy) & (F.col("qx") == other._qx))
    keys = ["n", "od", "oy", "ox", "ahead"]
    weights = box(at.select(*keys, "y", "x", F.expr(DISTANCE[channels]).alias("e")), s, keys, "e")
    weights = weights.withColumn("w", S.nlm_weight(F.col("e") * (255.0 * 255.0 / (3 * h * h * (2 * s + 1) ** 2)), wmode)).join(at.select(*keys, "y", "x", "a", "b"), [*keys, "y", "x"])
    back = weights.where("ahead = 0").select("n", "y", "x", "w", F.col("b").alias("q"))
    mirror = spread.withColumn("my", clamped(F.col("y") - F.col("oy"), HEIGHT)).withColumn("mx", clamped(F.col("x") - F.col("ox"), WIDTH))
    ahead = weights.where("ahead = 1").select("n", "od", "oy", "ox", F.col("y").alias("my"), F.col("x").alias("mx"), "w", F.col("a").alias("q"))
    every = back.unionByName(mirror.join(ahead, ["n", "od", "oy", "ox", "my", "mx"]).select("n", "y", "x", "w", "q"))
    sums = every.groupBy("n", "y", "x").agg(F.sum("w").alias("den"), F.max("w").alias("most"), *[F.sum(F.col("w") * F.col(f"q.{c}")).alias(f"_{c}") for c in names])
    m = wref * F.greatest(F.col("most"), F.lit(S.EPSILON))
    return sums.join(px, ["n", "y", "x"]).select("n", "y", "x", *[F.round((m * F.col(c) + F.col(f"_{c}")) / (m + F.col("den")), 6).alias(c) for c in names])


def sql(source: str, channels: str, a: int, s: int, h: float, wmode: int, d: int) -> str:
    """The same in SQL; source gives z(n, y, x, s0 ..)."""
    names, bound = planes_of(channels), lambda v, n: f"greatest(0, least({n} - 1, {v}))"
    w = "exp(-u)" if wmode == 0 else f"pow(greatest(1 - u, 0), {(1, 2, 8)[wmode - 1]})"
    return source + f""", o(od, oy, ox) AS (VALUES {", ".join(str(o) for o in half(d, a))}),
k AS (SELECT p.n, o.*, f.ahead, p.y, p.x, CASE f.ahead WHEN 0 THEN p.n ELSE {bound("p.n - od", "(SELECT max(n) + 1 FROM z)")} END AS fa, CASE f.ahead WHEN 1 THEN p.n ELSE {bound("p.n + od", "(SELECT max(n) + 1 FROM z)")} END AS fb FROM z p, o, (VALUES (0), (1)) f(ahead)),
e AS (SELECT k.*, {DISTANCE[channels]} AS e, {", ".join(f"a.{c} AS a{c}, b.{c} AS b{c}" for c in names)} FROM k JOIN z a ON a.n = fa AND a.y = k.y AND a.x = k.x JOIN z b ON b.n = fb AND b.y = {bound("k.y + oy", HEIGHT)} AND b.x = {bound("k.x + ox", WIDTH)}),
t AS (SELECT e.n, e.od, e.oy, e.ox, e.ahead, e.y, e.x, {bound("e.y + i.range", HEIGHT)} AS ty, {bound("e.x + j.range", WIDTH)} AS tx FROM e, range({-s}, {s + 1}) i, range({-s}, {s + 1}) j),
b AS (SELECT t.n, t.od, t.oy, t.ox, t.ahead, t.y, t.x, sum(r.e) * {255.0 * 255.0 / (3 * h * h * (2 * s + 1) ** 2)!r} AS u FROM t JOIN e r ON r.n = t.n AND r.od = t.od AND r.oy = t.oy AND r.ox = t.ox AND r.ahead = t.ahead AND r.y = t.ty AND r.x = t.tx GROUP BY ALL),
w AS (SELECT e.*, {w} AS w FROM e JOIN b USING (n, od, oy, ox, ahead, y, x)),
v AS (SELECT n, y, x, w, {", ".join(f"b{c} AS {c}" for c in names)} FROM w WHERE ahead = 0 UNION ALL
 SELECT p.n, p.y, p.x, w.w, {", ".join("w.a" + c for c in names)} FROM z p JOIN w ON w.ahead = 1 AND w.n = p.n AND w.y = {bound("p.y - w.oy", HEIGHT)} AND w.x = {bound("p.x - w.ox", WIDTH)}),
m AS (SELECT n, y, x, sum(w) AS den, greatest(max(w), {S.EPSILON!r}) AS m, {", ".join(f"sum(w * {c}) AS _{c}" for c in names)} FROM v GROUP BY ALL)
SELECT n, y, x, {", ".join(f"round((m * {c} + _{c}) / (m + den), 6) AS {c}" for c in names)} FROM m JOIN z USING (n, y, x)"""


GREY_SQL = CLIP_SQL + ", z AS (SELECT n, y, x, c / 65536.0 AS s0 FROM px)"


def grey(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_clip(spark, sf_dir).select("n", "y", "x", (F.col("c") / SCALE).alias("s0"))


def tiled(px: DataFrame, channels: str, a: int, s: int, h: float, wmode: int, d: int) -> DataFrame:
    """The columns of ``plan`` from shifted arrays over tiles: a pixel is shuffled as one sample, not once for each offset."""
    names = planes_of(channels)
    work = partial(N.nlm, d=d, a=a, s=s, h=h, channels=channels, wmode=wmode)
    samples = px.select("n", "y", "x", F.posexplode(F.array(*names)).alias("channel", "v"))
    out = framewise.apply(samples, work, d, tiling=framewise.Tiling(N.reach("nlm", **work.keywords)))
    each = [F.round(F.max(F.when(F.col("channel") == k, F.col("v"))), 6).alias(c) for k, c in enumerate(names)]
    return out.groupBy(F.col("n").cast("int").alias("n"), "y", "x").agg(*each)


def _mirrored(name: str, channels: str, a: int, s: int, h: float, wmode: int, d: int) -> None:
    count = len(planes_of(channels))
    grey_clip = channels == "Y"

    @query(name, sql(GREY_SQL if grey_clip else colour_sql(count, 1048576.0), channels, a, s, h, wmode, d))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return tiled(grey(spark, sf_dir) if grey_clip else colour(events_clip(spark, sf_dir), count, 1048576.0), channels, a, s, h, wmode, d)


for _args in (("nlm_mirrored", "Y", 2, 1, 60.0, 0, 0), ("nlm_mirrored_temporal", "Y", 1, 1, 60.0, 0, 1), ("nlm_uv", "UV", 2, 1, 8.0, 0, 0), ("nlm_yuv", "YUV", 2, 1, 8.0, 2, 0), ("nlm_rgb", "RGB", 2, 1, 8.0, 0, 0)):
    _mirrored(*_args)
