"""The predictive temporal search as unrolled joins, with its SQL.

The reference's own frame is searched in full; outwards, frame by frame, only around the
winners of the frame before. Distances are always to the reference.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from selfsim.operators.grid import spread
from selfsim.operators.lineage import cut
from selfsim.operators.match import candidates, ssd
from selfsim.plans.registry import query
from selfsim.plans.relational import B, GROUP, RANGE, REFS_SQL, clip_and_refs
from selfsim.sources.clips import CLIP_SQL, HEIGHT, WIDTH

RADIUS, PS_NUM, PS_RANGE = 2, 2, 2


def nearest(pairs: DataFrame, k: int, keys: tuple[str, ...]) -> DataFrame:
    """The k nearest by (dist, t, y, x)."""
    order = Window.partitionBy(*keys).orderBy("dist", "t", "my", "mx")
    return pairs.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= k).drop("_k")


def predictive(refs: DataFrame, blocks: DataFrame, lo: int, hi: int, k: int, radius: int, ps_num: int, ps_range: int) -> DataFrame:
    """(n, ref_id, k, t, my, mx, dist): the reference itself (k = 0), then the nearest of all frames.

    2 radius rounds of a seed explosion and an equi-join; a round reads at most ps_num
    windows for each reference. With more than two frames each way the rounds are checkpointed, as each
    would compute the ones before it again. Seeds of a direction start with the reference itself.
    """
    own = blocks.select(F.col("n").alias("_n"), F.col("y").alias("_y"), F.col("x").alias("_x"), F.col("p").alias("rp"))
    at = lambda t: blocks.select(F.col("n").alias(t), F.col("y").alias("my"), F.col("x").alias("mx"), F.col("p").alias("cp"))
    columns = ["n", "ref_id", "t", "my", "mx", "dist"]
    here = candidates(refs, blocks, lo, hi).withColumn("t", F.col("n").cast("int"))
    itself = (F.col("my") == F.col("ry")) & (F.col("mx") == F.col("rx"))
    spatial = here.where(~itself).select(*columns)
    seeds = nearest(here.withColumn("dist", F.when(itself, F.lit(-1)).otherwise(F.col("dist"))), ps_num, ("n", "ref_id")).select(*columns)
    with_patch = refs.join(own, (refs.n == own._n) & (refs.ry == own._y) & (refs.rx == own._x)).select("n", "ref_id", "rp")
    found = [spatial]
    for direction in (-1, 1):
        last = seeds
        for _ in range(radius):
            moved = last.select("n", "ref_id", (F.col("t") + direction).alias("t"), F.col("my").alias("sy"), F.col("mx").alias("sx"))
            spots = spread(spread(moved, "oy", range(-ps_range, ps_range + 1)), "ox", range(-ps_range, ps_range + 1))
            spots = spots.select("n", "ref_id", "t", (F.col("sy") + F.col("oy")).alias("my"), (F.col("sx") + F.col("ox")).alias("mx")).distinct()
            local = spots.join(at("t"), ["t", "my", "mx"]).join(with_patch, ["n", "ref_id"]).select("n", "ref_id", "t", "my", "mx", ssd(F.col("rp"), F.col("cp")).alias("dist"))
            local = cut(local) if radius > 2 else local
            found.append(local)
            last = nearest(local, ps_num, ("n", "ref_id"))
    first = refs.select("n", "ref_id", F.lit(0).alias("k"), F.col("n").cast("int").alias("t"), F.col("ry").alias("my"), F.col("rx").alias("mx"), F.lit(0).cast("long").alias("dist"))
    rank = Window.partitionBy("n", "ref_id").orderBy("dist", "t", "my", "mx")
    rest = nearest(reduce(DataFrame.unionByName, found), k - 1, ("n", "ref_id")).select("n", "ref_id", F.row_number().over(rank).alias("k"), "t", "my", "mx", "dist")
    return first.unionByName(rest)


def _sql() -> str:
    dist = f"(SELECT list_sum(list_transform(range(1, {B * B + 1}), lambda i: (a.p[i] - b.p[i]) * (a.p[i] - b.p[i])))::BIGINT FROM bk a, bk b WHERE a.n = g.n AND a.y = g.ry AND a.x = g.rx AND b.n = g.t AND b.y = g.my AND b.x = g.mx)"
    spots = lambda lo, hi: f"range(0, {HEIGHT - B + 1}) my, range(0, {WIDTH - B + 1}) mx WHERE my.range BETWEEN s.my - {lo} AND s.my + {hi} AND mx.range BETWEEN s.mx - {lo} AND s.mx + {hi}"
    parts = [CLIP_SQL + REFS_SQL, f"bk AS (SELECT n, y - i.range // {B} AS y, x - i.range % {B} AS x, list(c ORDER BY i.range) AS p FROM px, range({B * B}) i GROUP BY ALL)", f"g0 AS (SELECT s.n, ref_id, ry, rx, n AS t, my.range AS my, mx.range AS mx FROM (SELECT *, ry AS my, rx AS mx FROM refs) s, {spots(RANGE, RANGE)})", f"d0 AS (SELECT *, {dist} AS dist FROM g0 g)", f"seed AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY n, ref_id ORDER BY CASE WHEN my = ry AND mx = rx THEN 0 ELSE 1 END, dist, my, mx) AS r FROM d0) WHERE r <= {PS_NUM})"]
    union = ["SELECT n, ref_id, t, my, mx, dist FROM d0 WHERE my <> ry OR mx <> rx"]
    for step, name in ((-1, "p"), (1, "f")):
        last = "seed"
        for i in range(1, RADIUS + 1):
            parts.append(f"g{name}{i} AS (SELECT DISTINCT s.n, ref_id, ry, rx, t + {step} AS t, my.range AS my, mx.range AS mx FROM {last} s, {spots(PS_RANGE, PS_RANGE)} AND t + {step} BETWEEN 0 AND (SELECT max(n) FROM px))")
            parts.append(f"d{name}{i} AS (SELECT *, {dist} AS dist FROM g{name}{i} g)")
            parts.append(f"s{name}{i} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY n, ref_id ORDER BY dist, my, mx) AS r FROM d{name}{i}) WHERE r <= {PS_NUM})")
            union.append(f"SELECT n, ref_id, t, my, mx, dist FROM d{name}{i}")
            last = f"s{name}{i}"
    parts.append("al AS (" + " UNION ALL ".join(union) + ")")
    return ", ".join(parts) + f" SELECT n, ref_id, 0 AS k, n AS t, ry AS my, rx AS mx, CAST(0 AS BIGINT) AS dist FROM refs UNION ALL SELECT n, ref_id, CAST(k AS INT), CAST(t AS INT), CAST(my AS INT), CAST(mx AS INT), dist FROM (SELECT *, row_number() OVER (PARTITION BY n, ref_id ORDER BY dist, t, my, mx) AS k FROM al) WHERE k < {GROUP}"


@query("predictive_match", _sql())
def predictive_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J3, K1 to K3."""
    _, refs, blocks = clip_and_refs(spark, sf_dir)
    return predictive(refs, blocks, RANGE, RANGE, GROUP, RADIUS, PS_NUM, PS_RANGE)
