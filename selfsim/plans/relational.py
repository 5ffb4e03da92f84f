"""The relational core as queries over the events clip and the embedding patches, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from selfsim.functions import scalars as S
from selfsim.operators import grid, match, transforms
from selfsim.plans.registry import query
from selfsim.sources.clips import CLIP_SQL, HEIGHT, LINEITEM_SQL, PATCH_SQL, SCALE, WIDTH, colour, colour_sql, embedding_patches, events_clip, frames_of, lineitem_clip

B, STEP, RANGE, GROUP = 4, 6, 5, 8
#: Centroids that a vector is compared with at once.
CENTROIDS = 1024
REFS_SQL = f", ps AS (SELECT 'y' AS ax, least(range, {HEIGHT - B}) AS p FROM range(0, {HEIGHT - B + STEP}, {STEP}) UNION SELECT 'x', least(range, {WIDTH - B}) FROM range(0, {WIDTH - B + STEP}, {STEP})), " \
    "refs AS (SELECT n, CAST(dense_rank() OVER (PARTITION BY n ORDER BY a.p, b.p) - 1 AS INT) AS ref_id, CAST(a.p AS INT) AS ry, CAST(b.p AS INT) AS rx FROM (SELECT DISTINCT n FROM px), ps a, ps b WHERE a.ax = 'y' AND b.ax = 'x')"


def _match_sql(lo: int, hi: int, k: int, guide: str = "px", channels: bool = False) -> str:
    return f""", g AS (SELECT * FROM {guide}), pr AS (SELECT refs.n, ref_id, ry, rx, c.y AS my, c.x AS mx FROM refs JOIN (SELECT DISTINCT n, y, x FROM px WHERE y <= {HEIGHT - B} AND x <= {WIDTH - B}) c ON c.n = refs.n AND c.y BETWEEN ry - {lo} AND ry + {hi} AND c.x BETWEEN rx - {lo} AND rx + {hi}),
bl AS (SELECT n, CAST(y - i.range // {B} AS INT) AS y, CAST(x - i.range % {B} AS INT) AS x, i.range AS i, c FROM g, range({B * B}) i),
ra AS (SELECT {'pr.n, a.n AS m' if channels else 'pr.n, pr.n AS m'}, ref_id, ry, rx, my, mx, i, c FROM pr JOIN bl a ON {'' if channels else 'a.n = pr.n AND '}a.y = ry AND a.x = rx),
ds AS (SELECT ra.n, ref_id, ry, rx, my, mx, CAST(sum((ra.c - b.c) * (ra.c - b.c)) AS BIGINT) AS dist FROM ra JOIN bl b ON b.n = m AND b.y = my AND b.x = mx AND b.i = ra.i GROUP BY 1, 2, 3, 4, 5, 6),
mt AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY n, ref_id ORDER BY CASE WHEN my = ry AND mx = rx THEN 0 ELSE 1 END, dist, my, mx) - 1 AS INT) AS k FROM ds) WHERE k < {k})"""


def clip_and_refs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    px = events_clip(spark, sf_dir)
    refs = grid.references(px.select("n").distinct(), HEIGHT, WIDTH, B, STEP)
    return px, refs, grid.blocks(px, HEIGHT, WIDTH, B)


@query("clip_scan", CLIP_SQL + " SELECT * FROM px")
def clip_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1."""
    return events_clip(spark, sf_dir)


@query("lineitem_scan", LINEITEM_SQL + " SELECT * FROM px")
def lineitem_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1 on a clip whose planes are of another size."""
    return lineitem_clip(spark, sf_dir)


@query("temporal_clamped", CLIP_SQL + ", w AS (SELECT a.n, a.y, a.x, b.c FROM px a, range(-2, 3) d, px b WHERE b.n = greatest(0, least((SELECT max(n) FROM px), a.n + d.range)) AND b.y = a.y AND b.x = a.x) SELECT n, y, x, CAST(sum(c) AS BIGINT) AS total FROM w GROUP BY 1, 2, 3")
def temporal_clamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames beyond the ends repeat."""
    px = events_clip(spark, sf_dir)
    slots = grid.spread(px.select("n").distinct(), "d", range(-2, 3)).crossJoin(F.broadcast(frames_of(px))).select("n", grid.clamped(F.col("n") + F.col("d"), F.col("frames")).alias("t"))
    return slots.join(px.withColumnRenamed("n", "t"), "t").groupBy("n", "y", "x").agg(F.sum("c").alias("total"))


@query("temporal_distinct", CLIP_SQL + " SELECT a.n, a.y, a.x, CAST(sum(b.c) AS BIGINT) AS total, count(*) AS frames FROM px a JOIN px b ON b.n BETWEEN a.n - 2 AND a.n + 2 AND b.y = a.y AND b.x = a.x GROUP BY 1, 2, 3")
def temporal_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames beyond the ends are missing."""
    px = events_clip(spark, sf_dir)
    slots = grid.spread(px.select("n").distinct(), "d", range(-2, 3)).select("n", (F.col("n") + F.col("d")).alias("t"))
    return slots.join(px.withColumnRenamed("n", "t"), "t").groupBy("n", "y", "x").agg(F.sum("c").alias("total"), F.count("*").alias("frames"))


@query("raster_refs", CLIP_SQL + REFS_SQL + " SELECT * FROM refs")
def raster_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last position is clamped, never skipped."""
    return clip_and_refs(spark, sf_dir)[1]


@query("patch_extract", CLIP_SQL + REFS_SQL + f", o AS (SELECT n, ref_id, CAST(range AS INT) AS i, least({HEIGHT - 1}, greatest(0, ry + 3 + range // {B})) AS y, least({WIDTH - 1}, greatest(0, rx + 3 + range % {B})) AS x FROM refs, range({B * B})) SELECT o.n, ref_id, i, c FROM o JOIN px ON px.n = o.n AND px.y = o.y AND px.x = o.x")
def patch_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks three pixels off their references, the border replicated."""
    px, refs, _ = clip_and_refs(spark, sf_dir)
    return grid.patches(refs.withColumn("ry", F.col("ry") + 3).withColumn("rx", F.col("rx") + 3), px, HEIGHT, WIDTH, B).select("n", "ref_id", "i", "c")


@query("spatial_topk", CLIP_SQL + REFS_SQL + _match_sql(RANGE, RANGE, GROUP) + " SELECT * FROM mt")
def spatial_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1, D1, K1 to K3."""
    _, refs, blocks = clip_and_refs(spark, sf_dir)
    return match.top(match.candidates(refs, blocks, RANGE, RANGE), GROUP).select("n", "ref_id", "ry", "rx", "my", "mx", "dist", "k")


_ODD_SQL = CLIP_SQL + REFS_SQL + f""", od AS (SELECT n, y, x, CASE WHEN (y * {WIDTH} + x + n) % 37 = 0 THEN CAST('NaN' AS DOUBLE) WHEN (y * {WIDTH} + x + n) % 53 = 0 THEN CAST('Infinity' AS DOUBLE) ELSE CAST(c AS DOUBLE) END AS c FROM px)""" + _match_sql(RANGE, RANGE, 40, "od").replace("CAST(sum((ra.c - b.c) * (ra.c - b.c)) AS BIGINT) AS dist", "sum((ra.c - b.c) * (ra.c - b.c)) AS dist").replace("dist, my, mx) - 1 AS INT) AS k FROM ds", "CASE WHEN isfinite(dist) THEN 0 ELSE 1 END, CASE WHEN isfinite(dist) THEN dist ELSE 0 END, my, mx) - 1 AS INT) AS k FROM ds")


@query("nonfinite_topk", _ODD_SQL + " SELECT n, ref_id, ry, rx, my, mx, CASE WHEN isfinite(dist) THEN dist END AS dist, k FROM mt")
def nonfinite_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1, K3 on a clip with samples that aren't finite: finite distances by size, then all others by their place."""
    px, refs, _ = clip_and_refs(spark, sf_dir)
    at = F.col("y") * WIDTH + F.col("x") + F.col("n")
    odd = px.withColumn("c", F.when(at % 37 == 0, float("nan")).when(at % 53 == 0, float("inf")).otherwise(F.col("c").cast("double")))
    found = match.top(match.candidates(refs, grid.blocks(odd, HEIGHT, WIDTH, B), RANGE, RANGE), 40)
    bad = F.isnan("dist") | (F.abs("dist") == float("inf"))
    return found.select("n", "ref_id", "ry", "rx", "my", "mx", F.when(~bad, F.col("dist")).alias("dist"), "k")


@query("asym_window_topk", CLIP_SQL + REFS_SQL + _match_sql(3, 2, GROUP) + " SELECT * FROM mt")
def asym_window_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window of 6 has three positions before and two after."""
    _, refs, blocks = clip_and_refs(spark, sf_dir)
    return match.top(match.candidates(refs, blocks, 3, 2), GROUP).select("n", "ref_id", "ry", "rx", "my", "mx", "dist", "k")


@query("guided_match", CLIP_SQL + ", gd AS (SELECT CAST((n + 1) % (SELECT max(n) + 1 FROM px) AS INT) AS n, y, x, c FROM px)" + REFS_SQL + _match_sql(RANGE, RANGE, GROUP, "gd") + ", v AS (SELECT mt.n, ref_id, k, dist, sum(c) AS s FROM mt, range(4) a, range(4) b, px WHERE px.n = mt.n AND px.y = my + a.range AND px.x = mx + b.range GROUP BY 1, 2, 3, 4) SELECT n, ref_id, k, dist, CAST(s AS BIGINT) AS total FROM v")
def guided_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances from a guide, values from the source."""
    px, refs, blocks = clip_and_refs(spark, sf_dir)
    guide = grid.blocks(px.crossJoin(F.broadcast(frames_of(px))).withColumn("n", (F.col("n") + 1) % F.col("frames")), HEIGHT, WIDTH, B)
    found = match.top(match.candidates(refs, blocks, RANGE, RANGE, guide), GROUP)
    own = blocks.select(F.col("n"), F.col("y").alias("my"), F.col("x").alias("mx"), F.aggregate("p", F.lit(0).cast("long"), lambda a, c: a + c).alias("total"))
    return found.join(own, ["n", "my", "mx"]).select("n", "ref_id", "k", "dist", "total")


@query("multichannel_match", CLIP_SQL + REFS_SQL + ", one AS (SELECT * FROM refs WHERE n = 0)" + _match_sql(RANGE, RANGE, GROUP, channels=True).replace("FROM refs JOIN", "FROM one refs JOIN") + " SELECT * FROM mt")
def multichannel_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All frames as channels of one; the distance sums over them."""
    _, refs, blocks = clip_and_refs(spark, sf_dir)
    pairs = match.candidates(refs, blocks, RANGE, RANGE).groupBy("ref_id", "ry", "rx", "my", "mx").agg(F.sum("dist").alias("dist"))
    return match.top(pairs, GROUP, ("ref_id",)).select(F.lit(0).alias("n"), "ref_id", "ry", "rx", "my", "mx", "dist", "k")


def _groups(spark: SparkSession, sf_dir: str, size: int) -> DataFrame:
    """(label, k, vec_id, i, v): of each label the patches nearest its first one; distances in whole 2^-20 units."""
    pt = embedding_patches(spark, sf_dir)
    vec = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    first = vec.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("r"))
    d = F.aggregate(F.zip_with("embedding", "r", lambda a, b: F.pow(F.round((a.cast("double") - b.cast("double")) * 1024), F.lit(2)).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    near = vec.join(first, "label").select("label", "vec_id", d.alias("dist")).withColumn("k", F.row_number().over(Window.partitionBy("label").orderBy("dist", "vec_id")) - 1).where(F.col("k") < size)
    return near.join(pt, ["label", "vec_id"]).select("label", "k", "vec_id", "i", "v")


GROUPS_SQL = PATCH_SQL + """, f AS (SELECT label, min(vec_id) AS r FROM embeddings GROUP BY 1),
nd AS (SELECT a.label, a.vec_id, CAST(sum(CAST(round((a.v - b.v) * 1024) AS BIGINT) ** 2) AS BIGINT) AS dist FROM pt a JOIN f USING (label) JOIN pt b ON b.vec_id = r AND b.i = a.i GROUP BY 1, 2),
gr AS (SELECT label, k, vec_id, i, v FROM (SELECT *, CAST(row_number() OVER (PARTITION BY label ORDER BY dist, vec_id) - 1 AS INT) AS k FROM nd) JOIN pt USING (label, vec_id) WHERE k < 8)"""


@query("group_gather", GROUPS_SQL + " SELECT label, k, vec_id, i, round(v, 6) AS v FROM gr")
def group_gather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2, S8 on stored patches."""
    return _groups(spark, sf_dir, 8).withColumn("v", F.round("v", 6))


@query("group_center", GROUPS_SQL + " SELECT label, k, i, round(v - avg(v) OVER (PARTITION BY label, i), 6) AS v FROM gr")
def group_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T6."""
    return _groups(spark, sf_dir, 8).select("label", "k", "i", F.round(F.col("v") - F.avg("v").over(Window.partitionBy("label", "i")), 6).alias("v"))


@query("patch_center", PATCH_SQL + " SELECT vec_id, i, round(v - avg(v) OVER (PARTITION BY vec_id), 6) AS v FROM pt")
def patch_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T7."""
    return embedding_patches(spark, sf_dir).select("vec_id", "i", F.round(F.col("v") - F.avg("v").over(Window.partitionBy("vec_id")), 6).alias("v"))


_D2 = "h AS (SELECT {k}, s.i // 8 AS y, b.k AS u, sum(b.b * s.v) AS v FROM {src} s JOIN {t} b ON b.i = s.i % 8 GROUP BY ALL), c2 AS (SELECT {k}, CAST(b.k * 8 + u AS INT) AS i, sum(b.b * h.v) AS v FROM h JOIN {t} b ON b.i = y GROUP BY ALL)"


@query("dct2", PATCH_SQL + ", " + transforms.basis_sql("d8", transforms.dct(8)) + ", " + _D2.format(k="vec_id", src="pt", t="d8") + " SELECT vec_id, i, round(v, 6) + 0.0 AS v FROM c2")
def dct2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1."""
    return transforms.apply_2d(embedding_patches(spark, sf_dir), transforms.dct(8), ["vec_id"], 8).select("vec_id", "i", (F.round("v", 6) + 0.0).alias("v"))


@query("haar2d_mallat", PATCH_SQL + ", " + transforms.basis_sql("d8", transforms.haar(8)) + ", " + _D2.format(k="vec_id", src="pt", t="d8") + " SELECT vec_id, i, round(v, 6) + 0.0 AS v FROM c2")
def haar2d_mallat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T3."""
    return transforms.apply_2d(embedding_patches(spark, sf_dir), transforms.haar(8), ["vec_id"], 8).select("vec_id", "i", (F.round("v", 6) + 0.0).alias("v"))


_G8 = GROUPS_SQL + ", " + transforms.basis_sql("d8", transforms.dct(8)) + ", " + transforms.basis_sql("h8", transforms.interleaved(8)) + ", " + _D2.format(k="label, s.k", src="gr", t="d8").replace("SELECT label, s.k, CAST", "SELECT label, h.k, CAST") + ", c3 AS (SELECT label, CAST(b.k AS INT) AS k, c2.i, sum(b.b * c2.v) AS v FROM c2 JOIN h8 b ON b.i = c2.k GROUP BY ALL)"


def _coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = transforms.apply_2d(_groups(spark, sf_dir, 8), transforms.dct(8), ["label", "k"], 8)
    return transforms.apply(g, transforms.interleaved(8), ["label", "i"], "k")


@query("haar_group", _G8 + " SELECT label, k, i, round(v, 6) + 0.0 AS v FROM c3")
def haar_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T2 along the group, after T1."""
    return _coefficients(spark, sf_dir).select("label", "k", "i", (F.round("v", 6) + 0.0).alias("v"))


THRESHOLD = 0.27183


@query("bm3d_hard_group", _G8 + f", z AS (SELECT *, CASE WHEN (k = 0 AND i = 0) OR abs(round(v, 9)) >= {THRESHOLD} THEN 1 ELSE 0 END AS keep FROM c3) SELECT label, CAST(sum(keep) AS BIGINT) AS kept, round(1.0 / greatest(sum(keep), 1), 9) AS weight, round(sum(CASE WHEN keep = 1 THEN v * v ELSE 0 END), 5) AS energy FROM z GROUP BY label")
def bm3d_hard_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholded coefficients of each group; the first is always kept and counted."""
    keep = ((F.col("k") == 0) & (F.col("i") == 0)) | (F.abs(F.round("v", 9)) >= THRESHOLD)
    z = _coefficients(spark, sf_dir).withColumn("keep", keep.cast("int"))
    return z.groupBy("label").agg(F.sum("keep").alias("kept"), F.round(1.0 / F.greatest(F.sum("keep"), F.lit(1)), 9).alias("weight"), F.round(F.sum(F.when(F.col("keep") == 1, F.col("v") * F.col("v")).otherwise(0.0)), 5).alias("energy"))


@query("bm3d_wiener_group", _G8 + ", z AS (SELECT label, CASE WHEN k = 0 AND i = 0 THEN 1.0 ELSE v * v / (v * v + 0.01) END AS w FROM c3) SELECT label, round(1.0 / greatest(sum(w * w), 1e-12), 9) AS weight FROM z GROUP BY label")
def bm3d_wiener_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G2, W11, W17."""
    w = F.when((F.col("k") == 0) & (F.col("i") == 0), 1.0).otherwise(S.wiener(F.col("v"), 0.1))
    return _coefficients(spark, sf_dir).withColumn("w", w).groupBy("label").agg(F.round(1.0 / F.greatest(F.sum(F.col("w") * F.col("w")), F.lit(1e-12)), 9).alias("weight"))


@query("pixel_match_rows", GROUPS_SQL + ", d AS (SELECT a.label, a.i, b.i AS j, CAST(sum(CAST(round((a.v - b.v) * 1024) AS BIGINT) ** 2) AS BIGINT) AS dist FROM gr a JOIN gr b ON a.label = b.label AND a.k = b.k GROUP BY 1, 2, 3) SELECT label, CAST(i AS INT) AS i, CAST(j AS INT) AS j, dist, q FROM (SELECT *, CAST(row_number() OVER (PARTITION BY label, i ORDER BY CASE WHEN i = j THEN 0 ELSE 1 END, dist, j) - 1 AS INT) AS q FROM d) WHERE q < 4")
def pixel_match_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four nearest rows of each row of a group, itself first. A row is an array, so a pair is one row."""
    g = _groups(spark, sf_dir, 8).groupBy("label", "i").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda s: s["v"]).alias("r"))
    o = g.select("label", F.col("i").alias("j"), F.col("r").alias("s"))
    d = F.aggregate(F.zip_with("r", "s", lambda a, b: F.pow(F.round((a - b) * 1024), F.lit(2)).cast("long")), F.lit(0).cast("long"), lambda t, x: t + x)
    q = F.row_number().over(Window.partitionBy("label", "i").orderBy((F.col("i") == F.col("j")).cast("int").desc(), "dist", "j")) - 1
    return g.join(o, "label").select("label", "i", "j", d.alias("dist")).withColumn("q", q).where("q < 4")


@query("nearest_centroid", GROUPS_SQL + ", d AS (SELECT a.vec_id, b.label AS c, sum(CAST(round((a.v - b.v) * 1024) AS BIGINT) ** 2) AS dist FROM pt a JOIN gr b ON b.k = 0 AND a.i = b.i GROUP BY 1, 2) SELECT vec_id, arg_min(c, (dist, c)) AS centroid, CAST(min(dist) AS BIGINT) AS dist FROM d GROUP BY 1")
def nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first patch of each label as its centroid."""
    vec = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    cents = vec.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("r"))
    # blocks of centroids, a row each, so that no row holds more than about CENTROIDS of them; each vector is compared with every block
    blocks = -(-cents.count() // CENTROIDS)
    cents = cents.groupBy(F.pmod(F.xxhash64("label"), F.lit(max(1, blocks))).alias("block")).agg(F.collect_list(F.struct("label", "r")).alias("cs"))
    d = lambda c: F.struct(F.aggregate(F.zip_with("embedding", c["r"], lambda a, b: F.pow(F.round((a.cast("double") - b.cast("double")) * 1024), F.lit(2)).cast("long")), F.lit(0).cast("long"), lambda t, x: t + x).alias("dist"), c["label"].alias("c"))
    each = vec.select("vec_id", "embedding", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(0, blocks - 1)).cast("long"))).alias("block")).join(cents, "block").select("vec_id", F.array_min(F.transform("cs", d)).alias("m"))
    return each.groupBy("vec_id").agg(F.min("m").alias("m")).select("vec_id", F.col("m.c").alias("centroid"), F.col("m.dist").alias("dist"))


@query("scalar_weights", PATCH_SQL + ", u AS (SELECT vec_id, i, v, v * v * 20 AS u FROM pt) SELECT vec_id, i, round(exp(-u), 6) AS welsch, round(greatest(1 - u, 0), 6) AS bisquare1, round(pow(greatest(1 - u, 0), 2), 6) AS bisquare2, round(pow(greatest(1 - u, 0), 8), 6) AS bisquare8, round(sign(v) * greatest(abs(v) - 0.05, 0), 6) + 0.0 AS soft, round(v + 0.1 * (u - v), 6) AS relaxed, round(v * v / (v * v + 0.04), 6) AS gain, CAST(round_even(v * 4294967296, 0) AS BIGINT) AS fixed, round(1 - abs(2 * (i % 8) + 1 - 8) / 8.0, 6) AS tent, round(exp(-greatest(u / 64 - 0.02, 0) / 0.04), 6) AS pnlm FROM u")
def scalar_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W1 to W6, W8, W14, W16, W17, W19."""
    p = embedding_patches(spark, sf_dir).withColumn("u", F.col("v") * F.col("v") * 20)
    u, v = F.col("u"), F.col("v")
    r = lambda c: F.round(c, 6)
    return p.select("vec_id", "i", *[r(S.nlm_weight(u, k)).alias(n) for k, n in enumerate(("welsch", "bisquare1", "bisquare2", "bisquare8"))], (r(S.soft(v, F.lit(0.05))) + 0.0).alias("soft"), r(S.relax(v, u, 0.1)).alias("relaxed"), r(S.wiener(v, 0.2)).alias("gain"), S.fixed_point(v).alias("fixed"), r(S.tent(F.col("i") % 8, 8)).alias("tent"), r(S.pnlm_weight(u, 8, 0.1)).alias("pnlm"))


@query("fast_exp", PATCH_SQL + ", t AS (SELECT vec_id, i, CAST(12102203 AS FLOAT) * CAST(-400 * v * v AS FLOAT) AS t FROM pt), b AS (SELECT vec_id, i, CASE WHEN t > CAST(-1065353216 AS FLOAT) THEN CAST(trunc(t) AS BIGINT) + 1065353216 ELSE 0 END AS b FROM t) SELECT vec_id, i, round(CASE WHEN b > 0 THEN pow(2.0, b // 8388608 - 127) * (1 + b % 8388608 / 8388608.0) ELSE 0 END, 9) AS e FROM b")
def fast_exp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W18."""
    return embedding_patches(spark, sf_dir).select("vec_id", "i", F.round(S.fast_exp(-400 * F.col("v") * F.col("v")), 9).alias("e"))


@query("sv_shrink_prefix", PATCH_SQL + ", s AS (SELECT vec_id, i, sum(v * v) OVER (PARTITION BY vec_id ORDER BY i DESC) AS s FROM pt), p AS (SELECT *, min(CASE WHEN s * s > 0.25 THEN 1 ELSE 0 END) OVER (PARTITION BY vec_id ORDER BY i) AS ok FROM s) SELECT vec_id, i, round(CASE WHEN ok = 1 THEN (s + sqrt(greatest(s * s - 0.25, 0))) / 2 ELSE 0 END, 6) AS s FROM p")
def sv_shrink_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descending values shrink while their square exceeds C; the rest are zero from the first failure on."""
    p = embedding_patches(spark, sf_dir).select("vec_id", "i", F.sum(F.col("v") * F.col("v")).over(Window.partitionBy("vec_id").orderBy(F.desc("i"))).alias("s"))
    ok = F.min((F.col("s") * F.col("s") > 0.25).cast("int")).over(Window.partitionBy("vec_id").orderBy("i"))
    return p.withColumn("ok", ok).select("vec_id", "i", F.round(F.when(F.col("ok") == 1, (F.col("s") + F.sqrt(F.greatest(F.col("s") * F.col("s") - 0.25, F.lit(0.0)))) / 2).otherwise(0.0), 6).alias("s"))


_RGB = colour_sql(3, SCALE) + ", q AS (SELECT n, y, x, s0 AS r, s1 AS g, s2 AS b FROM z)"


@query("colour_transforms", _RGB + " SELECT n, y, x, round((r + g + b) / sqrt(3), 6) AS o1, round((r - b) / sqrt(2), 6) + 0.0 AS o2, round((r - 2 * g + b) / sqrt(6), 6) + 0.0 AS o3, round(0.299 * r + 0.587 * g + 0.114 * b, 6) AS luma, round((b - (0.299 * r + 0.587 * g + 0.114 * b)) / 1.772, 6) + 0.0 AS u, round((r - (0.299 * r + 0.587 * g + 0.114 * b)) / 1.402, 6) + 0.0 AS v, round(r, 6) AS back FROM q")
def colour_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W20, W21 on each run of three frames as colour planes, and the first plane back from its opponents."""
    q = colour(events_clip(spark, sf_dir), 3, SCALE).select("n", "y", "x", F.col("s0").alias("r"), F.col("s1").alias("g"), F.col("s2").alias("b"))
    o, t = S.opponent(F.col("r"), F.col("g"), F.col("b")), S.yuv(F.col("r"), F.col("g"), F.col("b"))
    r = lambda c: F.round(c, 6) + 0.0
    return q.select("n", "y", "x", *[r(c).alias(n) for c, n in zip((*o, *t), ("o1", "o2", "o3", "luma", "u", "v"), strict=True)], r(S.rgb_of_opponent(*o)[0]).alias("back"))


@query("area_downsample", CLIP_SQL + " SELECT n, CAST(y // 2 AS INT) AS y, CAST(x // 2 AS INT) AS x, avg(c) AS v FROM px GROUP BY 1, 2, 3")
def area_downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T8."""
    return events_clip(spark, sf_dir).groupBy("n", F.expr("CAST(y div 2 AS INT)").alias("y"), F.expr("CAST(x div 2 AS INT)").alias("x")).agg(F.avg("c").alias("v"))


@query("box_sum", CLIP_SQL + f" SELECT a.n, a.y, a.x, CAST(sum(b.c) AS BIGINT) AS total FROM px a, range(-1, 2) p, range(-1, 2) q, px b WHERE b.n = a.n AND b.y = greatest(0, least({HEIGHT - 1}, a.y + p.range)) AND b.x = greatest(0, least({WIDTH - 1}, a.x + q.range)) GROUP BY 1, 2, 3")
def box_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A clamped (2s+1)^2 sum as two one-dimensional clamped joins."""
    return box(events_clip(spark, sf_dir), 1, ["n"], "c").withColumnRenamed("c", "total")


def box(df: DataFrame, s: int, keys: list[str], value: str) -> DataFrame:
    """Separable box sum with a replicated border: each pixel is dealt to all outputs that read it."""
    for axis, length in (("x", WIDTH), ("y", HEIGHT)):
        out = F.transform(F.sequence(F.lit(-s), F.lit(s)), lambda o: F.col(axis) + o)  # noqa: B023
        # outputs p with clamp(p + o) = this pixel: p = pixel - o inside, and more of them at the border
        low, high = F.col(axis) == 0, F.col(axis) == length - 1
        times = lambda p: F.when(low, F.greatest(F.lit(0), s - p + 1)).when(high, F.greatest(F.lit(0), s + 1 - (length - 1 - p))).otherwise(F.lit(1))  # noqa: B023, E731
        dealt = df.select("*", F.explode(F.filter(out, lambda p: (p >= 0) & (p <= length - 1))).alias("_p"))  # noqa: B023
        others = [c for c in ("y", "x") if c != axis]
        df = dealt.groupBy(*keys, *others, F.col("_p").alias(axis)).agg(F.sum(F.col(value) * times(F.col("_p"))).alias(value))
    return df


_SC = CLIP_SQL + REFS_SQL + _match_sql(RANGE, RANGE, GROUP)


@query("scatter_add", _SC + ", sc AS (SELECT mt.n, my + a.range AS y, mx + b.range AS x, k + 1 AS w FROM mt, range(4) a, range(4) b) SELECT px.n, px.y, px.x, CAST(coalesce(sum(w * c), 0) AS BIGINT) AS num, CAST(coalesce(sum(w), 0) AS BIGINT) AS den, round(CASE WHEN sum(w) > 0 THEN sum(w * c) * 1.0 / sum(w) ELSE c END, 6) AS v FROM px LEFT JOIN sc ON sc.n = px.n AND sc.y = px.y AND sc.x = px.x GROUP BY px.n, px.y, px.x, c")
def scatter_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1, A2: each match adds its block with weight k + 1; uncovered pixels keep the source."""
    px, refs, blocks = clip_and_refs(spark, sf_dir)
    found = match.top(match.candidates(refs, blocks, RANGE, RANGE), GROUP).select("n", F.col("my").alias("y"), F.col("mx").alias("x"), (F.col("k") + 1).alias("w"))
    terms = found.join(blocks, ["n", "y", "x"]).select("n", "y", "x", "w", F.posexplode("p").alias("i", "c"))
    sums = terms.groupBy("n", (F.col("y") + F.expr(f"CAST(i div {B} AS INT)")).alias("y"), (F.col("x") + F.col("i") % B).alias("x")).agg(F.sum(F.col("w") * F.col("c")).alias("num"), F.sum("w").cast("long").alias("den"))
    return px.join(sums, ["n", "y", "x"], "left").select("n", "y", "x", F.coalesce("num", F.lit(0)).alias("num"), F.coalesce("den", F.lit(0)).alias("den"), F.round(F.coalesce(S.finish(F.col("num"), F.col("den"), F.col("c"), 0), F.col("c").cast("double")), 6).alias("v"))


@query("vaggregate", CLIP_SQL + " SELECT a.n, a.y, a.x, round(sum(a.c * (c.range + 1)) / 65536.0 / sum(c.range + 1), 6) AS v FROM px a, (SELECT DISTINCT n AS range FROM px) c WHERE abs(c.range - a.n) <= 1 GROUP BY 1, 2, 3")
def vaggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contributions (center, target, num, den) of three slices are summed by target."""
    px = events_clip(spark, sf_dir)
    fat = grid.spread(px, "d", (-1, 0, 1)).withColumn("center", F.col("n") - F.col("d")).join(px.select(F.col("n").alias("center")).distinct(), "center", "left_semi")
    fat = fat.select("center", F.col("n").alias("target"), "y", "x", (F.col("c") / SCALE * (F.col("center") + 1)).alias("num"), (F.col("center") + 1).cast("double").alias("den"))
    sums = fat.groupBy("target", "y", "x").agg(F.sum("num").alias("num"), F.sum("den").alias("den"))
    return sums.select(F.col("target").alias("n"), "y", "x", F.round(F.col("num") / F.col("den"), 6).alias("v"))


def nlm_plan(px: DataFrame, a: int, s: int, h: float, mode: int, d: int = 0, wref: float = 1.0) -> DataFrame:
    """(n, y, x, v); neighbours are clamped in time and space. px has v."""
    other = px.select(F.col("n").alias("_n"), F.col("y").alias("_y"), F.col("x").alias("_x"), F.col("v").alias("q"))
    count = F.broadcast(frames_of(px))
    pairs = grid.spread(grid.spread(grid.spread(px.crossJoin(count), "od", range(-d, d + 1)), "oy", range(-a, a + 1)), "ox", range(-a, a + 1)).where("od <> 0 OR oy <> 0 OR ox <> 0")
    on = (grid.clamped(F.col("n") + F.col("od"), F.col("frames")) == other._n) & (grid.clamped(F.col("y") + F.col("oy"), HEIGHT) == other._y) & (grid.clamped(F.col("x") + F.col("ox"), WIDTH) == other._x)
    dist = pairs.join(other, on).select("n", "od", "oy", "ox", "y", "x", (3 * (F.col("v") - F.col("q")) * (F.col("v") - F.col("q"))).alias("e"))
    u = F.col("e") * (255.0 * 255.0 / (3 * h * h * (2 * s + 1) ** 2))
    w = box(dist, s, ["n", "od", "oy", "ox"], "e").withColumn("w", S.nlm_weight(u, mode))
    at = w.crossJoin(count).join(other, (grid.clamped(F.col("n") + F.col("od"), F.col("frames")) == other._n) & (grid.clamped(F.col("y") + F.col("oy"), HEIGHT) == other._y) & (grid.clamped(F.col("x") + F.col("ox"), WIDTH) == other._x))
    sums = at.groupBy("n", "y", "x").agg(F.sum(F.col("w") * F.col("q")).alias("num"), F.sum("w").alias("den"), F.max("w").alias("most"))
    m = wref * F.greatest(F.col("most"), F.lit(S.EPSILON))
    return sums.join(px, ["n", "y", "x"]).select("n", "y", "x", F.round((m * F.col("v") + F.col("num")) / (m + F.col("den")), 6).alias("v"))


def _nlm_sql(a: int, s: int, h: float, mode: int, d: int) -> str:
    w = "exp(-u)" if mode == 0 else f"pow(greatest(1 - u, 0), {(1, 2, 8)[mode - 1]})"
    return CLIP_SQL + f""", z AS (SELECT n, y, x, c / 65536.0 AS v FROM px),
o AS (SELECT od.range AS od, oy.range AS oy, ox.range AS ox FROM range({-d}, {d + 1}) od, range({-a}, {a + 1}) oy, range({-a}, {a + 1}) ox WHERE od.range <> 0 OR oy.range <> 0 OR ox.range <> 0),
e AS (SELECT p.n, od, oy, ox, p.y, p.x, 3 * (p.v - q.v) * (p.v - q.v) AS e, q.v AS q FROM z p, o, z q WHERE q.n = greatest(0, least((SELECT max(n) FROM px), p.n + od)) AND q.y = greatest(0, least({HEIGHT - 1}, p.y + oy)) AND q.x = greatest(0, least({WIDTH - 1}, p.x + ox))),
f AS (SELECT n, od, oy, ox, y, x, q, greatest(0, least({HEIGHT - 1}, y + sy.range)) AS by, greatest(0, least({WIDTH - 1}, x + sx.range)) AS bx FROM e, range({-s}, {s + 1}) sy, range({-s}, {s + 1}) sx),
b AS (SELECT f.n, f.od, f.oy, f.ox, f.y, f.x, any_value(f.q) AS q, sum(r.e) * {255.0 * 255.0 / (3 * h * h * (2 * s + 1) ** 2)!r} AS u FROM f JOIN e r ON r.n = f.n AND r.od = f.od AND r.oy = f.oy AND r.ox = f.ox AND r.y = f.by AND r.x = f.bx GROUP BY 1, 2, 3, 4, 5, 6),
w AS (SELECT n, y, x, q, {w} AS w FROM b),
t AS (SELECT n, y, x, sum(w * q) AS num, sum(w) AS den, greatest(max(w), {S.EPSILON!r}) AS m FROM w GROUP BY 1, 2, 3)
SELECT n, y, x, round((m * v + num) / (m + den), 6) AS v FROM t JOIN z USING (n, y, x)"""


def _nlm(name: str, a: int, s: int, h: float, mode: int, d: int) -> None:
    @query(name, _nlm_sql(a, s, h, mode, d))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        px = events_clip(spark, sf_dir).select("n", "y", "x", (F.col("c") / SCALE).alias("v"))
        return nlm_plan(px, a, s, h, mode, d)


for _name, _a, _s, _h, _mode, _d in (("nlm_spatial", 2, 1, 60.0, 0, 0), ("nlm_bisquare1", 1, 1, 90.0, 1, 0), ("nlm_bisquare2", 1, 1, 90.0, 2, 0), ("nlm_bisquare8", 1, 1, 150.0, 3, 0), ("nlm_temporal", 1, 1, 60.0, 0, 1)):
    _nlm(_name, _a, _s, _h, _mode, _d)


@query("noise_estimate", GROUPS_SQL + ", d AS (SELECT a.label, a.i, b.i AS j, sum(CAST(round((a.v - b.v) * 1024) AS BIGINT) ** 2) AS dist FROM gr a JOIN gr b ON a.label = b.label AND a.k = b.k GROUP BY 1, 2, 3), q AS (SELECT *, row_number() OVER (PARTITION BY label, i ORDER BY CASE WHEN i = j THEN 0 ELSE 1 END, dist, j) - 1 AS q FROM d), e AS (SELECT label, avg(sqrt(dist / 8.0)) / 1024 AS s FROM q WHERE q BETWEEN 1 AND 3 GROUP BY 1) SELECT count(*) AS n_groups, round(avg(s), 6) AS sigma, round(avg(s) / 1.3923023, 6) AS unguided FROM e")
def noise_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean root distance of each row to its three nearest rows."""
    e = pixel_match_rows(spark, sf_dir).where("q between 1 and 3").groupBy("label").agg((F.avg(F.sqrt(F.col("dist") / 8.0)) / 1024).alias("s"))
    return e.agg(F.count("*").alias("n_groups"), F.round(F.avg("s"), 6).alias("sigma"), F.round(F.avg("s") / 1.3923023, 6).alias("unguided"))


@query("frame_stats", _SC + " SELECT n, count(DISTINCT ref_id) AS n_groups, count(*) AS n_matches, max(dist) AS worst, CAST(sum(CASE WHEN k = 7 THEN 1 ELSE 0 END) AS BIGINT) AS full_groups FROM mt GROUP BY n")
def frame_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10."""
    return spatial_topk(spark, sf_dir).groupBy("n").agg(F.countDistinct("ref_id").alias("n_groups"), F.count("*").alias("n_matches"), F.max("dist").alias("worst"), F.sum((F.col("k") == 7).cast("int")).alias("full_groups"))


@query("threshold_match", _SC + ", kept AS (SELECT * FROM mt WHERE dist <= 40000000), c AS (SELECT n, ref_id, CAST(pow(2, floor(log2(count(*)))) AS BIGINT) AS size FROM kept GROUP BY 1, 2) SELECT kept.n, kept.ref_id, k, dist, size FROM kept JOIN c ON c.n = kept.n AND c.ref_id = kept.ref_id WHERE k < size")
def threshold_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches within a bound, cut to the largest power of two."""
    kept = spatial_topk(spark, sf_dir).where("dist <= 40000000")
    size = F.pow(F.lit(2), F.floor(F.log2(F.count("*").over(Window.partitionBy("n", "ref_id"))))).cast("long")
    return kept.withColumn("size", size).where("k < size").select("n", "ref_id", "k", "dist", "size")
