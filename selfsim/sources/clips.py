"""Clips (frames of samples) and patches read from tables.

Canonical forms: pixels (n, y, x, c) with an integer sample c, so that distances are exact; patches (vec_id, label, i, v).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Days of a month, hours of a day, and what samples are divided by.
HEIGHT, WIDTH, SCALE = 31, 24, 65536.0
#: Months of shipping are counted from this year's January.
FIRST_YEAR = 1992


def events_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame for each event type: hour of day by day of month, the sample is the sum of cents; empty cells are 0."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "event_type", "value")
    cells = ev.groupBy("event_type", (F.dayofmonth("ts") - 1).alias("y"), F.hour("ts").alias("x")).agg(F.sum(F.round(F.col("value") * 100).cast("long")).alias("c"))
    types = cells.select("event_type").distinct().withColumn("n", F.dense_rank().over(Window.orderBy("event_type")) - 1)
    grid = types.select("event_type", "n", F.explode(F.sequence(F.lit(0), F.lit(HEIGHT - 1))).alias("y")).select("*", F.explode(F.sequence(F.lit(0), F.lit(WIDTH - 1))).alias("x"))
    return grid.join(cells, ["event_type", "y", "x"], "left").select("n", "y", "x", F.coalesce("c", F.lit(0)).cast("long").alias("c"))


def frames_of(px: DataFrame) -> DataFrame:
    """(frames), one row: how many frames the clip has."""
    return px.agg((F.max("n") + 1).alias("frames"))


def lineitem_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plane for each l_returnflag: day of shipping by month, the sample is the sum of cents in units of 2^20, so that distances are exact; empty cells are 0."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_returnflag", "l_shipdate", "l_extendedprice")
    month = (F.year("l_shipdate") - FIRST_YEAR) * 12 + F.month("l_shipdate") - 1
    cells = li.groupBy(F.col("l_returnflag").alias("flag"), month.alias("y"), (F.dayofmonth("l_shipdate") - 1).alias("x")).agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("c"))
    flags = cells.groupBy("flag").agg(F.max("y").alias("last")).withColumn("n", F.dense_rank().over(Window.orderBy("flag")) - 1).withColumn("last", F.max("last").over(Window.partitionBy(F.lit(0))))
    grid = flags.select("flag", "n", F.explode(F.expr("sequence(0, last)")).alias("y")).select("*", F.explode(F.sequence(F.lit(0), F.lit(HEIGHT - 1))).alias("x"))
    return grid.join(cells, ["flag", "y", "x"], "left").select("n", "y", "x", F.expr("coalesce(c, 0) div 1048576").cast("long").alias("c"))


def embedding_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector is an 8 x 8 patch: (vec_id, label, i, v), i = 8 y + x."""
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", F.posexplode("embedding").alias("i", "v")).withColumn("v", F.col("v").cast("double"))


def dense(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each plane: keys, h, w and its samples v in raster order."""
    return pixels.groupBy(*keys).agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"), F.transform(F.sort_array(F.collect_list(F.struct("y", "x", "v"))), lambda p: p["v"]).alias("v"))


#: The same clip in SQL, as the start of a WITH list: px(n, y, x, c).
CLIP_SQL = f"""
WITH ty AS (SELECT event_type, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS INT) AS n FROM (SELECT DISTINCT event_type FROM events)),
cell AS (SELECT n, day(ts) - 1 AS y, hour(ts) AS x, sum(CAST(round(value * 100) AS BIGINT)) AS c FROM events JOIN ty USING (event_type) GROUP BY 1, 2, 3),
px AS (SELECT g.n, CAST(g.y AS INT) AS y, CAST(g.x AS INT) AS x, CAST(coalesce(c, 0) AS BIGINT) AS c
 FROM (SELECT n, y.range AS y, x.range AS x FROM ty, range({HEIGHT}) y, range({WIDTH}) x) g LEFT JOIN cell ON cell.n = g.n AND cell.y = g.y AND cell.x = g.x)"""
LINEITEM_SQL = f"""
WITH cell AS (SELECT l_returnflag AS flag, (year(l_shipdate) - {FIRST_YEAR}) * 12 + month(l_shipdate) - 1 AS y, day(l_shipdate) - 1 AS x, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS c FROM lineitem GROUP BY 1, 2, 3),
px AS (SELECT CAST(n AS INT) AS n, CAST(g.y AS INT) AS y, CAST(g.x AS INT) AS x, CAST(coalesce(c, 0) // 1048576 AS BIGINT) AS c
 FROM (SELECT f.flag, f.n, y.range AS y, x.range AS x FROM (SELECT flag, dense_rank() OVER (ORDER BY flag) - 1 AS n FROM (SELECT DISTINCT flag FROM cell)) f, range(1200) y, range({HEIGHT}) x WHERE y.range <= (SELECT max(y) FROM cell)) g LEFT JOIN cell USING (flag, y, x))"""


def colour(px: DataFrame, count: int, scale: float) -> DataFrame:
    """(n, y, x, s0 ..): frames of count planes, one for each run of so many frames of the clip, so that every frame is in one; a shorter clip's last frame repeats."""
    runs = px.crossJoin(F.broadcast(frames_of(px))).select("*", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("frames") - count))).alias("m"))
    planes = [(F.max(F.when(F.col("n") == F.least(F.col("m") + k, F.col("frames") - 1), F.col("c"))) / scale).alias(f"s{k}") for k in range(count)]
    return runs.where(F.col("n").between(F.col("m"), F.col("m") + count - 1)).groupBy("m", "y", "x").agg(*planes).select(F.col("m").cast("int").alias("n"), "y", "x", *[f"s{k}" for k in range(count)])


def colour_sql(count: int, scale: float) -> str:
    """The same in SQL: z(n, y, x, s0 ..) after the clip."""
    last = "(SELECT max(n) FROM px)"
    planes = ", ".join(f"max(CASE WHEN px.n = least(f.n + {k}, {last}) THEN c END) / {scale} AS s{k}" for k in range(count))
    return CLIP_SQL + f", z AS (SELECT f.n, y, x, {planes} FROM px, (SELECT DISTINCT n FROM px WHERE n <= greatest(0, {last} - {count - 1})) f GROUP BY f.n, y, x)"


PATCH_SQL = "WITH pt AS (SELECT vec_id, label, i - 1 AS i, CAST(embedding[i] AS DOUBLE) AS v FROM (SELECT vec_id, label, embedding, unnest(range(1, 65)) AS i FROM embeddings))"
