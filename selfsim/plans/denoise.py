"""The denoising filters as queries over the events clip: its frames as a grey clip, or every run of three of them as colour planes.

Samples are scaled to about one; sigmas are in 8-bit units. Filters whose steps SQL has (search, fixed
transforms, shrinkage of coefficients, weighted sums) have SQL that gives the same rows; those that solve
each group by a decomposition don't, and tests hold them against plain loops.
The windows of TWSC and NLH are smaller than their defaults (60; 24 and 16) as the planes have 31 by 24 samples.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from selfsim.filters import numeric as N
from selfsim.operators import framewise
from selfsim.plans import oracles
from selfsim.plans.registry import query
from selfsim.sources.clips import CLIP_SQL, HEIGHT, WIDTH, colour_sql, events_clip
from selfsim.sources.clips import colour as colour_frames

UNIT = 1048576.0
GREY_SQL = CLIP_SQL + f", z AS (SELECT n, 0 AS ch, y, x, c / {UNIT} AS v FROM px)"
COLOUR_SQL = colour_sql(3, UNIT).replace(", z AS (", ", planes AS (") + ", z AS (SELECT n, c.ch, y, x, CASE c.ch WHEN 0 THEN s0 WHEN 1 THEN s1 ELSE s2 END AS v FROM planes, (VALUES (0), (1), (2)) c(ch))"


def grey(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_clip(spark, sf_dir).select("n", F.lit(0).alias("channel"), "y", "x", (F.col("c") / UNIT).alias("v"))


def colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    planes = colour_frames(events_clip(spark, sf_dir), 3, UNIT)
    return planes.select("n", F.posexplode(F.array("s0", "s1", "s2")).alias("channel", "v"), "y", "x").select("n", "channel", "y", "x", "v")


def rounded(px: DataFrame) -> DataFrame:
    return px.select(F.col("n").cast("long").alias("n"), F.col("channel").cast("long").alias("channel"), F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), (F.round("v", 6) + 0.0).alias("v"))


def tiling(work: partial) -> framewise.Tiling | None:
    halo = N.reach(work.func.__name__, **work.keywords)
    return None if halo is None else framewise.Tiling(halo)


def _filter(name: str, work: partial, source: Callable = grey, radius: int = 0, sql: str | None = None, run: Callable | None = None) -> None:
    @query(name, sql)
    def plan(spark: SparkSession, sf_dir: str) -> DataFrame:
        px = source(spark, sf_dir)
        return rounded(run(px, work) if run else framewise.apply(px, work, radius, tiling=tiling(work)))


_SHAPE = {"h": HEIGHT, "w": WIDTH}
_filter("bm3d", partial(N.bm3d, sigma=8.0), sql=oracles.bm3d_sql(GREY_SQL, [8.0], **_SHAPE))
_filter("bm3d_final", partial(N.bm3d, sigma=8.0, final=1), sql=oracles.bm3d_sql(GREY_SQL, [8.0], final=True, **_SHAPE))
_filter("bm3d_chroma", partial(N.bm3d, sigma=(8.0, 10.0, 12.0)), colour, sql=oracles.bm3d_sql(COLOUR_SQL, [8.0, 10.0, 12.0], **_SHAPE))
# K5: windows of nine blocks for groups of 16, which are padded with zeros; blocks of 4 every 3 samples
_filter("bm3d_padded", partial(N.bm3d, sigma=8.0, block_size=4, block_step=3, bm_range=1, group_size=16), sql=oracles.bm3d_sql(GREY_SQL, [8.0], b=4, step=3, rng=1, k=16, **_SHAPE))
_filter("bm3d_temporal", partial(N.bm3d, sigma=8.0, radius=1), radius=1, sql=oracles.bm3d_sql(GREY_SQL, [8.0], radius=1, **_SHAPE))
_filter("wnnm", partial(N.wnnm, sigma=8.0, residual=1))
_filter("wnnm_temporal", partial(N.wnnm, sigma=8.0, radius=1), radius=1)
_filter("mcwnnm", partial(N.mcwnnm, sigma=(8.0, 10.0, 12.0)), colour)
_filter("ncsr", partial(N.ncsr, sigma=8.0))
_filter("twsc", partial(N.twsc, sigma=8.0, search_window=24), colour)
_filter("twsc_split", partial(N.twsc, sigma=8.0, search_window=24, cfast=1), colour)
_filter("nlh_blind", partial(N.nlh, sigma=None, search_window=(16, 8), rgb=True), colour)
_filter("nlh", partial(N.nlh, sigma=8.0, search_window=(16, 8)), sql=oracles.nlh_sql(GREY_SQL, 8.0, HEIGHT, WIDTH, N.nlh_shape(HEIGHT, WIDTH), (16, 8)))
_filter("pnlm", partial(N.pnlm, sigma=8.0), radius=1, sql=oracles.pnlm_sql(GREY_SQL, 8.0, **_SHAPE))
_filter("lssc", partial(N.lssc, sigma=8.0))
_filter("bm4d", partial(N.bm4d, sigma=8.0), run=framewise.volumes, sql=oracles.bm4d_sql(GREY_SQL, 8.0, HEIGHT, WIDTH, N.CUBES, {c: np.kaiser(c, N.KAISER).tolist() for c, *_ in N.CUBES}))


@query("bm3d_rolling", oracles.bm3d_sql(GREY_SQL, [8.0], radius=1, **_SHAPE))
def bm3d_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of bm3d_temporal, by chunks of two frames."""
    work = partial(N.bm3d, sigma=8.0, radius=1)
    return rounded(framewise.rolling(grey(spark, sf_dir), work, radius=1, chunk=2, tiling=tiling(work)))


@query("bm3d_contributions", oracles.bm3d_sql(GREY_SQL, [8.0], radius=1, **_SHAPE))
def bm3d_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows from contributions by centre, summed by target."""
    px, work = grey(spark, sf_dir), partial(N.bm3d, sigma=8.0, radius=1)
    return rounded(framewise.aggregate(framewise.contributions(px, work, 1, tiling=tiling(work)), px))


@query("da3d")
def da3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the guide is the output of bm3d."""
    px = grey(spark, sf_dir)
    guide = framewise.apply(px, partial(N.bm3d, sigma=8.0), tiling=tiling(partial(N.bm3d, sigma=8.0)))
    return rounded(framewise.apply(px, partial(N.da3d, sigma=8.0), guide=guide, tiling=framewise.Tiling(N.PATCH - N.MID - 1, edge=N.TILE, even=True, crop=False)))


@query("clip_noise", oracles.noise_sql(GREY_SQL, HEIGHT, WIDTH))
def clip_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blind noise of each frame, guided and unguided."""
    measured = framewise.noise_of(grey(spark, sf_dir))
    return measured.select("n", F.col("groups").alias("n_groups"), F.round("sigma", 6).alias("sigma"), F.round(F.col("sigma") / N.UNGUIDED, 6).alias("unguided"))


@query("twsc_statistics")
def twsc_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each frame the solver's groups of the last round, those that took all rounds, those solved directly, the largest residual."""

    def work(win: np.ndarray, centre: int, place=None) -> pd.DataFrame:  # noqa: ANN001
        told: list = []
        N.twsc(win, centre, sigma=8.0, search_window=24, place=place, told=told)
        rounds, residual, direct = (np.concatenate([getattr(t, f) for t in told]) for f in ("rounds", "residual", "direct"))
        return pd.DataFrame([(len(rounds), int((rounds >= 10).sum()), int(direct.sum()), float(residual.max(initial=0)))], columns=["groups", "max_iter_groups", "direct_groups", "residual"])

    each = framewise.statistics(grey(spark, sf_dir), work, "groups long, max_iter_groups long, direct_groups long, residual double")
    return each.groupBy("n").agg(*[F.sum(c).alias(c) for c in ("groups", "max_iter_groups", "direct_groups")], (F.max("residual") < 1e-6).alias("solved"))


@query("capabilities", "SELECT * FROM (VALUES ('bm3d', true), ('bm4d', false), ('da3d', false), ('lssc', false), ('mcwnnm', true), ('ncsr', true), ('nlh', true), ('nlm', false), ('pnlm', false), ('twsc', true), ('vaggregate', false), ('wnnm', true)) v(filter, temporal)")
def capabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the filters that the api has, and whether they give contributions."""
    from selfsim import api

    return api.capabilities(spark)

