"""Rolling chunks, batch and stream, give what contributions and their sum give."""

from functools import partial

import numpy as np
import pytest

from selfsim.filters import numeric as N
from selfsim.operators import framewise
from selfsim.sources.clips import dense
from selfsim.streaming import rolling as stream

WORK = partial(N.bm3d, sigma=10.0, radius=1, block_size=4, bm_range=3)


def clip(spark, frames=7, channels=1):
    rng = np.random.default_rng(3)
    rows = [(n, c, y, x, float(v)) for n in range(frames) for c in range(channels) for (y, x), v in np.ndenumerate(rng.random((10, 12)))]
    return spark.createDataFrame(rows, "n int, channel int, y int, x int, v double")


def as_dict(df):
    return {(r.n, r.channel, r.y, r.x): r.v for r in df.collect()}


def same(a, b):
    return a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)


@pytest.mark.parametrize("chunk", [1, 2, 4, 64])
def test_any_chunk_gives_the_same_frames(spark, chunk):
    px = clip(spark)
    assert same(as_dict(framewise.rolling(px, WORK, 1, chunk)), as_dict(framewise.apply(px, WORK, 1)))


def test_units_filter_their_channels_and_copy_the_rest(spark):
    px = clip(spark, 3, 3)
    units = [((0,), WORK), ((2,), partial(N.bm3d, sigma=20.0, radius=1, block_size=4, bm_range=3))]
    got, want, src = as_dict(framewise.rolling(px, units, 1)), as_dict(framewise.apply(px, units, 1)), as_dict(px)
    assert same(got, want)
    assert all(got[k] == src[k] for k in got if k[1] == 1) and any(got[k] != src[k] for k in got if k[1] == 2)


def test_stream_of_planes(spark, tmp_path):
    px = clip(spark)
    planes = dense(px, ["n", "channel"]).selectExpr("CAST(n AS LONG) n", "CAST(channel AS LONG) channel", "CAST(h AS LONG) h", "CAST(w AS LONG) w", "v")
    for part in ("n > 3", "n <= 3 AND n <> 2", "n = 2 OR n = 5"):
        planes.where(part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(planes.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = stream.rolling(source, WORK, 1, frames=7, chunk=2).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out")
    q.awaitTermination(120)
    assert q.exception() is None
    got = as_dict(framewise.exploded(spark.read.parquet(f"{tmp_path}/out")))
    assert same(got, as_dict(framewise.apply(px, WORK, 1)))
