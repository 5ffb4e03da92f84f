"""The functions on small clips: arguments, planes, temporal modes, guides."""

from dataclasses import replace

import numpy as np
import pytest

from selfsim import api
from selfsim.filters import numeric as N
from selfsim.plans import nlm as plan
from selfsim.plans.relational import HEIGHT, WIDTH

rng = np.random.default_rng(5)
CLEAN = 0.5 + 0.2 * np.sin(np.arange(24) / 4)[None, None, :] * np.cos(np.arange(20) / 6)[None, :, None] + np.zeros((6, 1, 1))
NOISE = rng.normal(0, 12 / 255, (6, 3, 20, 24))


def make(spark, family="GRAY", frames=3):
    planes = 1 if family == "GRAY" else 3
    rows = [(n, c, y, x, float(CLEAN[n, y, x] + NOISE[n, c, y, x])) for n in range(frames) for c in range(planes) for y in range(20) for x in range(24)]
    return api.Clip.of(spark.createDataFrame(rows, "n int, channel int, y int, x int, v double"), family)


def values(clip):
    out = np.full((clip.frames, clip.planes, clip.height, clip.width), np.nan)
    for r in clip.pixels.collect():
        out[r.n, r.channel, r.y, r.x] = r.v
    return out


def better(clip, src):
    want = CLEAN[: clip.frames, None]
    got = values(clip)
    assert np.isfinite(got).all()
    return ((got - want) ** 2).mean() < ((values(src) - want) ** 2).mean()


@pytest.mark.parametrize(("name", "family", "more"), [("bm3d", "GRAY", {"final": 1}), ("bm3d", "YUV", {"chroma": 1}), ("nlm", "RGB", {"h": 12.0, "d": 1}), ("pnlm", "GRAY", {}), ("wnnm", "GRAY", {"residual": 1}), ("mcwnnm", "RGB", {}), ("ncsr", "GRAY", {}), ("lssc", "GRAY", {}), ("twsc", "RGB", {"search_window": 8}), ("twsc", "GRAY", {"search_window": 8, "estimate_sigma": 1, "sigma": None}), ("nlh", "GRAY", {"search_window": 8, "sigma": None, "basic_iters": 1}), ("nlh", "RGB", {"search_window": 8, "basic_iters": 1})])
def test_filters_reduce_noise(spark, name, family, more):
    src = make(spark, family, 2)
    args = ({} if name == "nlm" else {"sigma": 12.0}) | more
    assert better(api.FILTERS[name](src, **args), src)


def test_volumes_smaller_than_a_cube_are_copied(spark):
    small, src = make(spark, frames=2), make(spark, frames=6)
    assert np.array_equal(values(api.bm4d(small, sigma=12.0)), values(small))
    assert better(api.bm4d(src, sigma=12.0), src)


@pytest.mark.parametrize("name", ["bm3d", "wnnm", "ncsr"])
def test_rolling_is_legacy_and_sum(spark, name):
    src, f = make(spark, "YUV"), api.FILTERS[name]
    args = dict(sigma=[12.0, 0.0, 6.0], radius=1)
    parts = f(src, **args)
    assert isinstance(parts, api.Contributions)
    got = values(api.vaggregate(parts, src, 1))
    assert np.allclose(got, values(f(src, temporal_mode="rolling", rolling_chunk=2, **args)), atol=1e-9)
    assert np.array_equal(got[:, 1], values(src)[:, 1])
    some = values(api.vaggregate(parts, src, 1, planes=[2]))
    assert np.array_equal(some[:, 0], values(src)[:, 0]) and np.allclose(some[:, 2], got[:, 2])


def test_final_is_two_calls(spark):
    src = make(spark, frames=1)
    first = api.bm3d(src, sigma=8.0, block_size=4)
    assert np.allclose(values(api.bm3d(src, sigma=12.0, final=1, sigma_basic=8.0, block_size_basic=4)), values(api.bm3d(src, ref=first, sigma=12.0)))


def test_guides(spark):
    src = make(spark, frames=1)
    guide = api.bm3d(src, sigma=12.0)
    for name in ("wnnm", "ncsr", "twsc", "nlh", "nlm"):
        args = {"h": 12.0, "d": 0} if name == "nlm" else {"sigma": 12.0}
        assert not np.allclose(values(api.FILTERS[name](src, rclip=guide, **args)), values(api.FILTERS[name](src, **args)))
    assert np.array_equal(values(api.da3d(src, guide, sigma=0.0)), values(guide))
    assert better(api.da3d(src, guide, sigma=12.0), src)


def test_kernel_and_plan_of_pixel_means_agree(spark):
    stack = rng.random((5, 1, HEIGHT, WIDTH))
    px = spark.createDataFrame([(n, y, x, float(v)) for (n, _, y, x), v in np.ndenumerate(stack)], "n int, y int, x int, s0 double")
    for d in (0, 1):
        want = np.stack([N.nlm(stack, t, d=d, a=2, s=1, h=90.0)[0][t, 0] for t in range(5)])
        got = {(r.n, r.y, r.x): r.s0 for r in plan.plan(px, "Y", 2, 1, 90.0, 0, d).collect()}
        assert max(abs(got[k] - v) for k, v in np.ndenumerate(want)) < 2e-6


def test_kernel_against_the_plain_formula_inside():
    v, a, s, h = rng.random((1, 1, 16, 16)), 2, 1, 60.0
    out = N.nlm(v, 0, d=0, a=a, s=s, h=h)[0][0, 0]
    p, y, x = v[0, 0], 8, 8
    w = {(oy, ox): np.exp(-sum(3 * (p[y + i, x + j] - p[y + oy + i, x + ox + j]) ** 2 for i in (-1, 0, 1) for j in (-1, 0, 1)) * 255**2 / (3 * h * h * 9)) for oy in range(-a, a + 1) for ox in range(-a, a + 1) if (oy, ox) != (0, 0)}
    m = max(w.values())
    assert out[y, x] == pytest.approx((m * p[y, x] + sum(g * p[y + oy, x + ox] for (oy, ox), g in w.items())) / (m + sum(w.values())))


@pytest.mark.parametrize(("name", "args", "text"), [
    ("bm3d", {"sigma": -1.0}, "BM3D: sigma must be finite and non-negative"),
    ("bm3d", {"block_size": 5}, "BM3D: block_size must be one of 1, 2, 4, 8, 12, 16, 32"),
    ("bm3d", {"block_size": 32}, "BM3D: block_size must not exceed plane dimensions"),
    ("bm3d", {"group_size": 3}, "BM3D: group_size must be one of 1, 2, 4, 8, 16, 32, 64"),
    ("bm3d", {"chroma": 1}, "BM3D: chroma requires a YUV 4:4:4 clip"),
    ("bm3d", {"sigma_basic": 3.0}, "BM3D: sigma_basic, block_size_basic and group_size_basic require final=1"),
    ("bm3d", {"radius": 1, "temporal_mode": "fused"}, "BM3D: temporal_mode=fused is not supported; use rolling or legacy"),
    ("nlm", {"a": 0}, "NLM: invalid d/a/s/h/wref"),
    ("nlm", {"channels": "UV"}, "NLM: UV requires YUV"),
    ("nlm", {"a": 24}, "NLM: search radius a must be smaller than the processed plane width"),
    ("pnlm", {"block_size": 5}, "PNLM: block_size must be 4, 6 or 8"),
    ("wnnm", {"bm_range": 65}, "WNNM: bm_range must be in [1, 64]"),
    ("mcwnnm", {}, "MCWNNM: constant RGBS or YUV444PS required"),
    ("ncsr", {"delta": 2.0}, "NCSR: invalid iters/delta (iters in [1, 64], delta in [0, 1])"),
    ("lssc", {"radius": 1}, "LSSC: radius>0 is not implemented (no temporal clustering)"),
    ("twsc", {"estimate_sigma": 1, "sigma": 3.0}, "TWSC: estimate_sigma and explicit sigma are mutually exclusive"),
    ("twsc", {"bm_range": 3, "search_window": 8}, "TWSC: bm_range and search_window are mutually exclusive"),
    ("nlh", {"noise_model": "x"}, "NLH: noise_model must be auto, awgn, or real"),
    ("nlh", {"q": 3}, "NLH: invalid stage group/q/block/step combination"),
    ("bm4d", {"sigma": 1e-20}, "BM4D: sigma is too small"),
])
def test_messages(spark, name, args, text):
    with pytest.raises(api.InvalidInput) as caught:
        api.FILTERS[name](make(spark, frames=1), **args)
    assert str(caught.value) == text


def test_memory_limit_and_identity(spark):
    src = make(spark)
    with pytest.raises(api.ResourceFailure):
        api.bm3d(replace(src, width=19200, height=10800), memory_limit_mb=64)
    parts = api.wnnm(src, radius=1)
    with pytest.raises(api.InvalidInput, match="incompatible contribution identity"):
        api.vaggregate(parts, src, 2)
    with pytest.raises(api.InvalidInput, match="unique valid plane"):
        api.vaggregate(parts, src, 1, planes=[0, 0])
    assert api.capabilities(spark).count() == 12
    with pytest.raises(api.InvalidInput, match="VAggregate: missing or invalid contribution identity"):
        api.vaggregate(replace(parts, identity=None), src, 1)
    assert values(api.vaggregate(replace(parts, identity=None), src, 1, allow_legacy=1)).shape == (3, 1, 20, 24)
    with pytest.raises(api.InvalidInput, match="mixed contribution models"):
        api.vaggregate([parts, api.ncsr(src, radius=1)], src, 1)
    for wrong in ({"model": 7}, {"model_version": 1}, {"noise_profile": 1}, {"fat_version": 1}, {"fat_layout": 0}):
        with pytest.raises(api.InvalidInput, match="incompatible contribution identity"):
            api.vaggregate(replace(parts, identity=replace(parts.identity, **wrong)), src, 1)
    rows = api.properties(parts).orderBy("n").collect()
    assert [(r.n, r.fat_center, r.model, r.model_version, r.noise_profile, r.fat_version, r.fat_radius, r.fat_layout) for r in rows] == [(n, n, 2, 2, 0, 2, 1, 1) for n in range(3)]
    assert {(r.model, r.model_version, r.noise_profile, r.fat_version) for r in api.properties(api.bm3d(src)).collect()} == {(1, 3, 1, None)}


@pytest.mark.parametrize(("args", "text"), [({"sigma": float("nan")}, "parameter sigma[0] is not representable as a finite float"), ({"sigma": [3.0, 1e39]}, "parameter sigma[1] is not representable as a finite float"), ({"radius": 2**31}, "parameter radius[0] is not representable as a finite int")])
def test_numbers_that_do_not_fit(spark, args, text):
    with pytest.raises(api.InvalidInput) as caught:
        api.bm3d(make(spark, frames=1), **args)
    assert str(caught.value) == text


def test_diagnostics(spark):
    src = make(spark, frames=2)
    rows = api.twsc_diagnostics(src, 12.0, search_window=8).orderBy("n").collect()
    assert [r.n for r in rows] == [0, 1] and all(r.groups == 9 and r.max_iter_groups <= r.groups and r.direct_groups == 0 and r.residual < 1e-6 for r in rows)
    told = api.da3d_diagnostics(src, api.bm3d(src, sigma=12.0), 12.0).collect()
    assert len(told) == 2 and all(0 < r.patches and r.guide_only <= r.patches for r in told)


def test_nlh_on_subsampled_chroma(spark):
    full = make(spark, "YUV", 1)
    px = full.pixels.where("channel = 0 OR (y < 10 AND x < 12)")
    src = api.Clip.of(px, "YUV", (1, 1))
    out = api.nlh(src, sigma=12.0, search_window=8, basic_iters=1)
    got = {(r.channel, r.y, r.x) for r in out.pixels.collect()}
    assert got == {(r.channel, r.y, r.x) for r in px.collect()} and out.identity.model_version == 7


def test_samples_that_are_not_finite():
    win = np.full((1, 1, 16, 16), 0.5)
    win[0, 0, 3, 3] = np.nan
    for f in (N.twsc, N.nlh):
        with pytest.raises(api.NumericalFailure):
            f(win, 0, sigma=5.0)
    out = N.lssc(win, 0, 5.0)
    assert np.isnan(out[0]).any() and np.isfinite((out[0] / out[1])[0, 0, 12:, 12:]).all()
