"""The batched filters against plain loops, one reference at a time, and properties that need no oracle."""

import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from selfsim.filters import numeric as N
from selfsim.kernels import patches as K

sys.path.insert(0, str(Path(__file__).parent))
import brute_filters as B  # noqa: E402


def window(frames=1, channels=1, h=30, w=26, seed=1, flat=False):
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[:h, :w]
    clean = 0.5 + 0.2 * np.sin(y / 4) * np.cos(x / 5) + 0.1 * (x > w // 2)
    out = clean + 0.02 * np.arange(channels)[:, None, None] + 0.04 * rng.standard_normal((frames, channels, h, w))
    if flat:
        # ties: equal blocks everywhere
        out[:, :, : h // 2] = 0.25
    return out


CASES = [
    ("bm3d", {"sigma": 10.0}, 1, 1),
    ("bm3d", {"sigma": 10.0, "final": 1, "bm_range": 5}, 1, 1),
    ("bm3d", {"sigma": (10.0, 0.0, 5.0), "block_size": 4, "block_step": 3, "group_size": 16}, 1, 3),
    ("bm3d", {"sigma": 10.0, "radius": 1, "bm_range": 4}, 3, 1),
    ("wnnm", {"sigma": 10.0}, 1, 1),
    ("wnnm", {"sigma": 10.0, "residual": 1, "radius": 2, "bm_range": 4, "ps_range": 3}, 4, 1),
    ("mcwnnm", {"sigma": (8.0, 0.0, 12.0), "adaptive_aggregation": 1, "bm_range": 4}, 1, 3),
    ("ncsr", {"sigma": 10.0, "bm_range": 5}, 1, 1),
    ("twsc", {"sigma": 10.0, "search_window": 12}, 1, 3),
    ("twsc", {"sigma": 10.0, "search_window": 12, "cfast": 1}, 1, 3),
    ("twsc", {"sigma": 10.0, "search_window": 9, "radius": 1, "estimate_sigma": 1, "iters": 1}, 2, 1),
    ("nlh", {"sigma": 10.0, "search_window": 8, "basic_iters": 2}, 1, 3),
    ("nlh", {"sigma": None, "search_window": 8, "basic_iters": 1, "rgb": True}, 1, 3),
    ("pnlm", {"sigma": 10.0}, 3, 1),
    ("bm4d", {"sigma": 10.0}, 6, 1),
]


@pytest.mark.parametrize(("name", "args", "frames", "channels"), CASES)
@pytest.mark.parametrize("flat", [False, True])
def test_equals_plain_loops(name, args, frames, channels, flat):
    small = {"h": 14, "w": 13} if name == "bm4d" else {}
    win = window(frames, channels, flat=flat, **small)
    got, want = (getattr(m, name)(win, frames // 2, **args) for m in (N, B))
    if flat and (name, args.get("estimate_sigma")) != ("pnlm", None):
        # equal distances are ordered alike, but sums of equal blocks round apart; the quotient is what counts
        assert np.allclose(K.divide(*got, win), K.divide(*want, win), atol=2e-3)
    else:
        assert np.allclose(got[0], want[0], atol=1e-8) and np.allclose(got[1], want[1], atol=1e-8)


def test_guides_equal_plain_loops():
    win, guide = window(1, 1, seed=1), window(1, 1, seed=2)
    for name, args in (("wnnm", {"rclip": guide}), ("ncsr", {"rclip": guide}), ("twsc", {"rclip": guide, "search_window": 10}), ("bm3d", {"ref": guide}), ("nlh", {"rclip": guide, "search_window": 8, "basic_iters": 1})):
        got, want = (getattr(m, name)(win, 0, sigma=9.0, **args) for m in (N, B))
        assert np.allclose(K.divide(*got, win), K.divide(*want, win), atol=1e-8), name


@pytest.mark.parametrize("radius", [0, 2])
def test_search_equals_plain_loops(radius):
    for seed, flat in ((1, False), (2, True)):
        guide = np.round(10 * window(5, 2, seed=seed, flat=flat))
        guide[2, 0, 5, 5] = np.nan
        ys, xs = K.Place.whole(guide).grid(guide, 4, 5)
        found = K.search(guide, 2, ys, xs, 4, 3, 2, 9, radius, 2, 2)
        for r, (y, x) in enumerate((y, x) for y in ys for x in xs):
            want = B.K.search(guide, 2, int(y), int(x), 4, 3, 2, 9, radius, 2, 2)
            got = [(float(found.dist[r, j]), int(found.t[r, j]), int(found.y[r, j]), int(found.x[r, j])) for j in range(int(found.count[r]))]
            assert [g[1:] for g in got] == [w[1:] for w in want]
            assert np.allclose([g[0] for g in got], [w[0] for w in want], equal_nan=True)


@pytest.mark.parametrize("block", [1, 2, 4, 8, 16])
@pytest.mark.parametrize("kind", ["flat", "noise", "step"])
def test_sparse_coder_takes_every_block(block, kind):
    win = {"flat": np.full((1, 1, 20, 18), 0.5), "noise": window(1, 1, 20, 18), "step": np.round(window(1, 1, 20, 18))}[kind]
    num, den = N.lssc(win, 0, 10.0, block)
    out = K.divide(num, den, win)
    assert np.isfinite(out).all() and (den > 0).all()
    if kind == "flat":
        assert np.allclose(out, win)


def test_sparse_codes_equal_pursuit_one_by_one():
    rng = np.random.default_rng(4)
    d, x = N.unit(rng.standard_normal((16, 40))), rng.standard_normal((50, 16))
    got = N.sparse(d, x, 0.5)
    for row, code in zip(x, got, strict=True):
        chosen, r = [], row
        while r @ r > 0.5 and len(chosen) < 16:
            score = np.abs(d.T @ r)
            score[chosen] = -1
            best = int(score.argmax())
            rest = d[:, best] - d[:, chosen] @ np.linalg.lstsq(d[:, chosen], d[:, best], rcond=None)[0] if chosen else d[:, best]
            if rest @ rest <= N.PIVOT:
                break
            chosen.append(best)
            r = row - d[:, chosen] @ np.linalg.lstsq(d[:, chosen], row, rcond=None)[0]
        assert np.allclose(code, row - r, atol=1e-8)


def test_dictionary_by_rule():
    rng = np.random.default_rng(4)
    p = rng.standard_normal((500, 16))
    p -= p.mean(1, keepdims=True)
    atoms = N.dct_atoms(4, 256)
    assert atoms.shape == (16, 16) and np.allclose(atoms[:, 0], 0.25) and np.allclose(atoms.T @ atoms, np.eye(16))
    d = N.dictionary(p, 4)
    assert d.shape == (16, 256) and np.allclose((d**2).sum(0), 1)
    # fewer patches than atoms: fewer atoms; an atom of a flat patch is the first unit vector
    assert N.dictionary(p[:7], 4).shape == (16, 7) and np.allclose(N.unit(np.zeros((4, 1)))[:, 0], [1, 0, 0, 0])


def test_noise_falls():
    clean = window(1, 1, 64, 64, seed=0)
    rng = np.random.default_rng(5)
    y, x = np.mgrid[:64, :64]
    clean = (0.5 + 0.2 * np.sin(y / 9) * np.cos(x / 11))[None, None]
    noisy = clean + 10 / 255 * rng.standard_normal(clean.shape)
    for f, args in ((N.lssc, {}), (N.bm4d, {}), (N.pnlm, {})):
        out = K.divide(*f(np.repeat(noisy, 4, 0) if f is N.bm4d else noisy, 0, 10.0, **args), np.repeat(noisy, 4, 0) if f is N.bm4d else noisy)[:1]
        assert ((out - clean) ** 2).mean() < 0.7 * ((noisy - clean) ** 2).mean()
    guide = K.divide(*N.bm3d(noisy, 0, sigma=13.0), noisy)
    out = K.divide(*N.da3d(noisy, 0, guide, 10.0), noisy)
    assert ((out - clean) ** 2).mean() < ((guide - clean) ** 2).mean()


def test_tiles_are_even_and_ties_go_by_squares():
    assert N.even_tiles(300, 128) == [(0, 150), (150, 300)] and N.even_tiles(60, 128) == [(0, 60)] and N.even_tiles(330, 128) == [(0, 110), (110, 220), (220, 330)]
    assert [tuple(map(int, divmod(p, 5))) for p in N.in_squares(4, 5)[:8]] == [(0, 0), (1, 0), (0, 1), (1, 1), (2, 0), (3, 0), (2, 1), (3, 1)]
    assert sorted(N.in_squares(3, 7)) == list(range(21))


def test_solver_tells_rounds_and_residuals():
    told = []
    N.twsc(window(1, 1), 0, sigma=10.0, search_window=12, told=told)
    assert sum(len(t.rounds) for t in told) == 16 and all((1 <= t.rounds).all() and (t.rounds <= 10).all() and (t.residual < 1e-6).all() for t in told)
    # with a gate of zero every system is solved directly, to the same end
    rng = np.random.default_rng(1)
    y, rows, columns = rng.standard_normal((3, 16, 4)), np.full((3, 16), 0.3), np.full((3, 4), 0.4)
    a, b = K.twsc_groups(y, rows, columns), K.twsc_groups(y, rows, columns, gate=-1.0)
    assert np.allclose(a[0], b[0]) and b[1].direct.all() and not a[1].direct.any()


def test_places_see_the_planes_own_grid():
    """A window of a plane with a margin gives the plane's own pixels in its middle."""
    win = window(1, 1, 96, 80)
    whole = K.divide(*N.bm3d(win, 0, sigma=10.0, bm_range=5), win)
    place = K.Place(17, 9, 96, 80)
    part = win[:, :, 17:90, 9:71]
    got = K.divide(*N.bm3d(part, 0, sigma=10.0, bm_range=5, place=place), part)
    assert np.allclose(got[:, :, 27:-27, 27:-27], whole[:, :, 17 + 27 : 90 - 27, 9 + 27 : 71 - 27], atol=1e-10)


def test_tiles_give_the_whole_planes_pixels(spark):
    """Tiles with halos, whole planes and sums of contributions are the same frames, for every filter that takes tiles."""
    from functools import partial

    from selfsim.operators import framewise

    rng = np.random.default_rng(7)
    h, w = 70, 90
    stack = window(1, 1, h, w)
    px = spark.createDataFrame([(0, 0, int(y), int(x), float(stack[0, 0, y, x])) for y in range(h) for x in range(w)], "n int, channel int, y int, x int, v double")
    small = {"bm_range": 3, "block_size": 4, "block_step": 4}
    for work in (partial(N.bm3d, sigma=9.0, **small), partial(N.bm3d, sigma=9.0, final=1, **small), partial(N.wnnm, sigma=9.0, **small), partial(N.ncsr, sigma=9.0, **small), partial(N.twsc, sigma=9.0, search_window=5, block_size=4, block_step=4), partial(N.pnlm, sigma=9.0), partial(N.nlm, d=0, h=9.0, s=2)):
        halo = N.reach(work.func.__name__, **work.keywords)
        want = K.divide(*work(stack, 0), stack)[0, 0]
        for run in (framewise.apply, lambda p, f, tiling: framewise.aggregate(framewise.contributions(p, f, tiling=tiling), p)):
            got = {(r.y, r.x): r.v for r in run(px, work, tiling=framewise.Tiling(halo, edge=32)).collect()}
            assert len(got) == h * w and max(abs(got[y, x] - want[y, x]) for y in range(h) for x in range(w)) < 1e-9, work
    tiles = framewise.Tiling(N.PATCH - N.MID - 1, edge=N.TILE, even=True, crop=False)
    guide = np.round(stack, 2)
    gx = spark.createDataFrame([(0, 0, int(y), int(x), float(guide[0, 0, y, x])) for y in range(h) for x in range(w)], "n int, channel int, y int, x int, v double")
    got = {(r.y, r.x): r.v for r in framewise.apply(px, partial(N.da3d, sigma=9.0), guide=gx, tiling=tiles).collect()}
    want = K.divide(*N.da3d(stack, 0, guide, 9.0), stack)[0, 0]
    assert max(abs(got[y, x] - want[y, x]) for y in range(h) for x in range(w)) < 1e-9
    noise = framewise.noise_of(px).first()
    total, groups = N.noise(stack[0, 0], stack[0, 0])
    assert noise["groups"] == groups and abs(noise.sigma - total / groups) < 1e-12


def test_group_map_is_the_hook_of_the_group_filters(spark):
    from selfsim.operators import framewise

    stack = window(1, 1, 40, 40)
    px = spark.createDataFrame([(0, 0, int(y), int(x), float(stack[0, 0, y, x])) for y in range(40) for x in range(40)], "n int, channel int, y int, x int, v double")
    spots = lambda win, place, t: K.spots_of(win, place, 4, 4, 3, 3, 8)(t)
    mean = lambda groups, found: (np.repeat(groups.mean(1, keepdims=True), groups.shape[1], 1), 1.0)
    got = {(r.y, r.x): r.v for r in framewise.group_map(px, spots, mean, 4, 7).collect()}
    num, den = K.collect(stack, 0, lambda t: spots(stack, K.Place.whole(stack), t), lambda found: mean(K.blocks_of(stack, found, 4), found), 4)
    want = K.divide(num, den, stack)[0, 0]
    assert max(abs(got[k] - want[k]) for k in got) < 1e-9


def test_luma_at_chroma_size():
    luma = window(1, 1, 32, 40)
    assert np.allclose(N.reduced(luma, 16, 20)[0, 0, 3, 5], luma[0, 0, 6:8, 10:12].mean()) and N.reduced(luma, 32, 20).shape == (1, 1, 32, 20)
    planes = [luma, window(1, 1, 16, 20, seed=2), window(1, 1, 16, 20, seed=3)]
    out = N.nlh_planes(planes, 0, sigma=(8.0, 8.0, 0.0), search_window=8, basic_iters=1)
    assert [n.shape for n, _ in out] == [p.shape for p in planes] and np.allclose(K.divide(*out[2], planes[2]), planes[2])
    assert all(np.isfinite(n).all() for n, _ in out) and not np.allclose(K.divide(*out[1], planes[1]), planes[1])


def test_fast_exp_of_columns_and_arrays(spark):
    from selfsim.functions.scalars import fast_exp

    x = np.r_[-np.linspace(0, 90, 500), 0.0, -1e9]
    got = [r.e for r in spark.createDataFrame([(float(v),) for v in x], "x double").select(fast_exp(F.col("x")).alias("e")).collect()]
    assert np.allclose(got, N.fast_exp(x), rtol=1e-12, atol=0) and abs(N.fast_exp(np.array([-1.0]))[0] / np.exp(-1) - 1) < 0.07
