"""Properties of the filters on small stacks."""

import numpy as np
import pytest

from selfsim.filters import numeric as N
from selfsim.kernels import patches as K
from selfsim.operators.grid import positions
from selfsim.operators.transforms import dct, haar, interleaved

rng = np.random.default_rng(1)
yy, xx = np.mgrid[0:24, 0:32]
CLEAN = np.stack([0.5 + 0.2 * np.sin((xx + 2 * t) / 5) * np.cos((yy + t) / 7) for t in range(5)])[:, None]
NOISY = CLEAN + rng.normal(0, 15 / 255, CLEAN.shape)
FILTERS = {"bm3d": (N.bm3d, {}), "final": (N.bm3d, {"final": 1}), "wnnm": (N.wnnm, {}), "ncsr": (N.ncsr, {}), "mcwnnm": (N.mcwnnm, {}), "twsc": (N.twsc, {"search_window": 12}), "nlh": (N.nlh, {"search_window": 8, "basic_iters": 1}), "pnlm": (N.pnlm, {}), "lssc": (N.lssc, {}), "bm4d": (N.bm4d, {})}


def test_positions_keep_the_last():
    assert positions(20, 8, 8) == [0, 8, 12] and positions(24, 8, 8) == [0, 8, 16] and positions(4, 8, 8) == []


@pytest.mark.parametrize("n", [1, 2, 4, 8, 16])
def test_bases_are_orthonormal(n):
    for b in (dct(n), haar(n), interleaved(n)):
        assert np.allclose(np.array(b) @ np.array(b).T, np.eye(n))


@pytest.mark.parametrize("name", FILTERS)
def test_filters_reduce_noise(name):
    f, more = FILTERS[name]
    out = K.divide(*f(NOISY, 2, sigma=15.0, **more), NOISY)[2]
    assert np.isfinite(out).all()
    assert ((out - CLEAN[2]) ** 2).mean() < ((NOISY[2] - CLEAN[2]) ** 2).mean()


@pytest.mark.parametrize("name", FILTERS)
def test_sigma_zero_copies(name):
    f, more = FILTERS[name]
    num, den = f(NOISY, 2, sigma=0.0, **more)
    assert np.array_equal(K.divide(num, den, NOISY)[2], NOISY[2])


def test_guided_dual_domain():
    guide = K.divide(*N.bm3d(NOISY, 2, sigma=20.0), NOISY)
    out = K.divide(*N.da3d(NOISY, 2, guide, 15.0), NOISY)[2]
    assert ((out - CLEAN[2]) ** 2).mean() < ((guide[2] - CLEAN[2]) ** 2).mean() * 1.05


def test_search_orders_ties_and_starts_with_the_reference():
    at = lambda found: list(zip(found.y[0].tolist(), found.x[0].tolist(), strict=True))
    assert at(K.search(np.ones((1, 1, 12, 12)), 0, np.array([4]), np.array([4]), 4, 1, 1, 4)) == [(4, 4), (3, 3), (3, 4), (3, 5)]
    found = K.search(NOISY, 2, np.array([8]), np.array([8]), 8, 3, 3, 6, radius=2)
    assert (found.t[0, 0], *at(found)[0]) == (2, 8, 8) and (np.diff(found.dist[0]) >= 0).all()


def test_prefix_shrink_stops():
    assert np.allclose(K.shrink(np.array([[3.0, 0.5, 2.0]]), 1.0), [[(3 + 8**0.5) / 2, 0, 0]])
