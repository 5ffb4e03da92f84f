"""The filters on one window: (frames, channels, h, w) in, contributions (num, den) of the window out. sigma is in 8-bit units.

place tells where in its plane the window is; without it the window is the whole plane.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np

from selfsim.kernels import patches as K
from selfsim.kernels.patches import Matches, Place
from selfsim.operators.grid import positions
from selfsim.operators.transforms import dct, haar

#: The opponent transform, BT.601 full range with chroma around zero, sqrt(2) E[sqrt(chi2_16 / 16)], the share of sigma that BM3D takes.
OPPONENT = np.array([[3**-0.5, 3**-0.5, 3**-0.5], [2**-0.5, 0, -(2**-0.5)], [6**-0.5, -2 * 6**-0.5, 6**-0.5]])
YUV = np.array([[0.299, 0.587, 0.114], [-0.299 / 1.772, -0.587 / 1.772, 0.5], [0.5, -0.587 / 1.402, -0.114 / 1.402]])
UNGUIDED = 1.3923023108614498
BM3D_SIGMA = 0.75
#: Fixed values of the flat-patch mix: variances over sigma squared up to 0.9 are flat, from 1.6 on not at all.
FLAT, FLAT_SPAN = 1.6, 0.7
#: Fixed values of the sparse coder: atoms, their choice per patch, residual in sigmas, least pivot, weight of the noisy plane, seed and steps of the sampler.
ATOMS, MOST_ATOMS, RESIDUAL, PIVOT, NOISY = 256, 48, 1.15, 1e-4, 2.5
SEED, MULTIPLIER, INCREMENT = 0x4C535343, 1664525, 1013904223
LESSONS, SPARSE, SUPPORT = 256, 8, 32
#: Fixed values of the volume filter: (edge, most cubes, distance in sigma^2 a voxel) of the hard and the Wiener stage, step, reach, Kaiser shape, scale of the sums, least energy.
CUBES = ((4, 16, 2.9527), (5, 32, 0.7689))
CUBE_STEP, REACH, KAISER, SCALE, ENERGY = 3, 7, 2.0, 2.0**32, 1e-4
#: Fixed values of the dual-domain filter: tile, patch, centre, spatial sigma, range and frequency factors, weight to reach, least mass; of its exponential: 2^23 / ln 2 and 127 * 2^23.
TILE, PATCH, MID, SPACE, RANGE, FREQUENCY, REACHED, MASS = 128, 64, 31, 14.0, 0.7, 0.8, 2.0, 10.0
EXP_SLOPE, EXP_ZERO = 12102203.0, 1065353216.0


def identity(win: np.ndarray, centre: int) -> tuple[np.ndarray, np.ndarray]:
    """sigma = 0: the centre frame with weight one."""
    den = np.zeros(win.shape)
    den[centre] = 1
    return win * den, den


def per_channel(sigma, channels: int) -> np.ndarray:  # noqa: ANN001
    """Sigmas of the channels, as a fraction of full scale."""
    return np.broadcast_to(np.asarray(sigma, float) / 255, (channels,))


def bm3d(win, centre, ref=None, sigma=3.0, block_size=8, group_size=8, block_step=None, bm_range=9, radius=0, ps_num=2, ps_range=4, final=0, place=None):  # noqa: ANN001, ANN201
    """Groups are found once, on channel 0 (of ref where it is given), and serve every channel; channels with sigma 0 are copied."""
    s, step, place = BM3D_SIGMA * per_channel(sigma, win.shape[1]), block_step or min(8, block_size), place or Place.whole(win)
    if not (s > 0).any():
        return identity(win, centre)
    if final and ref is None:
        ref = np.stack([K.divide(*bm3d(win, t, None, sigma, block_size, group_size, step, bm_range, 0, place=place), win)[t] for t in range(len(win))])
    guide = (win if ref is None else ref)[:, :1]
    spots = K.spots_of(guide, place, block_size, step, bm_range, bm_range, group_size, radius, ps_num, ps_range)

    def work(found):  # noqa: ANN001, ANN202
        own, theirs = K.blocks_of(win, found, block_size), None if ref is None else K.blocks_of(ref, found, block_size)
        est, weight = own.copy(), np.zeros((len(own), 1, win.shape[1], 1, 1))
        for c in np.flatnonzero(s > 0):
            est[:, :, c], weight[:, 0, c, 0, 0] = K.bm3d_groups(own[:, :, c], None if theirs is None else theirs[:, :, c], s[c], group_size)
        return est, weight

    return _copied(win, centre, s, K.collect(win, centre, spots, work, block_size))


def reach(work: str, **a) -> int | None:  # noqa: ANN003
    """How far around a tile a window must go that the filter gives the tile's pixels as on the whole plane; None where that is the whole plane."""
    drift = a.get("radius", 0) * a.get("ps_range", 4)
    around = lambda span, b: 2 * (span + b + drift)
    if work == "bm3d":
        return (1 + bool(a.get("final"))) * around(a.get("bm_range", 9), a.get("block_size", 8))
    if work == "wnnm":
        return around(a.get("bm_range", 7), a.get("block_size", 8))
    if work in ("mcwnnm", "ncsr"):
        return a.get("iters", 2) * around(a.get("bm_range", 7), a.get("block_size", 8))
    if work == "twsc":
        return None if a.get("estimate_sigma") else a.get("iters", 2) * around(a.get("search_window", 60) // 2, a.get("block_size", 8))
    if work == "nlh":
        widest = lambda v, preset: max(x or preset for x in pair(v))
        return None if a.get("sigma") is None else (a.get("basic_iters", 3) + 1) * around(widest(a.get("search_window", (24, 16)), 24) // 2, widest(a.get("block_size"), 16))
    if work == "pnlm":
        return around(a.get("a", 2), a.get("block_size", 6))
    if work == "nlm":
        return 2 * a.get("a", 2) + a.get("s", 4)
    return None


def _finite(*stacks: np.ndarray | None) -> None:
    if any(v is not None and not np.isfinite(v).all() for v in stacks):
        raise K.NumericalFailure("samples must be finite")


def _copied(win: np.ndarray, centre: int, sigmas: np.ndarray, parts: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The contributions, with identity slices for the channels whose sigma is 0."""
    keep = (sigmas > 0)[None, :, None, None]
    return tuple(np.where(keep, p, q) for p, q in zip(parts, identity(win, centre), strict=True))


def _flat(win: np.ndarray, found: Matches, b: int) -> np.ndarray:
    """(n, channels b b, k) of the matches."""
    g = K.blocks_of(win, found, b)
    return g.reshape(*g.shape[:2], -1).transpose(0, 2, 1)


def _back(z: np.ndarray, channels: int, b: int) -> np.ndarray:
    return z.transpose(0, 2, 1).reshape(len(z), -1, channels, b, b)


def _by_rank(rank: np.ndarray, adaptive: int) -> np.ndarray | float:
    return (1 / np.maximum(rank, 1))[:, None, None, None, None] if adaptive else 1.0


def wnnm(win, centre, rclip=None, sigma=3.0, block_size=8, block_step=8, group_size=8, bm_range=7, radius=0, ps_num=2, ps_range=4, residual=0, adaptive_aggregation=1, place=None):  # noqa: ANN001, ANN201
    if sigma == 0:
        return identity(win, centre)

    def work(found):  # noqa: ANN001, ANN202
        z, rank = K.wnnm_groups(_flat(win, found, block_size), sigma / 255, bool(residual))
        return _back(z, win.shape[1], block_size), _by_rank(rank, adaptive_aggregation)

    return K.collect(win, centre, K.spots_of(win if rclip is None else rclip, place or Place.whole(win), block_size, block_step, bm_range, bm_range, group_size, radius, ps_num, ps_range), work, block_size)


def mcwnnm(win, centre, rclip=None, sigma=3.0, block_size=8, block_step=8, group_size=8, bm_range=7, radius=0, ps_num=2, ps_range=4, residual=1, adaptive_aggregation=0, iters=2, delta=0.1, admm_iter=10, rho=3.0, mu=1.001, place=None):  # noqa: ANN001, ANN201
    """rclip guides the first round only."""
    sigmas, place = per_channel(sigma, win.shape[1]), place or Place.whole(win)
    if not (sigmas > 0).any():
        return identity(win, centre)
    est = win
    for i in range(iters):
        est = est + delta * (win - est) if i else est

        def work(found, est=est):  # noqa: ANN001, ANN202
            z, rank = K.mcwnnm_groups(_flat(est, found, block_size), sigmas, bool(residual), admm_iter, rho, mu)
            return _back(z, win.shape[1], block_size), _by_rank(rank, adaptive_aggregation)

        guide = est if i or rclip is None else rclip
        num, den = K.collect(est, centre, K.spots_of(guide, place, block_size, block_step, bm_range, bm_range, group_size, radius, ps_num, ps_range), work, block_size, every=i + 1 < iters)
        est = K.divide(num, den, est)
    return _copied(win, centre, sigmas, (num, den))


def ncsr(win, centre, rclip=None, sigma=3.0, block_size=8, block_step=8, group_size=8, bm_range=7, radius=0, ps_num=2, ps_range=4, iters=2, delta=0.1, place=None):  # noqa: ANN001, ANN201
    """rclip guides the first round only; one channel."""
    if sigma == 0:
        return identity(win, centre)
    est, place = win, place or Place.whole(win)
    for i in range(iters):
        est = est + delta * (win - est) if i else est
        work = lambda found, est=est: (_back(K.ncsr_groups(_flat(est, found, block_size), found.dist, sigma / 255), win.shape[1], block_size), 1.0)
        guide = est if i or rclip is None else rclip
        num, den = K.collect(est, centre, K.spots_of(guide, place, block_size, block_step, bm_range, bm_range, group_size, radius, ps_num, ps_range), work, block_size, every=i + 1 < iters)
        est = K.divide(num, den, est)
    return num, den


def noise(plane: np.ndarray, guide: np.ndarray, place: Place | None = None, core: tuple[slice, slice] | None = None) -> tuple[float, int]:
    """(sum, groups): the blind noise of a plane is their quotient. 8 x 8 references every 4 pixels (that begin in the core), 16 matches in a window of 40 on the guide, root mean square gaps of each row to its three nearest."""
    total, groups, m, q = 0.0, 0, 64, 4
    both = np.stack([guide, plane])[None]
    for found in K.in_groups(K.spots_of(both[:, :1], place or Place.whole(both), 8, 4, 20, 19, 16, core=core)(0), 64 * 64 // 16):
        g, v = _flat(both[:, :1], found, 8), _flat(both[:, 1:], found, 8)
        near = K.nearest_rows(g, q)[:, :, 1:]
        gap = v[:, :, None, :] - v[np.arange(len(v))[:, None, None], near]
        total += float(np.sqrt((gap**2).mean(3)).sum()) / (m * (q - 1))
        groups += len(v)
    if not math.isfinite(total):
        raise K.NumericalFailure("the blind noise estimate is not finite")
    return total, groups


def blind(win: np.ndarray, rclip: np.ndarray | None, luma: bool) -> np.ndarray:
    """(frames, channels) of noise, as a fraction of full scale. With luma, channel 0 guides all, and what a plane did not select itself on is divided by the chi constant."""
    g = win if rclip is None else rclip
    measured = lambda plane, guide: (lambda total, groups: total / groups)(*noise(plane, guide))
    out = np.array([[measured(f[c], k[0 if luma else c]) for c in range(len(f))] for f, k in zip(win, g, strict=True)])
    if luma:
        out[:, (0 if rclip is not None else 1) :] /= UNGUIDED
    return out


def twsc(win, centre, rclip=None, sigma=3.0, block_size=8, block_step=None, group_size=8, search_window=60, radius=0, ps_num=2, ps_range=4, lambda2=1.0, iters=2, delta=0.0, estimate_sigma=0, admm_iter=10, rho=0.5, mu=1.1, tol=1e-6, cfast=0, place=None, told=None):  # noqa: ANN001, ANN201
    """Channels with a positive sigma jointly; with cfast, three of equal sigma go plane by plane through the opponent transform. rclip guides every round.

    told, a list, gets of the last round's groups what their solver says.
    """
    step, lo, place = block_step or min(8, block_size), search_window // 2, place or Place.whole(win)
    _finite(win, rclip)
    s = blind(win, rclip, False) if estimate_sigma else np.tile(per_channel(sigma, win.shape[1]), (len(win), 1))
    used = np.flatnonzero((s > 0).all(0))
    more = dict(block_size=block_size, block_step=step, group_size=group_size, search_window=search_window, radius=radius, ps_num=ps_num, ps_range=ps_range, lambda2=lambda2, iters=iters, delta=delta, admm_iter=admm_iter, rho=rho, mu=mu, tol=tol, place=place, told=told)
    if not len(used):
        return identity(win, centre)
    if cfast and len(used) == 3 and not estimate_sigma and radius == 0 and np.ptp(s) == 0:
        forward = lambda v: np.einsum("oc,tchw->tohw", OPPONENT, v)
        turned, guide, out = forward(win), None if rclip is None else forward(rclip), np.empty(win.shape)
        for c in range(3):
            out[:, c : c + 1] = K.divide(*twsc(turned[:, c : c + 1], centre, None if guide is None else guide[:, c : c + 1], s[0, 0] * 255, **more), turned[:, c : c + 1])
        return identity(np.einsum("oc,tohw->tchw", OPPONENT, out), centre)
    src, guide = win[:, used], None if rclip is None else rclip[:, used]
    est = src
    for i in range(iters):
        est, last = est + delta * (src - est) if i else est, i + 1 == iters

        def work(found, est=est, i=i, last=last):  # noqa: ANN001, ANN202
            y, original, own = _flat(est, found, block_size), _flat(src, found, block_size), s[found.t[:, 0]][:, used]
            gap = ((original - y) ** 2).mean(1) if i else 0.0
            columns = np.maximum(lambda2 * np.sqrt(np.abs((own**2).mean(1)[:, None] - gap) + np.zeros((len(y), y.shape[2]))), 1e-6)
            z, solved = K.twsc_groups(y, np.repeat(own, block_size**2, 1), columns, admm_iter, rho, mu, tol)
            if last and told is not None:
                told.append(solved)
            return _back(z, len(used), block_size), (1 / columns)[:, :, None, None, None]

        part = K.collect(est, centre, K.spots_of(est if guide is None else guide, place, block_size, step, lo, search_window - lo - 1, group_size, radius, ps_num, ps_range), work, block_size, every=not last)
        est = K.divide(*part, src)
    num, den = identity(win, centre)
    num[:, used], den[:, used] = part
    return num, den


def pair(value) -> tuple:  # noqa: ANN001
    """One value for both stages, or a value for each."""
    return tuple(value) if isinstance(value, (tuple, list)) and len(value) == 2 else (value[0],) * 2 if isinstance(value, (tuple, list)) else (value,) * 2


def nlh_shape(height: int, width: int, block_size=None, block_step=None, q=None) -> list[tuple[int, int, int]]:  # noqa: ANN001
    """(block, step, rows) of the two stages on a plane."""
    room = min(16, height, width)
    b = [given or min(preset, room) for given, preset in zip(pair(block_size), (8, 16), strict=True)]
    step = [given or min(preset, size) for given, preset, size in zip(pair(block_step), (6, 15), b, strict=True)]
    rows = [given or min(4, size * size) for given, size in zip(pair(q), b, strict=True)]
    return list(zip(b, step, rows, strict=True))


def reduced(luma: np.ndarray, h: int, w: int) -> np.ndarray:
    """A luma plane (frames, 1, H, W) as means over the areas that chroma samples of an h by w plane cover."""
    sy, sx = max(1, round(luma.shape[2] / h)), max(1, round(luma.shape[3] / w))
    return luma[:, :, : h * sy, : w * sx].reshape(*luma.shape[:2], h, sy, w, sx).mean((3, 5))


def nlh(win, centre, rclip=None, sigma=None, block_size=None, block_step=None, group_size=16, search_window=(24, 16), q=None, radius=0, ps_num=2, ps_range=4, basic_iters=3, lambda_basic=0.6, hard_strength=1.0, wiener_iters=2, wiener_sigma_scale=0.32, rgb=False, place=None):  # noqa: ANN001, ANN201
    """Hard rounds on every frame of the window, then one Wiener pass on the centre; sigma None is blind. RGB is filtered as YUV."""
    if rgb:
        turn = lambda v: np.einsum("yc,tchw->tyhw", YUV, v)
        inner = None if sigma is None else 255 * np.sqrt((YUV**2) @ per_channel(sigma, 3) ** 2)
        if inner is not None and not inner.any():
            return identity(win, centre)
        num, den = nlh(turn(win), centre, None if rclip is None else turn(rclip), inner, block_size, block_step, group_size, search_window, q, radius, ps_num, ps_range, basic_iters, lambda_basic, hard_strength, wiener_iters, wiener_sigma_scale, place=place)
        num, den, same = np.einsum("cy,tyhw->tchw", np.linalg.inv(YUV), num), den, identity(win, centre)
        return (num, den) if sigma is None else tuple(np.where((per_channel(sigma, 3) > 0)[None, :, None, None], p, z) for p, z in zip((num, den), same, strict=True))
    parts = nlh_planes([win[:, c : c + 1] for c in range(win.shape[1])], centre, None if rclip is None else [rclip[:, c : c + 1] for c in range(win.shape[1])], sigma, block_size, block_step, group_size, search_window, q, radius, ps_num, ps_range, basic_iters, lambda_basic, hard_strength, wiener_iters, wiener_sigma_scale, None if place is None else [place] * win.shape[1])
    return tuple(np.concatenate(v, 1) for v in zip(*parts, strict=True))


def nlh_planes(planes, centre, rclip=None, sigma=None, block_size=None, block_step=None, group_size=16, search_window=(24, 16), q=None, radius=0, ps_num=2, ps_range=4, basic_iters=3, lambda_basic=0.6, hard_strength=1.0, wiener_iters=2, wiener_sigma_scale=0.32, place=None):  # noqa: ANN001, ANN201
    """nlh of planes (frames, 1, h, w), each of its own size: luma, brought to a smaller plane's size by means over areas, finds the groups of all."""
    _finite(*planes, *(rclip or ()))
    shapes = [p.shape[2:] for p in planes]
    places = place or [Place.whole(p) for p in planes]
    guides = lambda luma: [luma if shape == shapes[0] else reduced(luma, *shape) for shape in shapes]
    if sigma is None:
        lead = guides((planes if rclip is None else rclip)[0])
        s = np.concatenate([blind(p, g, False) for p, g in zip(planes, lead, strict=True)], 1)
        s[:, (0 if rclip is not None else 1) :] /= UNGUIDED
    else:
        s = np.tile(per_channel(sigma, len(planes)), (len(planes[0]), 1))
    if not s.any():
        return [identity(p, centre) for p in planes]
    basic, out = list(planes), []
    for stage in range(basic_iters + 1):
        last = stage == basic_iters
        z, k, window = int(last), pair(group_size)[int(last)], pair(search_window)[int(last)]
        lo = window // 2
        if not last:
            basic = [lambda_basic * b + (1 - lambda_basic) * p for b, p in zip(basic, planes, strict=True)]
        lead, fresh = guides((basic if rclip is None else rclip)[0]), []
        for c, (plane, own, guide, place) in enumerate(zip(planes, basic, lead, places, strict=True)):
            b, step, rows = nlh_shape(place.height, place.width, block_size, block_step, q)[z]
            values, sums = plane if last else own, K.Sums(plane.shape)
            spots = K.spots_of(guide, place, b, step, lo, window - lo - 1, k, radius, ps_num, ps_range)
            for t in (centre,) if last else range(len(plane)):
                for found in K.in_groups(spots(t), b**4 // k + b * b * rows, power=True):
                    near = K.nearest_rows(_flat(guide, found, b), rows)
                    num, den = K.nlh_groups(_flat(values, found, b), near, _flat(own, found, b) if last else None, s[t, c], hard_strength, wiener_sigma_scale, wiener_iters)
                    weight = np.repeat(den[:, :, None], num.shape[2], 2)
                    sums.add(found, _back(num / np.maximum(weight, 1), 1, b), _back(weight, 1, b))
            fresh.append((sums.num, sums.den))
        if last:
            out = [_copied(p, centre, s[centre, c : c + 1], f) for c, (p, f) in enumerate(zip(planes, fresh, strict=True))]
        else:
            basic = [K.divide(*f, p) for p, f in zip(planes, fresh, strict=True)]
    return out


def half(d: int, a: int) -> list[tuple[int, int, int]]:
    """The offsets (frame, row, column) before the centre: one of each pair of opposite ones."""
    return [o for o in itertools.product(range(-d, 1), range(-a, a + 1), range(-a, a + 1)) if o < (0, 0, 0)]


def colour_distance(p: np.ndarray, q: np.ndarray, channels: str) -> np.ndarray:
    """Squared distance of the channels (c, h, w) of the mode, scaled to three channels."""
    d = (p - q) ** 2
    if channels == "RGB":
        m = (p[0] + q[0]) / 6
        return (2 / 3 + m) * d[0] + 4 / 3 * d[1] + (1 - m) * d[2]
    return d.sum(0) * {"Y": 3.0, "UV": 1.5, "YUV": 1.0}[channels]


def nlm(win, centre, rclip=None, d=1, a=2, s=4, h=1.2, channels="Y", wmode=0, wref=1.0, place=None):  # noqa: ANN001, ANN201
    """Pixel-wise means of the channels of a mode; frames repeat at the ends. Of two opposite offsets one weight map is made; the mirrored pixel reads it at its clamped place."""
    g, (rows, cols), last = win if rclip is None else rclip, win.shape[2:], len(win) - 1
    at = lambda v, y, x: v[..., np.clip(np.arange(rows) + y, 0, rows - 1)[:, None], np.clip(np.arange(cols) + x, 0, cols - 1)]
    scale = 255.0**2 / (3 * h * h * (2 * s + 1) ** 2)
    num, den, most = np.zeros(win.shape[1:]), np.zeros((rows, cols)), np.full((rows, cols), float(np.finfo(np.float32).eps))

    def weight(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        e = np.pad(colour_distance(p, q, channels), s, "edge")
        for axis in (0, 1):
            e = np.lib.stride_tricks.sliding_window_view(e, 2 * s + 1, axis=axis).sum(-1)
        u = e * scale
        return np.exp(-u) if wmode == 0 else np.maximum(1 - u, 0) ** {1: 1, 2: 2, 3: 8}[wmode]

    for od, oy, ox in half(d, a):
        back, ahead = max(0, centre + od), min(last, centre - od)
        w = weight(g[centre], at(g[back], oy, ox))
        mirrored = at(w if od == 0 else weight(g[ahead], at(g[centre], oy, ox)), -oy, -ox)
        num += w * at(win[back], oy, ox) + mirrored * at(win[ahead], -oy, -ox)
        den += w + mirrored
        most = np.maximum(most, np.maximum(w, mirrored))
    out = win.copy()
    out[centre] = (wref * most * win[centre] + num) / (wref * most + den)
    return identity(out, centre)


def pnlm(win, centre, sigma=3.0, a=2, block_size=6, group_size=16, place=None):  # noqa: ANN001, ANN201
    """Patchwise means with flat-patch mixing and tent windows, over every frame of the window."""
    if sigma == 0:
        return identity(win, centre)
    p, s, sums = block_size, sigma / 255, K.Sums(win.shape)
    tent = 1 - np.abs(2 * np.arange(p) + 1 - p) / p
    ys, xs = (place or Place.whole(win)).grid(win, p, p // 2)
    strip = max(1, K.AT_ONCE // max(1, len(xs) * (2 * a + 1) ** 2 * len(win)))
    for r in range(0, len(ys), strip):
        for found in K.in_groups(K.dense_search(win, centre, ys[r : r + strip], xs, p, a, group_size), win.shape[1] * p * p):
            g = K.blocks_of(win, found, p)
            w = np.exp(-np.maximum(found.dist / p**2 - 2 * s * s, 0) / (4 * s * s))
            w[:, 0] = 1
            raw = np.einsum("nk,nkcij->ncij", w, g) / w.sum(1)[:, None, None, None]
            alpha = np.clip((FLAT - g.var(axis=(1, 3, 4)) / s**2) / FLAT_SPAN, 0, 1)[:, :, None, None]
            est = alpha * g.mean(axis=(1, 3, 4))[:, :, None, None] + (1 - alpha) * raw
            sums.add(found.some(np.arange(len(g)), 1), est[:, None], np.outer(tent, tent))
    return sums.num, sums.den


def dct_atoms(b: int, atoms: int) -> np.ndarray:
    """(b b, n): the two-dimensional DCT atoms of b by b patches, at most atoms of them, by the sum of their frequencies, then rows first."""
    c = np.array(dct(b))
    order = sorted((u + v, u + v * b, u, v) for v in range(b) for u in range(b))[:atoms]
    return np.array([np.outer(c[v], c[u]).ravel() for *_, u, v in order]).T


def unit(d: np.ndarray) -> np.ndarray:
    """Columns of length one; one of hardly any length becomes the first unit vector."""
    norm = (d**2).sum(0)
    out = d / np.sqrt(np.maximum(norm, TINY_NORM))
    out[:, norm < TINY_NORM] = np.eye(len(d), 1)
    return out


TINY_NORM = 1e-12


def omp(d: np.ndarray, x: np.ndarray, most: int, tiny: float = 1e-12) -> np.ndarray:
    """(atoms, n): codes of the columns of x by orthogonal matching pursuit with at most `most` of the unit atoms d."""
    out = np.zeros((d.shape[1], x.shape[1]))
    for j in range(x.shape[1]):
        chosen, r, coef = [], x[:, j], np.zeros(0)
        for _ in range(min(most, d.shape[1])):
            score = np.abs(d.T @ r)
            score[chosen] = 0
            if score.max() < tiny:
                break
            chosen.append(int(score.argmax()))
            coef = np.linalg.lstsq(d[:, chosen], x[:, j], rcond=None)[0]
            r = x[:, j] - d[:, chosen] @ coef
            if r @ r < tiny:
                break
        out[chosen, j] = coef
    return out


def dictionary(patches: np.ndarray, block: int) -> np.ndarray:
    """(m, atoms) of patches (n, m), centred: DCT atoms, then sampled patches, and one round of K-SVD over LESSONS patches evenly spread."""
    n, m = patches.shape
    atoms = min(ATOMS, n)
    d, state = [dct_atoms(block, atoms)], SEED
    drawn = []
    for _ in range(atoms - d[0].shape[1]):
        state = (state * MULTIPLIER + INCREMENT) % 2**32
        drawn.append(state % n)
    d = unit(np.concatenate([d[0], patches[drawn].T], 1))
    if n < 2:
        return d
    some = min(n, LESSONS)
    y = patches[np.arange(some) * n // some].T
    codes = omp(d, y, SPARSE)
    r = d @ codes
    for k in range(atoms):
        use = np.flatnonzero(np.abs(codes[k]) > 1e-8)[: min(some, SUPPORT)]
        if len(use):
            old, coef = d[:, k].copy(), codes[k, use].copy()
            u, s, v = np.linalg.svd(y[:, use] - r[:, use] + np.outer(old, coef), full_matrices=False)
            sign = -1.0 if old @ u[:, 0] < 0 else 1.0
            d[:, k : k + 1] = unit(sign * u[:, :1])
            codes[k, use] = sign * s[0] * v[0]
            r[:, use] += np.outer(d[:, k], codes[k, use]) - np.outer(old, coef)
    return d


def sparse(d: np.ndarray, x: np.ndarray, budget: float) -> np.ndarray:
    """Approximations of the rows of x (n, m), all in step: atoms of the largest correlation, each made orthogonal to those before it, until
    the squared residual is at most budget, MOST_ATOMS are chosen, or what an atom adds is no more than PIVOT of it."""
    n, m = x.shape
    most, norm = min(m, d.shape[1], MOST_ATOMS), (d**2).sum(0)
    r, used, basis = x.copy(), np.zeros((n, d.shape[1]), bool), np.zeros((n, most, m))
    energy, live = (x**2).sum(1), np.arange(n)
    for k in range(most):
        live = live[energy[live] > budget]
        if not len(live):
            break
        score = np.where(used[live], -1, np.abs(r[live] @ d) / np.sqrt(norm))
        best = score.argmax(1)
        a, q = d.T[best], basis[live, :k]
        new = a - (q.transpose(0, 2, 1) @ (q @ a[:, :, None]))[:, :, 0]
        # once more, against rounding
        new -= (q.transpose(0, 2, 1) @ (q @ new[:, :, None]))[:, :, 0]
        pivot = (new**2).sum(1)
        good = pivot > PIVOT * norm[best]
        live, best, new = live[good], best[good], new[good] / np.sqrt(pivot[good])[:, None]
        z = (new * r[live]).sum(1)
        r[live] -= z[:, None] * new
        energy[live] -= z * z
        basis[live, k], used[live, best] = new, True
    return x - r


def lssc(win, centre, sigma=3.0, block_size=8, block_step=None, place=None, own_dictionary=None):  # noqa: ANN001, ANN201
    """Sparse codes of each patch over a dictionary of the plane; the noisy plane joins the average. A patch that isn't finite, or whose code exceeds 8, is copied."""
    if sigma == 0:
        return identity(win, centre)
    b, step, s, sums = block_size, block_step or max(1, block_size // 2), sigma / 255, K.Sums(win.shape)
    ys, xs = (place or Place.whole(win)).grid(win, b, step)
    for c in range(win.shape[1]):
        y, x = (v.ravel()[:, None] for v in np.meshgrid(ys, xs, indexing="ij"))
        every = Matches(np.zeros(y.shape), np.full(y.shape, centre), y, x, np.ones(len(y), np.int64))
        if not len(y):
            continue
        at = lambda rows, c=c, every=every: K.blocks_of(win[:, c : c + 1], every.some(rows, 1), b).reshape(len(rows), -1)
        if own_dictionary is None:
            # the dictionary reads the sampled patches only, but their numbers are of all
            p = at(np.arange(len(y)))
            d = dictionary(p - p.mean(1, keepdims=True), b)
        else:
            d = own_dictionary
        for k in range(0, len(y), 4096):
            rows = np.arange(k, min(len(y), k + 4096))
            p = at(rows)
            mean = p.mean(1, keepdims=True)
            fine = np.isfinite(p).all(1)
            code = sparse(d, np.where(fine[:, None], p - mean, 0), b * b * (RESIDUAL * s) ** 2)
            fine &= (np.abs(code) <= 8).all(1)
            sums.add(every.some(rows, 1), np.where(fine[:, None], code + mean, p).reshape(-1, 1, 1, b, b), 1.0, np.array([c]))
        w = NOISY * (b / step) ** 2 / sigma
        sums.num[centre, c] += w * win[centre, c]
        sums.den[centre, c] += w
    return sums.num, sums.den


def cube_matches(basic: np.ndarray, cube: int, most: int, limit: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(flat places (references, k), k) of the cubes nearest each reference within the limit, itself first, cut to powers of two; references by slices of a plane of them."""
    step, side = [np.array(positions(n, cube, CUBE_STEP)) for n in basic.shape], 2 * REACH + 1
    for z in step[0]:
        rows = max(1, K.AT_ONCE // (len(step[2]) * side**3))
        for r in range(0, len(step[1]), rows):
            ys, xs = step[1][r : r + rows], step[2]
            dist = np.full((len(ys) * len(xs), side, side * side), np.inf)
            for i in range(max(-REACH, -z), min(REACH, basic.shape[0] - cube - z) + 1):
                # the cube's planes as channels of a block
                dist[:, i + REACH] = K.windows(basic[z : z + cube], basic[z + i : z + i + cube], ys, xs, cube, REACH, REACH)
            dist = dist.reshape(len(ys) * len(xs), -1)
            dist[:, (REACH * side + REACH) * side + REACH] = -1
            count = np.minimum((dist <= limit).sum(1), most)
            count = 1 << np.log2(np.maximum(count, 1)).astype(np.int64)
            best = K.first_of(np.where(dist <= limit, dist, np.inf), most)
            dz, dy, dx = np.unravel_index(best, (side,) * 3)
            gy, gx = (v.ravel()[:, None] for v in np.meshgrid(ys, xs, indexing="ij"))
            flat = ((z + dz - REACH) * basic.shape[1] + gy + dy - REACH) * basic.shape[2] + gx + dx - REACH
            for k in np.unique(count):
                yield flat[count == k][:, :k], int(k)


def bm4d(win, centre, sigma=3.0, place=None):  # noqa: ANN001, ANN201
    """Cubes of a volume (frames, h, w): a hard and a Wiener stage; a volume smaller than a stage's cube skips it. Sums are whole numbers, exact in any order."""
    if sigma == 0:
        return win.copy(), np.ones(win.shape)
    s, out = sigma / 255, win.copy()
    for c in range(win.shape[1]):
        src = win[:, c]
        basic = src
        for stage, (cube, most, tau) in enumerate(CUBES):
            if min(src.shape) < cube:
                continue
            basis, kaiser = np.array(dct(cube)), np.kaiser(cube, KAISER)
            three = np.kron(basis, np.kron(basis, basis))
            window = np.kron(kaiser, np.kron(kaiser, kaiser))
            span = np.arange(cube)
            inner = ((span[:, None, None] * src.shape[1] + span[:, None]) * src.shape[2] + span).ravel()
            num, den = np.zeros(src.size, np.int64), np.zeros(src.size, np.int64)
            for flat, k in cube_matches(basic, cube, most, tau * cube**3 * s * s):
                h = np.array(haar(k))
                for r in range(0, len(flat), max(1, K.AT_ONCE // (k * cube**3))):
                    at = flat[r : r + max(1, K.AT_ONCE // (k * cube**3)), :, None] + inner
                    f = h @ (src.reshape(-1)[at] @ three.T)
                    if stage == 0:
                        keep = np.abs(f) >= K.LAMBDA * s
                        f, w = f * keep, 1 / np.maximum(keep.sum((1, 2)), 1)
                    else:
                        g = (h @ (basic.reshape(-1)[at] @ three.T)) ** 2
                        gain = g / (g + s * s)
                        f, w = f * gain, 1 / np.maximum((gain**2).sum((1, 2)), ENERGY)
                    weight = w[:, None, None] * window
                    est = (h.T @ f) @ three
                    np.add.at(num, at.ravel(), np.rint(weight * est * SCALE).astype(np.int64).ravel())
                    np.add.at(den, at.ravel(), np.broadcast_to(np.rint(weight * SCALE).astype(np.int64), est.shape).ravel())
            basic = np.where(den > 0, num / np.maximum(den, 1), src.reshape(-1)).reshape(src.shape)
        out[:, c] = basic
    return out, np.ones(win.shape)


def fast_exp(x: np.ndarray) -> np.ndarray:
    """exp read off a single float's bit pattern; zero below about -87.3."""
    bits = (np.maximum(np.float32(EXP_SLOPE) * x.astype(np.float32), np.float32(-EXP_ZERO))).astype(np.int64) + int(EXP_ZERO)
    return np.where(bits <= 0, 0, bits).astype(np.int32).view(np.float32).astype(float)


def even_tiles(n: int, edge: int) -> list[tuple[int, int]]:
    """(start, end) of the tiles along n pixels: n / edge of them, rounded, one at least, of even sizes."""
    many = max(1, (n + edge // 2) // edge)
    return [(n * i // many, n * (i + 1) // many) for i in range(many)]


def in_squares(h: int, w: int) -> np.ndarray:
    """Flat places of a core in the order in which the first of equal weights is taken: down each column of a 2 x 2 square, its columns left to right, and so for squares of squares."""
    y, x = np.divmod(np.arange(h * w), w)
    code = np.zeros(h * w, np.int64)
    for k in range(max(h, w).bit_length()):
        code |= (y >> k & 1) << 2 * k | (x >> k & 1) << 2 * k + 1
    return np.argsort(code, kind="stable")


def da3d_tile(y: np.ndarray, g: np.ndarray, s2: float) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(num, den, patches, those that took the guide) of a tile padded on all sides: patches at the pixels of least weight until all of the core weigh enough."""
    h, w = y.shape[1] - PATCH + 1, y.shape[2] - PATCH + 1
    num, den, order = np.zeros(y.shape), np.zeros(y.shape[1:]), in_squares(h, w)
    dy, dx = np.mgrid[-MID : PATCH - MID, -MID : PATCH - MID].astype(float)
    d2, patches, guided = dy**2 + dx**2, 0, 0
    while True:
        core = den[MID : MID + h, MID : MID + w].ravel()[order]
        least = int(core.argmin())
        if core[least] >= REACHED:
            return num, den, patches, guided
        cy, cx = divmod(int(order[least]), w)
        at = (slice(None), slice(cy, cy + PATCH), slice(cx, cx + PATCH))
        py, pg = y[at].copy(), g[at].copy()
        mid = pg[:, MID, MID][:, None, None].copy()
        range2 = ((pg - mid) ** 2).sum(0)
        kr = fast_exp(-(range2 / (10 * RANGE * s2) + d2 / (4 * SPACE**2)))
        a, b, c = (kr * dx * dx).sum(), (kr * dx * dy).sum(), (kr * dy * dy).sum()
        plane = np.zeros_like(py)
        if a * c - b * b >= 1e-4:
            u, v = (kr * dx * (py - mid)).sum((1, 2)), (kr * dy * (py - mid)).sum((1, 2))
            plane = ((c * u - b * v) / (a * c - b * b))[:, None, None] * dx + ((a * v - b * u) / (a * c - b * b))[:, None, None] * dy
        py, pg = py - plane, pg - plane
        k = fast_exp(-(((pg - mid) ** 2).sum(0) / (RANGE * s2) + d2 / (2 * SPACE**2)))
        patches += 1
        if k.sum() < MASS:
            out = (pg + plane) * k * k
            guided += 1
        else:
            ay, ag = ((k * z).sum((1, 2))[:, None, None] / k.sum() for z in (py, pg))
            fy, fg = np.fft.rfft2(k * py + (1 - k) * ay), np.fft.rfft2(k * pg + (1 - k) * ag)
            gain = fast_exp(-FREQUENCY * s2 * (k * k).sum() / np.maximum(np.abs(fg) ** 2, 1e-30))
            gain[:, 0, 0] = 1
            out = ((np.fft.irfft2(fy * gain, s=(PATCH, PATCH)) - (1 - k) * ay) + plane * k) * k
        num[at] += out
        den[at[1:]] += k * k


def da3d(win, centre, ref, sigma=3.0, place=None, told=None):  # noqa: ANN001, ANN201
    """Dual-domain filtering with a guide, on a grid of even tiles of the plane: those that lie in the window with the margin that patches
    need, inside the plane. sigma = 0 gives the guide. told, a list, gets (patches, those that took the guide) of each tile."""
    if sigma == 0:
        return identity(ref, centre)
    s2, (h, w), place, after = (sigma / 255) ** 2, win.shape[2:], place or Place.whole(win), PATCH - MID - 1
    pad = ((0, 0), (MID, after), (MID, after))
    y, g = np.pad(win[centre], pad, "symmetric"), np.pad(ref[centre], pad, "symmetric")
    num, den = np.zeros(y.shape), np.zeros(y.shape[1:])
    inside = lambda n, o, size: [(a - o, b - o) for a, b in even_tiles(n, TILE) if max(0, a - after) >= o and min(n, b + after) <= o + size]
    for y0, y1 in inside(place.height, place.y, h):
        for x0, x1 in inside(place.width, place.x, w):
            at = (slice(None), slice(y0, y1 + PATCH - 1), slice(x0, x1 + PATCH - 1))
            n, d, *counts = da3d_tile(y[at], g[at], s2)
            num[at] += n
            den[at[1:]] += d
            if told is not None:
                told.append(tuple(counts))
    full, weight = np.zeros(win.shape), np.zeros(win.shape)
    full[centre], weight[centre] = num[:, MID : MID + h, MID : MID + w], den[MID : MID + h, MID : MID + w]
    return full, weight


def da3d_colour(win, centre, ref, sigma=3.0, place=None):  # noqa: ANN001, ANN201
    """Three channels jointly, in opponent colours."""
    forward = lambda v: np.einsum("oc,tchw->tohw", OPPONENT, v)
    # the weights are those of all channels, so that sums are turned back as samples are
    num, den = da3d(forward(win), centre, forward(ref), sigma, place)
    return np.einsum("oc,tohw->tchw", OPPONENT, num), den
