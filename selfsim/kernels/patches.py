"""Pure numpy kernels of the patch filters, for all references of a window at once. Stacks are (frames, channels, h, w) in double precision.

A filter returns contributions (num, den) for every frame of its window; their sums over
centres, by target frame, divided, are the output. A window may be a part of a plane: its
Place tells where, as references stand on the plane's own grid.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np

from selfsim.operators.grid import positions
from selfsim.operators.transforms import dct, haar

#: The hard threshold in sigmas, the least weight that is divided by.
LAMBDA, TINY = 2.7, 1e-12
#: Stands for a distance that is not finite: after all finite ones, before none.
ODD = 1e300
#: Array elements that a step works on at once.
AT_ONCE = 1 << 21
#: Elements of differences that stay in a core's cache.
IN_CACHE = 1 << 15
#: Elements of groups that are solved together.
SOLVED_AT_ONCE = 1 << 18


class NumericalFailure(ArithmeticError):
    """Samples or sums that aren't finite, where a filter needs them so."""


@dataclass(frozen=True)
class Place:
    """A window of a plane of height by width pixels: its first row and column."""

    y: int
    x: int
    height: int
    width: int

    @classmethod
    def whole(cls, stack: np.ndarray) -> Place:
        return cls(0, 0, *stack.shape[-2:])

    def grid(self, stack: np.ndarray, b: int, step: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and columns, within the window, of the plane's references whose block is inside the window."""
        at = lambda n, o, size: np.array([p - o for p in positions(n, b, step) if o <= p and p + b <= o + size], np.int64)
        return at(self.height, self.y, stack.shape[-2]), at(self.width, self.x, stack.shape[-1])


@dataclass
class Matches:
    """Of each reference (rows) the found blocks, itself first: distance (nan if it is not finite), frame, row and column; count of them are real."""

    dist: np.ndarray
    t: np.ndarray
    y: np.ndarray
    x: np.ndarray
    count: np.ndarray

    def some(self, rows: np.ndarray, k: int) -> Matches:
        return Matches(self.dist[rows, :k], self.t[rows, :k], self.y[rows, :k], self.x[rows, :k], self.count[rows])


def even_parts(at: np.ndarray) -> list[np.ndarray]:
    """Positions in parts of one step each: all but the last of a grid, and its last, if it doesn't follow the step."""
    return [at] if len(at) < 3 or (np.diff(at) == at[1] - at[0]).all() else [at[:-1], at[-1:]]


def windows(own: np.ndarray, other: np.ndarray, ys: np.ndarray, xs: np.ndarray, b: int, lo: int, hi: int) -> np.ndarray:
    """(references, offsets) squared distances of the blocks at ys by xs of own (channels, h, w) to those of other at all offsets
    [-lo, hi] squared, in raster order; inf outside the plane, ODD for what is not finite.

    Rows of references are taken together as far as their differences stay in the cache; blocks and windows are views, and each
    column of the blocks adds its squared differences.
    """
    (channels, h, w), side, view = own.shape, lo + hi + 1, np.lib.stride_tricks.as_strided
    out = np.empty((len(ys), len(xs), side, side))
    wide = np.pad(other, ((0, 0), (lo, hi), (lo, hi)), "edge")
    for part_x in even_parts(xs) if len(xs) and len(ys) else []:
        sx, nx, x0 = int(part_x[1] - part_x[0]) if len(part_x) > 1 else 1, len(part_x), int(part_x[0])
        at_x = slice(int(np.searchsorted(xs, x0)), int(np.searchsorted(xs, x0)) + nx)
        for part_y in even_parts(ys):
            sy = int(part_y[1] - part_y[0]) if len(part_y) > 1 else 1
            many = max(1, IN_CACHE // (channels * b * nx * side))
            for r in range(0, len(part_y), many):
                y0, ny = int(part_y[r]), len(part_y[r : r + many])
                ref = np.ascontiguousarray(view(own[:, y0:, x0:], (channels, ny, b, nx, b), (own.strides[0], sy * own.strides[1], own.strides[1], sx * own.strides[2], own.strides[2])).transpose(4, 0, 1, 2, 3))[..., None]
                first = int(np.searchsorted(ys, y0))
                gap, total = np.empty((channels, ny, b, nx, side)), out[first : first + ny, at_x]
                for i in range(side):
                    for c in range(b):
                        near = view(wide[:, y0 + i :, x0 + c :], (channels, ny, b, nx, side), (wide.strides[0], sy * wide.strides[1], wide.strides[1], sx * wide.strides[2], wide.strides[2]))
                        np.subtract(near, ref[c], out=gap)
                        np.multiply(gap, gap, out=gap)
                        if c:
                            total[:, :, i] += gap.sum((0, 2))
                        else:
                            total[:, :, i] = gap.sum((0, 2))
    out[~np.isfinite(out)] = ODD
    off = np.arange(-lo, hi + 1)
    for axis, at, last in ((0, ys, h - b), (1, xs, w - b)):
        beyond = (at[:, None] + off < 0) | (at[:, None] + off > last)
        if beyond.any():
            # (references of the axis, offsets of the axis) first
            out.transpose((0, 2, 1, 3) if axis == 0 else (1, 3, 0, 2))[beyond] = np.inf
    return out.reshape(len(ys) * len(xs), -1)


def first_of(dist: np.ndarray, k: int) -> np.ndarray:
    """(rows, k) places of the k least of each row, ties by place."""
    k = min(k, dist.shape[1])
    if dist.shape[1] > 8 * k:
        # all that may be among the k least, in order of place, then a stable sort of these
        bound = np.partition(dist, k - 1, axis=1)[:, k - 1 : k]
        most = int((dist <= bound).sum(1).max(initial=k))
        if most < dist.shape[1] // 2:
            near = np.argsort(dist > bound, axis=1, kind="stable")[:, :most]
            return np.take_along_axis(near, np.argsort(np.take_along_axis(dist, near, 1), axis=1, kind="stable")[:, :k], 1)
    return np.argsort(dist, axis=1, kind="stable")[:, :k]


def search(guide: np.ndarray, t0: int, ys: np.ndarray, xs: np.ndarray, b: int, lo: int, hi: int, k: int, radius: int = 0, ps_num: int = 2, ps_range: int = 4) -> Matches:
    """The k nearest blocks of each reference at ys by xs, the reference first, then by distance (finite ones before others), t, y, x.

    In the reference's frame the window is [-lo, hi]; outwards, frame by frame, the union of the
    windows of ps_range around the last frame's ps_num winners, always against the reference.
    """
    frames, _, h, w = guide.shape
    ry, rx = (a.ravel() for a in np.meshgrid(ys, xs, indexing="ij"))
    side = lo + hi + 1
    dist = windows(guide[t0], guide[t0], ys, xs, b, lo, hi)
    dist[:, lo * side + lo] = -1
    best = first_of(dist, max(k, ps_num))
    got = lambda d, place: np.take_along_axis(d, place, 1)
    found = [(got(dist, best), np.full(best.shape, t0), ry[:, None] + best // side - lo, rx[:, None] + best % side - lo)]
    seeds = tuple(v[:, :ps_num] for v in found[0])
    if radius:
        blocks = np.lib.stride_tricks.sliding_window_view(guide, (b, b), (2, 3))
        ref, around = blocks[t0, :, ry, rx], np.arange(-ps_range, ps_range + 1)
        for step in (-1, 1):
            last = seeds
            for t in range(t0 + step, t0 + step * (radius + 1), step):
                if not 0 <= t < frames:
                    break
                real = np.repeat(np.isfinite(last[0]), len(around) ** 2, 1)
                y = (last[2][:, :, None, None] + around[:, None] + 0 * around).reshape(len(ry), -1)
                x = (last[3][:, :, None, None] + around + 0 * around[:, None]).reshape(len(ry), -1)
                real &= (y >= 0) & (y <= h - b) & (x >= 0) & (x <= w - b)
                # the union in raster order, each place once
                flat = np.sort(np.where(real, y * w + x, h * w), axis=1)
                real = (flat < h * w) & np.c_[np.ones(len(flat), bool), flat[:, 1:] != flat[:, :-1]]
                y, x = np.where(real, flat // w, 0), np.where(real, flat % w, 0)
                dist = np.full(flat.shape, np.inf)
                step_rows = max(1, AT_ONCE // (flat.shape[1] * ref[0].size))
                for r in range(0, len(ry), step_rows):
                    s = slice(r, r + step_rows)
                    d = np.square(blocks[t][:, y[s], x[s]].transpose(1, 2, 0, 3, 4) - ref[s, None]).sum((2, 3, 4))
                    dist[s] = np.where(real[s], np.where(np.isfinite(d), d, ODD), np.inf)
                best = first_of(dist, max(k, ps_num))
                here = (got(dist, best), np.full(best.shape, t), got(y, best), got(x, best))
                found.append(here)
                last = tuple(v[:, :ps_num] for v in here)
    dist, t, y, x = (np.concatenate(v, 1) for v in zip(*found, strict=True))
    order = np.lexsort((x, y, t, dist), axis=1)[:, :k]
    return settled(*(got(v, order) for v in (dist, t, y, x)))


def dense_search(guide: np.ndarray, centre: int, ys: np.ndarray, xs: np.ndarray, b: int, a: int, k: int) -> Matches:
    """The k nearest blocks within a pixels in every frame of the window, the reference first, then by distance, t, y, x."""
    side, n = 2 * a + 1, (2 * a + 1) ** 2
    dist = np.concatenate([windows(guide[centre], guide[t], ys, xs, b, a, a) for t in range(len(guide))], 1)
    dist[:, centre * n + a * side + a] = -1
    best = first_of(dist, k)
    ry, rx = (v.ravel()[:, None] for v in np.meshgrid(ys, xs, indexing="ij"))
    at = best % n
    return settled(np.take_along_axis(dist, best, 1), best // n, ry + at // side - a, rx + at % side - a)


def settled(dist: np.ndarray, t: np.ndarray, y: np.ndarray, x: np.ndarray) -> Matches:
    """Matches of sorted rows: the reference's distance is 0, what lies outside the plane doesn't count."""
    count = (dist < np.inf).sum(1)
    dist = np.where(dist >= ODD, np.nan, dist)
    dist[:, 0] = 0
    return Matches(dist, t, y, x, count)


def blocks_of(stack: np.ndarray, found: Matches, b: int) -> np.ndarray:
    """(references, k, channels, b, b) of the matches."""
    return np.lib.stride_tricks.sliding_window_view(stack, (b, b), (2, 3))[found.t, :, found.y, found.x]


def in_groups(found: Matches, size: int, power: bool = False) -> Iterator[Matches]:
    """Parts of matches of equal counts, of about SOLVED_AT_ONCE elements with size for a block; power: cut to the largest power of two."""
    count = 1 << (np.log2(np.maximum(found.count, 1)).astype(np.int64)) if power else found.count
    for k in np.unique(count):
        rows = np.flatnonzero(count == k)
        step = max(1, SOLVED_AT_ONCE // (int(k) * size))
        for r in range(0, len(rows), step):
            yield found.some(rows[r : r + step], int(k))


class Sums:
    """num and den of a window."""

    def __init__(self, shape: tuple[int, ...]) -> None:
        self.num, self.den, self.shape = np.zeros(shape), np.zeros(shape), shape

    def add(self, found: Matches, est: np.ndarray, weight: np.ndarray | float, channels: np.ndarray | None = None) -> None:
        """Adds blocks est (references, k, channels, b, b) with weights that broadcast to them."""
        _, c, h, w = self.shape
        b = est.shape[-1]
        own = np.arange(c) if channels is None else channels
        first = ((found.t[:, :, None] * c + own) * h + found.y[:, :, None]) * w + found.x[:, :, None]
        at = (first[..., None, None] + (np.arange(b)[:, None] * w + np.arange(b))).ravel()
        weight = np.broadcast_to(weight, est.shape)
        np.add.at(self.num.reshape(-1), at, (est * weight).ravel())
        np.add.at(self.den.reshape(-1), at, weight.ravel())


def bm3d_groups(p: np.ndarray, ref: np.ndarray | None, sigma: float, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hard thresholding, or Wiener gains from the reference groups, in the 3-D transform of groups (n, k, b, b) zero-padded to size; and their weights."""
    (n, k, b, _), c = p.shape, np.array(dct(p.shape[-1]))
    # columns of the padding multiply zeros
    g = np.array(haar(size))[:, :k]
    forward = lambda a: np.matmul(g, (c @ a @ c.T).reshape(n, k, b * b))
    z = forward(p)
    if ref is None:
        keep = np.abs(z) >= LAMBDA * sigma
        keep[:, 0, 0] = True
        z, weight = z * keep, 1.0 / np.maximum(keep.sum((1, 2)), 1)
    else:
        r = forward(ref) ** 2
        gain = r / (r + sigma * sigma) if sigma > 0 else np.ones_like(r)
        gain[:, 0, 0] = 1
        z, weight = z * gain, 1.0 / np.maximum((gain**2).sum((1, 2)), TINY)
    return c.T @ np.matmul(g.T, z).reshape(p.shape) @ c, weight


def shrink(s: np.ndarray, c: float, start: int = 0) -> np.ndarray:
    """Singular values (n, r), shrunk while their square exceeds c; zero from the first that doesn't."""
    out = s.copy()
    own = s[:, start:]
    ok = np.logical_and.accumulate(own * own > c, axis=1)
    out[:, start:] = np.where(ok, (own + np.sqrt(np.maximum(own * own - c, 0))) / 2, 0)
    return out


def economy(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Singular values (n, k), falling, and right singular vectors (n, k, k) in columns of y (n, m, k), from the k by k products.

    Values below about 1e-8 of the largest are rounding; what the filters do with them is to drop them.
    """
    e, v = np.linalg.eigh(y.transpose(0, 2, 1) @ y)
    return np.sqrt(np.maximum(e[:, ::-1], 0)), v[:, :, ::-1]


def scaled(y: np.ndarray, s: np.ndarray, new: np.ndarray, v: np.ndarray) -> np.ndarray:
    """y with its singular values replaced."""
    return y @ ((v * (new / np.maximum(s, 1e-300))[:, None]) @ v.transpose(0, 2, 1))


def wnnm_groups(y: np.ndarray, sigma: float, residual: bool) -> tuple[np.ndarray, np.ndarray]:
    """y (n, m, k): weighted nuclear norm shrinkage, and the ranks kept."""
    mean = y.mean(2, keepdims=True) if residual else 0.0
    y = y - mean
    s, v = economy(y)
    new = shrink(s, 8 * math.sqrt(2 * y.shape[2]) * sigma * sigma, 0 if residual else 1)
    return scaled(y, s, new, v) + mean, (new > 0).sum(1)


def mcwnnm_groups(y: np.ndarray, sigmas: np.ndarray, residual: bool, rounds: int = 10, rho: float = 3.0, mu: float = 1.001) -> tuple[np.ndarray, np.ndarray]:
    """y (n, channels b b, k), by channel: ADMM with channel weights."""
    mean = y.mean(2, keepdims=True) if residual else 0.0
    y = y - mean
    least = sigmas[sigmas > 0].min()
    w = np.repeat(least / np.where(sigmas > 0, sigmas, 1e-6 * least), y.shape[1] // len(sigmas))[:, None] ** 2
    c, z, a, rank = 8 * math.sqrt(2 * y.shape[2]) * least**2, np.zeros_like(y), np.zeros_like(y), np.zeros(len(y), int)
    for _ in range(rounds):
        x = (w * y + rho / 2 * (z - a / rho)) / (w + rho / 2)
        near = x + a / rho
        s, v = economy(near)
        new = shrink(s, c * 2 / rho, 0 if residual else 1)
        z, rank = scaled(near, s, new, v), (new > 0).sum(1)
        a, rho = a + rho * (x - z), min(1e4, mu * rho)
    return z + mean, rank


def ncsr_groups(y: np.ndarray, dist: np.ndarray, sigma: float) -> np.ndarray:
    """Centralised sparse coding of y (n, m, k) in its own left singular basis."""
    mean = y.mean(2, keepdims=True)
    y = y - mean
    s, v = economy(y)
    # a basis vector of a value that is only rounding has no part in any patch
    u = (y @ v) * np.where(s > 1e-7 * s[:, :1], 1 / np.maximum(s, 1e-300), 0)[:, None]
    coef = s[:, :, None] * v.transpose(0, 2, 1)
    w = np.exp(-dist / max(2 * y.shape[1] * sigma**2, TINY))
    beta = coef @ (w / w.sum(1, keepdims=True))[:, :, None]
    d = coef - beta
    tau = 2 * math.sqrt(2) * sigma**2 / (np.sqrt((d**2).mean(2, keepdims=True)) + TINY)
    return u @ (np.sign(d) * np.maximum(np.abs(d) - tau, 0) + beta) + mean


@dataclass
class Solved:
    """What the solver of twsc_groups says of each group: its rounds, the largest relative residual of its linear systems, whether a direct solution replaced one."""

    rounds: np.ndarray
    residual: np.ndarray
    direct: np.ndarray


def twsc_groups(y: np.ndarray, rows: np.ndarray, columns: np.ndarray, rounds: int = 10, rho: float = 0.5, mu: float = 1.1, tol: float = 1e-6, gate: float = 1e-10) -> tuple[np.ndarray, Solved]:
    """Trilaterally weighted sparse coding of y (n, m, k): noise by row (n, m) and by column (n, k).

    Each ADMM round solves a Sylvester system in the eigenbasis of the weighted Gram matrix; where
    its relative residual exceeds the gate, column by column by a direct factorisation instead.
    A group that has converged is left out of later rounds.
    """
    n, m, k = y.shape
    mean = y.mean(2, keepdims=True)
    y = y - mean
    d, s, _ = np.linalg.svd(y, full_matrices=False)
    s = np.sqrt(np.maximum(s**2 - k * columns[:, :1] ** 2, 0)) + TINY
    w1, w2 = 1 / np.maximum(rows, 1e-6) ** 2, 1 / np.maximum(columns, 1e-6) ** 2
    gram = (d * w1[:, :, None]).transpose(0, 2, 1) @ d * s[:, :, None] * s[:, None, :]
    e, q = np.linalg.eigh(gram)
    right = s[:, :, None] * (d.transpose(0, 2, 1) @ (w1[:, :, None] * y * w2[:, None, :]))
    z, dual = np.zeros((n, s.shape[1], k)), np.zeros((n, s.shape[1], k))
    told, live = Solved(np.zeros(n, int), np.zeros(n), np.zeros(n, bool)), np.arange(n)
    for _ in range(rounds):
        told.rounds[live] += 1
        rhs = right[live] + rho * z[live] - dual[live]
        c = q[live] @ ((q[live].transpose(0, 2, 1) @ rhs) / (e[live][:, :, None] * w2[live][:, None, :] + rho))
        gap = gram[live] @ c * w2[live][:, None, :] + rho * c - rhs
        gap = np.abs(gap).max((1, 2)) / np.maximum(np.abs(rhs).max((1, 2)), 1e-300)
        for i in np.flatnonzero(~(gap <= gate)):
            told.direct[live[i]] = True
            for j in range(k):
                c[i, :, j] = np.linalg.solve(gram[live[i]] * w2[live[i], j] + rho * np.eye(s.shape[1]), rhs[i, :, j])
        told.residual[live] = np.maximum(told.residual[live], gap)
        x = c + dual[live] / rho
        new = np.sign(x) * np.maximum(np.abs(x) - 1 / rho, 0)
        done = (np.abs(c - new).max((1, 2)) <= tol) & (np.abs(new - z[live]).max((1, 2)) <= tol)
        z[live], dual[live], rho = new, dual[live] + rho * (c - new), rho * mu
        live = live[~done]
        if not len(live):
            break
    return d @ (s[:, :, None] * z) + mean, told


def nearest_rows(guide: np.ndarray, q: int) -> np.ndarray:
    """(n, m, q): the q nearest rows of each row of guide (n, m, k), itself first, ties by index."""
    n, m, _ = guide.shape
    dot = guide @ guide.transpose(0, 2, 1)
    norm = np.diagonal(dot, axis1=1, axis2=2)
    both = norm[:, :, None] + norm[:, None, :]
    d = both - 2 * dot
    # equal rows are at distance zero, whatever the products' rounding
    d[d < 1e-13 * both] = 0
    at = np.arange(m)
    d[:, at, at] = -1
    out = np.empty((n, m, q), np.int64)
    for j in range(q):
        out[:, :, j] = d.argmin(2)
        np.put_along_axis(d, out[:, :, j : j + 1], np.inf, 2)
    return out


def nlh_groups(values: np.ndarray, near: np.ndarray, reference: np.ndarray | None, sigma: float, strength: float = 1.0, scale: float = 0.32, rounds: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """values (n, m, k), near (n, m, q) rows: Haar both ways, threshold or Wiener, sigma 0 unchanged; (num, den) by row."""
    (n, m, k), q = values.shape, near.shape[2]
    hq, hk = np.array(haar(q)), np.array(haar(k))
    at = (np.arange(n)[:, None, None] * m + near).reshape(-1)
    forward = lambda v: hq @ v.reshape(n * m, k)[at].reshape(-1, q, k) @ hk.T
    z = forward(values)
    if sigma == 0:
        pass
    elif reference is None:
        z[np.abs(z) < 2.025 * strength * sigma] = 0
        z[:, max(0, q - 2) :, 1:] = 0
    else:
        r = forward(reference) ** 2
        z = z * (r / np.maximum(r + (scale * sigma) ** 2, 1e-300)) ** rounds
    back = (hq.T @ z @ hk).reshape(-1, k)
    num = np.zeros(n * m * k)
    np.add.at(num, (at[:, None] * k + np.arange(k)).ravel(), back.ravel())
    return num.reshape(n, m, k), np.bincount(at, minlength=n * m).reshape(n, m).astype(float)


def collect(stack: np.ndarray, centre: int, spots: Callable[[int], Matches], work: Callable[[Matches], tuple], b: int, every: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Adds each group's weighted estimate: work(matches of equal count) gives blocks (n, k, c, b, b) and weights broadcast to them."""
    sums = Sums(stack.shape)
    for t in range(len(stack)) if every else (centre,):
        for found in in_groups(spots(t), stack.shape[1] * b * b):
            sums.add(found, *work(found))
    return sums.num, sums.den


def spots_of(guide: np.ndarray, place: Place, b: int, step: int, lo: int, hi: int, k: int, radius: int = 0, ps_num: int = 2, ps_range: int = 4, core: tuple[slice, slice] | None = None) -> Callable[[int], Matches]:
    """The matches of all references of a frame, with a core of those that begin in it."""
    ys, xs = place.grid(guide, b, step)
    if core is not None:
        ys, xs = (v[(v >= c.start) & (v < c.stop)] for v, c in zip((ys, xs), core, strict=True))

    def at(t: int) -> Matches:
        strip = max(1, AT_ONCE // max(1, len(xs) * (lo + hi + 1) ** 2))
        parts = [search(guide, t, ys[r : r + strip], xs, b, lo, hi, k, radius, ps_num, ps_range) for r in range(0, max(1, len(ys)), strip)]
        wide = max(p.t.shape[1] for p in parts)
        pad = lambda v: np.pad(v, ((0, 0), (0, wide - v.shape[1])), mode="edge") if v.shape[1] < wide else v
        return Matches(*(np.concatenate([pad(getattr(p, f)) for p in parts]) for f in ("dist", "t", "y", "x")), np.concatenate([p.count for p in parts]))

    return at


def divide(num: np.ndarray, den: np.ndarray, source: np.ndarray) -> np.ndarray:
    return np.where(den > TINY, num / np.maximum(den, TINY), source)
