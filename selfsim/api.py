"""The filters as functions of clips: arguments as lists for each plane, checked before anything runs.

A clip's pixels are (n, channel, y, x, v), one row for each sample, v at about 0 to 1 (chroma
around zero); subsampled chroma planes are simply smaller. A call gives a Clip, or, with radius > 0
in the legacy temporal mode, the contributions that VAggregate sums. Nothing is computed until the
pixels of the result are read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import partial, wraps
from inspect import signature

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from selfsim.filters import numeric as N
from selfsim.kernels.patches import NumericalFailure  # noqa: F401
from selfsim.operators import framewise
from selfsim.operators.grid import positions

#: Least float that is normal, largest float, bytes of frames that a window may pin, samples of a patch grid.
TINY_FLOAT, LARGE_FLOAT, PINNED, GRID = 1.1754943508222875e-38, 3.4028234663852886e38, 2 << 30, 16_000_000
#: The filters' numbers in order, their versions where they aren't 2, the version and layout of contributions.
MODELS = ("BM3D", "WNNM", "MCWNNM", "TWSC", "NCSR", "NLH", "LSSC", "NLM")
VERSIONS = {"NLH": 7, "TWSC": 6, "NCSR": 3, "LSSC": 4, "BM3D": 3}
FAT_VERSION, FAT_LAYOUT = 2, 1
DA3D_TILES = framewise.Tiling(N.PATCH - N.MID - 1, edge=N.TILE, even=True, crop=False)
GROUP_FILTERS = ("BM3D", "WNNM", "MCWNNM", "NCSR", "TWSC", "NLH")


class InvalidInput(ValueError):
    """An argument or a clip that the filter doesn't take."""


class Unsupported(InvalidInput):
    """An argument that is known and has no implementation."""


class ResourceFailure(MemoryError):
    """A window larger than memory_limit_mb."""


@dataclass(frozen=True)
class Identity:
    """What made a frame: the filter's number and version, and how it reads sigma; of contributions also the version and layout of their table."""

    model: int
    model_version: int
    noise_profile: int
    fat_version: int | None = None
    fat_radius: int | None = None
    fat_layout: int | None = None

    @classmethod
    def of(cls, name: str, radius: int | None = None) -> Identity:
        at = MODELS.index(name)
        return cls(at + 1, VERSIONS.get(name, 2), int(name == "BM3D"), *((FAT_VERSION, radius, FAT_LAYOUT) if radius is not None else ()))


@dataclass(frozen=True)
class Clip:
    """family is GRAY, YUV or RGB; subsampling the binary logarithms of the chroma planes' reduction."""

    pixels: DataFrame
    width: int
    height: int
    frames: int
    family: str = "GRAY"
    subsampling: tuple[int, int] = (0, 0)
    identity: Identity | None = None

    @staticmethod
    def of(pixels: DataFrame, family: str = "GRAY", subsampling: tuple[int, int] = (0, 0)) -> Clip:
        """Measures the clip; frames are 0 to frames - 1."""
        size = pixels.where("channel = 0").agg(F.max("x"), F.max("y"), F.max("n")).first()
        return Clip(pixels, *((-1 if v is None else int(v)) + 1 for v in size), family, subsampling)

    @property
    def planes(self) -> int:
        return 1 if self.family == "GRAY" else 3

    def size(self, plane: int) -> tuple[int, int]:
        """(width, height) of a plane."""
        sx, sy = self.subsampling if plane else (0, 0)
        return self.width >> sx, self.height >> sy

    def shape(self) -> tuple:
        return self.width, self.height, self.frames, self.family, self.subsampling


@dataclass(frozen=True)
class Contributions:
    """Sums to be: (center, target, channel, y0, x0, w, num, den), with what they were made by; untagged ones have no identity."""

    rows: DataFrame
    radius: int
    shape: tuple
    identity: Identity | None = None


Check = Callable[[bool, str], None]


def _checker(name: str) -> Check:
    def check(ok: bool, message: str) -> None:
        if not ok:
            raise InvalidInput(f"{name}: {message}")

    return check


def _clip_ok(clip: Clip) -> bool:
    return min(clip.width, clip.height, clip.frames) >= 1 and clip.width * clip.height < 2**31 and clip.family in ("GRAY", "YUV", "RGB")


def _floats(value: float | Sequence[float], planes: int) -> list[float]:
    """A value for each plane; the last one given repeats."""
    given = list(value) if isinstance(value, (list, tuple)) else [value]
    return [float(given[min(i, len(given) - 1)]) for i in range(planes)]


def _ints(value: int | Sequence[int] | None, planes: int, default: int, limit: Sequence[int] | None = None) -> list[int]:
    """As _floats; a missing value is the default, no larger than the plane's limit."""
    if value is None:
        return [min(default, limit[i]) if limit else default for i in range(planes)]
    return [int(v) for v in _floats(value, planes)]


def _finite(values: Sequence[float]) -> bool:
    return all(math.isfinite(v) and abs(v) <= LARGE_FLOAT for v in values)


def _admit(name: str, clip: Clip, window: int, memory_limit_mb: int | None) -> None:
    """The planes of a window, their sums and a guide in double precision, against the limit."""
    need = sum(w * h for w, h in map(clip.size, range(clip.planes))) * window * 8 * 4
    if memory_limit_mb is not None and need > memory_limit_mb << 20:
        raise ResourceFailure(f"{name}: a window needs about {need >> 20} MB of memory_limit_mb={memory_limit_mb}")


def _temporal(check: Check, radius: int, temporal_mode: str, rolling_chunk: int, rolling_cache_limit: int | None, rolling_cache_chunks: int | None) -> bool:
    """Whether finished frames are asked for. The cache sizes are checked only: Spark reuses what it needs."""
    mode = temporal_mode.lower()
    if mode == "fused":
        try:
            check(False, "temporal_mode=fused is not supported; use rolling or legacy")
        except InvalidInput as e:
            raise Unsupported(str(e)) from None
    check(mode in ("", "rolling", "legacy"), "temporal_mode must be rolling or legacy")
    if mode != "rolling" or radius <= 0:
        return False
    check(1 <= rolling_chunk <= 64, "rolling_chunk must be in [1, 64]")
    check(rolling_cache_limit is None or rolling_cache_chunks is None, "use only one of rolling_cache_limit and rolling_cache_chunks")
    check(all(1 <= c <= 64 for c in (rolling_cache_limit, rolling_cache_chunks) if c is not None), "rolling_cache_limit must be in [1, 64]")
    return True


def _tiling(units: Sequence[framewise.Unit]) -> framewise.Tiling | None:
    """Tiles with the widest halo that a unit's filter needs; none where one needs whole planes, or the halo would be most of a tile."""
    halos = [N.reach(work.func.__name__, **work.keywords) if isinstance(work, partial) else None for _, work in units]
    if not halos or None in halos:
        return None
    return framewise.Tiling(max(halos), edge=max(framewise.EDGE, framewise.CELL * -(-2 * max(halos) // framewise.CELL)))


def _copy(win, centre, *_, place=None):  # noqa: ANN001, ANN202
    return N.identity(win, centre)


def _finish(name: str, clip: Clip, units: Sequence[framewise.Unit], radius: int, rolling: bool, chunk: int = 4, guide: Clip | None = None) -> Clip | Contributions:
    """Frames at radius 0 or when rolling; otherwise contributions, copied planes as identity slices."""
    theirs, tiling = None if guide is None else guide.pixels, _tiling(units)
    made = replace(clip, identity=Identity.of(name))
    if rolling:
        return replace(made, pixels=framewise.rolling(clip.pixels, units, radius, chunk, theirs, tiling))
    if not radius:
        return replace(made, pixels=framewise.apply(clip.pixels, units, 0, theirs, tiling) if units else clip.pixels)
    filtered = {c for channels, _ in units for c in channels}
    copied = [((c,), _copy) for c in range(clip.planes) if c not in filtered]
    return Contributions(framewise.contributions(clip.pixels, [*units, *copied], radius, theirs, tiling), radius, clip.shape(), Identity.of(name, radius))


def _each(sigmas: Sequence[float], work: Callable, arguments: Callable[[int], dict]) -> list[framewise.Unit]:
    """A unit for each plane with a positive sigma."""
    return [((c,), partial(work, sigma=s, **arguments(c))) for c, s in enumerate(sigmas) if s > 0]


FORMAT = "constant Gray/YUV/RGB 32-bit float required"


def bm3d(clip: Clip, ref: Clip | None = None, sigma=3.0, block_size=None, group_size=None, block_step=None, bm_range=None, radius=0, ps_num=None, ps_range=None, chroma=0, final=0, sigma_basic=None, block_size_basic=None, group_size_basic=None, temporal_mode="legacy", rolling_chunk=4, rolling_cache_chunks=None, rolling_cache_limit=None, memory_limit_mb=None) -> Clip | Contributions:  # noqa: ANN001
    """F1. ref: the guide of the Wiener stage; final: both stages, the first with the basic values."""
    check, planes = _checker("BM3D"), clip.planes
    rolling = _temporal(check, radius, temporal_mode, rolling_chunk, rolling_cache_limit, rolling_cache_chunks)
    check(_clip_ok(clip), FORMAT)
    check(ref is None or ref.shape() == clip.shape(), "ref must match clip")
    sigmas = _floats(sigma, planes)
    check(_finite(sigmas) and min(sigmas) >= 0, "sigma must be finite and non-negative")
    blocks, groups = _ints(block_size, planes, 8), _ints(group_size, planes, 8)
    steps, ranges = _ints(block_step, planes, 8, blocks), _ints(bm_range, planes, 9)
    nums, ps_ranges = _ints(ps_num, planes, 2, groups), _ints(ps_range, planes, 4)
    check(0 <= radius <= 16, "radius must be in [0, 16]")
    check(chroma in (0, 1), "chroma must be 0 or 1")
    if chroma:
        check(clip.family == "YUV" and clip.subsampling == (0, 0), "chroma requires a YUV 4:4:4 clip")
        blocks, groups, steps, ranges, nums, ps_ranges = ([v[0]] * planes for v in (blocks, groups, steps, ranges, nums, ps_ranges))
    check(final in (0, 1), "final must be 0 or 1")
    basic_given = [v is not None for v in (sigma_basic, block_size_basic, group_size_basic)]
    check(bool(final) or not any(basic_given), "sigma_basic, block_size_basic and group_size_basic require final=1")
    check(not (final and ref is not None), "use only one of final and ref")
    if final:
        first_sigmas = sigmas if sigma_basic is None else _floats(sigma_basic, planes)
        first_blocks = blocks if block_size_basic is None else _ints(block_size_basic, planes, 8)
        first_groups = groups if group_size_basic is None else _ints(group_size_basic, planes, 8)
        check(_finite(first_sigmas) and min(first_sigmas) >= 0, "sigma_basic must be finite and non-negative")
        _stage_shape(check, clip, first_blocks, first_groups, "_basic")
        check(block_step is None or all(s <= b for s, b in zip(steps, first_blocks, strict=True)), "block_step must be in [1, block_size_basic]")
        check(ps_num is None or all(p <= g for p, g in zip(nums, first_groups, strict=True)), "ps_num must be in [1, group_size_basic]")
    _stage_shape(check, clip, blocks, groups, "")
    for i in range(planes):
        check(1 <= steps[i] <= blocks[i], "block_step must be in [1, block_size]")
        check(1 <= nums[i] <= groups[i], "ps_num must be in [1, group_size]")
        check(1 <= ranges[i] <= 64, "bm_range must be in [1, 64]")
        check(0 <= ps_ranges[i] <= 64, "ps_range must be in [0, 64]")
    _admit("BM3D", clip, 2 * radius + 1, memory_limit_mb)
    if final:
        same = dict(block_step=block_step, bm_range=bm_range, radius=radius, ps_num=ps_num, ps_range=ps_range, chroma=chroma, temporal_mode="rolling", rolling_chunk=rolling_chunk)
        ref = bm3d(clip, sigma=first_sigmas, block_size=first_blocks, group_size=first_groups, **same)
    shape = lambda c: dict(block_size=blocks[c], group_size=groups[c], block_step=steps[c], bm_range=ranges[c], radius=radius, ps_num=nums[c], ps_range=ps_ranges[c])
    units = [((0, 1, 2), partial(N.bm3d, sigma=tuple(sigmas), **shape(0)))] if chroma and any(sigmas) else _each(sigmas, N.bm3d, shape)
    return _finish("BM3D", clip, units, radius, rolling, rolling_chunk, ref)


def _stage_shape(check: Check, clip: Clip, blocks: Sequence[int], groups: Sequence[int], stage: str) -> None:
    for i, (b, g) in enumerate(zip(blocks, groups, strict=True)):
        check(b in (1, 2, 4, 8, 12, 16, 32), f"block_size{stage} must be one of 1, 2, 4, 8, 12, 16, 32")
        check(g in (1, 2, 4, 8, 16, 32, 64), f"group_size{stage} must be one of 1, 2, 4, 8, 16, 32, 64")
        check(b <= min(clip.size(i)), f"block_size{stage} must not exceed plane dimensions")


def nlm(clip: Clip, d=1, a=2, s=4, h=1.2, channels="AUTO", wmode=0, wref=1.0, rclip: Clip | None = None, memory_limit_mb=None) -> Clip:  # noqa: ANN001
    """F2."""
    check = _checker("NLM")
    check(_clip_ok(clip), FORMAT)
    check(0 <= d <= 256 and 1 <= a <= 64 and 0 <= s <= 1024 and _finite([h, wref]) and h > 0 and wref > 0, "invalid d/a/s/h/wref")
    check((2 * d + 1) * 4 * clip.width * clip.height * clip.planes <= PINNED, "temporal radius d pins too much frame memory for this frame size")
    check(wmode in (0, 1, 2, 3), "wmode must be 0 (Welsch) or 1, 2, 3 (Bisquare A, B, C)")
    check(channels in ("Y", "UV", "YUV", "RGB", "AUTO"), "channels must be Y, UV, YUV, RGB, or AUTO")
    mode = channels if channels != "AUTO" else "RGB" if clip.family == "RGB" else "Y"
    check(mode != "UV" or clip.family == "YUV", "UV requires YUV")
    check(mode != "YUV" or (clip.family == "YUV" and clip.subsampling == (0, 0)), "YUV requires YUV444")
    check(mode != "RGB" or clip.family == "RGB", "RGB requires RGB")
    used = {"Y": (0,), "UV": (1, 2)}.get(mode, (0, 1, 2))
    check(all(a < clip.size(c)[0] for c in used), "search radius a must be smaller than the processed plane width")
    check(rclip is None or rclip.shape() == clip.shape(), "rclip must match clip")
    _admit("NLM", clip, 2 * d + 1, memory_limit_mb)
    work = partial(N.nlm, d=d, a=a, s=s, h=h, channels=mode, wmode=wmode, wref=wref)
    return replace(clip, identity=Identity.of("NLM"), pixels=framewise.apply(clip.pixels, [(used, work)], d, None if rclip is None else rclip.pixels, _tiling([(used, work)])))


def _small_sigma(check: Check, sigmas: Sequence[float]) -> None:
    for v in sigmas:
        check(math.isfinite(v) and v >= 0, "sigma must be finite and non-negative")
        check(v == 0 or (v / 255) ** 2 >= TINY_FLOAT, "sigma is too small")


def pnlm(clip: Clip, sigma=3.0, d=1, a=2, block_size=6, group_size=16, memory_limit_mb=None) -> Clip:  # noqa: ANN001
    """F3."""
    check, sigmas = _checker("PNLM"), _floats(sigma, clip.planes)
    check(_clip_ok(clip), FORMAT)
    _small_sigma(check, sigmas)
    check(0 <= d <= 31, "d must be in [0, 31]")
    check(1 <= a <= 64, "a must be in [1, 64]")
    check(block_size in (4, 6, 8), "block_size must be 4, 6 or 8")
    check(2 <= group_size <= 32, "group_size must be in [2, 32]")
    for c in (c for c, v in enumerate(sigmas) if v):
        check(min(clip.size(c)) >= block_size, "a filtered plane is smaller than block_size")
        check(max(clip.size(c)) <= 8192, "filtered planes are limited to 8192 x 8192")
    check((2 * d + 1) * 4 * clip.width * clip.height * clip.planes <= PINNED, "temporal radius d pins too much frame memory for this frame size")
    _admit("PNLM", clip, 2 * d + 1, memory_limit_mb)
    units = _each(sigmas, N.pnlm, lambda c: dict(a=a, block_size=block_size, group_size=group_size))
    return replace(clip, pixels=framewise.apply(clip.pixels, units, d, tiling=_tiling(units)) if units else clip.pixels)


def _group_shape(check: Check, block_size: int, block_step: int, group_size: int, radius: int) -> None:
    check(1 <= block_size <= 16 and 1 <= group_size <= 32 and 1 <= block_step <= block_size and 0 <= radius <= 16, "invalid block_size/group_size/block_step/radius")


def wnnm(clip: Clip, sigma=3.0, block_size=8, block_step=8, group_size=8, bm_range=7, radius=0, ps_num=2, ps_range=4, residual=0, adaptive_aggregation=1, rclip: Clip | None = None, temporal_mode="legacy", rolling_chunk=4, rolling_cache_chunks=None, rolling_cache_limit=None, memory_limit_mb=None) -> Clip | Contributions:  # noqa: ANN001
    """F4."""
    check, sigmas = _checker("WNNM"), _floats(sigma, clip.planes)
    rolling = _temporal(check, radius, temporal_mode, rolling_chunk, rolling_cache_limit, rolling_cache_chunks)
    check(_clip_ok(clip), FORMAT)
    _group_shape(check, block_size, block_step, group_size, radius)
    check(1 <= bm_range <= 64, "bm_range must be in [1, 64]")
    check(1 <= ps_num <= group_size and 1 <= ps_range <= 64, "invalid ps_num/ps_range")
    _patch_filter_clip(check, clip, sigmas, block_size, rclip)
    _admit("WNNM", clip, 2 * radius + 1, memory_limit_mb)
    units = _each(sigmas, N.wnnm, lambda c: dict(block_size=block_size, block_step=block_step, group_size=group_size, bm_range=bm_range, radius=radius, ps_num=ps_num, ps_range=ps_range, residual=residual, adaptive_aggregation=adaptive_aggregation))
    return _finish("WNNM", clip, units, radius, rolling, rolling_chunk, rclip)


def _patch_filter_clip(check: Check, clip: Clip, sigmas: Sequence[float], block_size: int, rclip: Clip | None) -> None:
    check(_finite(sigmas) and min(sigmas) >= 0, "sigma must be finite and non-negative")
    check(all(block_size <= min(clip.size(c)) for c, v in enumerate(sigmas) if v), "block_size must not exceed plane dimensions")
    check(rclip is None or rclip.shape() == clip.shape(), "rclip must match clip")


def mcwnnm(clip: Clip, sigma=3.0, block_size=8, block_step=8, group_size=8, bm_range=7, radius=0, ps_num=2, ps_range=4, residual=1, adaptive_aggregation=0, rclip: Clip | None = None, admm_iter=10, rho=3.0, mu=1.001, iters=2, delta=0.1, temporal_mode="legacy", rolling_chunk=4, rolling_cache_chunks=None, rolling_cache_limit=None, memory_limit_mb=None) -> Clip | Contributions:  # noqa: ANN001
    """F5."""
    check = _checker("MCWNNM")
    rolling = _temporal(check, radius, temporal_mode, rolling_chunk, rolling_cache_limit, rolling_cache_chunks)
    check(_clip_ok(clip) and clip.planes == 3 and clip.subsampling == (0, 0), "constant RGBS or YUV444PS required")
    sigmas = _floats(sigma, 3)
    check(_finite(sigmas), "sigma must be finite")
    _group_shape(check, block_size, block_step, group_size, radius)
    check(1 <= bm_range <= 64, "bm_range must be in [1, 64]")
    check(1 <= admm_iter <= 1000 and _finite([rho, mu]) and rho > 0 and mu >= 1, "invalid admm_iter/rho/mu (admm_iter in [1, 1000], mu >= 1)")
    _rounds(check, iters, delta)
    check(1 <= ps_num <= group_size and 1 <= ps_range <= 64, "invalid ps_num/ps_range")
    _patch_filter_clip(check, clip, sigmas, block_size, rclip)
    _admit("MCWNNM", clip, 2 * radius + 1, memory_limit_mb)
    work = partial(N.mcwnnm, sigma=tuple(sigmas), block_size=block_size, block_step=block_step, group_size=group_size, bm_range=bm_range, radius=radius, ps_num=ps_num, ps_range=ps_range, residual=residual, adaptive_aggregation=adaptive_aggregation, iters=iters, delta=delta, admm_iter=admm_iter, rho=rho, mu=mu)
    return _finish("MCWNNM", clip, [((0, 1, 2), work)] if any(sigmas) else [], radius, rolling, rolling_chunk, rclip)


def _rounds(check: Check, iters: int, delta: float) -> None:
    check(1 <= iters <= 64 and math.isfinite(delta) and 0 <= delta <= 1, "invalid iters/delta (iters in [1, 64], delta in [0, 1])")


def ncsr(clip: Clip, sigma=3.0, block_size=8, block_step=8, group_size=8, bm_range=7, radius=0, ps_num=2, ps_range=4, rclip: Clip | None = None, iters=2, delta=0.1, temporal_mode="legacy", rolling_chunk=4, rolling_cache_chunks=None, rolling_cache_limit=None, memory_limit_mb=None) -> Clip | Contributions:  # noqa: ANN001
    """F6."""
    check, sigmas = _checker("NCSR"), _floats(sigma, clip.planes)
    rolling = _temporal(check, radius, temporal_mode, rolling_chunk, rolling_cache_limit, rolling_cache_chunks)
    check(_clip_ok(clip), FORMAT)
    _group_shape(check, block_size, block_step, group_size, radius)
    _rounds(check, iters, delta)
    check(1 <= ps_num <= group_size and 1 <= ps_range <= 64, "invalid ps_num/ps_range")
    check(1 <= bm_range <= 64, "bm_range must be in [1, 64]")
    _patch_filter_clip(check, clip, sigmas, block_size, rclip)
    _admit("NCSR", clip, 2 * radius + 1, memory_limit_mb)
    units = _each(sigmas, N.ncsr, lambda c: dict(block_size=block_size, block_step=block_step, group_size=group_size, bm_range=bm_range, radius=radius, ps_num=ps_num, ps_range=ps_range, iters=iters, delta=delta))
    return _finish("NCSR", clip, units, radius, rolling, rolling_chunk, rclip)


def lssc(clip: Clip, sigma=3.0, block_size=8, block_step=None, radius=0, memory_limit_mb=None) -> Clip:  # noqa: ANN001
    """F7."""
    check, sigmas = _checker("LSSC"), _floats(sigma, clip.planes)
    step = max(1, block_size // 2) if block_step is None else block_step
    check(_clip_ok(clip), FORMAT)
    check(block_size in (1, 2, 4, 8, 16) and 1 <= step <= block_size, "block_size must be 1, 2, 4, 8, or 16")
    check(radius == 0, "radius>0 is not implemented (no temporal clustering)")
    grid = len(positions(clip.width, block_size, step)) * len(positions(clip.height, block_size, step))
    check(grid <= GRID // block_size**2, "grid too large; increase block_step")
    _patch_filter_clip(check, clip, sigmas, block_size, None)
    _admit("LSSC", clip, 1, memory_limit_mb)
    return _finish("LSSC", clip, _each(sigmas, N.lssc, lambda c: dict(block_size=block_size, block_step=step)), 0, False)


def _window(check: Check, bm_range: int | None, search_window, default) -> int | tuple:  # noqa: ANN001
    check(bm_range is None or search_window is None, "bm_range and search_window are mutually exclusive")
    check(bm_range is None or 1 <= bm_range <= 64, "bm_range outside supported range")
    return 2 * bm_range + 1 if bm_range is not None else default if search_window is None else search_window


def _sigma_units(check: Check, clip: Clip, sigma) -> list[float]:  # noqa: ANN001
    given = list(sigma) if isinstance(sigma, (list, tuple)) else [sigma]
    check(1 <= len(given) <= clip.planes, "sigma must contain one value per selected input plane (last value broadcasts)")
    check(_finite(given), "sigma is not a finite number")
    check(min(given) >= 0, "sigma must be nonnegative")
    return _floats(given, clip.planes)


def _in(check: Check, low: float, high: float, **values: float) -> None:
    for name, v in values.items():
        check(math.isfinite(v) and low <= v <= high, f"{name} outside supported range" if isinstance(v, int) else f"invalid {name}")


def twsc(clip: Clip, sigma=None, block_size=8, block_step=None, group_size=8, bm_range=None, search_window=None, radius=0, ps_num=None, ps_range=4, lambda2=1.0, rclip: Clip | None = None, iters=2, delta=0.0, estimate_sigma=0, admm_iter=10, rho=0.5, mu=1.1, tol=1e-6, cfast=1, temporal_mode="legacy", rolling_chunk=4, rolling_cache_chunks=None, rolling_cache_limit=None, memory_limit_mb=None) -> Clip | Contributions:  # noqa: ANN001
    """F8. Planes of equal size are solved together."""
    check = _checker("TWSC")
    rolling = _temporal(check, radius, temporal_mode, rolling_chunk, rolling_cache_limit, rolling_cache_chunks)
    check(_clip_ok(clip), FORMAT)
    sigmas = _sigma_units(check, clip, 3.0 if sigma is None else sigma)
    check(rclip is None or rclip.shape() == clip.shape(), "rclip must match clip")
    window = _window(check, bm_range, search_window, 60)
    _in(check, 0, 1, estimate_sigma=estimate_sigma, cfast=cfast)
    check(not (estimate_sigma and sigma is not None), "estimate_sigma and explicit sigma are mutually exclusive")
    _in(check, 1, 16, block_size=block_size)
    _in(check, 1, 256, group_size=group_size)
    step = min(8, block_size) if block_step is None else block_step
    _in(check, 1, block_size, block_step=step)
    _in(check, 1, 64, iters=iters, ps_range=ps_range)
    _in(check, 1, 129, search_window=window)
    _in(check, 0, 16, radius=radius)
    seeds = min(2, group_size) if ps_num is None else ps_num
    _in(check, 1, 256, ps_num=seeds)
    check(seeds <= group_size, "ps_num exceeds resolved group_size")
    _in(check, 0, LARGE_FLOAT, lambda2=float(lambda2), rho=float(rho), tol=float(tol))
    _in(check, 0, 1, delta=float(delta))
    _in(check, 1, 1000, admm_iter=admm_iter)
    _in(check, 1, LARGE_FLOAT, mu=float(mu))
    check(rho > 0 and tol > 0, "rho and tol must be positive")
    used = [c for c in range(clip.planes) if estimate_sigma or sigmas[c]]
    check(not estimate_sigma or all(min(clip.size(c)) >= 8 for c in used), "noise estimation block_size requires at least 8x8 per plane")
    check(all(min(clip.size(c)) >= block_size for c in used), "selected plane is smaller than block_size")
    _admit("TWSC", clip, 2 * radius + 1, memory_limit_mb)
    more = dict(block_size=block_size, block_step=step, group_size=group_size, search_window=window, radius=radius, ps_num=seeds, ps_range=ps_range, lambda2=lambda2, iters=iters, delta=delta, estimate_sigma=estimate_sigma, admm_iter=admm_iter, rho=rho, mu=mu, tol=tol, cfast=int(bool(cfast) and clip.family == "RGB"))
    units = [(channels, partial(N.twsc, sigma=tuple(sigmas[c] for c in channels), **more)) for channels in _same_size(clip, used)]
    return _finish("TWSC", clip, units, radius, rolling, rolling_chunk, rclip)


def _same_size(clip: Clip, planes: Sequence[int]) -> list[tuple[int, ...]]:
    return [tuple(c for c in planes if clip.size(c) == size) for size in dict.fromkeys(clip.size(c) for c in planes)]


def nlh(clip: Clip, sigma=None, block_size=None, block_step=None, group_size=16, bm_range=None, search_window=None, radius=0, ps_num=2, ps_range=4, q=None, rclip: Clip | None = None, noise_model="auto", basic_iters=3, lambda_basic=0.6, hard_strength=1.0, wiener_iters=2, wiener_sigma_scale=0.32, temporal_mode="legacy", rolling_chunk=4, rolling_cache_chunks=None, rolling_cache_limit=None, memory_limit_mb=None) -> Clip | Contributions:  # noqa: ANN001
    """F9. Without sigma the noise is estimated. noise_model is checked and selects nothing. Subsampled chroma is matched on the luma, brought to its size by means over areas."""
    check = _checker("NLH")
    rolling = _temporal(check, radius, temporal_mode, rolling_chunk, rolling_cache_limit, rolling_cache_chunks)
    check(_clip_ok(clip), FORMAT)
    sigmas = None if sigma is None else _sigma_units(check, clip, sigma)
    check(rclip is None or rclip.shape() == clip.shape(), "rclip must match clip")
    window = _window(check, bm_range, search_window, (24, 16))
    check(noise_model in ("auto", "awgn", "real"), "noise_model must be auto, awgn, or real")
    for name, value, low, high in (("block_size", block_size, 2, 16), ("block_step", block_step, 1, 16), ("group_size", group_size, 2, 64), ("q", q, 2, 16), ("search_window", window, 1, 129)):
        given = value if isinstance(value, (list, tuple)) else [value]
        check(1 <= len(given) <= 2, f"{name} must have one or two values")
        check(all(v is None or low <= v <= high for v in given), f"invalid {name}")
    sizes, rows, steps, groups = N.pair(block_size), N.pair(q), N.pair(block_step), N.pair(group_size)
    bits = [v for v in (*rows, *groups) if v is not None]
    fits = all(b is None or ((r or 2) <= b * b and (s or 1) <= b) for b, r, s in zip(sizes, rows, steps, strict=True))
    check(all(v & (v - 1) == 0 for v in bits) and fits, "invalid stage group/q/block/step combination")
    _in(check, 0, 16, radius=radius)
    _in(check, 1, min(groups), ps_num=ps_num)
    _in(check, 1, 64, ps_range=ps_range, basic_iters=basic_iters, wiener_iters=wiener_iters)
    _in(check, 0, 1, lambda_basic=float(lambda_basic))
    _in(check, 0, LARGE_FLOAT, hard_strength=float(hard_strength), wiener_sigma_scale=float(wiener_sigma_scale))
    least = max([8 if sigmas is None else 2, *(b for b in sizes if b)])
    check(all(min(clip.size(c)) >= least for c in range(clip.planes)), "selected plane is smaller than block_size")
    _admit("NLH", clip, 2 * radius + 1, memory_limit_mb)
    more = dict(sigma=None if sigmas is None else tuple(sigmas), block_size=block_size, block_step=block_step, group_size=group_size, search_window=window, q=q, radius=radius, ps_num=ps_num, ps_range=ps_range, basic_iters=basic_iters, lambda_basic=lambda_basic, hard_strength=hard_strength, wiener_iters=wiener_iters, wiener_sigma_scale=wiener_sigma_scale)
    work = partial(N.nlh_planes, **more) if clip.subsampling != (0, 0) else partial(N.nlh, rgb=clip.family == "RGB", **more)
    return _finish("NLH", clip, [(tuple(range(clip.planes)), work)] if sigmas is None or any(sigmas) else [], radius, rolling, rolling_chunk, rclip)


def bm4d(clip: Clip, sigma=3.0, memory_limit_mb=None) -> Clip:  # noqa: ANN001
    """F10."""
    check, sigmas = _checker("BM4D"), _floats(sigma, clip.planes)
    check(_clip_ok(clip), FORMAT)
    _small_sigma(check, sigmas)
    _admit("BM4D", clip, 48, memory_limit_mb)
    units = _each(sigmas, N.bm4d, lambda c: {})
    return replace(clip, pixels=framewise.volumes(clip.pixels, units) if units else clip.pixels)


def da3d(clip: Clip, ref: Clip, sigma=3.0, memory_limit_mb=None) -> Clip:  # noqa: ANN001
    """F11. Planes with sigma 0 are the guide's. RGB with one sigma is filtered in opponent colours."""
    check, sigmas = _checker("DA3D"), _floats(sigma, clip.planes)
    check(_clip_ok(clip), FORMAT)
    check(ref.shape() == clip.shape(), "ref must match clip")
    _small_sigma(check, sigmas)
    check(all(min(clip.size(c)) >= 2 for c, v in enumerate(sigmas) if v), "a filtered plane must be at least 2 x 2 pixels")
    _admit("DA3D", clip, 1, memory_limit_mb)
    if clip.family == "RGB" and len(set(sigmas)) == 1:
        units = [((0, 1, 2), partial(N.da3d_colour, sigma=sigmas[0]))]
    else:
        units = [((c,), partial(N.da3d, sigma=v)) for c, v in enumerate(sigmas)]
    return replace(clip, pixels=framewise.apply(clip.pixels, units, 0, ref.pixels, DA3D_TILES))


def vaggregate(contributions: Contributions | Sequence[Contributions], src: Clip, radius: int = 0, planes: Sequence[int] | None = None, allow_legacy: int = 0, memory_limit_mb=None) -> Clip:  # noqa: ANN001
    """the sums of the contributions over the centres, divided; planes that aren't selected are the source's.

    Several tables are summed together if they are of one filter. Those without an identity are taken only with allow_legacy.
    """
    check = _checker("VAggregate")
    parts = [contributions] if isinstance(contributions, Contributions) else list(contributions)
    check(_clip_ok(src), "constant 32f clips required")
    check(0 <= radius <= 16, "radius must be in [0, 16]")
    chosen = list(range(src.planes)) if planes is None else list(planes)
    check(all(0 <= c < src.planes for c in chosen) and len(set(chosen)) == len(chosen), "planes must contain unique valid plane indices")
    check(bool(parts) and all(p.shape == src.shape() for p in parts), "clip must match src format, width, and frame count, with height=src.height*(2*radius+1)*2")
    for part in parts:
        check(part.identity is not None or bool(allow_legacy), "missing or invalid contribution identity")
        if part.identity is None:
            check(part.radius == radius, "incompatible contribution identity")
        else:
            model = part.identity.model
            known = 1 <= model <= len(GROUP_FILTERS) and part.identity == Identity.of(MODELS[model - 1], radius)
            check(known and part.radius == radius, "incompatible contribution identity")
    check(len({p.identity for p in parts}) == 1, "mixed contribution models")
    _admit("VAggregate", src, 2 * radius + 1, memory_limit_mb)
    rows = parts[0].rows
    for part in parts[1:]:
        rows = rows.unionByName(part.rows)
    made = None if parts[0].identity is None else replace(parts[0].identity, fat_version=None, fat_radius=None, fat_layout=None)
    return replace(src, pixels=framewise.aggregate(rows.where(F.col("channel").isin(chosen)), src.pixels), identity=made)


def properties(made: Clip | Contributions) -> DataFrame:
    """(n and the identity's fields), a row for each frame; of contributions a row for each centre, with fat_center."""
    told = made.identity.__dict__ if made.identity else {f: None for f in Identity.__dataclass_fields__}
    frames = made.rows.select(F.col("center").alias("n")).distinct().withColumn("fat_center", F.col("n")) if isinstance(made, Contributions) else made.pixels.select(F.col("n").cast("long").alias("n")).distinct()
    return frames.select("*", *[F.lit(v).cast("int").alias(f) for f, v in told.items()])


def twsc_diagnostics(clip: Clip, sigma: float | Sequence[float] = 3.0, **shape) -> DataFrame:  # noqa: ANN003
    """(n, groups, max_iter_groups, direct_groups, residual): of each frame, filtered by itself, what the solver says of the last round's groups."""
    given = tuple(_floats(sigma, clip.planes))

    def work(win, centre, place=None):  # noqa: ANN001, ANN202
        told: list = []
        N.twsc(win, centre, sigma=given, place=place, told=told, **shape)
        rounds, residual, direct = (np.concatenate([getattr(t, f) for t in told] or [np.zeros(0)]) for f in ("rounds", "residual", "direct"))
        return pd.DataFrame([(len(rounds), int((rounds >= shape.get("admm_iter", 10)).sum()), int(direct.sum()), float(residual.max(initial=0)))], columns=["groups", "max_iter_groups", "direct_groups", "residual"])

    return framewise.statistics(clip.pixels, work, "groups long, max_iter_groups long, direct_groups long, residual double").drop("channel")


def da3d_diagnostics(clip: Clip, ref: Clip, sigma: float = 3.0) -> DataFrame:
    """(n, patches, guide_only): of each grey frame the patches of all tiles, and those that took the guide's samples."""
    both = clip.pixels.where("channel = 0").unionByName(ref.pixels.where("channel = 0").withColumn("channel", F.lit(1)))

    def work(win, centre, place=None):  # noqa: ANN001, ANN202
        told: list = []
        N.da3d(win[:, :1], centre, win[:, 1:], sigma, place, told)
        return pd.DataFrame([(sum(p for p, _ in told), sum(g for _, g in told))], columns=["patches", "guide_only"])

    return framewise.statistics(both, work, "patches long, guide_only long").drop("channel")


def _representable(name: str, value: object) -> None:
    """Whole numbers fit 32 bits, others are finite single floats; the first that doesn't is named."""
    for k, v in enumerate(value if isinstance(value, (list, tuple)) else [value]):
        if isinstance(v, int) and not isinstance(v, bool) and not -(2**31) <= v < 2**31:
            raise InvalidInput(f"parameter {name}[{k}] is not representable as a finite int")
        if isinstance(v, float) and not (math.isfinite(v) and abs(v) <= LARGE_FLOAT):
            raise InvalidInput(f"parameter {name}[{k}] is not representable as a finite float")


def _guarded(f: Callable) -> Callable:
    """f, whose numbers are checked before anything else."""

    @wraps(f)
    def call(*args, **named):  # noqa: ANN002, ANN003, ANN202
        for name, value in signature(f).bind(*args, **named).arguments.items():
            if isinstance(value, (int, float, list, tuple)):
                _representable(name, value)
        return f(*args, **named)

    return call


bm3d, nlm, pnlm, wnnm, mcwnnm, ncsr, lssc, twsc, nlh, bm4d, da3d, vaggregate = map(_guarded, (bm3d, nlm, pnlm, wnnm, mcwnnm, ncsr, lssc, twsc, nlh, bm4d, da3d, vaggregate))
FILTERS = {f.__name__: f for f in (bm3d, nlm, pnlm, wnnm, mcwnnm, ncsr, lssc, twsc, nlh, bm4d, da3d, vaggregate)}


def capabilities(spark: SparkSession) -> DataFrame:
    """(filter, temporal), a row for each function."""
    return spark.createDataFrame([(n, n.upper() in GROUP_FILTERS) for n in FILTERS], "filter string, temporal boolean")
