"""Runs numeric filters on temporal windows, one task row group for each centre frame, unit of channels and tile, and sums the contributions in SQL.

A unit is (channels, work): the channels it filters together. work(window (frames,
channels, h, w), centre index[, guide window], place=...) gives (num, den). Channels of no unit are
copied. Pixels are (n, channel, y, x, v); planes (n, channel, h, w, v array in raster order).

Planes are read as cells of CELL by CELL samples. A tile's window has its pixels and a halo
around them, wide enough that whatever touches the tile is computed as on the whole plane; so a
task's size doesn't depend on the plane's, and the output not on the tiles.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from selfsim.functions.scalars import finish
from selfsim.kernels.patches import Place

CELL, EDGE = 64, 256
CONTRIBUTION = "center long, target long, channel long, y0 long, x0 long, w long, num array<double>, den array<double>"
COLUMNS = ["center", "target", "channel", "y0", "x0", "w", "num", "den"]
FINISHED = "n long, channel long, y0 long, x0 long, w long, v array<double>"
PLANE = "n long, channel long, h long, w long, v array<double>"
Unit = tuple[Sequence[int], Callable]


@dataclass(frozen=True)
class Tiling:
    """Tiles of edge pixels with a halo. even: n / edge of them, rounded, of even sizes, else all of edge but the last.
    crop: a tile's sums are whole in it; without, they reach into the halo and add up over tiles."""

    halo: int
    edge: int = EDGE
    even: bool = False
    crop: bool = True

    def many(self, n: str) -> str:
        return f"greatest(1, ({n} + {self.edge // 2}) div {self.edge})" if self.even else f"greatest(1, ({n} + {self.edge - 1}) div {self.edge})"

    def start(self, n: str, i: str) -> str:
        return f"({n} * {i}) div ({self.many(n)})" if self.even else f"least({n}, {i} * {self.edge})"

    def overlapping(self, n: str, at: str, size: str) -> Column:
        """The numbers of the tiles whose windows hold some of [at, at + size)."""
        return F.expr(f"filter(sequence(0, {self.many(n)} - 1), i -> {self.start(n, 'i')} - {self.halo} < {at} + {size} AND {self.start(n, '(i + 1)')} + {self.halo} > {at})")

    def bounds(self, n: int, i: int) -> tuple[int, int]:
        if self.even:
            many = max(1, (n + self.edge // 2) // self.edge)
            return n * i // many, n * (i + 1) // many
        return min(n, i * self.edge), min(n, (i + 1) * self.edge)


def cells(pixels: DataFrame) -> DataFrame:
    """(n, channel, height, width, cy, cx, h, w, v): a plane's size, a cell's place and size, and its samples in raster order."""
    size = pixels.groupBy("n", "channel").agg((F.max("y") + 1).cast("int").alias("height"), (F.max("x") + 1).cast("int").alias("width"))
    own = pixels.groupBy("n", "channel", F.expr(f"CAST(y div {CELL} * {CELL} AS INT)").alias("cy"), F.expr(f"CAST(x div {CELL} * {CELL} AS INT)").alias("cx"))
    own = own.agg((F.max("y") - F.min("y") + 1).cast("int").alias("h"), (F.max("x") - F.min("x") + 1).cast("int").alias("w"), F.transform(F.sort_array(F.collect_list(F.struct("y", "x", "v"))), lambda p: p["v"].cast("double")).alias("v"))
    return own.join(size, ["n", "channel"])


def in_units(planes: DataFrame, units: Sequence[Unit]) -> DataFrame:
    """Planes with the number of their unit; planes of no unit go."""
    numbered = [F.when(F.col("channel").isin([int(c) for c in channels]), F.lit(u)) for u, (channels, _) in enumerate(units)]
    return planes.withColumn("unit", F.coalesce(*numbered, F.lit(None).cast("int"))).where("unit IS NOT NULL")


def dealt(pixels: DataFrame, work: Callable | Sequence[Unit], tiling: Tiling | None, guide: DataFrame | None = None) -> tuple[DataFrame, list[Callable]]:
    """(cells with is_guide, unit, ty, tx, a row for each tile that reads them; the works). Without a tiling a plane is one tile."""
    held = cells(pixels).withColumn("is_guide", F.lit(False))
    if guide is not None:
        held = held.unionByName(cells(guide).withColumn("is_guide", F.lit(True)))
    held = held.withColumn("unit", F.lit(0)) if callable(work) else in_units(held, work)
    if tiling is None:
        held = held.select("*", F.lit(0).alias("ty"), F.lit(0).alias("tx"))
    else:
        held = held.select("*", F.explode(tiling.overlapping("height", "cy", "h")).alias("ty")).select("*", F.explode(tiling.overlapping("width", "cx", "w")).alias("tx"))
    return held, [work] if callable(work) else [w for _, w in work]


@dataclass
class Window:
    """A task's samples: frames, channels, their stack or, if planes differ in size, a list of one stack for each; the place and the part of it that is the tile."""

    frames: list[int]
    channels: list[int]
    stacks: list[np.ndarray]
    places: list[Place]
    cores: list[tuple[slice, slice]]

    @classmethod
    def of(cls, pdf: pd.DataFrame, tiling: Tiling | None) -> Window:
        frames, channels, first = sorted(map(int, pdf.n.unique())), sorted(map(int, pdf.channel.unique())), pdf.iloc[0]
        stacks, places, cores = [], [], []
        for channel in channels:
            own = pdf[pdf.channel == channel]
            height, width = int(own.height.iloc[0]), int(own.width.iloc[0])
            if tiling is None:
                y0, y1, x0, x1, core = 0, height, 0, width, (slice(0, height), slice(0, width))
            else:
                (sy, ey), (sx, ex) = tiling.bounds(height, int(first.ty)), tiling.bounds(width, int(first.tx))
                y0, y1, x0, x1 = max(0, sy - tiling.halo), min(height, ey + tiling.halo), max(0, sx - tiling.halo), min(width, ex + tiling.halo)
                core = (slice(sy - y0, ey - y0), slice(sx - x0, ex - x0)) if tiling.crop else (slice(0, y1 - y0), slice(0, x1 - x0))
            stack, at = np.zeros((len(frames), 1, y1 - y0, x1 - x0)), {n: t for t, n in enumerate(frames)}
            for r in own.itertuples():
                a, b, c, d = max(y0, r.cy), min(y1, r.cy + r.h), max(x0, r.cx), min(x1, r.cx + r.w)
                if a < b and c < d:
                    stack[at[int(r.n)], 0, a - y0 : b - y0, c - x0 : d - x0] = np.asarray(r.v, float).reshape(r.h, r.w)[a - r.cy : b - r.cy, c - r.cx : d - r.cx]
            stacks.append(stack)
            places.append(Place(y0, x0, height, width))
            cores.append(core)
        return cls(frames, channels, stacks, places, cores)

    @property
    def same(self) -> bool:
        """Whether the planes are of one size."""
        return len(set(self.places)) == 1

    def run(self, work: Callable, centre: int, guide: Window | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """(num, den) of each channel."""
        if not self.same:
            return work(self.stacks, centre, *([] if guide is None else [guide.stacks]), place=self.places)
        more = [] if guide is None else [np.concatenate(guide.stacks, 1)]
        num, den = work(np.concatenate(self.stacks, 1), centre, *more, place=self.places[0])
        return [(num[:, c : c + 1], den[:, c : c + 1]) for c in range(len(self.channels))]

    def part(self, lo: int, hi: int) -> Window:
        return Window(self.frames[lo:hi], self.channels, [s[lo:hi] for s in self.stacks], self.places, self.cores)

    def corner(self, c: int) -> tuple[int, int, int]:
        """The core's first row and column on the plane, and its width."""
        ys, xs = self.cores[c]
        return self.places[c].y + ys.start, self.places[c].x + xs.start, xs.stop - xs.start


def contributions(pixels: DataFrame, work: Callable | Sequence[Unit], radius: int = 0, guide: DataFrame | None = None, tiling: Tiling | None = None) -> DataFrame:
    """(center, target, channel, y0, x0, w, num, den): each frame goes to the 2 radius + 1 windows that hold it; a row is a tile's part of a slice.

    A window's size depends on the tile's size and the radius alone. Frames beyond the
    ends are missing. A single work filters all channels as one unit.
    """
    held, works = dealt(pixels, work, tiling, guide)
    real = pixels.select(F.col("n").cast("long").alias("center")).distinct()
    windows = held.select("*", F.explode(F.sequence(F.col("n").cast("long") - radius, F.col("n").cast("long") + radius)).alias("center")).join(real, "center", "left_semi")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own, centre, rows = Window.of(pdf[~pdf.is_guide], tiling), int(pdf.center.iloc[0]), []
        theirs = Window.of(pdf[pdf.is_guide], tiling) if pdf.is_guide.any() else None
        for c, (num, den) in enumerate(own.run(works[int(pdf.unit.iloc[0])], own.frames.index(centre), theirs)):
            at, (y0, x0, w) = own.cores[c], own.corner(c)
            rows += [(centre, n, own.channels[c], y0, x0, w, num[t, 0][at].ravel(), den[t, 0][at].ravel()) for t, n in enumerate(own.frames) if den[t, 0][at].any()]
        return pd.DataFrame(rows, columns=COLUMNS)

    return windows.groupBy("center", "unit", "ty", "tx").applyInPandas(run, CONTRIBUTION)


def aggregate(contrib: DataFrame, pixels: DataFrame) -> DataFrame:
    """(n, channel, y, x, v): sums by target pixel, divided; uncovered pixels keep the source."""
    each = contrib.select("target", "channel", "y0", "x0", "w", F.posexplode(F.arrays_zip("num", "den")).alias("i", "z"))
    sums = each.groupBy("target", "channel", (F.col("y0") + F.expr("i div w")).alias("_y"), (F.col("x0") + F.col("i") % F.col("w")).alias("_x")).agg(F.sum("z.num").alias("num"), F.sum("z.den").alias("den"))
    sums = sums.withColumnRenamed("channel", "_c")
    on = (pixels.n == sums.target) & (pixels.channel == sums._c) & (pixels.y == sums._y) & (pixels.x == sums._x)
    return pixels.join(sums, on, "left").select("n", "channel", "y", "x", F.coalesce(finish(F.col("num"), F.col("den"), F.col("v")), F.col("v")).alias("v"))


def apply(pixels: DataFrame, work: Callable | Sequence[Unit], radius: int = 0, guide: DataFrame | None = None, tiling: Tiling | None = None) -> DataFrame:
    """Frames: finished tile by tile where a centre gives its own frame alone, or where tiles are whole; else by the sum of the contributions."""
    if tiling is not None and not tiling.crop:
        return aggregate(contributions(pixels, work, radius, guide, tiling), pixels)
    return rolling(pixels, work, radius, guide=guide, tiling=tiling)


def volumes(pixels: DataFrame, work: Callable | Sequence[Unit], chunk: int = 32, halo: int = 8, tiling: Tiling | None = Tiling(16, even=True)) -> DataFrame:
    """Tumbling chunks of frames with a halo on both sides, and tiles; only a chunk's own frames and a tile's pixels are kept. work(volume, 0) gives finished frames."""
    held, works = dealt(pixels, work, tiling)
    key = lambda d: F.expr(f"(n + {d}) div {chunk}")
    split = held.select("*", F.explode(F.array_distinct(F.array(key(0), F.expr(f"greatest(n - {halo}, 0) div {chunk}"), key(halo)))).alias("chunk"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own, mine, rows = Window.of(pdf, tiling), int(pdf.chunk.iloc[0]), []
        if any(n // chunk == mine for n in own.frames):
            for c, (out, _) in enumerate(own.run(works[int(pdf.unit.iloc[0])], 0)):
                rows += [(n, own.channels[c], *own.corner(c), out[t, 0][own.cores[c]].ravel()) for t, n in enumerate(own.frames) if n // chunk == mine]
        return pd.DataFrame(rows, columns=["n", "channel", "y0", "x0", "w", "v"])

    return with_copies(split.groupBy("chunk", "unit", "ty", "tx").applyInPandas(run, FINISHED), pixels, work)


def with_copies(finished: DataFrame, pixels: DataFrame, work: Callable | Sequence[Unit]) -> DataFrame:
    """Pixels of finished tiles, and the source's of the channels of no unit."""
    at = finished.select("n", "channel", "y0", "x0", "w", F.posexplode("v").alias("i", "v"))
    out = at.select("n", "channel", F.expr("CAST(y0 + i div w AS INT)").alias("y"), F.expr("CAST(x0 + i % w AS INT)").alias("x"), "v")
    if callable(work):
        return out
    return out.unionByName(pixels.where(~F.col("channel").isin([int(c) for cs, _ in work for c in cs])).select(F.col("n").cast("long"), F.col("channel").cast("long"), F.col("y").cast("int"), F.col("x").cast("int"), F.col("v").cast("double")))


def chunk_keys(n: str, chunk: int, halo: int) -> str:
    """SQL of the chunks that a frame belongs to, as own frame or as halo."""
    return f"sequence(greatest({n} - {halo}, 0) div {chunk}, ({n} + {halo}) div {chunk})"


def finished(own: Window, work: Callable, radius: int, mine: Callable[[int], bool], guide: Window | None = None) -> list[tuple]:
    """(n, channel, y0, x0, w, v) of the own frames of a chunk whose halo of 2 radius frames is there, as far as the clip has them."""
    sums = [(np.zeros(s.shape), np.zeros(s.shape)) for s in own.stacks]
    kept = [t for t, n in enumerate(own.frames) if mine(n)]
    for t in range(max(0, min(kept) - radius), min(len(own.frames), max(kept) + radius + 1)):
        lo, hi = max(0, t - radius), min(len(own.frames), t + radius + 1)
        for (num, den), part in zip(sums, own.part(lo, hi).run(work, t - lo, None if guide is None else guide.part(lo, hi)), strict=True):
            num[lo:hi] += part[0]
            den[lo:hi] += part[1]
    rows = []
    for c, (num, den) in enumerate(sums):
        out = np.where(den > 1e-12, num / np.maximum(den, 1e-12), own.stacks[c])
        rows += [(own.frames[t], own.channels[c], *own.corner(c), out[t, 0][own.cores[c]].ravel()) for t in kept]
    return rows


def finished_chunk(frames: Sequence[int], stack: np.ndarray, channels: Sequence[int], work: Callable, radius: int, own: Callable[[int], bool]) -> list[tuple]:
    """(n, channel, h, w, v) of a chunk of whole planes (frames, channels, h, w)."""
    place = Place.whole(stack)
    window = Window(list(frames), list(channels), [stack[:, c : c + 1] for c in range(stack.shape[1])], [place] * stack.shape[1], [(slice(0, place.height), slice(0, place.width))] * stack.shape[1])
    return [(n, c, place.height, place.width, v) for n, c, _, _, _, v in finished(window, work, radius, own)]


def rolling(pixels: DataFrame, work: Callable | Sequence[Unit], radius: int, chunk: int = 4, guide: DataFrame | None = None, tiling: Tiling | None = None) -> DataFrame:
    """The same frames as contributions and their sum, chunk by chunk: one task holds a tile's window of chunk + 4 radius planes and emits finished pixels, so none is shuffled after it. The output doesn't depend on the chunk."""
    if tiling is not None and not tiling.crop:
        raise ValueError("rolling: tiles must be whole")
    held, works = dealt(pixels, work, tiling, guide)
    chunk = chunk if radius else 1
    split = held.select("*", F.explode(F.expr(chunk_keys("n", chunk, 2 * radius))).alias("chunk"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        src, key, rows = pdf[~pdf.is_guide], int(pdf.chunk.iloc[0]), []
        if (src.n // chunk == key).any():
            theirs = Window.of(pdf[pdf.is_guide], tiling) if pdf.is_guide.any() else None
            rows = finished(Window.of(src, tiling), works[int(pdf.unit.iloc[0])], radius, lambda n: n // chunk == key, theirs)
        return pd.DataFrame(rows, columns=["n", "channel", "y0", "x0", "w", "v"])

    return with_copies(split.groupBy("chunk", "unit", "ty", "tx").applyInPandas(run, FINISHED), pixels, work)


def exploded(planes: DataFrame) -> DataFrame:
    """Pixels of planes."""
    at = planes.select("n", "channel", "w", F.posexplode("v").alias("i", "v"))
    return at.select("n", "channel", F.expr("CAST(i div w AS INT)").alias("y"), (F.col("i") % F.col("w")).cast("int").alias("x"), "v")


def statistics(pixels: DataFrame, work: Callable, schema: str, tiling: Tiling | None = None) -> DataFrame:
    """(n, channel and the columns of schema): what work(window, 0, place=...) or, with a tiling, work(window, 0, place=..., core=...) says of each frame and tile, as a pandas frame. channel is the first of the frame's."""
    held, _ = dealt(pixels, work, tiling)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = Window.of(pdf, tiling)
        more = {} if tiling is None else {"core": own.cores[0]}
        out = work(np.concatenate(own.stacks, 1), 0, place=own.places[0], **more)
        out.insert(0, "channel", own.channels[0])
        out.insert(0, "n", own.frames[0])
        return out

    return held.groupBy("n", "ty", "tx").applyInPandas(run, f"n long, channel long, {schema}")


def noise_of(pixels: DataFrame) -> DataFrame:
    """(n, groups, sigma): the blind noise of channel 0 of each frame, guided by itself, from sums over tiles."""
    from selfsim.filters import numeric as N

    def work(win: np.ndarray, _: int, place: Place, core: tuple[slice, slice]) -> pd.DataFrame:
        return pd.DataFrame([N.noise(win[0, 0], win[0, 0], place, core)], columns=["total", "groups"])

    sums = statistics(pixels.where("channel = 0"), work, "total double, groups long", Tiling(28))
    return sums.groupBy("n").agg(F.sum("groups").alias("groups"), F.sum("total").alias("total")).select("n", "groups", (F.col("total") / F.nullif(F.col("groups"), F.lit(0))).alias("sigma"))


def group_map(pixels: DataFrame, spots: Callable, work: Callable, block: int, halo: int, radius: int = 0) -> DataFrame:
    """A filter from a function of groups, the hook that all group filters share: spots(window, place, t) gives the Matches of a frame's
    references, work(groups (n, k, channels, b, b), Matches) their estimates and weights; the estimates are averaged pixel by pixel.

    halo is how far a reference's estimate depends on samples around it, block included.
    """
    from selfsim.kernels import patches as K

    def run(win: np.ndarray, centre: int, place: Place | None = None) -> tuple[np.ndarray, np.ndarray]:
        where = place or Place.whole(win)
        return K.collect(win, centre, lambda t: spots(win, where, t), lambda found: work(K.blocks_of(win, found, block), found), block)

    return apply(pixels, run, radius, tiling=Tiling(2 * halo))
