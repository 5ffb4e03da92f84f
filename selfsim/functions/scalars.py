"""Weights, thresholds and colour transforms as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1.1920928955078125e-07


def nlm_weight(u: Column, mode: int) -> Column:
    """Welsch (0) or the bisquare weights of power 1, 2, 8 (1 to 3)."""
    return F.exp(-u) if mode == 0 else F.pow(F.greatest(1 - u, F.lit(0.0)), F.lit({1: 1, 2: 2, 3: 8}[mode]))


def soft(x: Column, tau: Column) -> Column:
    return F.signum(x) * F.greatest(F.abs(x) - F.greatest(tau, F.lit(0.0)), F.lit(0.0))


def relax(x: Column, y: Column, delta: float) -> Column:
    return x + delta * (y - x)


def fixed_point(x: Column) -> Column:
    """x in units of 2^-32, half to even."""
    return F.rint(x * 4294967296.0).cast("long")


def opponent(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    return (r + g + b) / math.sqrt(3), (r - b) / math.sqrt(2), (r - 2 * g + b) / math.sqrt(6)


def rgb_of_opponent(a: Column, b: Column, c: Column) -> tuple[Column, Column, Column]:
    return a / math.sqrt(3) + b / math.sqrt(2) + c / math.sqrt(6), a / math.sqrt(3) - 2 * c / math.sqrt(6), a / math.sqrt(3) - b / math.sqrt(2) + c / math.sqrt(6)


def yuv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """BT.601, full range, chroma around zero."""
    y = 0.299 * r + 0.587 * g + 0.114 * b
    return y, (b - y) / 1.772, (r - y) / 1.402


def wiener(r: Column, sigma: float) -> Column:
    return r * r / (r * r + sigma * sigma)


def finish(num: Column, den: Column, source: Column, least: float = 1e-12) -> Column:
    return F.when(den > least, num / den).otherwise(source)


def tent(i: Column, p: int) -> Column:
    return 1 - F.abs(2 * i + 1 - p) / p


def pnlm_weight(distance: Column, p: int, s: float) -> Column:
    return F.exp(-F.greatest(distance / (p * p) - 2 * s * s, F.lit(0.0)) / (4 * s * s))


def fast_exp(x: Column) -> Column:
    """exp read off a single float's bit pattern, 12102203 x + 127 * 2^23 without its fraction; zero where that isn't positive."""
    t = F.lit(12102203.0).cast("float") * x.cast("float")
    bits = F.when(t > F.lit(-1065353216.0).cast("float"), t.cast("long") + 1065353216).otherwise(F.lit(0))
    mantissa = bits % 8388608
    # below 2^23 the bits are those of a subnormal number
    return F.when(bits >= 8388608, F.pow(F.lit(2.0), F.floor(bits / 8388608) - 127) * (1 + mantissa / 8388608.0)).otherwise(F.pow(F.lit(2.0), F.lit(-126)) * mantissa / 8388608.0)
