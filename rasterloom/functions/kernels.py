"""Neighbourhood offsets as small constant arrays to explode."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, functions as F


def linear_kernel(radius: float) -> Callable[[float], float]:
    """Weight 1 - d/radius inside the radius, 0 outside."""
    return lambda d: max(1.0 - d / radius, 0.0)


def disc(radius: float) -> list[tuple[int, int, float]]:
    """(dy, dx, distance) of every lattice offset within ``radius``."""
    reach = math.ceil(radius)
    span = range(-reach, reach + 1)
    return [(dy, dx, math.hypot(dy, dx)) for dy in span for dx in span
            if math.hypot(dy, dx) <= radius]


def box(radius: int) -> list[tuple[int, int, float]]:
    """(dy, dx, Euclidean distance) of the (2r+1) square."""
    span = range(-radius, radius + 1)
    return [(dy, dx, math.hypot(dy, dx)) for dy in span for dx in span]


def weighted_disc(radius: float, kernel: Callable[[float], float]) -> list[tuple[int, int, float]]:
    """Disc offsets with a kernel weight, dropping those whose weight is zero."""
    return [(dy, dx, kernel(d)) for dy, dx, d in disc(radius) if kernel(d) > 0]


def offset_array(offsets: list[tuple[int, int, float]]) -> Column:
    """Constant array of struct(dy, dx, w); explode it next to a pixel row."""
    return F.array(*[
        F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(float(w)).alias("w"))
        for dy, dx, w in offsets])
