"""Boxes and points as Column builders. A box is six columns: <p>x0 <p>y0 <p>z0 <p>x1 <p>y1 <p>z1 for a prefix p."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


def _product(xs) -> Column:
    return reduce(lambda a, b: a * b, xs)


def extents(p: str) -> list[Column]:
    return [F.greatest(F.col(f"{p}{a}1") - F.col(f"{p}{a}0"), F.lit(0.0)) for a in AXES]


def volume(p: str) -> Column:
    return _product(extents(p))


def intersection(p: str, q: str) -> Column:
    """Volume that two boxes share."""
    return _product(F.greatest(F.least(F.col(f"{p}{a}1"), F.col(f"{q}{a}1")) - F.greatest(F.col(f"{p}{a}0"), F.col(f"{q}{a}0")), F.lit(0.0)) for a in AXES)


def iou(p: str, q: str) -> Column:
    """Shared volume over joint volume; 0 if the joint volume is 0."""
    shared = intersection(p, q)
    joint = volume(p) + volume(q) - shared
    return F.when(joint > 0, shared / joint).otherwise(0.0)


def over_smaller(p: str, q: str) -> Column:
    return intersection(p, q) / F.greatest(F.least(volume(p), volume(q)), F.lit(1e-12))


def smaller_over_larger(p: str, q: str) -> Column:
    return F.greatest(F.least(volume(p), volume(q)), F.lit(1e-12)) / F.greatest(F.greatest(volume(p), volume(q)), F.lit(1e-12))


def center(p: str, a: str) -> Column:
    return (F.col(f"{p}{a}0") + F.col(f"{p}{a}1")) * 0.5


def distance(ps: list[Column], qs: list[Column]) -> Column:
    return F.sqrt(reduce(lambda a, b: a + b, [(x - y) * (x - y) for x, y in zip(ps, qs, strict=True)]))


def diagonal(p: str) -> Column:
    return F.sqrt(reduce(lambda a, b: a + b, [e * e for e in extents(p)]))


def center_score(d: Column, diag_a: Column, diag_b: Column, least_scale: float) -> Column:
    """exp of minus the distance in units of the mean diagonal, which counts as least_scale at least."""
    return F.exp(-d / F.greatest((diag_a + diag_b) * 0.5, F.lit(least_scale)))


def time_score(frame: Column, last: Column, window: float) -> Column:
    """exp of minus the frames since last, over window; without a window 1 for the same frame; 0 if last is null."""
    gap = F.greatest(frame - last, F.lit(0))
    near = F.exp(-gap.cast("double") / window) if window > 0 else (gap == 0).cast("double")
    return F.when(last.isNull(), 0.0).otherwise(near)


def voxel(x: Column, size: float) -> Column:
    return F.floor(x / F.lit(size)).cast("int")


def corners(p: str) -> Column:
    """The eight corners as arrays of three: the lower four around, then the upper four."""
    at = lambda a, k: F.col(f"{p}{a}{k}")
    order = [(0, 0), (1, 0), (1, 1), (0, 1)]
    return F.array(*[F.array(at("x", i), at("y", j), at("z", k)) for k in (0, 1) for i, j in order])


def project(inverse: list[list[float]], fx: float, fy: float, cx: float, cy: float, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """Pixel column and row, rounded half to even, and depth of a point by a camera's inverse pose and focal lengths."""
    c = [F.lit(m[0]) * x + F.lit(m[1]) * y + F.lit(m[2]) * z + F.lit(m[3]) for m in inverse[:3]]
    return F.rint(F.lit(fx) * c[0] / c[2] + F.lit(cx)), F.rint(F.lit(fy) * c[1] / c[2] + F.lit(cy)), c[2]


def finite(x: Column, otherwise: float = 0.0) -> Column:
    """x, or `otherwise` for null, NaN and the infinities."""
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(bad, otherwise).otherwise(x)
