"""Scalar column expressions: shaping, angles, powers, logs, bit subsets."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Guards used in ratios and logarithms, and the floor given to a vanished kernel weight.
EPSILON = 1e-30
KERNEL_FLOOR = 1e-5


def clamp(x: Column, low, high) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def mix(a: Column, b: Column, t) -> Column:
    t = F.lit(t) if not isinstance(t, Column) else t
    return a * (1 - t) + b * t


def fract(x: Column) -> Column:
    return x - F.floor(x)


def step(edge, x: Column) -> Column:
    return F.when(x < F.lit(edge), 0.0).otherwise(1.0)


def smoothstep(low, high, x: Column) -> Column:
    t = clamp((x - F.lit(low)) / (F.lit(high) - F.lit(low)), 0.0, 1.0)
    return t * t * (3 - 2 * t)


def sgn(x: Column) -> Column:
    """Sign that calls zero positive (``signum`` gives 0 there)."""
    return F.when(x < 0, -1.0).otherwise(1.0)


def scrub(x: Column) -> Column:
    """NaN and infinities become 0."""
    bad = F.isnan(x) | x.isin(float("inf"), float("-inf"))
    return F.when(bad, 0.0).otherwise(x)


def acos_degrees(x: Column) -> Column:
    return F.degrees(F.acos(clamp(x, -1.0, 1.0)))


def log_abs(x: Column) -> Column:
    """``ln(|x|)`` kept finite at zero."""
    return F.ln(F.abs(x) + F.lit(EPSILON))


def log_rescale(x: Column, base: float) -> Column:
    """Map [0, 1] onto itself, ``log(x*base + 1) / log(base + 1)``."""
    return F.ln(x * base + 1) / F.ln(F.lit(base + 1.0))


def powers(x: Column, exponents: Iterable[int]) -> list[Column]:
    return [F.pow(x, F.lit(float(p))) for p in exponents]


def in_subset(code: Column, bit: int) -> Column:
    """Is class ``bit`` a member of the class subset encoded as an integer?"""
    return F.shiftright(code, bit).bitwiseAND(F.lit(1)) == 1


def mask_bit(mask: Column, position: Column) -> Column:
    """Is voter ``position`` (1-based) enabled in a string such as ``0011001``?"""
    return F.substring(mask, position, F.lit(1)) == "1"


def neg_log_cost(share: Column, area: Column) -> Column:
    """Labelling cost of a vote share: ``-ln((100 + share) * area / 100)``; infinite at zero area."""
    inside = (F.lit(100.0) + share) * area / 100.0
    return F.when(inside > 0, -F.ln(inside)).otherwise(F.lit(float("inf")))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))
