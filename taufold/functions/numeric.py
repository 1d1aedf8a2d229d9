"""Number expressions: buckets, hashes, normal draws and tails."""

from __future__ import annotations

import bisect
import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from taufold.functions.values import (
    SQRT_TWO_PI,
    TAIL_DENOMINATOR,
    TAIL_FAR_END,
    TAIL_NUMERATOR,
    TAIL_SPLIT,
)


def cuts_at_or_below(column: str, cuts: Sequence[float]) -> Column:
    """How many of the sorted ``cuts`` are <= the named column, as a balanced tree of comparisons.

    Stays inside generated code with log2(len(cuts)) comparisons per row; no join
    of rows with cuts.  NULL stays NULL.
    """
    return F.expr(f"CASE WHEN `{column}` IS NOT NULL THEN {_search(f'`{column}` >=', cuts, 0, len(cuts))} END")


def cuts_below(column: str, cuts: Sequence[float]) -> Column:
    """How many of the sorted ``cuts`` are < the named column."""
    return F.expr(f"CASE WHEN `{column}` IS NOT NULL THEN {_search(f'`{column}` >', cuts, 0, len(cuts))} END")


def _search(compare: str, cuts: Sequence[float], low: int, high: int) -> str:
    """SQL text: parsed once, where the same tree of Column calls takes a round trip per node."""
    if low == high:
        return str(low)
    mid = (low + high) // 2
    above, below = _search(compare, cuts, mid + 1, high), _search(compare, cuts, low, mid)
    return f"CASE WHEN {compare} DOUBLE('{float(cuts[mid])!r}') THEN {above} ELSE {below} END"


def hash32(seed: int, *keys: Column) -> Column:
    """32 bits of md5 over seed and keys: the same on every layout, rerun and engine."""
    text = F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def uniform(seed: int, *keys: Column) -> Column:
    """Uniform in (0, 1), never 0 or 1."""
    return (hash32(seed, *keys).cast("double") + 0.5) / float(2**32)


def standard_normal(seed: int, *keys: Column) -> Column:
    """One standard normal per key by Box-Muller; independent of partitioning."""
    radius = F.sqrt(-2.0 * F.log(uniform(seed, *keys, F.lit("r"))))
    return radius * F.cos(2.0 * math.pi * uniform(seed, *keys, F.lit("t")))


def poisson_steps() -> list[float]:
    """Distribution function of Poisson(1): a uniform's draw is the number of steps at or below it."""
    steps, total, term = [], 0.0, math.exp(-1.0)
    for k in range(13):
        term = term if k == 0 else term / k
        total += term
        steps.append(total)
    return steps


def poisson_one(uniform_column: str) -> Column:
    """Poisson(1) draw by inversion of a column of uniforms."""
    return cuts_at_or_below(uniform_column, poisson_steps())


def normal_tail(z: Column) -> Column:
    """P(Z > |z|), computed as a tail so that it keeps relative precision."""
    a = F.abs(z)
    peak = F.exp(-a * a / 2.0)
    near = peak * _horner(a, TAIL_NUMERATOR) / _horner(a, TAIL_DENOMINATOR)
    fraction = a + TAIL_FAR_END
    for k in (4.0, 3.0, 2.0, 1.0):
        fraction = a + F.lit(k) / fraction
    far = peak / fraction / SQRT_TWO_PI
    return F.when(a < TAIL_SPLIT, near).otherwise(far)


def _horner(x: Column, coefficients: Sequence[float]) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def two_sided_p(z: Column) -> Column:
    return 2.0 * normal_tail(z)


def student_two_sided(t: float, df: float) -> float:
    """Two-sided Student t p-value of one number, for result rows on the driver."""
    if t is None or math.isnan(t):
        return float("nan")
    return _incomplete_beta(df / 2.0, 0.5, df / (df + t * t))


def _incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0.0 or x >= 1.0:
        return min(max(x, 0.0), 1.0)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b
    return front * _beta_fraction(a, b, x) / a


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta, evaluated from its far end."""
    depth = 400
    value = 1.0
    for m in range(depth, 0, -1):
        half = m // 2
        if m % 2:
            d = -(a + half) * (a + b + half) * x / ((a + 2 * half) * (a + 2 * half + 1))
        else:
            d = half * (b - half) * x / ((a + 2 * half - 1) * (a + 2 * half))
        value = 1.0 + d / value
    return 1.0 / value


def interpolate(sorted_pair: tuple[float, float], share: float) -> float:
    low, high = sorted_pair
    return low if low == high else low + (high - low) * share


def distinct_cuts(cuts: Sequence[float]) -> list[float]:
    """Sorted cuts with repeated values dropped."""
    out: list[float] = []
    for c in cuts:
        if bisect.bisect_left(out, c) == len(out):
            out.append(c)
    return out
