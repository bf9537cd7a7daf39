"""Small column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def safe_div(num, den) -> Column:
    """num / den, 0.0 when den is 0 or NULL (T28 guard)."""
    return F.coalesce(F.try_divide(col(num).cast("double"), col(den).cast("double")), F.lit(0.0))


def fixed_sum(c, digits: int = 6) -> Column:
    """Sum of a double in fixed point (whole micro-units as decimals, wide
    enough for any sum of money), cast back.

    Decimal addition is associative, so the result does not depend on the
    order partial sums arrive in: a recomputed partition (lost executor) or a
    second evaluation in the same plan yields the same bits, which keeps
    comparisons against quantiles of the same sums consistent.
    """
    scale = 10 ** digits
    return (F.sum(F.round(col(c) * F.lit(float(scale))).cast("decimal(28,0)")).cast("double") / F.lit(float(scale)))


def count_below(cuts, value, n_cuts: int) -> Column:
    """Number of elements of the sorted array ``cuts`` that are < ``value``
    (a lower-bound binary search), in ⌈log2(n_cuts+1)⌉ + 1 steps of an
    ``aggregate`` over a fixed sequence: O(log n) per row instead of a linear
    scan over the cut points."""
    import math
    steps = max(1, math.ceil(math.log2(n_cuts + 1)) + 1)
    arr, v = col(cuts), col(value)

    def step(acc, _i):
        lo, hi = acc["lo"], acc["hi"]
        mid = F.floor((lo + hi) / 2).cast("int")
        below = F.element_at(arr, mid + 1) < v
        moved = F.when(below, F.struct((mid + 1).alias("lo"), hi.alias("hi"))).otherwise(
            F.struct(lo.alias("lo"), mid.alias("hi")))
        return F.when(lo < hi, moved).otherwise(acc)

    init = F.struct(F.lit(0).alias("lo"), F.size(arr).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), init, step, lambda acc: acc["lo"])


def fixed_mean(c, digits: int = 6) -> Column:
    """Mean of values that are exact at ``digits`` decimals (money, counts),
    summed as whole decimals and divided once: independent of summation order."""
    scale = float(10 ** digits)
    return (F.sum(F.round(col(c) * F.lit(scale)).cast("decimal(28,0)")).cast("double") / F.count(col(c)) / F.lit(scale))


def round_half_away(c, digits: int = 6) -> Column:
    """``round(x * 10^d) / 10^d`` in floating point: the same operations an
    SQL engine's double ``round`` performs, so equal doubles give equal
    results even on exact decimal ties (used for compared outputs)."""
    scale = float(10 ** digits)
    return F.round(col(c) * F.lit(scale)) / F.lit(scale)
