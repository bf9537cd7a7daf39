"""Skew-reducing transforms as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lapse.functions.util import col


def log_shift(c, shift: float = 0.1) -> Column:
    """ln(x + shift); NULL where the argument is not positive."""
    return F.ln(col(c).cast("double") + F.lit(shift))


def sqrt(c) -> Column:
    return F.sqrt(col(c).cast("double"))


def boxcox(c, lam) -> Column:
    """Box-Cox transform for a given λ (a number or a column): ln(x) at
    λ = 0, (x^λ - 1)/λ otherwise; NULL for x <= 0 (B17)."""
    x = col(c).cast("double")
    lam = lam if isinstance(lam, Column) else F.lit(float(lam))
    y = F.when(lam == 0, F.ln(x)).otherwise((F.pow(x, lam) - 1) / lam)
    return F.when(x > 0, y)


def boxcox1p(c, lam) -> Column:
    """Box-Cox of 1 + x (B17); NULL for x <= -1."""
    return boxcox(col(c).cast("double") + 1, lam)
