"""Time arithmetic with the reference's semantics.

Differences are computed on microsecond epochs so that whole days are
*floored* toward minus infinity (a timedelta's ``.days``: -12 h is -1 day),
which neither ``datediff`` nor ``timestampdiff`` do.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lapse.functions.util import col

MICROS_PER_DAY = 86_400_000_000


def as_ts(c) -> Column:
    """Session-zone timestamp (driver parquet stores ``timestamp_ntz``)."""
    return col(c).cast("timestamp")


def elapsed_micros(a, b) -> Column:
    return F.unix_micros(as_ts(a)) - F.unix_micros(as_ts(b))


def elapsed_days(a, b) -> Column:
    """Whole days from ``b`` to ``a``, floored."""
    return F.floor(elapsed_micros(a, b) / F.lit(MICROS_PER_DAY))


def elapsed_seconds(a, b) -> Column:
    """Seconds from ``b`` to ``a`` as double."""
    return elapsed_micros(a, b) / F.lit(1_000_000.0)


def calendar_days(a, b) -> Column:
    """Calendar-day difference of the two dates."""
    return F.datediff(F.to_date(as_ts(a)), F.to_date(as_ts(b)))


def plus_days(ts, n: int = 1) -> Column:
    """Timestamp shifted by ``n`` days."""
    return F.timestamp_micros(F.unix_micros(as_ts(ts)) + F.lit(n * MICROS_PER_DAY))


def ts_text(ts) -> Column:
    """Second-resolution text form, used where results leave the engine."""
    return F.date_format(as_ts(ts), "yyyy-MM-dd HH:mm:ss")
