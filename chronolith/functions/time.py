"""Bi-temporal validity. Times are epoch seconds; ``now`` is always an argument, never the wall clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STUB_SOURCE = "partition:stub"


def valid_at(t: Column | int) -> Column:
    """Not tombstoned, and t in the half-open [valid_from, valid_until); valid_from defaults to observed_at."""
    t = F.lit(t) if isinstance(t, int) else t
    begun = F.coalesce("valid_from", "observed_at") <= t
    return ~F.col("tombstoned") & begun & (F.col("valid_until").isNull() | (F.col("valid_until") > t))


def live_now(now: int) -> Column:
    """The listing paths' filter: not tombstoned and not expired (valid_from plays no part)."""
    return ~F.col("tombstoned") & unexpired(now)


def unexpired(now: int) -> Column:
    return F.col("valid_until").isNull() | (F.col("valid_until") > now)


def no_stub() -> Column:
    return F.col("source") != STUB_SOURCE
