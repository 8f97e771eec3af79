"""Fixed instants as columns. ``now`` is always a parameter so results repeat."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, functions as F


def to_millis(now) -> int:
    """Epoch millis of ``now``: int millis, ISO string, or datetime (naive = UTC)."""
    if isinstance(now, int):
        return now
    if isinstance(now, str):
        now = _dt.datetime.fromisoformat(now.replace("Z", "+00:00"))
    if now.tzinfo is None:
        now = now.replace(tzinfo=_dt.timezone.utc)
    return int(round(now.timestamp() * 1000))


def ts_lit(now) -> Column:
    """A TIMESTAMP literal for ``now`` independent of the Python process zone."""
    return F.timestamp_millis(F.lit(to_millis(now)))


def iso_utc(col) -> Column:
    """``Date.prototype.toISOString`` of a timestamp (session zone is UTC)."""
    return F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
