"""Epoch milliseconds <-> TIMESTAMP_NTZ without touching the session zone.

Arithmetic between TIMESTAMP_NTZ values is zone-free, so results do not move
when a cluster runs with a different ``spark.sql.session.timeZone``.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EPOCH_TEXT = "1970-01-01 00:00:00"


def _epoch() -> Column:
    return F.lit(EPOCH_TEXT).cast("timestamp_ntz")


def epoch_millis(ts_ntz: Column) -> Column:
    """Whole milliseconds since the epoch (floored) of a wall-clock timestamp."""
    return F.timestamp_diff("MILLISECOND", _epoch(), ts_ntz)


def from_epoch_millis(ms: Column) -> Column:
    """Epoch milliseconds to TIMESTAMP_NTZ; 0 and null mean 'not set' and give null."""
    return F.timestamp_add("MILLISECOND", F.nullif(ms, F.lit(0)), _epoch())
