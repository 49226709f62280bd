"""Processing time as columns: milliseconds since 1970."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def millis(ts: str) -> Column:
    """Whole milliseconds of a timestamp without zone, whatever the session's zone is."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts}) div 1000")


def align(ms: Column, interval: int) -> Column:
    """Start of the reporting interval that holds a time."""
    return ms - ms % interval
