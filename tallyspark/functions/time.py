"""The processing time: a column that callers fix, or the clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clock(now: Column | None = None) -> Column:
    """``now`` if it is given; else the time at which the query starts, the same for all its rows."""
    return F.current_timestamp() if now is None else now
