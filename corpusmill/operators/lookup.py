"""Joins of many rows with a lookup table whose size is looked at first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import staged

#: Rows up to which a lookup table is broadcast; more rows meet in an ordinary join.
BROADCAST_ROWS = 1_000_000


def sized(table: DataFrame, most: int | None = None) -> DataFrame:
    """The table, computed once, with a broadcast hint if it has at most ``most`` rows (``BROADCAST_ROWS``)."""
    t = staged(table, "lookup")
    return F.broadcast(t) if t.count() <= (BROADCAST_ROWS if most is None else most) else t
