"""Joins whose smaller side is broadcast only after its size was checked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of ids (about 100 bytes each) up to which a side is broadcast; beyond, Spark shuffles both sides or decides itself.
BROADCAST_ROWS = 500_000


def is_small(df: DataFrame, rows: int | None = None) -> bool:
    """Whether ``df`` has at most ``rows`` rows (``BROADCAST_ROWS`` by default); the count stops there."""
    rows = BROADCAST_ROWS if rows is None else rows
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df``, marked for broadcast if it is small."""
    return F.broadcast(df) if is_small(df, rows) else df
