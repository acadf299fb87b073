"""Sending small tables to all tasks, by their counted size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a few bytes each that may be broadcast: some 10 MB.
BROADCAST_ROWS = 500_000


def sendable(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The stored table ``df``, marked for broadcast if it has at most ``rows`` rows; a shuffle joins it otherwise."""
    return F.broadcast(df) if df.count() <= rows else df
