"""Broadcast behind a size check.

A side is broadcast only after a bounded count proves, for this very input, that it
holds at most ``max_rows`` rows (``limit(max_rows + 1).count()`` stops reading once the
bound is passed). Beyond the bound the plain join is returned and Spark shuffles both
sides, with AQE free to demote it to a broadcast if the measured output is small.
The answer is not kept: a file may grow between two plans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fits(df: DataFrame, max_rows: int) -> bool:
    """True if ``df`` has at most ``max_rows`` rows."""
    return df.limit(max_rows + 1).count() <= max_rows


def bounded_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """``broadcast(df)`` when the size check passes, else ``df`` unchanged."""
    return F.broadcast(df) if fits(df, max_rows) else df
