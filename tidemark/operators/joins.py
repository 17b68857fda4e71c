"""What joins share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bounded(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """``df``, of a few numbers a row, marked for broadcast only if a count shows at most ``most`` rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
