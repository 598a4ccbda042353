"""Change log as a stream: every micro-batch keeps the last value per cell in a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cell_state(stream: DataFrame, key: str = "object_id") -> DataFrame:
    """Streaming aggregate (key, field, value): the last value per cell by (ts, seq); write it in update or complete mode."""
    return stream.groupBy(key, "field").agg(F.max_by("value", F.struct("ts", "seq")).alias("value"))


def changes_per_window(stream: DataFrame, size: str = "1 day", late: str = "2 days") -> DataFrame:
    """Changes per field and window, late rows beyond the watermark dropped; append mode."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", size), "field").agg(F.count("*").alias("changes"))
