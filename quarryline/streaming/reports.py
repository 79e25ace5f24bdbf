"""Accounting as a stream (an extension: the batch reports are the reference for its results)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.operators import accounting


def windowed_stats(log: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Totals and savings of each project and window of created_at; rows later than `late` behind the newest are left out."""
    span = F.window("created_at", width)
    return accounting.with_savings(log.withWatermark("created_at", late).groupBy("project_id", span.alias("span")).agg(*accounting._totals()))
