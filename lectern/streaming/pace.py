"""The acquisition pace as a stream: an addition of our own, for catalogs that grow while they are read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pace_stream(events: DataFrame, time_col: str = "ts", late: str = "1 day", window: str = "1 hour") -> DataFrame:
    """(start, n): how many rows fell into each window of event time, out of a streaming or a plain DataFrame. Rows that come
    later than `late` behind the newest are not counted in a stream."""
    time = F.col(time_col).cast("timestamp")
    rows = events.select(time.alias("t")).withWatermark("t", late)
    return rows.groupBy(F.window("t", window).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")
