"""Extension: observations as a stream. The batch operators have no streaming counterpart to match."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_overview(stream: DataFrame, fk: str, row_id: str, status: str) -> DataFrame:
    """fk, n_observations, latest_status so far: the state is one row for each entity. Output mode update or complete."""
    x = stream.filter(F.col(fk).isNotNull()).groupBy(fk).agg(F.count(F.lit(1)).alias("n_observations"), F.max(F.struct(row_id, status)).alias("last"))
    return x.select(fk, "n_observations", F.col(f"last.{status}").alias("latest_status"))


def windowed_counts(stream: DataFrame, time: str, key: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts of a key by tumbling event-time windows; rows later than the watermark are dropped by the engine, as streams must."""
    w = stream.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), key, "n")


def deduplicated(stream: DataFrame, keys: list[str], time: str, late: str = "2 days") -> DataFrame:
    """Rows without repeats of the keys within the watermark: retried uploads with a new id count once."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
