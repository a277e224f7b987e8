"""Weekly shares over a stream: the batch definition with a watermark, late rows counted until it passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 1970-01-01 was a Thursday: windows of seven days start on Mondays when shifted by four.
MONDAY = "4 days"


def weekly_window(ts: str) -> Column:
    """The week that a time lies in, from Monday."""
    return F.window(ts, "7 days", startTime=MONDAY)


def weekly_counts(events: DataFrame, ts: str, groups: list[str], inside: Column, lateness: str = "2 days") -> DataFrame:
    """(week, groups, records, inside, share) of a streaming or batch DataFrame."""
    g = events.withWatermark(ts, lateness).groupBy(weekly_window(ts).alias("w"), *groups).agg(F.count(F.lit(1)).alias("records"), F.count_if(inside).alias("inside"))
    return g.select(F.col("w.start").cast("date").alias("week"), *groups, "records", "inside", F.try_divide(F.col("inside").cast("double"), F.col("records").cast("double")).alias("share"))


def deduplicated(events: DataFrame, key: str, ts: str, lateness: str = "2 days") -> DataFrame:
    """The first row of each key within the watermark; state is dropped behind it."""
    return events.withWatermark(ts, lateness).dropDuplicatesWithinWatermark([key])


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there, write it as Parquet and stop; running again takes up only what is new."""
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
