"""Validation of rows as they arrive: digests by day of both sides' streams, given out once the watermark has closed a day."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.hashing import row_hash


def additive_digests(stream: DataFrame, time: str, columns: list[str], window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """window_start, window_end, row_count and hash_sum of a stream's rows.

    hash_sum adds the first 60 bits of the row hashes: free of order, sensitive to repetition, and one number of state for a
    window, so state doesn't grow with its rows.
    """
    part = F.conv(F.substring(row_hash(stream, columns), 1, 15), 16, 10).cast("decimal(38,0)")
    rows = stream.select(F.col(time).cast("timestamp").alias("__time"), part.alias("__part")).withWatermark("__time", delay)
    sums = rows.groupBy(F.window("__time", window).alias("w")).agg(F.count(F.lit(1)).alias("row_count"), F.sum("__part").alias("hash_sum"))
    return sums.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "row_count", F.col("hash_sum").cast("string").alias("hash_sum"))


def compare_windows(source: DataFrame, target: DataFrame) -> DataFrame:
    """Windows of two digest tables: window_start, both sides' rows and sums, match."""
    keys = ["window_start", "window_end"]
    s, t = (d.select(*keys, F.col("row_count").alias(f"{n}_rows"), F.col("hash_sum").alias(f"{n}_sum")) for d, n in ((source, "source"), (target, "target")))
    return s.join(t, keys, "full_outer").withColumn("match", F.col("source_rows").eqNullSafe(F.col("target_rows")) & F.col("source_sum").eqNullSafe(F.col("target_sum")))


def on_closed(stream: DataFrame, act: Callable[[DataFrame, int], None], checkpoint: str):
    """Start a query that calls act with each batch of closed windows; with the checkpoint it goes on where it ended."""
    return stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(act).start()
