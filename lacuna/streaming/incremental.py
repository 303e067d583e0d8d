"""Catalogues that arrive bit by bit: size functions add up, so each batch only adds counts."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.measure import bin_of


def stream_size_counts(stream: DataFrame, low: float, high: float, n_bins: int, radius: str = "r") -> DataFrame:
    """bin, counts of a stream of voids, in logarithmic bins; for the "complete" or "update" output mode."""
    at = bin_of(F.log(radius), math.log(low), math.log(high), n_bins)
    return stream.where((F.col(radius) >= low) & (F.col(radius) <= high)).groupBy(at.alias("bin")).agg(F.count("*").alias("counts"))


def stream_windowed_counts(stream: DataFrame, time: str, width: str, late: str, value: str, low: float, high: float, n_bins: int) -> DataFrame:
    """Histogram of a value in windows of time, dropping what comes later than the watermark allows."""
    rows = stream.withWatermark(time, late).select(time, bin_of(F.col(value), low, high, n_bins).alias("bin")).where("bin IS NOT NULL")
    return rows.groupBy(F.window(time, width).alias("w"), "bin").agg(F.count("*").alias("counts")).select(F.col("w.start").alias("start"), "bin", "counts")


def run_to_table(counts: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Runs the stream over what there is into a table in memory, and returns that."""
    query = counts.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return counts.sparkSession.table(name)
