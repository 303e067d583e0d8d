"""Voronoi volumes by random samples: each belongs to the nearest tracer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import materialise, require
from .spatial import nearest


def uniform_points(spark, n: int, box: float, seed: int = 0) -> DataFrame:
    """n points, the same ones on every run and in any partitioning."""
    draws = [((F.xxhash64(F.col("id"), F.lit(seed), F.lit(k)).bitwiseAND(F.lit((1 << 53) - 1))) / F.lit(float(1 << 53)) * F.lit(box)).alias(c) for k, c in enumerate(("cx", "cy", "cz"))]
    return spark.range(n).select(F.col("id").alias("sample"), *draws)


def tessellate(tracers: DataFrame, box: float, per_tracer: int = 32, key: str = "idx", seed: int = 0, cells: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(idx, n_samples, volume) of all tracers, and the samples (x, y, z, w), whose weights share out their owner's.

    The owner's weight is one, or its column w. Tracers that no sample is nearest to have volume 0.
    """
    n = tracers.count()
    require(n > 0, "there are no tracers")
    points = materialise(uniform_points(tracers.sparkSession, n * per_tracer, box, seed))
    owned = materialise(nearest(points, tracers, box, "sample", key, cells or max(1, min(256, round((n / 2) ** (1 / 3))))).select("sample", key))
    counts = owned.groupBy(key).agg(F.count("*").alias("n_samples"))
    unit = box**3 / (n * per_tracer)
    weight = F.col("w") if "w" in tracers.columns else F.lit(1.0)
    volumes = tracers.select(key, weight.alias("w")).join(counts, key, "left").withColumn("n_samples", F.coalesce("n_samples", F.lit(0)))
    shares = volumes.where("n_samples > 0").select(key, (F.col("w") / F.col("n_samples")).alias("w"))
    samples = points.join(owned, "sample").join(shares, key).select(F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("cz").alias("z"), "w")
    return volumes.select(key, "n_samples", (F.col("n_samples") * F.lit(unit)).alias("volume")), samples
