"""Sequences and sums of plain numbers as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import require


def linspace(spark: SparkSession, low: float, high: float, n: int) -> DataFrame:
    """i, v: n numbers from low to high, both included."""
    require(n > 0, f"n is {n}")
    step = (high - low) / (n - 1) if n > 1 else 0.0
    return spark.range(n).select(F.col("id").alias("i"), F.when((F.col("id") == n - 1) & F.lit(n > 1), F.lit(float(high))).otherwise(F.lit(float(low)) + F.col("id") * F.lit(step)).alias("v"))


def arange(spark: SparkSession, low: float, high: float, step: float = 1.0) -> DataFrame:
    """i, v: from low by steps, short of high."""
    require(step != 0, "the step is 0")
    n = max(0, -int(-(high - low) // step))
    return spark.range(n).select(F.col("id").alias("i"), (F.lit(float(low)) + F.col("id") * F.lit(float(step))).alias("v"))


def logspace(spark: SparkSession, low: float, high: float, n: int) -> DataFrame:
    """i, v: n powers of ten between the exponents low and high."""
    return linspace(spark, low, high, n).withColumn("v", F.pow(F.lit(10.0), F.col("v")))


def constant(spark: SparkSession, n: int, value: float) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("i"), F.lit(float(value)).alias("v"))


def reduce(df: DataFrame, column: str = "v") -> DataFrame:
    """One row: sum, minimum and maximum."""
    return df.agg(F.sum(column).alias("sum"), F.min(column).alias("min"), F.max(column).alias("max"))
