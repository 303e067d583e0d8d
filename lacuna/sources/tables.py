"""Point sets, catalogues and spectra derived from the parquet tables by fixed rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BOX = 100.0
# Spheres without tracers, as x, y, z, radius.
HOLES = [(25.0, 25.0, 25.0, 13.0), (75.0, 70.0, 30.0, 10.5), (35.0, 80.0, 75.0, 9.0), (80.0, 20.0, 85.0, 7.5)]

#: The columns of a tracer, in SQL that Spark and DuckDB both read.
TRACER_COLUMNS = """
  CAST(((l_orderkey*7919 + l_linenumber*104729) % 1000003) AS DOUBLE)/1000003.0e0*100.0e0 AS x,
  CAST(((l_partkey*15485863 + l_orderkey*31) % 1000003) AS DOUBLE)/1000003.0e0*100.0e0 AS y,
  CAST(((l_suppkey*32452843 + l_orderkey*127 + l_linenumber*8191) % 1000003) AS DOUBLE)/1000003.0e0*100.0e0 AS z"""
VELOCITY_COLUMNS = "l_discount - 0.05e0 AS vx, l_tax - 0.04e0 AS vy, (l_quantity - 25.5e0)/100.0e0 AS vz"
VOID_COLUMNS = """
  s_suppkey AS void_id,
  CAST((s_suppkey*7919 + 13) % 1009 AS DOUBLE)/1009.0e0*100.0e0 AS cx,
  CAST((s_suppkey*104729 + 7) % 1013 AS DOUBLE)/1013.0e0*100.0e0 AS cy,
  CAST((s_suppkey*1299709 + 3) % 1019 AS DOUBLE)/1019.0e0*100.0e0 AS cz,
  5.0e0 + CAST(s_suppkey % 10 AS DOUBLE) AS r"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _columns(df: DataFrame, text: str) -> DataFrame:
    depth, parts, now = 0, [], ""
    for ch in text:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and not depth:
            parts.append(now)
            now = ""
        else:
            now += ch
    return df.selectExpr(*[p.strip() for p in [*parts, now]])


def tracers(spark: SparkSession, sf_dir: str, velocities: bool = False) -> DataFrame:
    """x, y, z in a box of 100, weight w, and velocities on demand."""
    return _columns(table(spark, sf_dir, "lineitem"), TRACER_COLUMNS + ", l_quantity AS w" + (", " + VELOCITY_COLUMNS) * velocities)


def keep_outside(df: DataFrame, holes=HOLES, box: float = BOX) -> DataFrame:
    """Rows in none of the spheres, by minimum image."""
    for hx, hy, hz, r in holes:
        d2 = sum((_image(F.col(c) - F.lit(h), box) ** 2 for c, h in zip("xyz", (hx, hy, hz))), F.lit(0.0))
        df = df.where(d2 >= r * r)
    return df


def _image(d, box):
    return d - F.lit(box) * F.floor(d / F.lit(box) + 0.5)


def carved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keep_outside(tracers(spark, sf_dir))


def voids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _columns(table(spark, sf_dir, "supplier"), VOID_COLUMNS)


def sized_voids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue for size functions: void_id, r, brand."""
    return table(spark, sf_dir, "part").selectExpr("p_partkey AS void_id", "5.0e0 + p_size/5.0e0 AS r", "p_brand AS brand")


def sky(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr("c_custkey AS idx", "CAST(c_custkey*137 % 360 AS DOUBLE) AS ra", "CAST(c_custkey*71 % 120 AS DOUBLE) - 60.0e0 AS dec", "0.05e0 + CAST(c_custkey % 50 AS DOUBLE)/100.0e0 AS z")


def spectrum(spark: SparkSession, points: int = 512, low: float = -4.0, high: float = 2.0) -> DataFrame:
    """k, pk: a cold-dark-matter-like power spectrum, log-spaced in k."""
    step = (high - low) / (points - 1)
    k = spark.range(points).select(F.col("id").alias("i"), F.pow(F.lit(10.0), F.lit(low) + F.lit(step) * F.col("id")).alias("k"))
    q = F.col("k") / F.lit(0.2)
    transfer = F.log(1 + 2.34 * q) / (2.34 * q) * F.pow(1 + 3.89 * q + F.pow(16.1 * q, 2) + F.pow(5.46 * q, 3) + F.pow(6.71 * q, 4), F.lit(-0.25))
    return k.withColumn("pk", F.lit(1.468e6) * F.pow("k", F.lit(0.96)) * transfer * transfer)


SPECTRUM_SQL = """(SELECT i, k, 1.468e6 * pow(k, 0.96e0) * t * t AS pk FROM (
  SELECT i, k, ln(1 + 2.34e0*q)/(2.34e0*q) * pow(1 + 3.89e0*q + pow(16.1e0*q, 2) + pow(5.46e0*q, 3) + pow(6.71e0*q, 4), -0.25e0) AS t FROM (
    SELECT i, k, k/0.2e0 AS q FROM (SELECT i, pow(10.0e0, -4.0e0 + 6.0e0/511*i) AS k FROM range(512) AS n(i)))))"""
