"""Mass assignment: tracers spread over the nodes of a periodic grid by piecewise polynomial kernels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import GridSpec, require

# Nodes per axis that a tracer reaches, by scheme.
SCHEMES = {"ngp": 1, "cic": 2, "tsc": 3, "pcs": 4}


def axis_weights(u: Column, scheme: str) -> list[tuple[Column, Column]]:
    """(node, weight) along an axis, not wrapped; u: the position in cells."""
    if scheme == "ngp":
        return [(F.floor(u + 0.5), F.lit(1.0))]
    if scheme == "cic":
        i = F.floor(u)
        t = u - i
        return [(i, 1 - t), (i + 1, t)]
    if scheme == "tsc":
        i = F.floor(u + 0.5)
        t = u - i
        return [(i - 1, 0.5 * (0.5 - t) * (0.5 - t)), (i, 0.75 - t * t), (i + 1, 0.5 * (0.5 + t) * (0.5 + t))]
    require(scheme == "pcs", f"unknown scheme {scheme}")
    i = F.floor(u)
    t = u - i
    s = 1 - t
    return [(i - 1, s * s * s / 6), (i, (4 - 6 * t * t + 3 * t * t * t) / 6), (i + 1, (4 - 6 * s * s + 3 * s * s * s) / 6), (i + 2, t * t * t / 6)]


#: For each scheme: whether positions count from the nearest node rather than from the one below, and for each node that
#: a tracer reaches along an axis its offset and its weight, a polynomial in the position t counted so.
KERNELS = {
    "ngp": (True, [(0, (1.0,))]),
    "cic": (False, [(0, (1.0, -1.0)), (1, (0.0, 1.0))]),
    "tsc": (True, [(-1, (0.125, -0.5, 0.5)), (0, (0.75, 0.0, -1.0)), (1, (0.125, 0.5, 0.5))]),
    "pcs": (False, [(-1, (1 / 6, -0.5, 0.5, -1 / 6)), (0, (2 / 3, 0.0, -1.0, 0.5)), (1, (1 / 6, 0.5, 0.5, -0.5)), (2, (0.0, 0.0, 0.0, 1 / 6))]),
}


def deposit(tracers: DataFrame, spec: GridSpec, scheme: str = "cic", weight: str | None = None, shift: float = 0.0) -> DataFrame:
    """ix, iy, iz, value: weight per unit volume at nodes that got any; shift: of the grid, in cells.

    A tracer's weights at its nodes are polynomials of its place in its cell, so a cell's tracers count by their moments:
    these are summed on both sides of the shuffle, and only cells, not tracers, are spread over nodes, an axis at a time.
    """
    require(scheme in KERNELS, f"unknown scheme {scheme}")
    near, kernel = KERNELS[scheme]
    n, powers = F.lit(spec.n), range(len(kernel[0][1]))
    places, cells = {}, []
    for c in "xyz":
        u = F.col(c) / F.lit(spec.cell) - F.lit(shift)
        i = F.floor(u + 0.5) if near else F.floor(u)
        cells.append(F.pmod(i, n).cast("int").alias(f"i{c}"))
        places[c] = (u - i).alias(f"t{c}")
    rows = tracers.select(*cells, *places.values(), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("m"))

    def power(c: str, k: int) -> Column:
        out = F.col(f"t{c}") if k else F.lit(1.0)
        for _ in range(k - 1):
            out = out * F.col(f"t{c}")
        return out

    moments = [(a, b, c) for a in powers for b in powers for c in powers]
    sums = rows.groupBy("ix", "iy", "iz").agg(*[F.sum(F.col("m") * power("x", a) * power("y", b) * power("z", c)).alias(f"m{a}{b}{c}") for a, b, c in moments])
    left = [f"{a}{b}{c}" for a, b, c in moments]
    for axis in "xyz":
        rest = sorted({name[1:] for name in left})
        spread = F.array(*[F.struct(F.pmod(F.col(f"i{axis}") + off, n).cast("int").alias("i"), *[sum((F.lit(w) * F.col(f"m{k}{name}") for k, w in enumerate(weights) if w), F.lit(0.0)).alias(f"m{name}") for name in rest]) for off, weights in kernel])
        others = [f"i{c}" for c in "xyz" if c != axis]
        sums = sums.select(*others, F.explode(spread).alias("s")).select(*others, F.col("s.i").alias(f"i{axis}"), *[F.col(f"s.m{name}") for name in rest])
        left = rest
    return sums.groupBy("ix", "iy", "iz").agg((F.sum("m") / F.lit(spec.cell**3)).alias("value"))


def spine(spark, spec: GridSpec) -> DataFrame:
    """Every node of a grid."""
    n = F.lit(spec.n)
    ids = spark.range(spec.total)
    return ids.select(F.floor(F.col("id") / (n * n)).cast("int").alias("ix"), F.pmod(F.floor(F.col("id") / n), n).cast("int").alias("iy"), F.pmod(F.col("id"), n).cast("int").alias("iz"))


def dense(grid: DataFrame, spec: GridSpec, value: str = "value") -> DataFrame:
    """grid with zeros at the nodes that it lacks."""
    return spine(grid.sparkSession, spec).join(grid, ["ix", "iy", "iz"], "left").withColumn(value, F.coalesce(F.col(value), F.lit(0.0)))


def mesh(tracers: DataFrame, spec: GridSpec, weight: str | None = None) -> DataFrame:
    """cx, cy, cz, n, w: tracers and weight in each occupied cell."""
    cell = [F.least(F.floor(F.col(c) / F.lit(spec.cell)), F.lit(spec.n - 1)).cast("int").alias(f"c{c}") for c in "xyz"]
    return tracers.groupBy(*cell).agg(F.count("*").alias("n"), F.sum(F.col(weight) if weight else F.lit(1.0)).alias("w"))


def trilinear(points: DataFrame, grid: DataFrame, spec: GridSpec, key: str) -> DataFrame:
    """key and the grid's value at each point (x, y, z), linear between nodes."""
    df = points.select(key, *[F.array(*[F.struct(F.pmod(i, F.lit(spec.n)).cast("int").alias("i"), w.alias("w")) for i, w in axis_weights(F.col(c) / F.lit(spec.cell), "cic")]).alias(f"__{c}") for c in "xyz"])
    for c in "xyz":
        df = df.withColumn(f"__{c}", F.explode(f"__{c}"))
    df = df.select(key, F.col("__x.i").alias("ix"), F.col("__y.i").alias("iy"), F.col("__z.i").alias("iz"), (F.col("__x.w") * F.col("__y.w") * F.col("__z.w")).alias("__w"))
    return df.join(grid, ["ix", "iy", "iz"]).groupBy(key).agg(F.sum(F.col("__w") * F.col("value")).alias("value"))


def local_minima(grid: DataFrame, spec: GridSpec, threshold: float) -> DataFrame:
    """Nodes at or below the threshold that are lower than their 26 neighbours; of equal ones the first counts as lower.

    Only nodes below the threshold are compared: a neighbour above it can't be lower.
    """
    n = spec.n
    low = grid.where(F.col("value") <= threshold).withColumn("flat", (F.col("ix").cast("long") * n + F.col("iy")) * n + F.col("iz"))
    steps = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    near = low.select("value", "flat", "ix", "iy", "iz")
    for c in "xyz":
        near = near.withColumn(f"d{c}", steps)
    near = near.where("NOT (dx = 0 AND dy = 0 AND dz = 0)")
    near = near.select(*[F.pmod(F.col(f"i{c}") + F.col(f"d{c}"), F.lit(n)).cast("int").alias(f"i{c}") for c in "xyz"], F.struct(F.col("value"), F.col("flat")).alias("other"))
    best = near.groupBy("ix", "iy", "iz").agg(F.min("other").alias("other"))
    return low.join(best, ["ix", "iy", "iz"], "left").where(F.col("other").isNull() | (F.struct("value", "flat") < F.col("other"))).select("ix", "iy", "iz", "value", "flat")
