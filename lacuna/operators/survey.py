"""Surveys: data and randoms in a region of any shape."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import GridSpec, require
from .assignment import deposit
from .spatial import cell_key


def survey_box(randoms: DataFrame, most_radius: float, least_radius: float, search_factor: float = 2.0) -> tuple[float, tuple[float, float, float]]:
    """A cubic box that leaves a margin around the randoms, and the offset that centres them in it."""
    row = randoms.agg(*[f(c).alias(f"{k}{c}") for c in "xyz" for k, f in (("lo", F.min), ("hi", F.max))]).first()
    require(row["lox"] is not None and all(math.isfinite(v) for v in row), "the randoms' extent isn't finite")
    margin = most_radius + max((search_factor - 1) * most_radius, 3 * least_radius) + least_radius
    box = max(row[f"hi{c}"] - row[f"lo{c}"] for c in "xyz") + 2 * 1.01 * margin
    return box, tuple(box / 2 - (row[f"lo{c}"] + row[f"hi{c}"]) / 2 for c in "xyz")


def occupied(randoms: DataFrame, spec: GridSpec) -> DataFrame:
    """ix, iy, iz of nodes that are nearest to a random."""
    node = [F.pmod(F.floor(F.col(c) / F.lit(spec.cell) + 0.5), F.lit(spec.n)).cast("int").alias(f"i{c}") for c in "xyz"]
    return randoms.select(*node).distinct()


def closing_steps(n_randoms: int, n_occupied: int) -> int:
    """Steps k of closing, so that (2k + 1)^3 nodes would hold 128 randoms or more; 4 at most."""
    mean = n_randoms / max(n_occupied, 1)
    k = 0
    while k < 4 and mean * (2 * k + 1) ** 3 < 128:
        k += 1
    return k


def _dilate(nodes: DataFrame, k: int, n: int) -> DataFrame:
    for c in "xyz":  # an axis at a time: cubes are products
        nodes = nodes.withColumn("__d", F.explode(F.sequence(F.lit(-k), F.lit(k)))).withColumn(f"i{c}", F.pmod(F.col(f"i{c}") + F.col("__d"), F.lit(n)).cast("int")).drop("__d").distinct()
    return nodes


def close(nodes: DataFrame, k: int, spec: GridSpec) -> DataFrame:
    """Nodes after a closing with a cube of 2k + 1: all that is within k of the nodes, without what is within k of the rest."""
    if not k:
        return nodes
    grown = _dilate(nodes, k, spec.n)
    for c in "xyz":
        rows = grown.withColumn("__d", F.explode(F.sequence(F.lit(-k), F.lit(k)))).withColumn(f"i{c}", F.pmod(F.col(f"i{c}") + F.col("__d"), F.lit(spec.n)).cast("int"))
        grown = rows.groupBy("ix", "iy", "iz").count().where(F.col("count") == 2 * k + 1).drop("count")
    return grown


def survey_contrast(data: DataFrame, randoms: DataFrame, spec: GridSpec, alpha: float, scheme: str = "cic", footprint: DataFrame | None = None, weight: str | None = None, random_weight: str | None = None) -> DataFrame:
    """ix, iy, iz, value: data over alpha times randoms, minus one, at nodes that have randoms; by weight, where given."""
    a = deposit(data, spec, scheme, weight).withColumnRenamed("value", "d")
    b = deposit(randoms, spec, scheme, random_weight).withColumnRenamed("value", "r")
    rows = b.where("r > 0").join(a, ["ix", "iy", "iz"], "left")
    rows = rows.select("ix", "iy", "iz", (F.coalesce("d", F.lit(0.0)) / (F.lit(alpha) * F.col("r")) - 1).alias("value"))
    return rows if footprint is None else rows.join(footprint, ["ix", "iy", "iz"], "left_semi")


def footprint_fractions(voids: DataFrame, nodes: DataFrame, spec: GridSpec) -> DataFrame:
    """void_id, footprint, footprint_shell: observed shares of the sphere of radius r and of the shell from r to 2r.

    Points of a lattice around each void are looked up at their nearest nodes; the spacing is the larger of r / 8 and half a cell.
    """
    step = F.greatest(F.col("r") / 8, F.lit(spec.cell / 2))
    rows = voids.select("void_id", "cx", "cy", "cz", "r", step.alias("s")).withColumn("m", F.floor(2 * F.col("r") / F.col("s")).cast("int"))
    for c in "xyz":
        rows = rows.withColumn(f"l{c}", F.explode(F.sequence(-F.col("m"), F.col("m"))))
    d2 = (F.col("lx") * F.col("lx") + F.col("ly") * F.col("ly") + F.col("lz") * F.col("lz")) * F.col("s") * F.col("s")
    rows = rows.withColumn("d2", d2).where("d2 <= 4 * r * r")
    node = {f"i{c}": F.pmod(F.floor((F.col(f"c{c}") + F.col(f"l{c}") * F.col("s")) / F.lit(spec.cell) + 0.5), F.lit(spec.n)).cast("int") for c in "xyz"}
    met = rows.withColumns(node).withColumn("__cell", cell_key(F.col("ix"), F.col("iy"), F.col("iz"), spec.n)).select("void_id", "d2", "r", "__cell")
    seen = nodes.select(cell_key(F.col("ix"), F.col("iy"), F.col("iz"), spec.n).alias("__cell"), F.lit(1.0).alias("seen"))
    met = met.join(seen, "__cell", "left").withColumn("seen", F.coalesce("seen", F.lit(0.0)))
    inside = F.col("d2") <= F.col("r") * F.col("r")
    return met.groupBy("void_id").agg(F.avg(F.when(inside, F.col("seen"))).alias("footprint"), F.avg(F.when(~inside, F.col("seen"))).alias("footprint_shell"))


def solid_angle(randoms: DataFrame, bands: int = 64) -> float:
    """Solid angle in steradians that the randoms (x, y, z from the observer) cover, from equal-area cells of the sky.

    Cells next to empty ones count by their number of randoms against the mean of inner cells.
    """
    d = F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)
    row = F.least(F.floor((F.col("z") / d + 1) / 2 * bands), F.lit(bands - 1)).cast("int")
    wide = 2 * bands
    col = F.least(F.floor(F.pmod(F.atan2("y", "x"), F.lit(2 * math.pi)) / (2 * math.pi) * wide), F.lit(wide - 1)).cast("int")
    cells = {(r["a"], r["b"]): r["n"] for r in randoms.groupBy(row.alias("a"), col.alias("b")).agg(F.count("*").alias("n")).collect()}  # bands * 2 bands at most
    require(bool(cells), "there are no randoms")

    def around(a, b):
        return [(i, j % wide) for i in (a - 1, a, a + 1) for j in (b - 1, b, b + 1) if 0 <= i < bands]

    inner = [n for c, n in cells.items() if all(x in cells for x in around(*c))]
    area = 4 * math.pi / (bands * wide)
    if not inner:
        return area * len(cells)
    mean = sum(inner) / len(inner)
    edge = sum(min(1.0, n / mean) for c, n in cells.items() if not all(x in cells for x in around(*c)))
    return area * (len(inner) + edge)


def survey_volume(randoms: DataFrame, bands: int = 64) -> float:
    """The volume of a region that is a solid angle times a range of distances."""
    d = F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)
    lo, hi = randoms.agg(F.min(d), F.max(d)).first()
    return solid_angle(randoms, bands) * (hi**3 - lo**3) / 3
