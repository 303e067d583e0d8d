"""Joins by distance: cells turn a radius into an equality, so that Spark plans hash or sort-merge joins.

A centre is repeated once for each cell that its sphere reaches; a tracer lies in one cell. Cell sides should be near
the reach: smaller cells repeat centres more, larger ones bring tracers that the distance test drops.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import require


def image(d: Column, box: float) -> Column:
    """The shortest of d and its periodic images."""
    return d - F.lit(box) * F.floor(d / F.lit(box) + 0.5)


def cell_of(v: Column, cell: float, n: int) -> Column:
    return F.least(F.floor(v / F.lit(cell)), F.lit(n - 1)).cast("int")


def cell_key(x: Column, y: Column, z: Column, n: int) -> Column:
    return (x.cast("long") * n + y) * n + z


def cells_for(box: float, reach: float, most: int = 512) -> int:
    """Cells a side so that a cell's side is about half the reach."""
    return max(1, min(most, int(2 * box / max(reach, box / most))))


def with_cell(df: DataFrame, box: float, n: int, axes=("x", "y", "z"), name: str = "__cell") -> DataFrame:
    return df.withColumn(name, cell_key(*[cell_of(F.col(c), box / n, n) for c in axes], n))


def _reached(c: Column, reach: Column, cell: float, n: int, periodic: bool) -> Column:
    low, high = F.floor((c - reach) / F.lit(cell)).cast("int"), F.floor((c + reach) / F.lit(cell)).cast("int")
    if periodic:
        high = F.least(high, low + (n - 1))  # every cell once, even if the sphere wraps around
        return F.sequence(low, high)
    low, high = F.greatest(low, F.lit(0)), F.least(high, F.lit(n - 1))
    return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))


def _gap(c: Column, i: Column, cell: float, n: int, periodic: bool) -> Column:
    """Distance along an axis from c to the cell i, or to the nearest of its images."""
    def to(j):
        return F.greatest(F.lit(0.0), j * F.lit(cell) - c, c - (j + 1) * F.lit(cell))

    return F.least(to(i), to(i + n), to(i - n)) if periodic else to(i)


def reached_cells(centres: DataFrame, reach: Column, box: float, n: int, periodic: bool = True) -> DataFrame:
    """centres (cx, cy, cz) repeated for each cell their spheres touch, with its key __cell."""
    cell = box / n
    df = centres.withColumn("__reach", reach)
    for c in ("x", "y", "z"):
        df = df.withColumn(f"__{c}", F.explode(_reached(F.col(f"c{c}"), F.col("__reach"), cell, n, periodic)))
        df = df.withColumn(f"__g{c}", _gap(F.col(f"c{c}"), F.col(f"__{c}"), cell, n, periodic))
        df = df.where(sum((F.col(f"__g{k}") ** 2 for k in "xyz"[: "xyz".index(c) + 1]), F.lit(0.0)) <= F.col("__reach") ** 2 * (1 + 1e-9)) if n > 3 else df
    if periodic:
        df = df.withColumns({f"__{c}": F.pmod(F.col(f"__{c}"), F.lit(n)) for c in "xyz"})
    return df.withColumn("__cell", cell_key(F.col("__x"), F.col("__y"), F.col("__z"), n)).drop("__x", "__y", "__z", "__gx", "__gy", "__gz")


def within(centres: DataFrame, tracers: DataFrame, reach: Column, box: float, most_reach: float, periodic: bool = True) -> DataFrame:
    """Pairs of a centre (cx, cy, cz, ...) and a tracer (x, y, z, ...) no further apart than reach, with dx, dy, dz, d2.

    most_reach: the largest reach, which sets the cells. Column names of the two sides must differ.
    """
    require(box > 0 and most_reach > 0, "box and reach must be positive")
    n = cells_for(box, most_reach)
    left = reached_cells(centres, reach, box, n, periodic)
    right = with_cell(tracers, box, n)
    df = left.join(right, "__cell")
    for c in "xyz":
        d = F.col(c) - F.col(f"c{c}")
        df = df.withColumn(f"d{c}", image(d, box) if periodic else d)
    df = df.withColumn("d2", F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz"))
    return df.where(F.col("d2") <= F.col("__reach") * F.col("__reach")).drop("__cell", "__reach")


def nearest(centres: DataFrame, tracers: DataFrame, box: float, key: str, tracer_key: str, n: int, periodic: bool = True) -> DataFrame:
    """key, nearest tracer's tracer_key and d2 for each centre; ties go to the smallest tracer_key.

    Spheres are searched outwards; a centre is settled once one holds a tracer, so few centres go on to the next. The
    first sphere is a cell of n a side, or less where about 17 tracers would lie in less if they were spread evenly.
    """
    from ..core import materialise

    found, open_ = None, centres.select(key, "cx", "cy", "cz")
    reach = min(box / n, box * (4 / max(1, tracers.count())) ** (1 / 3))
    while True:
        near = within(open_, tracers, F.lit(reach), box, reach, periodic)
        best = near.groupBy(key).agg(F.min(F.struct("d2", tracer_key)).alias("b")).select(key, f"b.{tracer_key}", "b.d2")
        best = materialise(best)
        found = best if found is None else found.unionByName(best)
        rest = open_.join(best.select(key), key, "left_anti")
        if reach > box * (0.8661 if periodic else 1.7321) or rest.isEmpty():
            return found
        open_, reach = materialise(rest), reach * 2
