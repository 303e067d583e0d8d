"""Operators on single rows of a tracer or void table, and their tallies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..core import CatalogueError, materialise, require

AXES = ("x", "y", "z")
#: Units in the last place by which a coordinate may miss the box and still be folded in.
FOLD = 4 * 2.0**-23
MORTON_BITS = 21


def wrap(v: Column, box: float) -> Column:
    """v folded into [0, box); what is not finite stays."""
    folded = F.pmod(v, F.lit(box))
    inside = (v >= 0) & (v < box)
    finite = ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))
    return F.when(inside | ~finite, v).when(v == box, F.lit(0.0)).otherwise(F.when(folded >= box, F.lit(0.0)).otherwise(folded))


def wrap_periodic(df: DataFrame, box: float, axes=AXES) -> DataFrame:
    require(box > 0, f"the box is {box}")
    return df.withColumns({c: wrap(F.col(c), box) for c in axes})


def wrap_tally(df: DataFrame, box: float, axes=AXES) -> DataFrame:
    """One row: coordinates that were not finite, on the upper boundary, and wrapped."""
    def bad(c):
        return F.isnan(c) | (F.abs(F.col(c)) == F.lit(float("inf")))

    def count(test):
        return sum((F.count_if(test(c)) for c in axes), F.lit(0))

    return df.agg(
        count(bad).alias("n_nonfinite"),
        count(lambda c: F.col(c) == box).alias("n_boundary"),
        count(lambda c: ~bad(c) & (F.col(c) != box) & ((F.col(c) < 0) | (F.col(c) > box))).alias("n_wrapped"),
    )


def outside_box(df: DataFrame, box: float, axes=AXES) -> DataFrame:
    """Rows with a coordinate that is neither in [0, box) nor within rounding of it."""
    slack = box * FOLD
    ok = F.lit(True)
    for c in axes:
        ok = ok & F.coalesce((F.col(c) >= -slack) & (F.col(c) < box + slack) & ~F.isnan(c), F.lit(False))
    return df.where(~ok)


def accept_box(df: DataFrame, box: float, key: str, axes=AXES) -> DataFrame:
    """df folded into the box; raises with the count and the first row that is outside."""
    n, first = outside_box(df, box, axes).agg(F.count("*"), F.min(key)).first()
    if n:
        raise CatalogueError(f"{n} rows lie outside the box of {box}, the first with {key} {first}")
    return wrap_periodic(df, box, axes)


def translate(df: DataFrame, offset, axes=AXES, units: str = "cartesian") -> DataFrame:
    require(units == "cartesian", "positions on the sky can't be translated")
    return df.withColumns({c: F.col(c) + F.lit(float(d)) for c, d in zip(axes, offset)})


def bounds(df: DataFrame, axes=AXES) -> DataFrame:
    """One row: minimum, maximum, centre and half span of every axis."""
    out = []
    for c in axes:
        lo, hi = F.min(c), F.max(c)
        out += [lo.alias(f"{c}_min"), hi.alias(f"{c}_max"), ((lo + hi) / 2).alias(f"{c}_centre"), ((hi - lo) / 2).alias(f"{c}_half")]
    return df.agg(*out)


def check_weights(df: DataFrame, weight: str = "w") -> None:
    """Weights must be finite, not negative, and not all zero."""
    bad, total = df.agg(F.count_if(F.col(weight).isNull() | F.isnan(weight) | (F.abs(F.col(weight)) == float("inf")) | (F.col(weight) < 0)), F.sum(weight)).first()
    require(not bad, f"{bad} weights are negative or not finite")
    require(total is not None and total > 0, "the weights add up to nothing")


def spread_bits(v: Column) -> Column:
    """Each of the lower 21 bits moved to every third place."""
    for shift, mask in ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v


def morton(df: DataFrame, low, high, axes=AXES) -> DataFrame:
    """df with its Morton code: positions between low and high in 2**21 steps an axis, bits interleaved."""
    top = float((1 << MORTON_BITS) - 1)
    code = F.lit(0).cast("long")
    for shift, (c, a, b) in enumerate(zip(axes, low, high)):
        step = F.floor((F.col(c) - F.lit(float(a))) / F.lit(max(float(b) - float(a), 1e-300)) * F.lit(top))
        q = F.greatest(F.lit(0), F.least(F.lit(int(top)), step)).cast("long")
        code = code.bitwiseOR(F.shiftleft(spread_bits(q), shift))
    return df.withColumn("morton", code)


def exact_subsample(df: DataFrame, fraction: float, key: list[str], draw: Column | None = None, seed: int = 0) -> DataFrame:
    """Exactly round(fraction * rows) rows; draw: a number a row, by default a hash of key, of which the smallest stay.

    The threshold is found from counts by piece of the draw's range, so no task orders all rows.
    """
    require(0 < fraction <= 1, f"the fraction is {fraction}")
    draw = F.xxhash64(F.lit(seed), *key) if draw is None else draw
    rows = df.withColumn("__draw", draw.cast("long"))
    n = rows.count()
    wanted = int(fraction * n + 0.5)
    if not wanted:
        return df.limit(0)
    low, high = -(2**63), 2**63 - 1
    inside = 0  # rows below the piece that holds the last wanted one
    while high - low > 0:
        width = max(1, (high - low + 1) // 1024)
        piece = F.floor((F.col("__draw").cast("decimal(38,0)") - F.lit(str(low)).cast("decimal(38,0)")) / F.lit(str(width)).cast("decimal(38,0)"))
        counts = sorted((int(r[0]), r[1]) for r in rows.where((F.col("__draw") >= low) & (F.col("__draw") <= high)).groupBy(piece).count().collect())
        for p, k in counts:
            if inside + k >= wanted:
                break
            inside += k
        low, high = low + p * width, min(high, low + (p + 1) * width - 1)
        if k <= 100_000:
            break
    sure = rows.where(F.col("__draw") < low)
    edge = rows.where((F.col("__draw") >= low) & (F.col("__draw") <= high)).withColumn("__at", F.row_number().over(Window.orderBy("__draw", *key))).where(F.col("__at") <= wanted - inside).drop("__at")
    return sure.unionByName(edge).drop("__draw")


def contrast(df: DataFrame, value: str = "value") -> DataFrame:
    """value / mean - 1; the mean must be positive. df is written down first, so that it is made once."""
    df = materialise(df)
    mean = df.agg(F.avg(value)).first()[0]
    require(mean is not None and mean > 0, f"the mean is {mean}")
    return df.withColumn(value, F.col(value) / F.lit(mean) - 1)


def compact(voids: DataFrame, radius: str = "r") -> DataFrame:
    """Without the rows that were given up, which have negative radii."""
    return voids.where(F.col(radius) >= 0)


def column_check(df: DataFrame, columns: list[str]) -> DataFrame:
    """For each column: rows, values that aren't finite, and minimum and maximum of the others."""
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in columns])).alias("s")).select("s.*")
    bad = F.col("v").isNull() | F.isnan("v") | (F.abs(F.col("v")) == float("inf"))
    good = F.when(~bad, F.col("v"))
    return rows.groupBy("name").agg(F.count("*").alias("n"), F.count_if(bad).alias("n_nonfinite"), F.min(good).alias("min"), F.max(good).alias("max"))


def check_catalogue(voids: DataFrame, box: float | None = None, sky: bool = False) -> DataFrame:
    """problem, severity, n: what a void catalogue has against it."""
    def bad(c):
        return F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf"))

    rules = [("radius not finite or not positive", "error", bad("r") | (F.col("r") <= 0)), ("centre not finite", "error", bad("cx") | bad("cy") | bad("cz"))]
    if sky:
        rules.append(("position off the sky", "error", (F.col("cx") < 0) | (F.col("cx") >= 360) | (F.abs(F.col("cy")) > 90)))
    elif box:
        slack = 1e-5 * box
        rules.append(("centre outside the box", "warning", sum(((F.col(c) < -slack) | (F.col(c) >= box + slack)).cast("int") for c in ("cx", "cy", "cz")) > 0))
    one = voids.agg(*[F.count_if(test).alias(f"n{i}") for i, (_, _, test) in enumerate(rules)])
    listed = F.array(*[F.struct(F.lit(p).alias("problem"), F.lit(s).alias("severity"), F.col(f"n{i}").alias("n")) for i, (p, s, _) in enumerate(rules)])
    return one.select(F.explode(listed).alias("x")).select("x.*").where("n > 0")


def bits_set(df: DataFrame, words: str) -> DataFrame:
    return df.agg(F.sum(F.bit_count(words).cast("long")).alias("n_set"))


def tally(df: DataFrame, finding: Column, radius: str = "radius", worst: Column | None = None) -> DataFrame:
    """One row on the rows that a finding holds for: n, r_min, r_max, and the largest of a measure."""
    hit = F.coalesce(finding, F.lit(False))
    return df.agg(F.count_if(hit).alias("n"), F.min(F.when(hit, F.col(radius))).alias("r_min"), F.max(F.when(hit, F.col(radius))).alias("r_max"), F.max(F.when(hit, worst if worst is not None else F.lit(0.0))).alias("worst"))


def add_columns(df: DataFrame, other: DataFrame, key: str = "idx") -> DataFrame:
    """df with the further columns of a file that lists the same rows in the same order."""
    require(not set(other.columns) & set(df.columns) - {key}, "both sides have a column of the same name")
    joined = df.join(other, key, "left")
    missing = joined.where(F.col(next(c for c in other.columns if c != key)).isNull()).limit(1).count()
    require(not missing, "the other file has fewer rows")
    return joined
