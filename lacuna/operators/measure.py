"""Measurements on catalogues: size functions, profiles, one-point distributions."""

from __future__ import annotations

import math
from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..core import require
from .shells import sums_within
from .spatial import within


def bin_of(v: Column, low: float, high: float, n: int) -> Column:
    """The bin of v among n equal ones; the upper edge belongs to the last, what is outside to none."""
    i = F.floor((v - F.lit(low)) * F.lit(n / (high - low)))
    return F.when((v >= low) & (v <= high), F.least(i, F.lit(n - 1)).cast("int"))


def size_edges(low: float, high: float, n: int, logarithmic: bool) -> list[float]:
    if logarithmic:
        return [low * (high / low) ** (i / n) for i in range(n + 1)]
    return [low + (high - low) * i / n for i in range(n + 1)]


def size_function(voids: DataFrame, volume: float, n_bins: int, low: float = 0.0, high: float = 0.0, logarithmic: bool = True, radius: str = "r") -> DataFrame:
    """bin, r_lo, r_hi, r_centre, counts, vsf, err: voids per unit volume and unit of ln r, or of r. Bounds of 0 are the data's."""
    require(n_bins > 0 and volume > 0, "bins and volume must be positive")
    if low <= 0 or high <= 0:
        a, b = voids.agg(F.min(radius), F.max(radius)).first()
        require(a is not None, "the catalogue is empty")
        low, high = low if low > 0 else a, high if high > 0 else b
    require(0 < low < high, f"the radii go from {low} to {high}")
    r = F.col(radius)
    at = bin_of(F.log(r), math.log(low), math.log(high), n_bins) if logarithmic else bin_of(r, low, high, n_bins)
    counts = voids.where((r >= low) & (r <= high)).select(at.alias("bin")).where("bin IS NOT NULL").groupBy("bin").agg(F.count("*").alias("counts"))
    edges = size_edges(low, high, n_bins, logarithmic)
    rows = [(i, edges[i], edges[i + 1], math.sqrt(edges[i] * edges[i + 1]) if logarithmic else (edges[i] + edges[i + 1]) / 2, (math.log(edges[i + 1] / edges[i]) if logarithmic else edges[i + 1] - edges[i])) for i in range(n_bins)]
    bins = voids.sparkSession.createDataFrame(rows, "bin int, r_lo double, r_hi double, r_centre double, width double")
    out = bins.join(counts, "bin", "left").withColumn("counts", F.coalesce("counts", F.lit(0)).cast("long"))
    vsf = F.col("counts") / (F.lit(float(volume)) * F.col("width"))
    return out.withColumn("vsf", vsf).withColumn("err", F.when(F.col("counts") > 0, F.col("vsf") / F.sqrt("counts")).otherwise(0.0)).drop("width")


def combine_size_functions(parts: DataFrame, targets: DataFrame, how: str = "mean") -> DataFrame:
    """bin, r_centre, vsf, err on the targets' radii, from parts (input, r_centre, vsf, err).

    Each input counts within its own radii, log-log between two positive values and linearly otherwise. mean: error
    sqrt(sum err^2) / n. median: of an even number the mean of the middle two. stitch: the first input that counts.
    """
    require(how in ("mean", "median", "stitch"), f"unknown way {how}")
    order = Window.partitionBy("input").orderBy("r_centre")
    spans = parts.withColumns({"r2": F.lead("r_centre").over(order), "v2": F.lead("vsf").over(order), "e2": F.lead("err").over(order)})
    last = F.col("r2").isNull()
    hit = (F.col("t.r_centre") >= F.col("s.r_centre")) & (F.col("t.r_centre") < F.col("s.r2")) | last & (F.col("t.r_centre") == F.col("s.r_centre"))
    # Targets and inputs are binned curves of some tens of points each.
    met = targets.alias("t").join(F.broadcast(spans.alias("s")), hit)
    x = F.when(F.col("s.r2").isNull(), 0.0).otherwise(F.log(F.col("t.r_centre") / F.col("s.r_centre")) / F.log(F.col("s.r2") / F.col("s.r_centre")))

    def between(a, b):
        a, b = F.col(a), F.coalesce(F.col(b), F.col(a))
        return F.when((a > 0) & (b > 0), F.exp(F.log(a) * (1 - x) + F.log(b) * x)).otherwise(a * (1 - x) + b * x)

    met = met.select("t.bin", "t.r_centre", "s.input", between("s.vsf", "s.v2").alias("v"), between("s.err", "s.e2").alias("e"))
    if how == "mean":
        out = met.groupBy("bin", "r_centre").agg(F.avg("v").alias("vsf"), (F.sqrt(F.sum(F.col("e") * F.col("e"))) / F.count("*")).alias("err"))
    elif how == "median":
        ranked = met.withColumns({"k": F.row_number().over(Window.partitionBy("bin").orderBy("v", "input")), "m": F.count("*").over(Window.partitionBy("bin"))})
        middle = ranked.where("k = floor((m + 1) / 2) OR k = floor(m / 2) + 1")
        out = middle.groupBy("bin", "r_centre").agg(F.avg("v").alias("vsf"), F.avg("e").alias("err"))
    else:
        out = met.groupBy("bin", "r_centre").agg(F.min_by("v", "input").alias("vsf"), F.min_by("e", "input").alias("err"))
    return targets.select("bin", "r_centre").join(out, ["bin", "r_centre"], "left").select("bin", "r_centre", F.coalesce("vsf", F.lit(0.0)).alias("vsf"), F.coalesce("err", F.lit(0.0)).alias("err"))


def _binned_pairs(voids, tracers, box, n_bins, extent, most_radius, weight, velocity, weighted_velocity, periodic):
    """void_id, r, bin, n, mass and flow from a row for each pair of a void and a tracer."""
    near = within(voids, tracers, F.col("r") * F.lit(extent), box, most_radius * extent, periodic)
    d = F.sqrt("d2")
    at = F.floor(d * (F.lit(float(n_bins)) / (F.lit(extent) * F.col("r")))).cast("int")
    m = F.col(weight).cast("double") if weight else F.lit(1.0)
    near = near.withColumns({"bin": at, "m": m}).where(F.col("bin") < n_bins)
    sums = [F.count("*").alias("n"), F.sum("m").alias("mass")]
    if velocity:
        v = F.when(F.col("d2") > 0, (F.col("dx") * F.col("vx") + F.col("dy") * F.col("vy") + F.col("dz") * F.col("vz")) / d).otherwise(0.0)
        sums += [F.sum(v * F.col("m") if weighted_velocity else v).alias("flow")]
    binned = near.groupBy("void_id", "bin").agg(*sums)
    all_bins = voids.select("void_id", "r").withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))))
    return all_bins.join(binned, ["void_id", "bin"], "left")


def _binned_sums(voids, tracers, box, n_bins, extent, most_radius, weight, velocity, weighted_velocity, periodic):
    """void_id, r, bin, n, mass and flow from sums within each bin's outer edge."""
    weights, flow = (weight,) if weight else (), ("__vx", "__vy", "__vz") if velocity else ()
    if velocity:
        m = F.col(weight).cast("double") if weight and weighted_velocity else F.lit(1.0)
        tracers = tracers.withColumns({f"__v{c}": F.col(f"v{c}") * m for c in "xyz"})
    # In the tasks, so that voids don't carry n_bins limits into each block; a void without a size has no limits.
    spread, r = partial(bin_limits, n_bins=n_bins, extent=extent), F.col("r").cast("double")
    sized = voids.where((r > 0) & (r < float("inf")))
    sums = sums_within(sized, tracers, r, n_bins, box, most_radius * extent, weights, periodic=periodic, flow=flow, reach=r * F.lit(extent), spread=spread)
    named = {"n": "n", "mass": weight or "n"}
    both = voids.select("void_id", "r").join(sums, "void_id", "left")
    own = [[F.col(f"flow_{k}").alias("flow")] if velocity else [] for k in range(n_bins)]
    step = [F.struct(F.lit(k).alias("bin"), *own[k], *[(F.col(f"{c}_{k}") - F.col(f"{c}_{k - 1}") if k else F.col(f"{c}_0")).alias(out) for out, c in named.items()]) for k in range(n_bins)]
    return both.select("void_id", "r", F.explode(F.array(*step)).alias("b")).select("void_id", "r", "b.*").withColumn("mass", F.col("mass").cast("double"))


def bin_limits(r: np.ndarray, n_bins: int, extent: float) -> np.ndarray:
    """For each radius the largest squared distances that the bins' expression puts into bin 0, into 0 or 1, and so on."""
    scale = (float(n_bins) / (extent * r))[:, None]
    edge = np.arange(1, n_bins + 1)[None, :]
    limit = (edge / scale) ** 2

    def within_edge(d2):
        return np.floor(np.sqrt(d2) * scale) < edge

    while (over := ~within_edge(limit)).any():
        limit = np.where(over, np.nextafter(limit, 0.0), limit)
    while (under := within_edge(np.nextafter(limit, np.inf))).any():
        limit = np.where(under, np.nextafter(limit, np.inf), limit)
    reach = r * extent
    return np.minimum(limit, (reach * reach)[:, None])


def profiles(voids: DataFrame, tracers: DataFrame, box: float, n_bins: int, extent: float, mean_density: float, most_radius: float, cumulative: bool = True, weight: str | None = None, velocity: bool = False, weighted_velocity: bool = False, periodic: bool = True) -> DataFrame:
    """void_id, bin, n, density and, on demand, v_rad: density contrasts around each void, in bins of r / (extent * void radius).

    cumulative: within the bin's outer edge; else in the shell. v_rad is always the shell's mean. A tracer at distance
    extent * r or more is in no bin. Empty bins give density -1 in shells and v_rad 0.
    """
    require(n_bins > 0 and extent > 0, "bins and extent must be positive")
    if periodic and 2 * most_radius * extent >= box:
        rows = _binned_pairs(voids, tracers, box, n_bins, extent, most_radius, weight, velocity, weighted_velocity, periodic)
    else:
        rows = _binned_sums(voids, tracers, box, n_bins, extent, most_radius, weight, velocity, weighted_velocity, periodic)
    mass, n = F.coalesce("mass", F.lit(0.0)), F.coalesce("n", F.lit(0)).cast("long")
    step = F.lit(extent / n_bins) * F.col("r")
    outer, inner = (F.col("bin") + 1) * step, F.col("bin") * step
    if cumulative:
        enclosed = F.sum(mass).over(Window.partitionBy("void_id").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
        density = enclosed / (F.lit(4 / 3 * math.pi) * outer * outer * outer) / F.lit(mean_density) - 1
    else:
        density = mass / (F.lit(4 / 3 * math.pi) * (outer * outer * outer - inner * inner * inner)) / F.lit(mean_density) - 1
    out = [F.col("void_id"), F.col("bin"), n.alias("n"), density.alias("density")]
    if velocity:
        norm = mass if weighted_velocity else n
        out.append(F.when(norm > 0, F.col("flow") / norm).otherwise(0.0).alias("v_rad"))
    return rows.select(*out)


def profile_radius(bin_: Column, n_bins: int, extent: float, cumulative: bool = True) -> Column:
    """Where a bin stands, in void radii: its outer edge if cumulative, else its middle."""
    return (bin_ + F.lit(1.0 if cumulative else 0.5)) * F.lit(extent / n_bins)


def stack(profile: DataFrame, columns: list[str], places: int | None = None) -> DataFrame:
    """The mean profile over voids and its standard error. places: the values have so many decimals, and means are rounded to as many.

    Such means are exact up to their rounding, whatever the order of the rows; halves go away from zero.
    """
    aggs = []
    for c in columns:
        mean = F.avg(c) if places is None else F.round(F.sum(F.col(c).cast(f"decimal({16 + places},{places})")) / F.count(c), places).cast("double")
        aggs += [mean.alias(c), (F.stddev_samp(c) / F.sqrt(F.count(c))).alias(f"{c}_err")]
    return profile.groupBy("bin").agg(F.count("*").alias("n_voids"), *aggs)


def widen(profile: DataFrame, column: str) -> DataFrame:
    """One array per void, by bin."""
    return profile.groupBy("void_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("bin", column))), lambda s: s[column]).alias(column))


def distribution(values: DataFrame, column: str, low: float, high: float, n_bins: int, by: list[str] | None = None) -> DataFrame:
    """bin, lo, hi, n, pdf of a column, within groups; values outside the edges count in the normalisation only."""
    by = by or []
    total = values.groupBy(*by).agg(F.count("*").alias("total"))
    counts = values.select(*by, bin_of(F.col(column), low, high, n_bins).alias("bin")).where("bin IS NOT NULL").groupBy(*by, "bin").agg(F.count("*").alias("n"))
    width = (high - low) / n_bins
    rows = total.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1)))).join(counts, [*by, "bin"], "left")
    n = F.coalesce("n", F.lit(0)).cast("long")
    return rows.select(*by, "bin", (F.lit(low) + F.col("bin") * width).alias("lo"), (F.lit(low) + (F.col("bin") + 1) * width).alias("hi"), n.alias("n"), (n / (F.col("total") * F.lit(width))).alias("pdf"))
