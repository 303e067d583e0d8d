"""Theory as column expressions and small relational plans: windows, moments, abundances, distances.

Tables of radii, wavenumbers and quadrature nodes have hundreds of rows; joins between them are products of two
such tables and are broadcast on that ground.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..core import require

# Speed of light in 100 km/s, and the exponent of the fitted spherical map.
HUBBLE_LENGTH = 2997.92458
MAP_EXPONENT = 1.594


def _l(x: float) -> Column:
    return F.lit(float(x))


# --- windows ---------------------------------------------------------------------------------------------------


def window(x: Column, gaussian: bool = False) -> Column:
    """The Fourier transform of a unit top-hat sphere, or of a Gaussian, at x = kR."""
    if gaussian:
        return F.exp(-0.5 * x * x)
    return F.when(x <= 1e-4, _l(1)).otherwise(3 * (F.sin(x) - x * F.cos(x)) / (x * x * x))


def window_slope(x: Column, gaussian: bool = False) -> Column:
    """Its derivative; by series where the closed form cancels."""
    if gaussian:
        return -x * F.exp(-0.5 * x * x)
    closed = 3 * (x * x * F.sin(x) - 3 * F.sin(x) + 3 * x * F.cos(x)) / (x * x * x * x)
    return F.when(x < 1e-2, -x / 5 + x * x * x / 70).otherwise(closed)


# --- integrals over a power spectrum ---------------------------------------------------------------------------


def log_weights(pk: DataFrame) -> DataFrame:
    """pk with the trapezoid weight of each point in an integral over ln k."""
    order = Window.orderBy("k")
    before, after = F.lag("k").over(order), F.lead("k").over(order)
    left = F.coalesce(F.log(F.col("k")) - F.log(before), _l(0))
    right = F.coalesce(F.log(after) - F.log(F.col("k")), _l(0))
    return pk.withColumns({"before": before, "weight": 0.5 * (left + right), "left_half": 0.5 * left})


def moments(pk: DataFrame, radii: DataFrame, order: int = 2, gaussian: bool = False) -> DataFrame:
    """radius, order, sigma, high_k_fraction: sigma_j^2 = 1 / (2 pi^2) int k^(2j+2) P W^2 dk by trapezoids in ln k."""
    require(0 <= order <= 4, f"the order is {order}")
    steps = Window.partitionBy("radius").orderBy("k")
    w = window(F.col("k") * F.col("radius"), gaussian)
    rows = pk.select("k", "pk").join(F.broadcast(radii.select("radius")))
    base = rows.withColumn("f", F.col("k") * F.col("k") * F.col("k") * F.col("pk") * w * w)
    base = base.withColumn("last", F.max("k").over(Window.partitionBy("radius")))
    previous = F.lag("k").over(steps)
    base = base.withColumns({"dlnk": F.log(F.col("k")) - F.log(previous), "k0": previous, "f0": F.lag("f").over(steps)}).where("k0 IS NOT NULL")
    by_order = base.withColumn("order", F.explode(F.sequence(F.lit(0), F.lit(order))))
    piece = 0.5 * (F.col("f") * F.pow("k", 2 * F.col("order")) + F.col("f0") * F.pow("k0", 2 * F.col("order"))) * F.col("dlnk")
    total, high = F.sum(piece), F.sum(F.when(F.col("k") > F.col("last") / 2, piece).otherwise(0.0))
    sums = by_order.groupBy("radius", "order").agg(total.alias("t"), high.alias("h"))
    return sums.select("radius", "order", F.when(F.col("t") > 0, F.sqrt(F.col("t") / _l(2 * math.pi**2))).otherwise(0.0).alias("sigma"), F.when(F.col("t") > 0, F.col("h") / F.col("t")).otherwise(0.0).alias("high_k_fraction"))


def sigma_slope(pk: DataFrame, radii: DataFrame, gaussian: bool = False) -> DataFrame:
    """radius, slope: d ln sigma / d ln R."""
    rows = log_weights(pk).join(F.broadcast(radii.select("radius")))
    x = F.col("k") * F.col("radius")
    base, w = F.col("weight") * F.col("k") * F.col("k") * F.col("k") * F.col("pk"), window(x, gaussian)
    sums = rows.groupBy("radius").agg(F.sum(base * w * window_slope(x, gaussian) * x).alias("a"), F.sum(base * w * w).alias("b"))
    return sums.select("radius", F.when(F.col("b") > 0, F.col("a") / F.col("b")).otherwise(0.0).alias("slope"))


def covariance(pk: DataFrame, radii: DataFrame, gaussian: bool = False) -> DataFrame:
    """i, j, s for j <= i: the covariance of the density smoothed on the i-th and j-th radius, from small to large."""
    amplitude = log_weights(pk).select("k", F.sqrt(F.col("weight") * F.col("k") * F.col("k") * F.col("k") * F.col("pk") / _l(2 * math.pi**2)).alias("a"))
    numbered = radii.select("radius").withColumn("i", F.row_number().over(Window.orderBy("radius")) - 1)
    rows = amplitude.join(F.broadcast(numbered)).select("k", "i", (F.col("a") * window(F.col("k") * F.col("radius"), gaussian)).alias("v"))
    other = rows.select("k", F.col("i").alias("j"), F.col("v").alias("u"))
    return rows.join(other, "k").where("j <= i").groupBy("i", "j").agg(F.sum(F.col("u") * F.col("v")).alias("s"))


def derivative_variance(pk: DataFrame, radii: DataFrame, gaussian: bool = False) -> DataFrame:
    """radius, variance, slope_variance: <delta^2> and <(d delta / dR)^2>."""
    rows = log_weights(pk).join(F.broadcast(radii.select("radius")))
    x = F.col("k") * F.col("radius")
    base = F.col("weight") * F.col("k") * F.col("k") * F.col("k") * F.col("pk") / _l(2 * math.pi**2)
    dw = F.col("k") * window_slope(x, gaussian)
    return rows.groupBy("radius").agg(F.sum(base * F.pow(window(x, gaussian), 2)).alias("variance"), F.sum(base * dw * dw).alias("slope_variance"))


def variance_kernel(pk: DataFrame, radii: DataFrame, gaussian: bool = False) -> DataFrame:
    """radius, k, row, weight: the linear map from P(k) to the variance (row 0), its derivative in R (1) and slope variance (2)."""
    rows = log_weights(pk).join(F.broadcast(radii.select("radius")))
    x, w = F.col("k") * F.col("radius"), None
    w, dw = window(x, gaussian), F.col("k") * window_slope(x, gaussian)
    base = F.col("weight") * F.col("k") * F.col("k") * F.col("k") / _l(2 * math.pi**2)
    entries = F.array(*[F.struct(F.lit(i).alias("row"), v.alias("weight")) for i, v in enumerate((base * w * w, 2 * base * w * dw, base * dw * dw))])
    return rows.select("radius", "k", F.explode(entries).alias("e")).select("radius", "k", "e.*")


def walk(kernel: DataFrame, pk: DataFrame) -> DataFrame:
    """radius, sigma, slope (dS/dR), slope_variance of a spectrum on the kernel's wavenumbers: a join and a sum."""
    rows = kernel.join(pk.select("k", "pk"), "k")
    part = [F.sum(F.when(F.col("row") == i, F.col("weight") * F.col("pk"))) for i in range(3)]
    return rows.groupBy("radius").agg(F.sqrt(part[0]).alias("sigma"), part[1].alias("slope"), part[2].alias("slope_variance"))


# --- peaks -----------------------------------------------------------------------------------------------------


def peak_shape(sigmas: DataFrame) -> DataFrame:
    """radius, sigma_0, gamma, r_star from moments of order 0 to 2."""
    wide = sigmas.groupBy("radius").agg(*[F.max(F.when(F.col("order") == j, F.col("sigma"))).alias(f"sigma_{j}") for j in range(3)])
    return wide.select("radius", "sigma_0", (F.col("sigma_1") * F.col("sigma_1") / (F.col("sigma_0") * F.col("sigma_2"))).alias("gamma"), (_l(math.sqrt(3)) * F.col("sigma_1") / F.col("sigma_2")).alias("r_star"))


def peak_g(gamma: Column, w: Column) -> Column:
    """The peak function G(gamma, w) by the published fit, equations 4.4 and 4.5 of Bardeen, Bond, Kaiser and Szalay (1986)."""
    g2 = gamma * gamma
    d = 9 - 5 * g2
    a1, b1 = 2.5 / d, 432 / (_l(math.sqrt(10 * math.pi)) * d * d * F.sqrt(d))
    c1 = 1.84 + 1.13 * F.pow(1 - g2, _l(5.72))
    c2 = 8.91 + 1.27 * F.exp(6.51 * g2)
    c3 = 2.58 * F.exp(1.05 * g2)
    return (w * w * w - 3 * g2 * w + (b1 * w * w + c1) * F.exp(-a1 * w * w)) / (1 + c2 * F.exp(-c3 * w))


def peak_density(nu: Column, gamma: Column, r_star: Column) -> Column:
    """Peaks per unit volume and unit of nu; not negative."""
    return F.greatest(_l(0), F.exp(-0.5 * nu * nu) / (_l(4 * math.pi**2) * r_star * r_star * r_star) * peak_g(gamma, gamma * nu))


def peak_density_above(shapes: DataFrame, delta: float, intervals: int = 2048, g=peak_g) -> DataFrame:
    """radius, density: peaks above |delta|, or dips below it, by Simpson's rule in nu over 12 or more from the threshold on.

    g: the peak function of gamma and gamma nu; numeric.peak_g_exact is the other one.
    """
    nodes = shapes.sparkSession.range(intervals + 1)
    rows = shapes.withColumn("nu0", _l(abs(delta)) / F.col("sigma_0")).join(F.broadcast(nodes))
    rows = rows.withColumn("h", F.greatest(_l(12), 40 / F.greatest(_l(1), F.col("nu0"))) / intervals)
    rows = rows.withColumn("nu", F.col("nu0") + F.col("h") * F.col("id"))
    rule = F.when(F.col("id").isin(0, intervals), 1).when(F.col("id") % 2 == 1, 4).otherwise(2)
    f = rule * F.exp(-0.5 * F.col("nu") * F.col("nu")) * g(F.col("gamma"), F.col("gamma") * F.col("nu"))
    sums = rows.groupBy("radius", "r_star", "h").agg(F.sum(f).alias("s"))
    return sums.select("radius", F.greatest(_l(0), F.col("s") * F.col("h") / 3 / (_l(4 * math.pi**2) * F.pow("r_star", F.lit(3)))).alias("density"))


def slope_on(rows: DataFrame, x: str, y: str, name: str) -> DataFrame:
    """rows with dy/dx to second order on uneven points, one-sided at the ends; needs three points."""
    order = Window.orderBy(x)
    at = {f"__{c}{k:+d}": F.lag(c, -k).over(order) for c in (x, y) for k in (-2, -1, 1, 2)}
    r = rows.withColumns(at)
    c = F.col

    def three(x0, y0, x1, y1, x2, y2, where):
        """The derivative at point `where` of the parabola through three points."""
        xs, ys = (x0, x1, x2), (y0, y1, y2)
        p = xs[where]
        total = None
        for i in range(3):
            a, b = (xs[j] for j in range(3) if j != i)
            term = ys[i] * ((p - a) + (p - b)) / ((xs[i] - a) * (xs[i] - b))
            total = term if total is None else total + term
        return total

    p = {k: (c(f"__{x}{k:+d}"), c(f"__{y}{k:+d}")) for k in (-2, -1, 1, 2)} | {0: (c(x), c(y))}
    central = three(*p[-1], *p[0], *p[1], 1)
    first, last = three(*p[0], *p[1], *p[2], 0), three(*p[-2], *p[-1], *p[0], 2)
    d = F.when(p[-1][0].isNull(), first).when(p[1][0].isNull(), last).otherwise(central)
    return r.withColumn(name, d).drop(*at)


def peak_size_function(cumulative: DataFrame, logarithmic: bool = True) -> DataFrame:
    """radius, vsf: -dC/d ln R, or -dC/dR, from radius, density; zero where C or a neighbour vanishes."""
    order = Window.orderBy("radius")
    rows = cumulative.withColumns({"x": F.log("radius"), "y": F.when(F.col("density") > 0, F.log("density")).otherwise(0.0), "dead": (F.col("density") <= 0)})
    rows = rows.withColumn("near_dead", F.coalesce(F.lag("dead").over(order), F.lit(False)) | F.coalesce(F.lead("dead").over(order), F.lit(False)) | F.col("dead"))
    rows = slope_on(rows, "x", "y", "slope")
    value = -F.col("density") * F.col("slope") / (F.lit(1.0) if logarithmic else F.col("radius"))
    return rows.select("radius", F.when(F.col("near_dead"), 0.0).otherwise(F.greatest(_l(0), value)).alias("vsf"))


# --- excursion sets --------------------------------------------------------------------------------------------


def moving_barrier(sigma: Column, alpha: float, beta: float, gamma: float) -> Column:
    """alpha (1 + (beta / sigma)^gamma); zero where sigma isn't positive."""
    return F.when(sigma > 0, _l(alpha) * (1 + F.pow(_l(beta) / sigma, _l(gamma)))).otherwise(0.0)


def two_barrier_multiplicity(sigma: Column, delta_v: float, delta_c: float, terms: int = 64) -> Column:
    """First crossings of delta_v before delta_c, per ln sigma, by the series of Sheth and van de Weygaert (2004)."""
    require(delta_v < 0 < delta_c, "the thresholds must lie on both sides of zero")
    low = abs(delta_v)
    share = low / (delta_c + low)
    x = _l(share / low) * sigma
    first = _l(math.sqrt(2 / math.pi)) * _l(low) / sigma * F.exp(_l(-0.5 * low * low) / (sigma * sigma))

    def add(total, j):
        return total + F.exp(-0.5 * F.pow(j * _l(math.pi) * x, 2)) * j * _l(math.pi) * x * x * F.sin(j * _l(math.pi * share))

    series = 2 * F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(terms)), lambda j: j.cast("double")), _l(0), add)
    return F.when(sigma > 0, F.greatest(_l(0), F.when(x <= 0.276, first).otherwise(series))).otherwise(0.0)


def linear_to_nonlinear(delta: Column) -> Column:
    """The fitted spherical map: (1 - d / c)^-c - 1."""
    return F.pow(1 - delta / MAP_EXPONENT, _l(-MAP_EXPONENT)) - 1


def nonlinear_to_linear(delta: Column) -> Column:
    return MAP_EXPONENT * (1 - F.pow(1 + delta, _l(-1 / MAP_EXPONENT)))


def linear_radius(radius: Column, delta_nonlinear: float) -> Column:
    """The Lagrangian radius of a sphere that has expanded to the given contrast."""
    return radius * _l((1 + delta_nonlinear) ** (1 / 3))


def two_barrier_size_function(pk: DataFrame, radii: DataFrame, delta_nonlinear: float = -0.8, delta_c: float = 1.686, conserve: str = "number") -> DataFrame:
    """radius, vsf per ln R; conserve: "number" of voids, or "volume", in going from Lagrangian to Eulerian radii."""
    require(-1 < delta_nonlinear < 0, f"the threshold is {delta_nonlinear}")
    require(conserve in ("number", "volume"), f"unknown {conserve}")
    delta_v = MAP_EXPONENT * (1 - (1 + delta_nonlinear) ** (-1 / MAP_EXPONENT))
    scale = (1 + delta_nonlinear) ** (1 / 3)
    lagrangian = radii.select((F.col("radius") * _l(scale)).alias("radius"))
    sigma = moments(pk, lagrangian, 0).select("radius", "sigma")
    rows = sigma.join(sigma_slope(pk, lagrangian), "radius")
    volume = _l(4 / 3 * math.pi) * F.pow(F.col("radius") if conserve == "number" else F.col("radius") / _l(scale), F.lit(3))
    vsf = two_barrier_multiplicity(F.col("sigma"), delta_v, delta_c) * -F.col("slope") / volume
    return rows.select((F.col("radius") / _l(scale)).alias("radius"), F.greatest(_l(0), vsf).alias("vsf"))


def survival(hazards: DataFrame) -> DataFrame:
    """radius, p: the chance to cross first at each radius, coming from the largest, from hazards (radius, lam)."""
    larger = Window.orderBy(F.col("radius").desc()).rowsBetween(Window.unboundedPreceding, -1)
    alive = F.exp(-F.coalesce(F.sum("lam").over(larger), _l(0)))
    return hazards.select("radius", (alive * (1 - F.exp(-F.col("lam")))).alias("p"))


def edges_of(centres: DataFrame, logarithmic: bool = True) -> DataFrame:
    """i, lo, hi around ascending centres: midpoints inside, the outer ones mirrored."""
    order = Window.orderBy("centre")
    x = F.log("centre") if logarithmic else F.col("centre")
    rows = centres.select("centre", x.alias("x"), (F.row_number().over(order) - 1).alias("i"))
    before, after = F.lag("x").over(Window.orderBy("x")), F.lead("x").over(Window.orderBy("x"))
    lo = F.coalesce((before + F.col("x")) / 2, F.col("x") - (after - F.col("x")) / 2)
    hi = F.coalesce((F.col("x") + after) / 2, F.col("x") + (F.col("x") - before) / 2)
    back = F.exp if logarithmic else (lambda c: c)
    return rows.select("i", "centre", back(lo).alias("lo"), back(hi).alias("hi"))


# --- distances -------------------------------------------------------------------------------------------------

# Nodes and weights of Gauss's rule with eight points, for half the interval.
GAUSS_8 = [(0.18343464249564981, 0.36268378337836199), (0.52553240991632899, 0.31370664587788729), (0.79666647741362674, 0.22238103445337448), (0.96028985649753623, 0.10122853629037626)]
# Fixed value: the redshift up to which distances are inverted.
FURTHEST = 1e4


def expansion(z: Column, omega_m: float, omega_de: float, omega_r: float = 0.0, w0: float = -1.0, wa: float = 0.0) -> Column:
    """E(z) of a universe with curvature and dark energy w0 + wa z / (1 + z)."""
    a = 1 + z
    curvature = 1 - omega_m - omega_de - omega_r
    dark = F.pow(a, _l(3 * (1 + w0 + wa))) * F.exp(_l(-3 * wa) * z / a)
    return F.sqrt(_l(omega_m) * a * a * a + _l(omega_r) * a * a * a * a + _l(curvature) * a * a + _l(omega_de) * dark)


def comoving_distance(z: Column, omega_m: float = 0.3, omega_de: float = 0.7, omega_r: float = 0.0, w0: float = -1.0, wa: float = 0.0, step: float = 0.05) -> Column:
    """Comoving distance in Mpc/h: Gauss's rule on pieces of redshift no longer than step."""
    pieces = F.greatest(F.lit(1), F.ceil(z / _l(step))).cast("int")
    width = z / pieces

    def piece(total, i):
        middle = (i + 0.5) * width
        for x, w in GAUSS_8:
            for s in (-1, 1):
                total = total + _l(w / 2) * width / expansion(middle + _l(s * x / 2) * width, omega_m, omega_de, omega_r, w0, wa)
        return total

    return _l(HUBBLE_LENGTH) * F.aggregate(F.transform(F.sequence(F.lit(0), pieces - 1), lambda i: i.cast("double")), _l(0), piece)


def sky_to_cartesian(rows: DataFrame, observer=(0.0, 0.0, 0.0), **cosmology) -> DataFrame:
    """x, y, z from ra and dec in degrees and redshift z; raises on values off the sky."""
    bad = rows.where(F.isnan("ra") | F.isnan("dec") | F.isnan("z") | (F.abs("dec") > 90) | (F.col("z") < 0)).limit(1).count()
    require(not bad, "ra, dec or redshift is off the sky")
    rows = rows.withColumn("__d", comoving_distance(F.col("z"), **cosmology))
    ra, dec, d = F.radians("ra"), F.radians("dec"), F.col("__d")
    x, y, z = d * F.cos(dec) * F.cos(ra), d * F.cos(dec) * F.sin(ra), d * F.sin(dec)
    return rows.withColumns({"x": x + _l(observer[0]), "y": y + _l(observer[1]), "__z": z + _l(observer[2])}).drop("z", "ra", "dec", "__d").withColumnRenamed("__z", "z")


def distance_table(nodes: int = 8192, omega_m: float = 0.3, omega_de: float = 0.7, omega_r: float = 0.0, w0: float = -1.0, wa: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Comoving distances up to FURTHEST, ln(1 + z) there, and its derivative by distance; even steps in ln(1 + z)."""
    x = np.linspace(0.0, math.log1p(FURTHEST), nodes)
    step = x[1] - x[0]

    def rate(y):
        """d ln(1 + z) / d distance."""
        a = np.exp(y)
        dark = a ** (3 * (1 + w0 + wa)) * np.exp(-3 * wa * (a - 1) / a)
        return np.sqrt(omega_m * a**3 + omega_r * a**4 + (1 - omega_m - omega_de - omega_r) * a * a + omega_de * dark) / a / HUBBLE_LENGTH

    middle, total = (x[1:] + x[:-1]) / 2, np.zeros(nodes - 1)
    for p, w in GAUSS_8:
        for s in (-1, 1):
            total += w / 2 * step / rate(middle + s * p / 2 * step)
    return np.concatenate([[0.0], np.cumsum(total)]), x, rate(x)


def redshift_of(d: Column, **cosmology) -> Column:
    """The inverse of comoving_distance, by cubic interpolation in a table that values and slopes fix; it is sent with the function.

    Its error is below 1e-9 of 1 + z. Raises on distances that FURTHEST doesn't reach.
    """
    far, x, slope = distance_table(**cosmology)

    @F.pandas_udf("double")
    def invert(d: pd.Series) -> pd.Series:
        v = d.to_numpy(float)
        if (v > far[-1]).any():
            raise ValueError(f"no redshift up to {FURTHEST:g} reaches a distance of {np.nanmax(v)}")
        i = np.clip(np.searchsorted(far, v, "right") - 1, 0, len(far) - 2)
        h = far[i + 1] - far[i]
        t = (v - far[i]) / h
        y = (1 + 2 * t) * (1 - t) ** 2 * x[i] + t * (1 - t) ** 2 * h * slope[i] + t * t * (3 - 2 * t) * x[i + 1] - t * t * (1 - t) * h * slope[i + 1]
        return pd.Series(np.expm1(y))

    return invert(d)


def cartesian_to_sky(rows: DataFrame, observer=(0.0, 0.0, 0.0), **cosmology) -> DataFrame:
    """ra in [0, 360), dec and redshift from x, y, z; the observer's own place is ra 0, dec 0."""
    p = [F.col(c) - _l(o) for c, o in zip("xyz", observer)]
    d = F.sqrt(p[0] * p[0] + p[1] * p[1] + p[2] * p[2])
    ra = F.pmod(F.degrees(F.atan2(p[1], p[0])), _l(360))
    ra = F.when(ra >= 360, 0.0).otherwise(ra)
    dec = F.when(d > 0, F.degrees(F.asin(F.greatest(_l(-1), F.least(_l(1), p[2] / d))))).otherwise(0.0)
    return rows.withColumns({"ra": F.when(d > 0, ra).otherwise(0.0), "dec": dec, "redshift": F.when(d > 0, redshift_of(d, **cosmology)).otherwise(0.0)})
