"""Theory that needs iteration or random walks: NumPy on small tables, or in tasks that each make their own walks."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import require

_erf = np.vectorize(math.erf, otypes=[float])
_erfc = np.vectorize(math.erfc, otypes=[float])


# --- spherical evolution ---------------------------------------------------------------------------------------


def _eds_nonlinear(delta: np.ndarray) -> np.ndarray:
    """The exact map for an Einstein-de Sitter universe, underdense: by the parametric solution, with the root by halving."""
    delta = np.asarray(delta, float)
    lo, hi = np.zeros_like(delta), np.full_like(delta, 60.0)

    def linear(eta):
        return -(3 / 20) * (6 * np.maximum(np.sinh(eta) - eta, 0)) ** (2 / 3)

    for _ in range(200):
        middle = (lo + hi) / 2
        deep = linear(middle) < delta
        hi, lo = np.where(deep, middle, hi), np.where(deep, lo, middle)
    eta = (lo + hi) / 2
    small = eta < 1e-2
    e = np.where(small, 1.0, eta)
    full = 4.5 * (np.sinh(e) - e) ** 2 / (np.cosh(e) - 1) ** 3 - 1
    return np.where(small, delta + 17 / 21 * delta * delta, full)


def _lcdm_nonlinear(delta: np.ndarray, omega_m: float, omega_de: float, step: float = 2e-3) -> np.ndarray:
    """The map in a universe with a cosmological constant: Runge-Kutta steps in ln a for the contrast and for the growth."""
    start = math.log(1e-3)
    n = math.ceil(-start / step)
    h = -start / n

    def rates(x, y):
        a = math.exp(x)
        e2 = omega_m / a**3 + (1 - omega_m - omega_de) / a**2 + omega_de
        om = omega_m / a**3 / e2
        drag = 2 + 0.5 * (-3 * omega_m / a**3 - 2 * (1 - omega_m - omega_de) / a**2) / e2
        g, dg, d, dd = y
        return np.array([dg, -drag * dg + 1.5 * om * g, dd, -drag * dd + 4 / 3 * dd * dd / (1 + d) + 1.5 * om * d * (1 + d)])

    def grow(seeds):
        one = np.ones_like(seeds)
        y = np.array([1e-3 * one, 1e-3 * one, seeds, seeds])
        for i in range(n):
            x = start + i * h
            k1 = rates(x, y)
            k2 = rates(x + h / 2, y + h / 2 * k1)
            k3 = rates(x + h / 2, y + h / 2 * k2)
            k4 = rates(x + h, y + h * k3)
            y = y + h / 6 * (k1 + 2 * k2 + 2 * k3 + k4)
        return y

    growth = grow(np.zeros(1))[0][0] / 1e-3
    return grow(np.asarray(delta, float) / growth)[2]


def spherical_map_nonlinear(delta: Column, how: str = "fit", omega_m: float = 0.3, omega_de: float = 0.7) -> Column:
    """The non-linear contrast of a sphere with the given linear one, at the time of the linear theory.

    how: "fit", "eds" or "lcdm"; linear contrasts must not be positive for the latter two.
    """
    if how == "fit":
        from .theory import linear_to_nonlinear

        return linear_to_nonlinear(delta)
    require(how in ("eds", "lcdm"), f"unknown map {how}")

    @F.pandas_udf("double")
    def evolve(d: pd.Series) -> pd.Series:
        x = d.to_numpy(float)
        return pd.Series(_eds_nonlinear(x) if how == "eds" else _lcdm_nonlinear(x, omega_m, omega_de))

    return evolve(delta)


def spherical_map_linear(delta: Column, how: str = "fit", omega_m: float = 0.3, omega_de: float = 0.7) -> Column:
    """The inverse of spherical_map_nonlinear, by interpolation on a fine table."""
    if how == "fit":
        from .theory import nonlinear_to_linear

        return nonlinear_to_linear(delta)
    require(how in ("eds", "lcdm"), f"unknown map {how}")
    linear = -np.concatenate([np.linspace(0, 1, 400, endpoint=False), np.linspace(1, 12, 2200)])
    table = _eds_nonlinear(linear) if how == "eds" else _lcdm_nonlinear(linear, omega_m, omega_de)

    @F.pandas_udf("double")
    def back(d: pd.Series) -> pd.Series:
        return pd.Series(np.interp(d.to_numpy(float), table[::-1], linear[::-1]))

    return back(delta)


# --- peaks, exactly --------------------------------------------------------------------------------------------


def _curvature_weight(x: np.ndarray) -> np.ndarray:
    """f(x) of Bardeen, Bond, Kaiser and Szalay (1986), equation A15."""
    x2 = x * x
    odd = 0.5 * (x2 * x - 3 * x) * (_erf(x * math.sqrt(2.5)) + _erf(x * math.sqrt(2.5) / 2))
    even = math.sqrt(2 / (5 * math.pi)) * ((31 / 4 * x2 + 8 / 5) * np.exp(-5 / 8 * x2) + (x2 / 2 - 8 / 5) * np.exp(-5 / 2 * x2))
    return odd + even


def _peak_g_exact(gamma: np.ndarray, w: np.ndarray, intervals: int = 512) -> np.ndarray:
    out = np.zeros(len(w))
    rule = np.ones(intervals + 1)
    rule[1:-1:2], rule[2:-1:2] = 4, 2
    for i, (g, v) in enumerate(zip(gamma, w)):
        s2 = 1 - g * g
        high = max(v, 0) + 12 * math.sqrt(s2)
        x = np.linspace(0, high, intervals + 1)
        f = _curvature_weight(x) * np.exp(-((x - v) ** 2) / (2 * s2)) / math.sqrt(2 * math.pi * s2)
        out[i] = (rule * f).sum() * high / intervals / 3
    return out


def peak_g_exact(gamma: Column, w: Column) -> Column:
    """The peak function by Simpson's rule over the curvature."""

    @F.pandas_udf("double")
    def exact(g: pd.Series, v: pd.Series) -> pd.Series:
        return pd.Series(_peak_g_exact(g.to_numpy(float), v.to_numpy(float)))

    return exact(gamma, w)


# --- first crossings -------------------------------------------------------------------------------------------


def cholesky(cov: np.ndarray) -> np.ndarray:
    """The Cholesky factor of a covariance, with as little added to the diagonal as it takes."""
    jitter = 0.0
    for k in range(12):
        try:
            return np.linalg.cholesky(cov + jitter * np.eye(len(cov)))
        except np.linalg.LinAlgError:
            jitter = np.trace(cov) / len(cov) * 10.0 ** (k - 14)
    raise ValueError("the covariance isn't positive")


def first_crossing_counts(spark, cov: np.ndarray, barrier: np.ndarray, n_paths: int, collapse: np.ndarray | None = None, seed: int = 0, per_task: int = 20_000) -> DataFrame:
    """step, counts: walks that first fall to the (negative) barrier at each step, from the largest radius on.

    cov: by radius, from large to small. collapse: a positive barrier; a walk above it is absorbed. Walks are made in
    groups with seeds of their own, so that results don't depend on how tasks are dealt out.
    """
    factor = cholesky(np.asarray(cov, float))
    barrier = np.asarray(barrier, float)
    require(len(barrier) == len(factor), "the barrier and the covariance differ in size")
    groups = -(-n_paths // per_task)

    def walk(batches):
        for pdf in batches:
            total = np.zeros(len(barrier), np.int64)
            for g in pdf["id"]:
                rng = np.random.Generator(np.random.Philox(key=[seed, int(g)]))
                n = min(per_task, n_paths - int(g) * per_task)
                for s in range(0, n, 2000):
                    d = rng.standard_normal((min(2000, n - s), len(barrier))) @ factor.T
                    hit = d <= barrier
                    first = np.where(hit.any(1), hit.argmax(1), len(barrier))
                    if collapse is not None:
                        up = d >= collapse
                        first = np.where(up.any(1) & (up.argmax(1) < first), len(barrier), first)
                    total += np.bincount(first, minlength=len(barrier) + 1)[: len(barrier)]
            yield pd.DataFrame({"step": np.arange(len(barrier)), "counts": total})

    return spark.range(0, groups, 1, min(groups, 64)).mapInPandas(walk, "step int, counts long").groupBy("step").agg(F.sum("counts").alias("counts"))


def crossing_multiplicity(counts: DataFrame, radii: list[float], n_paths: int) -> DataFrame:
    """radius, f: crossings per walk and unit of R between neighbouring radii; those at the largest radius have no bin."""
    rows = [(i, float(r), float(radii[i - 1] - r)) for i, r in enumerate(radii) if i]
    bins = counts.sparkSession.createDataFrame(rows, "step int, radius double, width double")
    return bins.join(counts, "step", "left").select("radius", (F.coalesce("counts", F.lit(0)) / (F.col("width") * F.lit(float(n_paths)))).alias("f"))


def up_crossing_hazards(radii: np.ndarray, variance: np.ndarray, slope_variance: np.ndarray, barrier: np.ndarray) -> np.ndarray:
    """The chance to cross downwards between neighbouring radii, from the variance and that of the slope d delta / dR.

    The flux of walks through a moving barrier, from large radii on: density at the barrier times the mean speed relative
    to it, given the correlation of value and slope; between radii by the trapezoid rule.
    """
    r, s, v, b = (np.asarray(x, float) for x in (radii, variance, slope_variance, barrier))
    sigma = np.sqrt(s)
    ds, db = np.gradient(s, r), np.gradient(b, r)
    mean = ds / 2 / s * b - db  # of the slope in R, given the value, relative to the barrier's
    spread = np.sqrt(np.maximum(v - ds * ds / 4 / s, 1e-30))
    y = mean / spread  # going to smaller radii a void walk falls: positive slope in R
    rate = np.exp(-(b * b) / (2 * s)) / np.sqrt(2 * math.pi) / sigma * spread * (np.exp(-y * y / 2) / math.sqrt(2 * math.pi) + y * 0.5 * _erfc(-y / math.sqrt(2)))
    return 0.5 * (rate[1:] + rate[:-1]) * np.abs(np.diff(r))


def up_crossing_multiplicity(radii, variance, slope_variance, barrier) -> tuple[np.ndarray, np.ndarray]:
    """Middles between radii, and first crossings per unit of R, with walks that crossed at larger radii taken out."""
    order = np.argsort(radii)[::-1]
    r = np.asarray(radii, float)[order]
    lam = up_crossing_hazards(r, np.asarray(variance)[order], np.asarray(slope_variance)[order], np.asarray(barrier)[order])
    alive = np.exp(-np.concatenate([[0], np.cumsum(lam)[:-1]]))
    return 0.5 * (r[1:] + r[:-1]), alive * (1 - np.exp(-lam)) / np.abs(np.diff(r))


def moving_barrier_size_function(pk: DataFrame, radii: list[float], delta_nonlinear: float = -0.7, alpha: float = 0.096, beta: float = 1.15, gamma: float = 0.43, points: int = 96) -> DataFrame:
    """radius, vsf per ln R: up-crossings of a moving barrier, moved from Lagrangian to Eulerian radii.

    The barrier's shape in sigma is alpha (1 + (beta / sigma)^gamma), scaled so that its value at the radii's middle is
    the linear threshold. This is the published up-crossing approximation, good to some per cent; a network's
    correction, which others train for it, isn't part of this package.
    """
    from . import theory

    require(-1 < delta_nonlinear < 0 and min(radii) > 0, "bad threshold or radii")
    c = theory.MAP_EXPONENT
    linear = c * (1 - (1 + delta_nonlinear) ** (-1 / c))
    scale = (1 + delta_nonlinear) ** (1 / 3)
    spark = pk.sparkSession
    r = np.geomspace(min(radii) * scale * 0.9, max(radii) * scale * 4, points)
    rows = theory.derivative_variance(pk, spark.createDataFrame([(float(x),) for x in r], "radius double")).toPandas().sort_values("radius")
    sigma = np.sqrt(rows["variance"].to_numpy())
    shape = alpha * (1 + (beta / sigma) ** gamma)
    at = np.interp(np.median(radii) * scale, r, shape)
    middles, f = up_crossing_multiplicity(r, rows["variance"], rows["slope_variance"], linear * shape / at)
    order = np.argsort(middles)
    found = np.interp(np.asarray(radii) * scale, middles[order], f[order])
    vsf = found * np.asarray(radii) * scale / (4 / 3 * math.pi * (np.asarray(radii) * scale) ** 3)
    return spark.createDataFrame([(float(a), float(b)) for a, b in zip(radii, vsf)], "radius double, vsf double")
