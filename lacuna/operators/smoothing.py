"""Smoothing on the grid by planes and pencils of a three-dimensional Fourier transform.

Planes of constant ix are transformed in y and z by one task each, dealt anew into pencils of constant iy, transformed
and filtered along x, and brought back the same way. A task holds one plane of n * n values. Grids of up to WHOLE nodes a
side, 16 MB, are transformed by one task for each radius instead; results are the same.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import GridSpec, require
from .assignment import SCHEMES

#: Nodes a side of grids that one task transforms as a whole.
WHOLE = 128


def top_hat(kr: np.ndarray) -> np.ndarray:
    safe = np.where(kr > 1e-4, kr, 1.0)
    return np.where(kr > 1e-4, 3 * (np.sin(safe) - safe * np.cos(safe)) / safe**3, 1.0)


def gaussian(kr: np.ndarray) -> np.ndarray:
    return np.exp(-0.5 * kr * kr)


def correction(kx, ky, kz, n: int, scheme: str | None, mode: str = "full", interlaced: bool = False) -> np.ndarray:
    """What undoes the assignment window: "full" divides by it; "aliasing" divides by the power of all its images."""
    if scheme is None or mode == "none":
        return np.ones(np.broadcast_shapes(kx.shape, ky.shape, kz.shape))
    require(mode in ("full", "aliasing"), f"unknown correction {mode}")
    p = SCHEMES[scheme]
    w = np.sinc(kx / n) ** p * np.sinc(ky / n) ** p * np.sinc(kz / n) ** p
    if mode == "full":
        return 1 / w
    images = np.arange(-64, 65)

    def summed(k, sign):
        s = np.sinc(k[..., None] / n + images) ** (2 * p)
        return (s * (np.where(images % 2, -1, 1) if sign else 1)).sum(-1)

    power = summed(kx, False) * summed(ky, False) * summed(kz, False)
    if interlaced:  # images an odd number of periods away cancel
        power = 0.5 * (power + summed(kx, True) * summed(ky, True) * summed(kz, True))
    return w / power


def _noise(seed: int, ix: int, n: int) -> np.ndarray:
    return np.random.Generator(np.random.Philox(key=[seed, ix])).standard_normal((n, n))


def planes(grid: DataFrame, spec: GridSpec, value: str = "value") -> DataFrame:
    """ix, v: the values of each plane, in order of iy and iz; nodes that grid lacks are zero."""
    n = spec.n

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.zeros((n, n))
        v[pdf["iy"], pdf["iz"]] = pdf[value]
        return pd.DataFrame({"ix": [int(pdf["ix"].iloc[0])], "v": [v.tobytes()]})

    return grid.select("ix", "iy", "iz", value).groupBy("ix").applyInPandas(pack, "ix int, v binary")


def nodes(packed: DataFrame, spec: GridSpec, by: list[str] | None = None) -> DataFrame:
    """The reverse of planes(): a row for each node."""
    n, by = spec.n, by or []

    def unpack(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                v = np.frombuffer(row.v)
                out = {"ix": np.full(n * n, row.ix), "iy": np.repeat(np.arange(n), n), "iz": np.tile(np.arange(n), n), "value": v}
                yield pd.DataFrame({b: np.full(n * n, getattr(row, b)) for b in by} | out)

    kinds = dict(packed.dtypes)
    return packed.mapInPandas(unpack, ", ".join([*(f"{b} {kinds[b]}" for b in by), "ix int, iy int, iz int, value double"]))


def _to_pencils(packed: DataFrame, spec: GridSpec, seed: int | None = None) -> DataFrame:
    """iy, ix, v, u: transformed in y and z; u is the same of white noise, for surrogates."""
    n = spec.n

    def run(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                f = np.fft.rfft2(np.frombuffer(row.v).reshape(n, n))
                g = np.fft.rfft2(_noise(seed, row.ix, n)) if seed is not None else None
                yield pd.DataFrame({"iy": np.arange(n), "ix": np.full(n, row.ix), "v": [x.tobytes() for x in f], "u": [x.tobytes() for x in g] if g is not None else [None] * n})

    return packed.mapInPandas(run, "iy int, ix int, v binary, u binary")


def _spectrum_of(pdf: pd.DataFrame, n: int, surrogate: str | None):
    """The modes of a pencil slab, shape (n, n // 2 + 1), and its wavenumbers in units of the fundamental one."""
    def along(column: str) -> np.ndarray:
        rows = np.zeros((n, n // 2 + 1), complex)  # planes that the grid lacks are zero
        rows[pdf["ix"].to_numpy()] = [np.frombuffer(v, complex) for v in pdf[column]]
        return np.fft.fft(rows, axis=0)

    f = along("v")
    iy = int(pdf["iy"].iloc[0])
    if surrogate:
        g = along("u")
        keep = f[0, 0]
        size = np.abs(g)
        f = np.abs(f) * (np.where(size > 0, g / np.where(size > 0, size, 1), 1) if surrogate == "phases" else g / n**1.5)
        if iy == 0:
            f[0, 0] = keep
    k = np.fft.fftfreq(n, 1 / n)
    return f, k[:, None], np.array([[k[iy]]]), np.arange(n // 2 + 1)[None, :].astype(float)


def _whole_spectrum(table: pa.Table, n: int, surrogate: str | None, seed: int):
    """The modes of a whole grid, shape (n, n, n // 2 + 1), and the wavenumbers of the axes; nodes that it lacks are zero."""
    ix, iy, iz = (table.column(f"i{c}").to_numpy() for c in "xyz")
    cube = np.zeros((n, n, n))
    cube[ix, iy, iz] = table.column("value").to_numpy()
    f = np.fft.rfftn(cube)
    if surrogate:
        for i in range(n):
            cube[i] = _noise(seed, i, n) if (ix == i).any() else 0.0
        f = _shuffled(f, np.fft.rfftn(cube), surrogate, n)
    k = np.fft.fftfreq(n, 1 / n)
    return f, k[:, None, None], k[None, :, None], np.arange(n // 2 + 1)[None, None, :].astype(float)


def _shuffled(f: np.ndarray, g: np.ndarray, surrogate: str, n: int) -> np.ndarray:
    """Modes of the size of f with the phases of g, or with all of g's chance; the mean stays."""
    size = np.abs(g)
    out = np.abs(f) * (np.where(size > 0, g / np.where(size > 0, size, 1), 1) if surrogate == "phases" else g / n**1.5)
    out[0, 0, 0] = f[0, 0, 0]
    return out


def smooth(grid: DataFrame, spec: GridSpec, radii: list[float], kind: str = "top-hat", scheme: str | None = None, deconvolve: str = "full", interlaced: bool = False, extra: float = 0.0, surrogate: str | None = None, seed: int = 0) -> DataFrame:
    """radius, ix, iy, iz, value: the grid smoothed on each radius.

    extra: a further Gaussian, in units of the radius. surrogate: None, "phases" (random phases, power kept) or "gaussian".
    """
    require(kind in ("top-hat", "gaussian"), f"unknown filter {kind}")
    require(surrogate in (None, "phases", "gaussian"), f"unknown surrogate {surrogate}")
    n, unit = spec.n, 2 * math.pi / spec.box

    def response(kx, ky, kz, r: float) -> np.ndarray:
        kr = unit * np.sqrt(kx * kx + ky * ky + kz * kz) * r
        w = top_hat(kr) if kind == "top-hat" else gaussian(kr)
        return w * gaussian(kr * extra) if extra else w

    if n <= WHOLE:

        def whole(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            r = key[0].as_py()
            f, kx, ky, kz = _whole_spectrum(table, n, surrogate, seed)
            f *= correction(kx, ky, kz, n, scheme, deconvolve, interlaced)
            v = np.fft.irfftn(f * response(kx, ky, kz, r), (n, n, n)).ravel()
            at = np.arange(n**3, dtype=np.int32)
            return pa.table({"radius": np.full(n**3, r), "ix": at // n**2, "iy": at // n % n, "iz": at % n, "value": v})

        rows = grid.select(F.explode(F.array(*[F.lit(float(r)) for r in radii])).alias("radius"), "ix", "iy", "iz", F.col("value").cast("double").alias("value"))
        return rows.groupBy("radius").applyInArrow(whole, "radius double, ix int, iy int, iz int, value double")

    def filtered(pdf: pd.DataFrame) -> pd.DataFrame:
        f, kx, ky, kz = _spectrum_of(pdf, n, surrogate)
        f = f * correction(kx, ky, kz, n, scheme, deconvolve, interlaced)
        iy, out = int(pdf["iy"].iloc[0]), []
        for r in radii:
            back = np.fft.ifft(f * response(kx, ky, kz, r), axis=0)
            out += [(r, i, iy, row.tobytes()) for i, row in enumerate(back)]
        return pd.DataFrame(out, columns=["radius", "ix", "iy", "v"])

    def plane(pdf: pd.DataFrame) -> pd.DataFrame:
        f = np.stack([np.frombuffer(pdf["v"].iloc[i], complex) for i in np.argsort(pdf["iy"].to_numpy())])
        return pd.DataFrame({"radius": [pdf["radius"].iloc[0]], "ix": [int(pdf["ix"].iloc[0])], "v": [np.fft.irfft2(f, (n, n)).tobytes()]})

    pencils = _to_pencils(planes(grid, spec), spec, seed if surrogate else None)
    back = pencils.groupBy("iy").applyInPandas(filtered, "radius double, ix int, iy int, v binary")
    return nodes(back.groupBy("radius", "ix").applyInPandas(plane, "radius double, ix int, v binary"), spec, ["radius"])


def interlace(first: DataFrame, shifted: DataFrame, spec: GridSpec) -> DataFrame:
    """The mean of a deposit and of one on a grid shifted by half a cell, moved back in Fourier space."""
    n = spec.n
    both = _to_pencils(planes(first, spec), spec).withColumn("half", F.lit(0)).unionByName(_to_pencils(planes(shifted, spec), spec).withColumn("half", F.lit(1)))

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        f, kx, ky, kz = _spectrum_of(pdf[pdf["half"] == 0], n, None)
        g, *_ = _spectrum_of(pdf[pdf["half"] == 1], n, None)
        f = 0.5 * (f + g * np.exp(-1j * math.pi * (kx + ky + kz) / n))
        back = np.fft.ifft(f, axis=0)
        return pd.DataFrame({"ix": np.arange(n), "iy": int(pdf["iy"].iloc[0]), "v": [row.tobytes() for row in back]})

    def plane(pdf: pd.DataFrame) -> pd.DataFrame:
        f = np.stack([np.frombuffer(pdf["v"].iloc[i], complex) for i in np.argsort(pdf["iy"].to_numpy())])
        return pd.DataFrame({"ix": [int(pdf["ix"].iloc[0])], "v": [np.fft.irfft2(f, (n, n)).tobytes()]})

    return nodes(both.groupBy("iy").applyInPandas(merged, "ix int, iy int, v binary").groupBy("ix").applyInPandas(plane, "ix int, v binary"), spec)


def check_radii(radii: list[float], spec: GridSpec) -> None:
    """Statistics need radii of two cells to half the box."""
    for r in radii:
        require(2 * spec.cell <= r <= spec.box / 2, f"the radius {r} isn't between two cells and half the box")


def grid_moments(grid: DataFrame, spec: GridSpec, radii: list[float], order: int = 2, kind: str = "top-hat", scheme: str | None = None, deconvolve: str = "full", interlaced: bool = False, shot_noise: float = 0.0, surrogate: str | None = None, seed: int = 0) -> DataFrame:
    """radius, order, sigma, high_k_fraction: sums over the modes of the contrast's power; shot_noise: power to subtract from each."""
    require(0 <= order <= 4, f"the order is {order}")
    check_radii(radii, spec)
    n, unit = spec.n, 2 * math.pi / spec.box

    def added(f, kx, ky, kz) -> pd.DataFrame:
        c = correction(kx, ky, kz, n, scheme, deconvolve, interlaced)
        k2 = kx * kx + ky * ky + kz * kz
        twice = np.where((kz == 0) | ((n % 2 == 0) & (kz == n // 2)), 1.0, 2.0) * (k2 > 0)
        power = (np.abs(f * c) ** 2 - shot_noise * n**6 / spec.box**3 * c**2) * twice / float(n) ** 6
        out = []
        for r in radii:
            w = (top_hat if kind == "top-hat" else gaussian)(unit * np.sqrt(k2) * r) ** 2
            for j in range(order + 1):
                p = power * w * (unit * unit * k2) ** j
                out.append((r, j, p.sum(), p[np.broadcast_to(k2 > (n / 4) ** 2, p.shape)].sum()))
        return pd.DataFrame(out, columns=["radius", "order", "total", "high"])

    schema = "radius double, order int, total double, high double"
    if n <= WHOLE:

        def whole(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            out = added(*_whole_spectrum(table, n, surrogate, seed))
            return pa.Table.from_pandas(out.astype({"order": "int32"}), preserve_index=False)

        parts = grid.select(F.lit(0).alias("one"), "ix", "iy", "iz", F.col("value").cast("double").alias("value")).groupBy("one").applyInArrow(whole, schema)
    else:
        parts = _to_pencils(planes(grid, spec), spec, seed if surrogate else None).groupBy("iy").applyInPandas(lambda pdf: added(*_spectrum_of(pdf, n, surrogate)), schema)
    rows = parts.groupBy("radius", "order").agg(F.sum("total").alias("t"), F.sum("high").alias("h"))
    return rows.select("radius", "order", F.when(F.col("t") > 0, F.sqrt("t")).otherwise(0.0).alias("sigma"), F.when(F.col("t") > 0, F.col("h") / F.col("t")).otherwise(0.0).alias("high_k_fraction"))
