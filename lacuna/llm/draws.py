"""Hypergeometric draws for totals of any size."""

from __future__ import annotations

import math

import numpy as np

#: NumPy draws up to this total.
NUMPY_TOTAL = 10**9


def _log_ratio(a: int, b: int) -> float:
    """ln(a! / b!) without the cancellation of two large logarithms: exactly for small numbers, else by Stirling's series."""
    if min(a, b) < 1000:
        return math.lgamma(a + 1) - math.lgamma(b + 1)
    d = a - b
    return d * math.log(b) + (a + 0.5) * math.log1p(d / b) - d + (1 / a - 1 / b) / 12 - (1 / a**3 - 1 / b**3) / 360


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n drawn from good + bad are good; beyond NumPy's total by rejection under a ratio of uniforms.

    The table-mountain hat of Stadlober (1990) covers the law, so what is accepted has it exactly.
    """
    if not n or not good:
        return 0
    if not bad:
        return n
    if good + bad < NUMPY_TOTAL:
        return int(rng.hypergeometric(good, bad, n))
    total = good + bad
    few, many, m = min(good, bad), max(good, bad), min(n, total - n)
    p = few / total
    mean, spread = m * p + 0.5, math.sqrt((total - m) * m * p * (1 - p) / (total - 1) + 0.5)
    hat = 2 * math.sqrt(2 / math.e) * spread + 3 - 2 * math.sqrt(3 / math.e)
    mode = (m + 1) * (few + 1) // (total + 2)
    least, most = max(0, m - many), min(m, few)
    while True:
        u, v = rng.random(), rng.random()
        if not u:
            continue
        k = math.floor(mean + hat * (v - 0.5) / u)
        if not least <= k <= most:
            continue
        chance = _log_ratio(mode, k) + _log_ratio(few - mode, few - k) + _log_ratio(m - mode, m - k) + _log_ratio(many - m + mode, many - m + k)
        if 2 * math.log(u) <= chance:
            break
    drawn = k if good <= bad else m - k
    return drawn if m == n else good - drawn


def multivariate(rng: np.random.Generator, counts: np.ndarray, n: int) -> np.ndarray:
    """How many of each colour are among n drawn: one colour after another, each from what is left."""
    out, rest = np.zeros(len(counts), np.int64), int(np.sum(counts))
    for i, good in enumerate(np.asarray(counts).tolist()):
        rest -= good
        out[i] = hypergeometric(rng, good, rest, n)
        n -= int(out[i])
    return out
