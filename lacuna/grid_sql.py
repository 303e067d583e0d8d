"""SQL for queries on smoothed grids and finders: transforms as sums over one axis at a time, acceptance by recursion.

Every function returns common table expressions, as a list of "name AS (...)".
"""

from __future__ import annotations

import math


def angle(k: str, i: str, n: int) -> str:
    return f"({2 * math.pi!r}*((({k}*{i}) % {n})/{n}.0e0))"


def dense_contrast(grid: str, out: str, n: int) -> list[str]:
    """ix, iy, iz, value: the grid's values over their mean, less one, zeros included."""
    full = f"SELECT i AS ix, j AS iy, k AS iz FROM range({n}) a(i), range({n}) b(j), range({n}) c(k)"
    return [
        f"{out}_d AS MATERIALIZED (SELECT f.ix, f.iy, f.iz, coalesce(g.value, 0) AS value FROM ({full}) f LEFT JOIN {grid} g USING (ix, iy, iz))",
        f"{out} AS MATERIALIZED (SELECT ix, iy, iz, value/(SELECT avg(value) FROM {out}_d) - 1 AS value FROM {out}_d)",
    ]


def forward(grid: str, out: str, n: int) -> list[str]:
    """kx, ky, kz (0 to n / 2), re, im: the modes of a real grid."""
    return [
        f"{out}_a AS MATERIALIZED (SELECT ix, iy, kz, sum(value*cos(t)) AS re, -sum(value*sin(t)) AS im FROM (SELECT ix, iy, value, kz, {angle('kz', 'iz', n)} AS t FROM {grid}, range({n // 2 + 1}) r(kz)) GROUP BY ix, iy, kz)",
        f"{out}_b AS MATERIALIZED (SELECT ix, ky, kz, sum(re*cos(t) + im*sin(t)) AS re, sum(im*cos(t) - re*sin(t)) AS im FROM (SELECT ix, kz, re, im, ky, {angle('ky', 'iy', n)} AS t FROM {out}_a, range({n}) r(ky)) GROUP BY ix, ky, kz)",
        f"{out} AS MATERIALIZED (SELECT kx, ky, kz, sum(re*cos(t) + im*sin(t)) AS re, sum(im*cos(t) - re*sin(t)) AS im FROM (SELECT ky, kz, re, im, kx, {angle('kx', 'ix', n)} AS t FROM {out}_b, range({n}) r(kx)) GROUP BY kx, ky, kz)",
    ]


def backward(modes: str, out: str, n: int, by: str = "") -> list[str]:
    """ix, iy, iz, value of modes kx, ky, kz (0 to n / 2), re, im; by: a column that tells several grids apart."""
    g = f"{by}, " if by else ""
    return [
        f"{out}_a AS MATERIALIZED (SELECT {g}ix, ky, kz, sum(re*cos(t) - im*sin(t)) AS re, sum(im*cos(t) + re*sin(t)) AS im FROM (SELECT {g}ky, kz, re, im, ix, {angle('kx', 'ix', n)} AS t FROM {modes}, range({n}) r(ix)) GROUP BY {g}ix, ky, kz)",
        f"{out}_b AS MATERIALIZED (SELECT {g}ix, iy, kz, sum(re*cos(t) - im*sin(t)) AS re, sum(im*cos(t) + re*sin(t)) AS im FROM (SELECT {g}ix, kz, re, im, iy, {angle('ky', 'iy', n)} AS t FROM {out}_a, range({n}) r(iy)) GROUP BY {g}ix, iy, kz)",
        f"{out} AS MATERIALIZED (SELECT {g}ix, iy, iz, sum(CASE WHEN kz = 0 OR kz = {n // 2} THEN 1 ELSE 2 END*(re*cos(t) - im*sin(t)))/{float(n) ** 3!r} AS value FROM (SELECT {g}ix, iy, kz, re, im, iz, {angle('kz', 'iz', n)} AS t FROM {out}_b, range({n}) r(iz)) GROUP BY {g}ix, iy, iz)",
    ]


def signed(k: str, n: int) -> str:
    return f"(CASE WHEN {k} < {n // 2} THEN {k} ELSE {k} - {n} END)"


def squared(n: int) -> str:
    return f"({signed('kx', n)}*{signed('kx', n)} + {signed('ky', n)}*{signed('ky', n)} + kz*kz)"


def window(n: int, power: int) -> str:
    """The assignment window of a scheme that reaches `power` nodes."""
    one = lambda k: f"(CASE WHEN {k} = 0 THEN 1.0e0 ELSE sin({math.pi!r}*{k}/{n})/({math.pi!r}*{k}/{n}) END)"
    return f"pow({one(signed('kx', n))}*{one(signed('ky', n))}*{one('kz')}, {power})"


def top_hat(kr: str) -> str:
    return f"(CASE WHEN {kr} > 1e-4 THEN 3*(sin({kr}) - {kr}*cos({kr}))/pow({kr}, 3) ELSE 1.0e0 END)"


def smoothed(modes: str, out: str, n: int, box: float, radii: list[float], power: int) -> list[str]:
    """radius, ix, iy, iz, value on each radius; power: of the assignment window that is divided out."""
    kr = f"({2 * math.pi / box!r}*sqrt(k2)*radius)"
    listed = ", ".join(f"{r}::DOUBLE" for r in radii)
    return [
        f"{out}_f AS MATERIALIZED (SELECT radius, kx, ky, kz, re*w AS re, im*w AS im FROM (SELECT radius, kx, ky, kz, re, im, {top_hat(kr)}/win AS w FROM (SELECT *, {squared(n)} AS k2, {window(n, power)} AS win FROM {modes}), (SELECT unnest([{listed}]) AS radius)))",
        *backward(f"{out}_f", out, n, "radius"),
    ]


def moments(modes: str, n: int, box: float, radii: list[float], power: int, order: int = 2) -> str:
    """radius, order, t, h: sums of power over all modes and over the high ones."""
    listed = ", ".join(f"{r}::DOUBLE" for r in radii)
    kr = f"({2 * math.pi / box!r}*sqrt(k2)*radius)"
    return f"""SELECT radius, j::INT AS "order", sum(p*pow({(2 * math.pi / box) ** 2!r}*k2, j)) AS t, sum(CASE WHEN k2 > {(n / 4) ** 2!r} THEN p*pow({(2 * math.pi / box) ** 2!r}*k2, j) ELSE 0 END) AS h
FROM (SELECT radius, k2, m*pow({top_hat(kr)}, 2) AS p FROM (SELECT k2, CASE WHEN k2 = 0 THEN 0 WHEN kz = 0 OR kz = {n // 2} THEN 1 ELSE 2 END*(re*re + im*im)/(win*win)/{float(n) ** 6!r} AS m FROM (SELECT *, {squared(n)} AS k2, {window(n, power)} AS win FROM {modes})), (SELECT unnest([{listed}]) AS radius)), range({order + 1}) o(j) GROUP BY radius, j"""


def nodes(grid: str, out: str, n: int, box: float, radius: float, threshold: float) -> list[str]:
    """void_id, cx, cy, cz, depth of the nodes at or below the threshold."""
    cell = box / n
    return [f"{out} AS MATERIALIZED (SELECT ((ix*{n} + iy)*{n} + iz)::BIGINT AS void_id, ix*{cell!r} AS cx, iy*{cell!r} AS cy, iz*{cell!r} AS cz, value AS depth FROM {grid} WHERE radius = {radius} AND value <= {threshold})"]


def hit(a: str, b: str, box: float, fraction: float, scale: float) -> str:
    image = lambda d: f"(({d}) - {box}*round(({d})/{box}))"
    d2 = " + ".join(f"pow({image(f'{a}.c{c} - {b}.c{c}')}, 2)" for c in "xyz")
    return f"sqrt({d2}) < {scale!r}*({a}.r + {b}.r - {fraction}*least({a}.r, {b}.r))"


def free_of(candidates: str, found: str | None, out: str, box: float, fraction: float, scale: float) -> list[str]:
    """Candidates that collide with no void found so far."""
    where = f" WHERE NOT EXISTS (SELECT 1 FROM {found} b WHERE {hit('a', 'b', box, fraction, scale)})" if found else ""
    return [f"{out} AS MATERIALIZED (SELECT * FROM {candidates} a{where})"]


def accepted(candidates: str, found: str | None, out: str, box: float, fraction: float, scale: float) -> list[str]:
    """The voids found so far and, numbered on, the candidates that a pass from deep to shallow accepts."""
    own = "void_id, cx, cy, cz, r, depth"
    before = f"(SELECT count(*) FROM {found})" if found else "0"
    return [
        f"{out}_o AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY depth, void_id) AS k FROM {candidates})",
        f"{out}_e AS MATERIALIZED (SELECT a.k, list(b.k) AS hits FROM {out}_o a JOIN {out}_o b ON b.k < a.k AND {hit('a', 'b', box, fraction, scale)} GROUP BY a.k)",
        f"{out}_w(k, taken) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT w.k + 1, CASE WHEN list_has_any(w.taken, coalesce(e.hits, [])) THEN w.taken ELSE list_append(w.taken, w.k + 1) END FROM {out}_w w LEFT JOIN {out}_e e ON e.k = w.k + 1 WHERE w.k < (SELECT count(*) FROM {out}_o))",
        f"{out} AS MATERIALIZED ({f'SELECT {own} FROM {found} UNION ALL ' if found else ''}SELECT row_number() OVER (ORDER BY depth, void_id) + {before} - 1 AS void_id, cx, cy, cz, r, depth FROM {out}_o WHERE k IN (SELECT unnest(taken) FROM {out}_w WHERE k = (SELECT count(*) FROM {out}_o)))",
    ]


def resized(candidates: str, tracers: str, out: str, box: float, least: float, reach: float, threshold: float) -> list[str]:
    """Candidates with their crossing radius as r, without those that have none."""
    image = lambda d: f"(({d}) - {box}*round(({d})/{box}))"
    d2 = " + ".join(f"pow({image(f'{c} - c{c}')}, 2)" for c in "xyz")
    level = f"({1 + threshold!r}*4/3*{math.pi!r}*(SELECT count(*) FROM {tracers})/{box**3!r})"
    return [
        f"{out}_n AS MATERIALIZED (SELECT * FROM (SELECT void_id, {d2} AS d2 FROM {candidates}, {tracers}) WHERE d2 <= {reach * reach!r})",
        f"{out}_k AS MATERIALIZED (SELECT void_id, sqrt(d2) AS d, rank() OVER (PARTITION BY void_id ORDER BY d2) - 1 AS inside, count(*) OVER (PARTITION BY void_id) AS total FROM {out}_n)",
        f"{out}_s AS MATERIALIZED (SELECT void_id, max(d) AS r FROM {out}_k WHERE d > {least} AND d <= {reach} AND inside <= {level}*pow(d, 3) AND total > {level}*{reach**3!r} GROUP BY void_id)",
        f"{out} AS MATERIALIZED (SELECT c.void_id, cx, cy, cz, s.r, depth FROM {candidates} c JOIN {out}_s s USING (void_id))",
    ]
