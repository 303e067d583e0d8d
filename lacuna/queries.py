"""Named queries over the parquet tables, and the same in SQL."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import grid_sql
from .core import GridSpec, materialise
from .functions import numeric, theory
from .operators import assignment, crossing, measure, overlap, rows, shells, smoothing, spatial, survey, tessellation
from .plans import finders
from .sources import tables

BOX = tables.BOX
PI = repr(math.pi)
TR = f"tr AS (SELECT {tables.TRACER_COLUMNS}, l_quantity AS w, {tables.VELOCITY_COLUMNS} FROM lineitem)"
VO = f"vo AS (SELECT {tables.VOID_COLUMNS} FROM supplier)"
_Q: dict = {}
_SQL: dict = {}


def query(f, sql=None):
    _Q[f.__name__] = f
    return f


def sql(name: str, text: str) -> None:
    _SQL[name] = text.strip()


def queries():
    return dict(_Q)


def oracle_sql():
    return dict(_SQL)


def _image(d: str) -> str:
    return f"(({d}) - {BOX}*round(({d})/{BOX}))"


def _rounded(df: DataFrame, places: int = 6, keep=()) -> DataFrame:
    """Doubles rounded, so that the order of summation doesn't show; -0.0 becomes 0.0."""
    return df.select(*[(F.round(c, places) + F.lit(0.0)).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes])


def _points(spark, sf_dir):
    """Tracers with a row key that tells equal rows apart by their columns only."""
    return tables.tracers(spark, sf_dir)


def flagship(spark, sf_dir):
    """Density contrast by cloud in cell, and how many nodes lie below each tenth."""
    spec = GridSpec(8, BOX)
    grid = rows.contrast(assignment.dense(assignment.deposit(_points(spark, sf_dir), spec, "cic"), spec))
    return grid.groupBy(F.floor(F.col("value") * 10).alias("tenth")).agg(F.count("*").alias("nodes"))


# --- rows ------------------------------------------------------------------------------------------------------


@query
def tracers(spark, sf_dir):
    return _points(spark, sf_dir)


sql("tracers", f"WITH {TR} SELECT x, y, z, w FROM tr")


@query
def wrap_periodic(spark, sf_dir):
    moved = rows.translate(_points(spark, sf_dir), (60.0, -130.0, 250.0))
    return _rounded(rows.wrap_periodic(moved, BOX))


sql("wrap_periodic", f"""WITH {TR}, m AS (SELECT x + 60.0e0 AS x, y - 130.0e0 AS y, z + 250.0e0 AS z, w FROM tr)
SELECT {", ".join(f"round(CASE WHEN {c} >= 0 AND {c} < 100 THEN {c} ELSE {c} - 100.0e0*floor({c}/100.0e0) END, 6) + 0.0e0 AS {c}" for c in "xyz")}, round(w, 6) + 0.0e0 AS w FROM m""")


@query
def wrap_tally(spark, sf_dir):
    moved = rows.translate(_points(spark, sf_dir), (60.0, -130.0, 0.0))
    return rows.wrap_tally(moved, BOX).select(*[F.col(c).cast("long").alias(c) for c in ("n_nonfinite", "n_boundary", "n_wrapped")])


sql("wrap_tally", f"""WITH {TR}, m AS (SELECT unnest([x + 60.0e0, y - 130.0e0, z]) AS v FROM tr)
SELECT count(*) FILTER (NOT isfinite(v))::BIGINT AS n_nonfinite, count(*) FILTER (v = 100)::BIGINT AS n_boundary, count(*) FILTER (isfinite(v) AND v <> 100 AND (v < 0 OR v > 100))::BIGINT AS n_wrapped FROM m""")


@query
def outside_box(spark, sf_dir):
    return rows.outside_box(rows.translate(_points(spark, sf_dir), (0.0, 5.0, -3.0)), BOX).agg(F.count("*").alias("n"))


sql("outside_box", f"WITH {TR} SELECT count(*) AS n FROM tr WHERE y + 5 >= {100 + 100 * 4 * 2.0**-23!r} OR z - 3 < -{100 * 4 * 2.0**-23!r}")


@query
def translate(spark, sf_dir):
    return rows.translate(tables.voids(spark, sf_dir), (1.5, -2.5, 3.0), ("cx", "cy", "cz"))


sql("translate", f"WITH {VO} SELECT void_id, cx + 1.5e0 AS cx, cy - 2.5e0 AS cy, cz + 3.0e0 AS cz, r FROM vo")


@query
def bounds(spark, sf_dir):
    return rows.bounds(_points(spark, sf_dir))


sql("bounds", f"WITH {TR} SELECT " + ", ".join(f"min({c}) AS {c}_min, max({c}) AS {c}_max, (min({c}) + max({c}))/2 AS {c}_centre, (max({c}) - min({c}))/2 AS {c}_half" for c in "xyz") + " FROM tr")


@query
def column_check(spark, sf_dir):
    return rows.column_check(_points(spark, sf_dir), ["x", "y", "z", "w"])


sql("column_check", f"WITH {TR}, u AS (UNPIVOT (SELECT x, y, z, w FROM tr) ON x, y, z, w INTO NAME name VALUE v) SELECT name, count(*) AS n, count(*) FILTER (NOT isfinite(v)) AS n_nonfinite, min(v) AS min, max(v) AS max FROM u GROUP BY name")


@query
def catalogue_check(spark, sf_dir):
    bad = tables.voids(spark, sf_dir).withColumns({"r": F.col("r") - 6, "cx": F.col("cx") + 20})
    return rows.check_catalogue(bad, BOX)


sql("catalogue_check", f"""WITH {VO}, b AS (SELECT cx + 20 AS cx, cy, cz, r - 6 AS r FROM vo)
SELECT * FROM (SELECT 'radius not finite or not positive' AS problem, 'error' AS severity, count(*) FILTER (r <= 0) AS n FROM b
UNION ALL SELECT 'centre outside the box', 'warning', count(*) FILTER (cx >= 100.001) FROM b) WHERE n > 0""")


@query
def morton_codes(spark, sf_dir):
    return rows.morton(_points(spark, sf_dir), (0, 0, 0), (BOX,) * 3).select("x", "y", "z", "morton")


_bits = lambda c: "list_sum(list_transform(range(21), lambda b: (((greatest(0, least(2097151, floor(%s/100.0e0*2097151)))::BIGINT >> b) & 1) << (3*b + %d))::HUGEINT))" % (c, "xyz".index(c))
sql("morton_codes", f"WITH {TR} SELECT x, y, z, ({_bits('x')} + {_bits('y')} + {_bits('z')})::BIGINT AS morton FROM tr")


@query
def exact_subsample(spark, sf_dir):
    df = tables.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("idx"))
    return rows.exact_subsample(df, 0.37, ["idx"], F.pmod(F.col("idx") * 2654435761, F.lit(4294967296)))


sql("exact_subsample", "SELECT idx FROM (SELECT c_custkey AS idx, row_number() OVER (ORDER BY (c_custkey * 2654435761) % 4294967296, c_custkey) AS k, count(*) OVER () AS n FROM customer) WHERE k <= floor(0.37e0*n + 0.5e0)")


@query
def bits_set(spark, sf_dir):
    return rows.bits_set(tables.table(spark, sf_dir, "orders"), "o_custkey")


sql("bits_set", "SELECT sum(bit_count(o_custkey))::BIGINT AS n_set FROM orders")


@query
def compact_catalogue(spark, sf_dir):
    return rows.compact(tables.voids(spark, sf_dir).withColumn("r", F.when(F.col("void_id") % 3 == 0, -F.col("r")).otherwise(F.col("r"))))


sql("compact_catalogue", f"WITH {VO} SELECT * FROM vo WHERE void_id % 3 <> 0")


@query
def payload_checksums(spark, sf_dir):
    return tables.table(spark, sf_dir, "supplier").select("s_suppkey", F.crc32(F.col("s_name").cast("binary")).alias("crc"))


# The checksum's table follows from its polynomial, a bit at a time; then a step for each byte.
sql("payload_checksums", """WITH t AS (SELECT list(list_reduce([i] || range(8), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS tab FROM range(256) r(i)),
s AS (SELECT s_suppkey, list_transform(range(octet_length(encode(s_name))), lambda i: ('0x' || substr(hex(encode(s_name)), 2*i + 1, 2))::BIGINT) AS bytes FROM supplier)
SELECT s_suppkey, xor(list_reduce([4294967295::BIGINT] || bytes, lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8)), 4294967295)::BIGINT AS crc FROM s, t""")


# --- grids -----------------------------------------------------------------------------------------------------


def _deposit_sql(scheme: str, n: int, table: str = "tr", mass: str = "w", out: str = "g", shift: float = 0.0) -> str:
    cell = BOX / n
    parts = []
    for c in "xyz":
        u = f"({c}/{cell!r} - {shift!r})" if shift else f"({c}/{cell!r})"
        if scheme == "ngp":
            w = f"[{{'i': floor({u} + 0.5e0), 'w': 1.0e0}}]"
        elif scheme == "cic":
            t = f"({u} - floor({u}))"
            w = f"[{{'i': floor({u}), 'w': 1 - {t}}}, {{'i': floor({u}) + 1, 'w': {t}}}]"
        elif scheme == "tsc":
            i = f"floor({u} + 0.5e0)"
            t = f"({u} - {i})"
            w = f"[{{'i': {i} - 1, 'w': 0.5e0*(0.5e0 - {t})*(0.5e0 - {t})}}, {{'i': {i}, 'w': 0.75e0 - {t}*{t}}}, {{'i': {i} + 1, 'w': 0.5e0*(0.5e0 + {t})*(0.5e0 + {t})}}]"
        else:
            i = f"floor({u})"
            t, s = f"({u} - {i})", f"(1 - ({u} - {i}))"
            w = f"[{{'i': {i} - 1, 'w': {s}*{s}*{s}/6}}, {{'i': {i}, 'w': (4 - 6*{t}*{t} + 3*{t}*{t}*{t})/6}}, {{'i': {i} + 1, 'w': (4 - 6*{s}*{s} + 3*{s}*{s}*{s})/6}}, {{'i': {i} + 2, 'w': {t}*{t}*{t}/6}}]"
        parts.append(f"{w} AS a{c}")
    wrap = lambda c: f"((p{c}.i + {n}) % {n})::INT AS i{c}"
    o = "" if out == "g" else out
    return f"""{o}s AS (SELECT {mass} AS m, {", ".join(parts)} FROM {table}), {o}ex AS (SELECT m, unnest(ax) AS px, ay, az FROM {o}s), {o}ey AS (SELECT m, px, unnest(ay) AS py, az FROM {o}ex), {o}ez AS (SELECT m, px, py, unnest(az) AS pz FROM {o}ey),
{out} AS (SELECT ix, iy, iz, sum(m)/{cell**3!r} AS value FROM (SELECT {wrap("x")}, {wrap("y")}, {wrap("z")}, m*px.w*py.w*pz.w AS m FROM {o}ez) GROUP BY ix, iy, iz)"""


def _assign(scheme):
    def run(spark, sf_dir):
        return _rounded(assignment.deposit(_points(spark, sf_dir), GridSpec(8, BOX), scheme, "w"))

    run.__name__ = f"assign_{scheme}"
    query(run)
    sql(run.__name__, f"WITH {TR}, {_deposit_sql(scheme, 8)} SELECT ix, iy, iz, round(value, 6) + 0.0e0 AS value FROM g")


for _scheme in assignment.SCHEMES:
    _assign(_scheme)


@query
def density_contrast(spark, sf_dir):
    spec = GridSpec(10, BOX)
    return _rounded(rows.contrast(assignment.dense(assignment.deposit(_points(spark, sf_dir), spec, "cic", "w"), spec)))


sql("density_contrast", f"""WITH {TR}, {_deposit_sql("cic", 10)}, f AS (SELECT i AS ix, j AS iy, k AS iz FROM range(10) a(i), range(10) b(j), range(10) c(k)),
d AS (SELECT f.ix::INT AS ix, f.iy::INT AS iy, f.iz::INT AS iz, coalesce(value, 0) AS value FROM f LEFT JOIN g USING (ix, iy, iz))
SELECT ix, iy, iz, round(value/(SELECT avg(value) FROM d) - 1, 6) + 0.0e0 AS value FROM d""")


@query
def mesh_cells(spark, sf_dir):
    return assignment.mesh(_points(spark, sf_dir), GridSpec(8, BOX), "w")


sql("mesh_cells", f"WITH {TR} SELECT least(floor(x/12.5e0), 7)::INT AS cx, least(floor(y/12.5e0), 7)::INT AS cy, least(floor(z/12.5e0), 7)::INT AS cz, count(*) AS n, sum(w) AS w FROM tr GROUP BY 1, 2, 3")


@query
def grid_minima(spark, sf_dir):
    spec = GridSpec(8, BOX)
    grid = rows.contrast(assignment.dense(assignment.deposit(_points(spark, sf_dir), spec, "ngp"), spec))
    return _rounded(assignment.local_minima(grid, spec, 0.0)).select("ix", "iy", "iz", "value")


sql("grid_minima", f"""WITH {TR}, c AS (SELECT (floor(x/12.5e0 + 0.5e0)::INT % 8) AS ix, (floor(y/12.5e0 + 0.5e0)::INT % 8) AS iy, (floor(z/12.5e0 + 0.5e0)::INT % 8) AS iz, count(*) AS n FROM tr GROUP BY 1, 2, 3),
f AS (SELECT i AS ix, j AS iy, k AS iz, (i*8 + j)*8 + k AS flat FROM range(8) a(i), range(8) b(j), range(8) c(k)),
g AS (SELECT f.*, coalesce(n, 0) AS n FROM f LEFT JOIN c USING (ix, iy, iz)), m AS (SELECT avg(n) AS m FROM g)
SELECT ix::INT AS ix, iy::INT AS iy, iz::INT AS iz, round(n/m - 1, 6) + 0.0e0 AS value FROM g, m WHERE n <= m AND NOT EXISTS (
  SELECT 1 FROM g o WHERE o.flat <> g.flat AND least(abs(o.ix - g.ix), 8 - abs(o.ix - g.ix)) <= 1 AND least(abs(o.iy - g.iy), 8 - abs(o.iy - g.iy)) <= 1 AND least(abs(o.iz - g.iz), 8 - abs(o.iz - g.iz)) <= 1
  AND (o.n < g.n OR o.n = g.n AND o.flat < g.flat))""")


@query
def trilinear_values(spark, sf_dir):
    spec = GridSpec(8, BOX)
    grid = assignment.dense(assignment.deposit(_points(spark, sf_dir), spec, "ngp"), spec)
    at = tables.voids(spark, sf_dir).select("void_id", F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("cz").alias("z"))
    return _rounded(assignment.trilinear(at, grid, spec, "void_id"))


sql("trilinear_values", f"""WITH {TR}, {VO}, g AS (SELECT (floor(x/12.5e0 + 0.5e0)::INT % 8) AS ix, (floor(y/12.5e0 + 0.5e0)::INT % 8) AS iy, (floor(z/12.5e0 + 0.5e0)::INT % 8) AS iz, count(*)/1953.125e0 AS value FROM tr GROUP BY 1, 2, 3),
q AS (SELECT void_id, (floor(cx/12.5e0)::INT + i) % 8 AS ix, (floor(cy/12.5e0)::INT + j) % 8 AS iy, (floor(cz/12.5e0)::INT + k) % 8 AS iz,
  (CASE i WHEN 0 THEN 1 - (cx/12.5e0 - floor(cx/12.5e0)) ELSE cx/12.5e0 - floor(cx/12.5e0) END)*(CASE j WHEN 0 THEN 1 - (cy/12.5e0 - floor(cy/12.5e0)) ELSE cy/12.5e0 - floor(cy/12.5e0) END)*(CASE k WHEN 0 THEN 1 - (cz/12.5e0 - floor(cz/12.5e0)) ELSE cz/12.5e0 - floor(cz/12.5e0) END) AS w
  FROM vo, range(2) a(i), range(2) b(j), range(2) c(k))
SELECT void_id, round(sum(w*coalesce(value, 0)), 6) + 0.0e0 AS value FROM q LEFT JOIN g USING (ix, iy, iz) GROUP BY void_id""")


# --- distances -------------------------------------------------------------------------------------------------


@query
def sphere_counts(spark, sf_dir):
    sums = shells.sums_within(tables.voids(spark, sf_dir), _points(spark, sf_dir), F.array(F.col("r") * F.col("r")), 1, BOX, 14.0, ("w",))
    return sums.select("void_id", F.col("n_0").alias("n"), F.col("w_0").alias("w"))


_D2 = f"pow({_image('x - cx')}, 2) + pow({_image('y - cy')}, 2) + pow({_image('z - cz')}, 2)"
sql("sphere_counts", f"WITH {TR}, {VO} SELECT void_id, count(*) AS n, sum(w) AS w FROM vo JOIN tr ON {_D2} <= r*r GROUP BY void_id")


@query
def sphere_counts_open(spark, sf_dir):
    near = spatial.within(tables.voids(spark, sf_dir), _points(spark, sf_dir), F.col("r"), BOX, 14.0, periodic=False)
    return near.groupBy("void_id").agg(F.count("*").alias("n"))


sql("sphere_counts_open", f"WITH {TR}, {VO} SELECT void_id, count(*) AS n FROM vo JOIN tr ON pow(x - cx, 2) + pow(y - cy, 2) + pow(z - cz, 2) <= r*r GROUP BY void_id")


@query
def nearest_tracer(spark, sf_dir):
    seen = tables.table(spark, sf_dir, "part").selectExpr("p_partkey AS idx", "CAST((p_partkey*48271) % 2003 AS DOUBLE)/2003.0e0*100.0e0 AS x", "CAST((p_partkey*69621) % 2011 AS DOUBLE)/2011.0e0*100.0e0 AS y", "CAST((p_partkey*16807) % 2017 AS DOUBLE)/2017.0e0*100.0e0 AS z")
    return _rounded(spatial.nearest(tables.voids(spark, sf_dir), seen, BOX, "void_id", "idx", 8))


sql("nearest_tracer", f"""WITH {VO}, p AS (SELECT p_partkey AS idx, ((p_partkey*48271) % 2003)::DOUBLE/2003.0e0*100.0e0 AS x, ((p_partkey*69621) % 2011)::DOUBLE/2011.0e0*100.0e0 AS y, ((p_partkey*16807) % 2017)::DOUBLE/2017.0e0*100.0e0 AS z FROM part),
d AS (SELECT void_id, idx, {_D2} AS d2 FROM vo, p) SELECT void_id, arg_min(idx, (d2, idx)) AS idx, round(min(d2), 6) + 0.0e0 AS d2 FROM d GROUP BY void_id""")


def _profile_sql(cumulative: bool, weighted: bool, velocity: bool = False) -> str:
    m = "w" if weighted else "1.0e0"
    vel = ", sum(CASE WHEN d2 > 0 THEN (dx*vx + dy*vy + dz*vz)/sqrt(d2) ELSE 0 END) AS flow" if velocity else ""
    norm = "(SELECT sum(w) FROM tr)/1e6" if weighted else "(SELECT count(*) FROM tr)/1e6"
    outer, inner = "((bin + 1)*0.3e0*r)", "(bin*0.3e0*r)"
    if cumulative:
        density = f"sum(coalesce(mass, 0)) OVER (PARTITION BY void_id ORDER BY bin)/({4 / 3 * math.pi!r}*pow({outer}, 3))/({norm}) - 1"
    else:
        density = f"coalesce(mass, 0)/({4 / 3 * math.pi!r}*(pow({outer}, 3) - pow({inner}, 3)))/({norm}) - 1"
    v = ", round(CASE WHEN coalesce(n, 0) > 0 THEN flow/n ELSE 0 END, 6) + 0.0e0 AS v_rad" if velocity else ""
    return f"""WITH {TR}, {VO}, p AS (SELECT void_id, r, {_image("x - cx")} AS dx, {_image("y - cy")} AS dy, {_image("z - cz")} AS dz, w, vx, vy, vz FROM vo, tr),
q AS (SELECT *, dx*dx + dy*dy + dz*dz AS d2 FROM p WHERE dx*dx + dy*dy + dz*dz <= 9*r*r),
b AS (SELECT void_id, floor(sqrt(d2)*(10.0e0/(3.0e0*r)))::INT AS bin, count(*) AS n, sum({m}) AS mass{vel} FROM q GROUP BY 1, 2),
s AS (SELECT void_id, r, i::INT AS bin FROM vo, range(10) t(i))
SELECT void_id, bin, coalesce(n, 0)::BIGINT AS n, round({density}, 6) + 0.0e0 AS density{v} FROM s LEFT JOIN b USING (void_id, bin)"""


def _profiles(name, **kw):
    def run(spark, sf_dir):
        tr = tables.tracers(spark, sf_dir, velocities=True)
        mean = tr.agg(F.sum("w") if kw.get("weight") else F.count("*").cast("double")).first()[0] / BOX**3
        return _rounded(measure.profiles(tables.voids(spark, sf_dir), tr, BOX, 10, 3.0, mean, 14.0, **kw))

    run.__name__ = name
    query(run)
    sql(name, _profile_sql(kw.get("cumulative", True), bool(kw.get("weight")), kw.get("velocity", False)))


_profiles("profiles_cumulative")
_profiles("profiles_shell_weighted", cumulative=False, weight="w")
_profiles("profiles_velocity", velocity=True)


@query
def profiles_stacked(spark, sf_dir):
    return _rounded(measure.stack(_Q["profiles_cumulative"](spark, sf_dir), ["density"], places=6))


sql("profiles_stacked", f"SELECT bin, count(*) AS n_voids, round(avg(density), 6) + 0.0e0 AS density, round(stddev_samp(density)/sqrt(count(density)), 6) + 0.0e0 AS density_err FROM ({_profile_sql(True, False)}) GROUP BY bin")


@query
def profiles_wide(spark, sf_dir):
    wide = measure.widen(_Q["profiles_cumulative"](spark, sf_dir), "n")
    return wide.select("void_id", F.concat_ws(",", F.transform("n", lambda v: v.cast("string"))).alias("n"))


sql("profiles_wide", f"SELECT void_id, string_agg(n::VARCHAR, ',' ORDER BY bin) AS n FROM ({_profile_sql(True, False)}) GROUP BY void_id")

_HOLES = "ho AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {x}, {y}, {z}, {r})" for i, (x, y, z, r) in enumerate(tables.HOLES)) + ") t(void_id, cx, cy, cz, hole))"


def _holes(spark):
    return spark.createDataFrame([(i, *h) for i, h in enumerate(tables.HOLES)], "void_id long, cx double, cy double, cz double, hole double")


_CARVED = f"""ca AS (SELECT * FROM tr WHERE {" AND ".join(f"pow({_image(f'x - {hx}')}, 2) + pow({_image(f'y - {hy}')}, 2) + pow({_image(f'z - {hz}')}, 2) >= {r * r}" for hx, hy, hz, r in tables.HOLES)})"""


def _crossing_sql(weighted: bool) -> str:
    inside = "sum(w) OVER (PARTITION BY void_id ORDER BY d2 RANGE UNBOUNDED PRECEDING) - sum(w) OVER (PARTITION BY void_id, d2)" if weighted else "rank() OVER (PARTITION BY void_id ORDER BY d2) - 1"
    total = "sum(w)" if weighted else "count(*)"
    level = f"(0.3e0*4/3*{PI}*(SELECT {total} FROM ca)/1e6)"
    return f"""WITH {TR}, {_CARVED}, {_HOLES}, p AS (SELECT void_id, hole, w, {_D2} AS d2 FROM ho, ca), q AS (SELECT * FROM p WHERE d2 <= 4*hole*hole),
k AS (SELECT *, {inside} AS inside FROM q), s AS (SELECT void_id, hole, {total} AS total, max(CASE WHEN sqrt(d2) > hole AND sqrt(d2) <= 2*hole AND inside <= {level}*pow(sqrt(d2), 3) THEN sqrt(d2) END) AS d FROM k GROUP BY 1, 2),
t AS (SELECT void_id, d, CASE WHEN total <= {level}*pow(2*hole, 3) THEN CASE WHEN total = 0 THEN 'empty' ELSE 'beyond search' END WHEN d IS NULL THEN 'below rung' END AS reason FROM s)
SELECT void_id::BIGINT AS void_id, round(CASE WHEN reason IS NULL THEN d END, 6) + 0.0e0 AS radius, reason FROM t"""


def _crossing(name, weight):
    def run(spark, sf_dir):
        tr = materialise(tables.carved(spark, sf_dir))
        total = tr.agg(F.sum(weight) if weight else F.count("*").cast("double")).first()[0]
        found = crossing.crossing_radius(_holes(spark), tr, BOX, total / BOX**3, -0.7, F.col("hole"), 2 * F.col("hole"), 26.0, weight=weight)
        return _rounded(found)

    run.__name__ = name
    query(run)
    sql(name, _crossing_sql(bool(weight)))


_crossing("crossing_radius", None)
_crossing("crossing_radius_weighted", "w")


@query
def refusal_reasons(spark, sf_dir):
    tr = _points(spark, sf_dir)
    near = crossing.crossing_radius(tables.voids(spark, sf_dir), tr, BOX, tr.count() / BOX**3, -0.2, F.col("r"), F.col("r") * 1.5, 21.0)
    return near.groupBy("reason").agg(F.count("*").alias("n"))


sql("refusal_reasons", f"""WITH {TR}, {VO}, p AS (SELECT void_id, r, {_D2} AS d2 FROM vo, tr), q AS (SELECT * FROM p WHERE d2 <= 2.25e0*r*r), l AS (SELECT 0.8e0*4/3*{PI}*count(*)/1e6 AS level FROM tr),
k AS (SELECT *, rank() OVER (PARTITION BY void_id ORDER BY d2) - 1 AS inside FROM q), s AS (SELECT void_id, r, count(*) AS total, max(CASE WHEN sqrt(d2) > r AND sqrt(d2) <= 1.5e0*r AND inside <= level*pow(sqrt(d2), 3) THEN sqrt(d2) END) AS d FROM k, l GROUP BY 1, 2)
SELECT CASE WHEN coalesce(total, 0) <= level*pow(1.5e0*vo.r, 3) THEN CASE WHEN coalesce(total, 0) = 0 THEN 'empty' ELSE 'beyond search' END WHEN d IS NULL THEN 'below rung' END AS reason, count(*) AS n FROM vo LEFT JOIN s USING (void_id), l GROUP BY 1""")


@query
def survey_crossing(spark, sf_dir):
    tr = materialise(tables.carved(spark, sf_dir))
    randoms = tables.table(spark, sf_dir, "lineitem").selectExpr("CAST((l_orderkey*15485863 + l_linenumber*32452843) % 1000003 AS DOUBLE)/1000003.0e0*100.0e0 AS x", "CAST((l_partkey*7919 + l_orderkey*131) % 1000003 AS DOUBLE)/1000003.0e0*100.0e0 AS y", "CAST((l_suppkey*104729 + l_orderkey*8191 + l_linenumber*17) % 1000003 AS DOUBLE)/1000003.0e0*100.0e0 AS z")
    alpha = tr.count() / randoms.count()
    return _rounded(crossing.survey_crossing_radius(_holes(spark), tr, randoms, BOX, alpha, -0.7, F.col("hole") * 0.5, 1.8 * F.col("hole"), 24.0))


_OPEN = "pow(x - cx, 2) + pow(y - cy, 2) + pow(z - cz, 2)"
sql("survey_crossing", f"""WITH {TR}, {_CARVED}, {_HOLES}, ra AS (SELECT ((l_orderkey*15485863 + l_linenumber*32452843) % 1000003)::DOUBLE/1000003.0e0*100.0e0 AS x, ((l_partkey*7919 + l_orderkey*131) % 1000003)::DOUBLE/1000003.0e0*100.0e0 AS y, ((l_suppkey*104729 + l_orderkey*8191 + l_linenumber*17) % 1000003)::DOUBLE/1000003.0e0*100.0e0 AS z FROM lineitem),
l AS (SELECT 0.3e0*(SELECT count(*) FROM ca)/(SELECT count(*) FROM ra) AS level),
b AS (SELECT x, y, z, 1 AS d, 0 AS r FROM ca UNION ALL SELECT x, y, z, 0, 1 FROM ra), q AS (SELECT void_id, hole, d, r, {_OPEN} AS d2 FROM ho, b WHERE {_OPEN} <= pow(1.8e0*hole, 2)),
k AS (SELECT *, sum(d) OVER o - sum(d) OVER e AS nd, sum(r) OVER o - sum(r) OVER e AS nr FROM q WINDOW o AS (PARTITION BY void_id ORDER BY d2 RANGE UNBOUNDED PRECEDING), e AS (PARTITION BY void_id, d2)),
s AS (SELECT void_id, sum(d) AS td, sum(r) AS tr, max(CASE WHEN d = 1 AND sqrt(d2) > 0.5e0*hole AND sqrt(d2) <= 1.8e0*hole AND nr > 0 AND nd <= level*nr THEN sqrt(d2) END) AS dist FROM k, l GROUP BY 1),
t AS (SELECT void_id, dist, CASE WHEN tr = 0 THEN 'no randoms' WHEN td <= level*tr THEN 'beyond search' WHEN dist IS NULL THEN 'below rung' END AS reason FROM s, l)
SELECT void_id::BIGINT AS void_id, round(CASE WHEN reason IS NULL THEN dist END, 6) + 0.0e0 AS radius, reason FROM t""")


# --- overlap ---------------------------------------------------------------------------------------------------


@query
def colliding_pairs(spark, sf_dir):
    v = tables.voids(spark, sf_dir)
    return overlap.collisions(v, v, BOX, 0.3, 14.0).where("void_id < o_void_id").select("void_id", "o_void_id")


_HIT = lambda f: " AND ".join(["sqrt(" + " + ".join(f"pow({_image(f'a.c{c} - b.c{c}')}, 2)" for c in "xyz") + f") < a.r + b.r - {f}*least(a.r, b.r)"])
sql("colliding_pairs", f"WITH {VO} SELECT a.void_id, b.void_id AS o_void_id FROM vo a JOIN vo b ON a.void_id < b.void_id AND {_HIT('0.3e0')}")


@query
def accepted_in_order(spark, sf_dir):
    v = tables.voids(spark, sf_dir).withColumn("depth", -F.col("r"))
    return overlap.accept_in_order(v, "depth", BOX, 0.5, 14.0).select("void_id", "r")


sql("accepted_in_order", f"""WITH RECURSIVE {VO}, o AS (SELECT *, row_number() OVER (ORDER BY -r, void_id) AS k FROM vo),
e AS (SELECT a.k, list(b.k) AS hits FROM o a JOIN o b ON b.k < a.k AND {_HIT('0.5e0')} GROUP BY a.k),
w(k, taken) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT w.k + 1, CASE WHEN list_has_any(w.taken, coalesce(e.hits, [])) THEN w.taken ELSE list_append(w.taken, w.k + 1) END FROM w LEFT JOIN e ON e.k = w.k + 1 WHERE w.k < (SELECT count(*) FROM o))
SELECT void_id, r FROM o WHERE k IN (SELECT unnest(taken) FROM w WHERE k = (SELECT count(*) FROM o))""")


@query
def free_of_prior(spark, sf_dir):
    v = tables.voids(spark, sf_dir)
    return overlap.without_collisions(v.where("void_id % 4 <> 0"), v.where("void_id % 4 = 0"), BOX, 0.0, 14.0).select("void_id")


sql("free_of_prior", f"WITH {VO} SELECT a.void_id FROM vo a WHERE a.void_id % 4 <> 0 AND NOT EXISTS (SELECT 1 FROM vo b WHERE b.void_id % 4 = 0 AND {_HIT('0.0e0')})")


@query
def accepted_with_displacement(spark, sf_dir):
    v = tables.voids(spark, sf_dir).withColumn("depth", F.pmod(F.col("void_id") * 7919, F.lit(101)).cast("double"))
    return overlap.accept_with_displacement(v, v.limit(0), "depth", BOX, 1.0).select("void_id", "r")


sql("accepted_with_displacement", f"""WITH RECURSIVE {VO}, o AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY (void_id*7919) % 101, void_id) AS k FROM vo), s AS MATERIALIZED (SELECT list(r ORDER BY k) AS rs FROM o),
e AS MATERIALIZED (SELECT a.k, any_value(a.r) AS r, list(b.k) AS near FROM o a JOIN o b ON b.k < a.k AND {_HIT('1.0e0')} GROUP BY a.k),
w(k, live) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT k + 1, CASE WHEN len(hits) = 0 OR list_max(list_transform(hits, lambda j: rs[j])) < r THEN list_append(list_filter(live, lambda j: NOT list_contains(hits, j)), k + 1) ELSE live END
  FROM (SELECT w.k, w.live, e.r, s.rs, list_intersect(w.live, coalesce(e.near, [])) AS hits FROM w LEFT JOIN e ON e.k = w.k + 1, s WHERE w.k < (SELECT count(*) FROM o)))
SELECT void_id, r FROM o WHERE k IN (SELECT unnest(live) FROM w WHERE k = (SELECT count(*) FROM o))""")


# --- size functions and distributions --------------------------------------------------------------------------


def _vsf(name, logarithmic):
    def run(spark, sf_dir):
        return _rounded(measure.size_function(tables.sized_voids(spark, sf_dir), 1e6, 12, logarithmic=logarithmic), 9)

    run.__name__ = name
    query(run)
    f, back = ("ln", "exp") if logarithmic else ("", "")
    centre = "sqrt(r_lo*r_hi)" if logarithmic else "(r_lo + r_hi)/2"
    width = "ln(r_hi/r_lo)" if logarithmic else "r_hi - r_lo"
    sql(name, f"""WITH v AS (SELECT 5.0e0 + p_size/5.0e0 AS r FROM part), m AS (SELECT {f}(min(r)) AS a, {f}(max(r)) AS b FROM v),
c AS (SELECT least(floor(({f}(r) - a)*(12/(b - a))), 11)::INT AS bin, count(*) AS n FROM v, m GROUP BY 1), s AS (SELECT i::INT AS bin, {back}(a + (b - a)*i/12.0e0) AS r_lo, {back}(a + (b - a)*(i + 1)/12.0e0) AS r_hi FROM range(12) t(i), m),
j AS (SELECT bin, r_lo, r_hi, coalesce(n, 0) AS counts, coalesce(n, 0)/(1e6*({width})) AS vsf FROM s LEFT JOIN c USING (bin))
SELECT bin, round(r_lo, 9) + 0.0e0 AS r_lo, round(r_hi, 9) + 0.0e0 AS r_hi, round({centre}, 9) + 0.0e0 AS r_centre, counts::BIGINT AS counts, round(vsf, 9) + 0.0e0 AS vsf, round(CASE WHEN counts > 0 THEN vsf/sqrt(counts) ELSE 0 END, 9) + 0.0e0 AS err FROM j""")


_vsf("size_function_log", True)
_vsf("size_function_linear", False)


def _parts(spark):
    rows_ = [(i, r, (i + 1) * 1e-3 / r**2 if (i, r) != (1, 9.0) else 0.0, 1e-4 / r) for i, rs in enumerate(((4.0, 6.0, 9.0, 13.0), (5.0, 9.0, 12.0), (7.0, 8.5, 11.0, 15.0))) for r in rs]
    return rows_, spark.createDataFrame(rows_, "input int, r_centre double, vsf double, err double") if spark else None


def _combined(how):
    def run(spark, sf_dir):
        targets = spark.range(11).select(F.col("id").cast("int").alias("bin"), (F.lit(4.25) + F.col("id")).alias("r_centre"))
        return _rounded(measure.combine_size_functions(_parts(spark)[1], targets, how), 12)

    run.__name__ = f"size_function_{how}"
    query(run)
    values = ", ".join(f"({i}, {r!r}::DOUBLE, {v!r}::DOUBLE, {e!r}::DOUBLE)" for i, r, v, e in _parts(None)[0])
    mix = lambda a, b: f"CASE WHEN {a} > 0 AND {b} > 0 THEN exp(ln({a})*(1 - x) + ln({b})*x) ELSE {a}*(1 - x) + {b}*x END"
    agg = {"mean": "avg(v) AS vsf, sqrt(sum(e*e))/count(*) AS err FROM k GROUP BY bin", "median": "avg(v) AS vsf, avg(e) AS err FROM (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY v, input) AS n, count(*) OVER (PARTITION BY bin) AS m FROM k) WHERE n = floor((m + 1)/2) OR n = floor(m/2) + 1 GROUP BY bin", "stitch": "arg_min(v, input) AS vsf, arg_min(e, input) AS err FROM k GROUP BY bin"}[how]
    sql(run.__name__, f"""WITH p AS (SELECT *, lead(r) OVER w AS r2, lead(v) OVER w AS v2, lead(e) OVER w AS e2 FROM (VALUES {values}) t(input, r, v, e) WINDOW w AS (PARTITION BY input ORDER BY r)),
t AS (SELECT i::INT AS bin, 4.25e0 + i AS rc FROM range(11) n(i)), h AS (SELECT bin, input, v, coalesce(v2, v) AS v2, e, coalesce(e2, e) AS e2, CASE WHEN r2 IS NULL THEN 0 ELSE ln(rc/r)/ln(r2/r) END AS x FROM t JOIN p ON rc >= r AND rc < r2 OR r2 IS NULL AND rc = r),
k AS (SELECT bin, input, {mix("v", "v2")} AS v, {mix("e", "e2")} AS e FROM h), c AS (SELECT bin, {agg})
SELECT bin, rc AS r_centre, round(coalesce(vsf, 0), 12) + 0.0e0 AS vsf, round(coalesce(err, 0), 12) + 0.0e0 AS err FROM t LEFT JOIN c USING (bin)""")


for _how in ("mean", "median", "stitch"):
    _combined(_how)


@query
def value_distribution(spark, sf_dir):
    spec = GridSpec(10, BOX)
    grid = rows.contrast(assignment.dense(assignment.deposit(_points(spark, sf_dir), spec, "ngp"), spec))
    return _rounded(measure.distribution(grid, "value", -0.5, 0.5, 10), 9)


sql("value_distribution", f"""WITH {TR}, c AS (SELECT (floor(x/10.0e0 + 0.5e0)::INT % 10) AS ix, (floor(y/10.0e0 + 0.5e0)::INT % 10) AS iy, (floor(z/10.0e0 + 0.5e0)::INT % 10) AS iz, count(*) AS n FROM tr GROUP BY 1, 2, 3),
f AS (SELECT i AS ix, j AS iy, k AS iz FROM range(10) a(i), range(10) b(j), range(10) c(k)), g AS (SELECT coalesce(n, 0)/1000.0e0 AS v FROM f LEFT JOIN c USING (ix, iy, iz)), d AS (SELECT v/(SELECT avg(v) FROM g) - 1 AS v FROM g),
h AS (SELECT least(floor((v + 0.5e0)*10.0e0), 9)::INT AS bin, count(*) AS n FROM d WHERE v BETWEEN -0.5e0 AND 0.5e0 GROUP BY 1)
SELECT i::INT AS bin, round(-0.5e0 + i*0.1e0, 9) + 0.0e0 AS lo, round(-0.5e0 + (i + 1)*0.1e0, 9) + 0.0e0 AS hi, coalesce(n, 0)::BIGINT AS n, round(coalesce(n, 0)/(1000*0.1e0), 9) + 0.0e0 AS pdf FROM range(10) t(i) LEFT JOIN h ON h.bin = i""")

# --- theory ----------------------------------------------------------------------------------------------------

_RADII = (4.0, 6.0, 8.0, 12.0, 16.0, 24.0)
_RA = "ra AS (SELECT unnest([" + ", ".join(f"{r}::DOUBLE" for r in _RADII) + "]) AS radius)"
_PK = f"pk AS (SELECT k, pk FROM {tables.SPECTRUM_SQL})"
_W = "CASE WHEN k*radius <= 1e-4 THEN 1 ELSE 3*(sin(k*radius) - k*radius*cos(k*radius))/pow(k*radius, 3) END"
_DW = "CASE WHEN k*radius < 1e-2 THEN -k*radius/5 + pow(k*radius, 3)/70 ELSE 3*(pow(k*radius, 2)*sin(k*radius) - 3*sin(k*radius) + 3*k*radius*cos(k*radius))/pow(k*radius, 4) END"
_WT = "wt AS (SELECT k, pk, 0.5e0*(coalesce(ln(k) - ln(lag(k) OVER (ORDER BY k)), 0) + coalesce(ln(lead(k) OVER (ORDER BY k)) - ln(k), 0)) AS weight FROM pk)"


def _radii(spark):
    return spark.createDataFrame([(r,) for r in _RADII], "radius double")


_MOMENTS = f"""f AS (SELECT radius, k, pow(k, 3)*pk*pow({_W}, 2) AS f FROM pk, ra), l AS (SELECT radius, k, f, lag(k) OVER w AS k0, lag(f) OVER w AS f0, max(k) OVER (PARTITION BY radius) AS top FROM f WINDOW w AS (PARTITION BY radius ORDER BY k)),
t AS (SELECT radius, j::INT AS "order", sum(0.5e0*(f*pow(k, 2*j) + f0*pow(k0, 2*j))*(ln(k) - ln(k0))) AS t, sum(CASE WHEN k > top/2 THEN 0.5e0*(f*pow(k, 2*j) + f0*pow(k0, 2*j))*(ln(k) - ln(k0)) ELSE 0 END) AS h FROM l, range(3) n(j) WHERE k0 IS NOT NULL GROUP BY 1, 2),
mo AS (SELECT radius, "order", sqrt(t/({2 * math.pi**2!r})) AS sigma, h/t AS high_k_fraction FROM t)"""


@query
def spectrum_moments(spark, sf_dir):
    return _rounded(theory.moments(tables.spectrum(spark), _radii(spark)), 7)


sql("spectrum_moments", f'WITH {_PK}, {_RA}, {_MOMENTS} SELECT radius, "order", round(sigma, 7) + 0.0e0 AS sigma, round(high_k_fraction, 7) + 0.0e0 AS high_k_fraction FROM mo')


@query
def sigma_slope(spark, sf_dir):
    return _rounded(theory.sigma_slope(tables.spectrum(spark), _radii(spark)), 7)


sql("sigma_slope", f"WITH {_PK}, {_RA}, {_WT} SELECT radius, round(sum(weight*pow(k, 3)*pk*({_W})*({_DW})*k*radius)/sum(weight*pow(k, 3)*pk*pow({_W}, 2)), 7) + 0.0e0 AS slope FROM wt, ra GROUP BY radius")


@query
def scale_covariance(spark, sf_dir):
    return _rounded(theory.covariance(tables.spectrum(spark), _radii(spark)), 7)


sql("scale_covariance", f"""WITH {_PK}, {_RA}, {_WT}, n AS (SELECT radius, row_number() OVER (ORDER BY radius)::INT - 1 AS i FROM ra), a AS (SELECT i, k, weight*pow(k, 3)*pk/({2 * math.pi**2!r}) AS b, {_W} AS w FROM wt, n)
SELECT p.i::INT AS i, q.i::INT AS j, round(sum(p.b*p.w*q.w), 7) + 0.0e0 AS s FROM a p JOIN a q ON p.k = q.k AND q.i <= p.i GROUP BY 1, 2""")


@query
def kernel_walk(spark, sf_dir):
    pk = tables.spectrum(spark)
    return _rounded(theory.walk(theory.variance_kernel(pk, _radii(spark)), pk), 7)


sql("kernel_walk", f"""WITH {_PK}, {_RA}, {_WT}, b AS (SELECT radius, k, weight*pow(k, 3)*pk/({2 * math.pi**2!r}) AS b, {_W} AS w, {_DW} AS d FROM wt, ra)
SELECT radius, round(sqrt(sum(b*w*w)), 7) + 0.0e0 AS sigma, round(sum(2*b*w*k*d), 7) + 0.0e0 AS slope, round(sum(b*k*d*k*d), 7) + 0.0e0 AS slope_variance FROM b GROUP BY radius""")


@query
def peak_shapes(spark, sf_dir):
    return _rounded(theory.peak_shape(theory.moments(tables.spectrum(spark), _radii(spark))), 7)


_SHAPES = """sh AS (SELECT radius, s0, s1*s1/(s0*s2) AS gamma, sqrt(3.0e0)*s1/s2 AS r_star FROM (SELECT radius, max(sigma) FILTER ("order" = 0) AS s0, max(sigma) FILTER ("order" = 1) AS s1, max(sigma) FILTER ("order" = 2) AS s2 FROM mo GROUP BY radius))"""
sql("peak_shapes", f"WITH {_PK}, {_RA}, {_MOMENTS}, {_SHAPES} SELECT radius, round(s0, 7) + 0.0e0 AS sigma_0, round(gamma, 7) + 0.0e0 AS gamma, round(r_star, 7) + 0.0e0 AS r_star FROM sh")

_G = lambda g, w: f"((pow({w}, 3) - 3*{g}*{g}*{w} + (432/({math.sqrt(10 * math.pi)!r}*pow(9 - 5*{g}*{g}, 2.5e0))*{w}*{w} + 1.84e0 + 1.13e0*pow(1 - {g}*{g}, 5.72e0))*exp(-2.5e0/(9 - 5*{g}*{g})*{w}*{w}))/(1 + (8.91e0 + 1.27e0*exp(6.51e0*{g}*{g}))*exp(-2.58e0*exp(1.05e0*{g}*{g})*{w})))"


@query
def peak_densities(spark, sf_dir):
    shapes = theory.peak_shape(theory.moments(tables.spectrum(spark), _radii(spark)))
    nu = spark.range(9).select((F.col("id") * 0.5).alias("nu"))
    rows_ = shapes.join(F.broadcast(nu))
    return _rounded(rows_.select("radius", "nu", (theory.peak_density(F.col("nu"), F.col("gamma"), F.col("r_star")) * 1e6).alias("density")))


sql("peak_densities", f"WITH {_PK}, {_RA}, {_MOMENTS}, {_SHAPES}, n AS (SELECT i*0.5e0 AS nu FROM range(9) t(i)) SELECT radius, nu, round(1e6*greatest(0, exp(-0.5e0*nu*nu)/({4 * math.pi**2!r}*pow(r_star, 3))*{_G('gamma', '(gamma*nu)')}), 6) + 0.0e0 AS density FROM sh, n")

_ABOVE = f"""q AS (SELECT radius, r_star, gamma, i, greatest(12.0e0, 40/greatest(1.0e0, 0.5e0/s0))/2048 AS h, 0.5e0/s0 AS nu0 FROM sh, range(2049) t(i)), u AS (SELECT *, nu0 + h*i AS nu FROM q),
ab AS (SELECT radius, greatest(0, sum((CASE WHEN i IN (0, 2048) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)*exp(-0.5e0*nu*nu)*{_G("gamma", "(gamma*nu)")})*h/3/({4 * math.pi**2!r}*pow(r_star, 3))) AS density FROM u GROUP BY radius, r_star, h)"""


@query
def peak_density_above(spark, sf_dir):
    shapes = theory.peak_shape(theory.moments(tables.spectrum(spark), _radii(spark)))
    return _rounded(theory.peak_density_above(shapes, -0.5).withColumn("density", F.col("density") * 1e6))


sql("peak_density_above", f"WITH {_PK}, {_RA}, {_MOMENTS}, {_SHAPES}, {_ABOVE} SELECT radius, round(1e6*density, 6) + 0.0e0 AS density FROM ab")


@query
def peak_size_function(spark, sf_dir):
    shapes = theory.peak_shape(theory.moments(tables.spectrum(spark), _radii(spark)))
    return _rounded(theory.peak_size_function(theory.peak_density_above(shapes, -0.5)).withColumn("vsf", F.col("vsf") * 1e6))


_THREE = lambda p, x0, y0, x1, y1, x2, y2: f"({y0}*(2*{p} - {x1} - {x2})/(({x0} - {x1})*({x0} - {x2})) + {y1}*(2*{p} - {x0} - {x2})/(({x1} - {x0})*({x1} - {x2})) + {y2}*(2*{p} - {x0} - {x1})/(({x2} - {x0})*({x2} - {x1})))"
sql("peak_size_function", f"""WITH {_PK}, {_RA}, {_MOMENTS}, {_SHAPES}, {_ABOVE}, y AS (SELECT radius, density, ln(radius) AS x, ln(density) AS y FROM ab),
n AS (SELECT *, lag(x) OVER w AS xa, lag(y) OVER w AS ya, lag(x, 2) OVER w AS xaa, lag(y, 2) OVER w AS yaa, lead(x) OVER w AS xb, lead(y) OVER w AS yb, lead(x, 2) OVER w AS xbb, lead(y, 2) OVER w AS ybb FROM y WINDOW w AS (ORDER BY radius))
SELECT radius, round(1e6*greatest(0, -density*CASE WHEN xa IS NULL THEN {_THREE("x", "x", "y", "xb", "yb", "xbb", "ybb")} WHEN xb IS NULL THEN {_THREE("x", "xaa", "yaa", "xa", "ya", "x", "y")} ELSE {_THREE("x", "xa", "ya", "x", "y", "xb", "yb")} END), 6) + 0.0e0 AS vsf FROM n""")


@query
def moving_barrier(spark, sf_dir):
    s = spark.range(40).select((F.col("id") * 0.1).alias("sigma"))
    return _rounded(s.select("sigma", theory.moving_barrier(F.col("sigma"), 0.096, 1.15, 0.43).alias("barrier")))


sql("moving_barrier", "SELECT i/10.0e0 AS sigma, round(CASE WHEN i > 0 THEN 0.096e0*(1 + pow(1.15e0/(i*0.1e0), 0.43e0)) ELSE 0 END, 6) + 0.0e0 AS barrier FROM range(40) t(i)")

_DV, _DC = -2.71, 1.686
_SHARE = -_DV / (_DC - _DV)
_TWO = lambda s: f"greatest(0, CASE WHEN {_SHARE / -_DV!r}*{s} <= 0.276e0 THEN {math.sqrt(2 / math.pi) * -_DV!r}/{s}*exp({-0.5 * _DV * _DV!r}/({s}*{s})) ELSE 2*list_sum(list_transform(range(1, 65), lambda j: exp(-0.5e0*pow(j*{PI}*{_SHARE / -_DV!r}*{s}, 2))*j*{PI}*pow({_SHARE / -_DV!r}*{s}, 2)*sin(j*{math.pi * _SHARE!r}))) END)"


@query
def two_barrier_multiplicity(spark, sf_dir):
    s = spark.range(1, 60).select((F.col("id") * 0.1).alias("sigma"))
    return _rounded(s.select("sigma", theory.two_barrier_multiplicity(F.col("sigma"), _DV, _DC).alias("f")))


sql("two_barrier_multiplicity", f"SELECT round(s, 6) AS sigma, round({_TWO('s')}, 6) + 0.0e0 AS f FROM (SELECT i*0.1e0 AS s FROM range(1, 60) t(i))")


def _abundance(name, conserve):
    def run(spark, sf_dir):
        return _rounded(theory.two_barrier_size_function(tables.spectrum(spark), _radii(spark), conserve=conserve).withColumn("vsf", F.col("vsf") * 1e6))

    run.__name__ = name
    query(run)
    scale = 0.2 ** (1 / 3)
    v = theory.MAP_EXPONENT * (1 - 0.2 ** (-1 / theory.MAP_EXPONENT))
    share = -v / (1.686 - v)
    two = _TWO("sg").replace(repr(_SHARE / -_DV), repr(share / -v)).replace(repr(math.sqrt(2 / math.pi) * -_DV), repr(math.sqrt(2 / math.pi) * -v)).replace(repr(-0.5 * _DV * _DV), repr(-0.5 * v * v)).replace(repr(math.pi * _SHARE), repr(math.pi * share))
    radius = "radius" if conserve == "number" else f"(radius/{scale!r})"
    sql(name, f"""WITH {_PK}, {_RA.replace("AS radius", f"*{scale!r} AS radius")}, {_WT}, {_MOMENTS}, sl AS (SELECT radius, sum(weight*pow(k, 3)*pk*({_W})*({_DW})*k*radius)/sum(weight*pow(k, 3)*pk*pow({_W}, 2)) AS slope FROM wt, ra GROUP BY radius),
s AS (SELECT radius, sigma AS sg, slope FROM mo JOIN sl USING (radius) WHERE "order" = 0)
SELECT round(radius/{scale!r}, 6) + 0.0e0 AS radius, round(1e6*greatest(0, {two}*-slope/({4 / 3 * math.pi!r}*pow({radius}, 3))), 6) + 0.0e0 AS vsf FROM s""")


_abundance("two_barrier_size_function", "number")
_abundance("volume_conserving_size_function", "volume")


@query
def spherical_map(spark, sf_dir):
    d = spark.range(20).select((F.col("id") * -0.2).alias("delta"))
    return _rounded(d.select("delta", theory.linear_to_nonlinear(F.col("delta")).alias("nonlinear"), theory.nonlinear_to_linear(theory.linear_to_nonlinear(F.col("delta"))).alias("back")))


sql("spherical_map", "SELECT round(i*-0.2e0, 6) + 0.0e0 AS delta, round(pow(1 + i*0.2e0/1.594e0, -1.594e0) - 1, 6) + 0.0e0 AS nonlinear, round(i*-0.2e0, 6) + 0.0e0 AS back FROM range(20) t(i)")


@query
def survival_chances(spark, sf_dir):
    h = spark.range(1, 12).select(F.col("id").cast("double").alias("radius"), (1 / (1.0 + F.col("id") * F.col("id"))).alias("lam"))
    return _rounded(theory.survival(h), 9)


sql("survival_chances", "WITH h AS (SELECT i::DOUBLE AS radius, 1/(1.0e0 + i*i) AS lam FROM range(1, 12) t(i)) SELECT radius, round(exp(-coalesce(sum(lam) OVER (ORDER BY radius DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))*(1 - exp(-lam)), 9) + 0.0e0 AS p FROM h")


@query
def bin_edges(spark, sf_dir):
    return _rounded(theory.edges_of(_radii(spark).withColumnRenamed("radius", "centre")), 9)


sql("bin_edges", f"""WITH {_RA}, n AS (SELECT radius, row_number() OVER (ORDER BY radius) - 1 AS i, ln(radius) AS x, lag(ln(radius)) OVER (ORDER BY radius) AS a, lead(ln(radius)) OVER (ORDER BY radius) AS b FROM ra)
SELECT i::INT AS i, radius AS centre, round(exp(coalesce((a + x)/2, x - (b - x)/2)), 9) + 0.0e0 AS lo, round(exp(coalesce((x + b)/2, x + (x - a)/2)), 9) + 0.0e0 AS hi FROM n""")

_E = lambda z: f"sqrt(0.3e0*pow(1 + {z}, 3) + 0.7e0)"
_DIST = "2997.92458e0*(" + " + ".join(f"list_sum(list_transform(range(n), lambda i: {w / 2!r}*z/n/{_E(f'(z/n*(i + 0.5e0 + {s * x / 2!r}))')}))" for x, w in theory.GAUSS_8 for s in (-1, 1)) + ")"


@query
def comoving_distances(spark, sf_dir):
    return _rounded(tables.sky(spark, sf_dir).select("idx", theory.comoving_distance(F.col("z")).alias("d")))


sql("comoving_distances", f"SELECT idx, round({_DIST}, 6) + 0.0e0 AS d FROM (SELECT c_custkey AS idx, z, greatest(1, ceil(z/0.05e0))::INT AS n FROM (SELECT c_custkey, 0.05e0 + (c_custkey % 50)::DOUBLE/100.0e0 AS z FROM customer))")


@query
def sky_positions(spark, sf_dir):
    return _rounded(theory.sky_to_cartesian(tables.sky(spark, sf_dir)).select("idx", "x", "y", "z"), 5)


sql("sky_positions", f"""WITH s AS (SELECT c_custkey AS idx, radians((c_custkey*137 % 360)::DOUBLE) AS ra, radians((c_custkey*71 % 120)::DOUBLE - 60) AS dec, 0.05e0 + (c_custkey % 50)::DOUBLE/100.0e0 AS z FROM customer),
d AS (SELECT idx, ra, dec, {_DIST} AS d FROM (SELECT *, greatest(1, ceil(z/0.05e0))::INT AS n FROM s)) SELECT idx, round(d*cos(dec)*cos(ra), 5) + 0.0e0 AS x, round(d*cos(dec)*sin(ra), 5) + 0.0e0 AS y, round(d*sin(dec), 5) + 0.0e0 AS z FROM d""")


@query
def sky_round_trip(spark, sf_dir):
    there = theory.sky_to_cartesian(tables.sky(spark, sf_dir))
    return _rounded(theory.cartesian_to_sky(there).select("idx", "dec", "redshift"), 4)


sql("sky_round_trip", "SELECT c_custkey AS idx, round((c_custkey*71 % 120)::DOUBLE - 60, 4) + 0.0e0 AS dec, round(0.05e0 + (c_custkey % 50)::DOUBLE/100.0e0, 4) + 0.0e0 AS redshift FROM customer")

# --- surveys ---------------------------------------------------------------------------------------------------


@query
def survey_occupancy(spark, sf_dir):
    spec = GridSpec(16, BOX)
    nodes = survey.occupied(_points(spark, sf_dir).where("pow(x - 50, 2) + pow(y - 50, 2) + pow(z - 50, 2) < 1600 AND abs(x - 50) > 4"), spec)
    return survey.close(nodes, 1, spec).select("ix", "iy", "iz")


_NODES = f"""no AS (SELECT DISTINCT (floor(x/6.25e0 + 0.5e0)::INT % 16) AS ix, (floor(y/6.25e0 + 0.5e0)::INT % 16) AS iy, (floor(z/6.25e0 + 0.5e0)::INT % 16) AS iz FROM tr WHERE pow(x - 50, 2) + pow(y - 50, 2) + pow(z - 50, 2) < 1600 AND abs(x - 50) > 4),
st AS (SELECT i - 1 AS i, j - 1 AS j, k - 1 AS k FROM range(3) a(i), range(3) b(j), range(3) c(k)), di AS (SELECT DISTINCT (ix + i + 16) % 16 AS ix, (iy + j + 16) % 16 AS iy, (iz + k + 16) % 16 AS iz FROM no, st),
cl AS (SELECT ix, iy, iz FROM (SELECT (ix + i + 16) % 16 AS ix, (iy + j + 16) % 16 AS iy, (iz + k + 16) % 16 AS iz FROM di, st) GROUP BY 1, 2, 3 HAVING count(*) = 27)"""
sql("survey_occupancy", f"WITH {TR}, {_NODES} SELECT ix::INT AS ix, iy::INT AS iy, iz::INT AS iz FROM cl")


@query
def survey_footprints(spark, sf_dir):
    spec = GridSpec(16, BOX)
    return _rounded(survey.footprint_fractions(tables.voids(spark, sf_dir), _Q["survey_occupancy"](spark, sf_dir), spec))


sql("survey_footprints", f"""WITH {TR}, {VO}, {_NODES}, v AS (SELECT *, greatest(r/8, 3.125e0) AS s FROM vo), l AS (SELECT void_id, cx, cy, cz, r, s, unnest(generate_series(-floor(2*r/s)::INT, floor(2*r/s)::INT)) AS a FROM v),
m AS (SELECT *, unnest(generate_series(-floor(2*r/s)::INT, floor(2*r/s)::INT)) AS b FROM l), n AS (SELECT *, unnest(generate_series(-floor(2*r/s)::INT, floor(2*r/s)::INT)) AS c FROM m), o AS (SELECT *, (a*a + b*b + c*c)*s*s AS d2 FROM n WHERE (a*a + b*b + c*c)*s*s <= 4*r*r),
p AS (SELECT void_id, d2, r, (floor((cx + a*s)/6.25e0 + 0.5e0)::INT + 160) % 16 AS ix, (floor((cy + b*s)/6.25e0 + 0.5e0)::INT + 160) % 16 AS iy, (floor((cz + c*s)/6.25e0 + 0.5e0)::INT + 160) % 16 AS iz FROM o),
q AS (SELECT p.*, CASE WHEN cl.ix IS NULL THEN 0.0e0 ELSE 1.0e0 END AS seen FROM p LEFT JOIN cl USING (ix, iy, iz))
SELECT void_id, round(avg(seen) FILTER (d2 <= r*r), 6) + 0.0e0 AS footprint, round(avg(seen) FILTER (d2 > r*r), 6) + 0.0e0 AS footprint_shell FROM q GROUP BY void_id""")


@query
def survey_bounds(spark, sf_dir):
    box, offset = survey.survey_box(_points(spark, sf_dir), 20.0, 5.0)
    return spark.createDataFrame([(round(box, 6), *[round(o, 6) for o in offset])], "box double, ox double, oy double, oz double")


sql("survey_bounds", f"""WITH {TR}, e AS (SELECT min(x) AS ax, max(x) AS bx, min(y) AS ay, max(y) AS ab, min(z) AS az, max(z) AS bz FROM tr), b AS (SELECT *, greatest(bx - ax, ab - ay, bz - az) + 2*1.01e0*45 AS box FROM e)
SELECT round(box, 6) AS box, round(box/2 - (ax + bx)/2, 6) AS ox, round(box/2 - (ay + ab)/2, 6) AS oy, round(box/2 - (az + bz)/2, 6) AS oz FROM b""")


# --- what SQL can't say ----------------------------------------------------------------------------------------

_SPEC = GridSpec(32, BOX)


def _carved_grid(spark, sf_dir):
    tr = tables.carved(spark, sf_dir)
    return rows.contrast(assignment.dense(assignment.deposit(tr, _SPEC, "cic"), _SPEC))


def _with_idx(df):
    """Tracers numbered; numbers are kept by the files they are written to."""
    return materialise(df.withColumn("idx", F.monotonically_increasing_id()))


_N = _SPEC.n
#: The carved tracers' contrast and its modes.
_MODES = [TR, _CARVED.replace("ca AS (", "ca AS MATERIALIZED ("), _deposit_sql("cic", _N, "ca", "1.0e0"), *grid_sql.dense_contrast("g", "dc", _N), *grid_sql.forward("dc", "mo", _N)]


def _with(parts: list[str], select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' * recursive}" + ",\n".join(parts) + "\n" + select


@query
def smoothed_grid(spark, sf_dir):
    return _rounded(smoothing.smooth(_carved_grid(spark, sf_dir), _SPEC, [8.0, 12.0], scheme="cic"))


_SMOOTHED = [*_MODES, *grid_sql.smoothed("mo", "sm", _N, BOX, [8.0, 12.0], 2)]
sql("smoothed_grid", _with(_SMOOTHED, "SELECT radius, ix::INT AS ix, iy::INT AS iy, iz::INT AS iz, round(value, 6) + 0.0e0 AS value FROM sm"))


@query
def interlaced_grid(spark, sf_dir):
    tr = materialise(tables.carved(spark, sf_dir))
    return _rounded(smoothing.interlace(assignment.deposit(tr, _SPEC, "tsc"), assignment.deposit(tr, _SPEC, "tsc", shift=0.5), _SPEC))


_FULL = f"SELECT i AS ix, j AS iy, k AS iz FROM range({_N}) a(i), range({_N}) b(j), range({_N}) c(k)"
_TURN = f"({-math.pi!r}*({grid_sql.signed('kx', _N)} + {grid_sql.signed('ky', _N)} + kz)/{_N})"
sql("interlaced_grid", _with([
    TR, _CARVED.replace("ca AS (", "ca AS MATERIALIZED ("), _deposit_sql("tsc", _N, "ca", "1.0e0"), _deposit_sql("tsc", _N, "ca", "1.0e0", "hg", 0.5),
    *[f"{o} AS MATERIALIZED (SELECT f.ix, f.iy, f.iz, coalesce({t}.value, 0) AS value FROM ({_FULL}) f LEFT JOIN {t} USING (ix, iy, iz))" for o, t in (("d0", "g"), ("d1", "hg"))],
    *grid_sql.forward("d0", "m0", _N), *grid_sql.forward("d1", "m1", _N),
    f"mi AS MATERIALIZED (SELECT kx, ky, kz, 0.5e0*(a.re + b.re*cos({_TURN}) - b.im*sin({_TURN})) AS re, 0.5e0*(a.im + b.im*cos({_TURN}) + b.re*sin({_TURN})) AS im FROM m0 a JOIN m1 b USING (kx, ky, kz))",
    *grid_sql.backward("mi", "il", _N),
], "SELECT ix::INT AS ix, iy::INT AS iy, iz::INT AS iz, round(value, 6) + 0.0e0 AS value FROM il"))


@query
def smoothed_distribution(spark, sf_dir):
    smoothed = smoothing.smooth(_carved_grid(spark, sf_dir), _SPEC, [8.0, 12.0], scheme="cic")
    return _rounded(measure.distribution(smoothed, "value", -1.0, 1.0, 40, ["radius"]), 9)


sql("smoothed_distribution", _with([*_SMOOTHED, "h AS (SELECT radius AS r, least(floor((value + 1)*20.0e0), 39)::INT AS bin, count(*) AS n FROM sm WHERE value BETWEEN -1 AND 1 GROUP BY 1, 2)", "b AS (SELECT radius, i::INT AS i FROM (SELECT DISTINCT radius FROM sm), range(40) t(i))"],
    f"SELECT radius, i AS bin, round(-1.0e0 + i*0.05e0, 9) + 0.0e0 AS lo, round(-1.0e0 + (i + 1)*0.05e0, 9) + 0.0e0 AS hi, coalesce(n, 0)::BIGINT AS n, round(coalesce(n, 0)/({_N**3}*0.05e0), 9) + 0.0e0 AS pdf FROM b LEFT JOIN h ON h.bin = i AND h.r = radius"))


@query
def grid_moments(spark, sf_dir):
    return _rounded(smoothing.grid_moments(_carved_grid(spark, sf_dir), _SPEC, [8.0, 12.0, 16.0], scheme="cic"))


_GRID_MOMENTS = _with(_MODES, f"""SELECT radius, "order", round(sqrt(t), 6) + 0.0e0 AS sigma, round(h/t, 6) + 0.0e0 AS high_k_fraction FROM ({grid_sql.moments("mo", _N, BOX, [8.0, 12.0, 16.0], 2)})""")
sql("grid_moments", _GRID_MOMENTS)


@query
def surrogate_moments(spark, sf_dir):
    return _rounded(smoothing.grid_moments(_carved_grid(spark, sf_dir), _SPEC, [8.0, 12.0, 16.0], scheme="cic", surrogate="phases", seed=3))


sql("surrogate_moments", _GRID_MOMENTS)  # random phases keep each mode's power

_LADDER = [12.0, 9.0, 7.0]


@query
def spherical_voids(spark, sf_dir):
    return _rounded(finders.spherical_finder(_carved_grid(spark, sf_dir), _SPEC, _LADDER, -0.7))


def _finder_sql(sized: bool, scale: float = 1.0) -> str:
    """A finder with cells as seeds: candidates of each rung, without those that collide, resized, and accepted in order."""
    parts, found = [*_MODES, *grid_sql.smoothed("mo", "sm", _N, BOX, _LADDER, 2)], None
    for i, r in enumerate(_LADDER):
        parts += grid_sql.nodes("sm", f"n{i}", _N, BOX, r, -0.7)
        parts.append(f"s{i} AS (SELECT *, {r}::DOUBLE AS r FROM n{i})")
        parts += grid_sql.free_of(f"s{i}", found, f"c{i}", BOX, 0.0, scale)
        last = f"c{i}"
        if sized:
            reach = finders.reach_of(_LADDER, i, _SPEC.cell, 2.0)
            parts += [*grid_sql.resized(f"c{i}", "ca", f"z{i}", BOX, r, reach, -0.7), *grid_sql.free_of(f"z{i}", found, f"y{i}", BOX, 0.0, scale)]
            last = f"y{i}"
        parts += grid_sql.accepted(last, found, f"f{i}", BOX, 0.0, scale)
        found = f"f{i}"
    return _with(parts, f"SELECT void_id::BIGINT AS void_id, {', '.join(f'round({c}, 6) + 0.0e0 AS {c}' for c in ('cx', 'cy', 'cz', 'r', 'depth'))} FROM {found}", recursive=True)


sql("spherical_voids", _finder_sql(False))


def _finder(name, settings):
    def run(spark, sf_dir):
        tr = _with_idx(tables.carved(spark, sf_dir))
        return _rounded(finders.tracer_finder(_carved_grid(spark, sf_dir), tr, _SPEC, _LADDER, -0.7, settings))

    run.__name__ = name
    return query(run)


_finder("excursion_set_voids", "excursion-set")
_finder("excursion_peak_voids", "excursion-peak")
_finder("lagrangian_overlap_voids", "lagrangian-overlap")
_finder("hill_voids", finders.Settings(refine="hill"))
sql("excursion_set_voids", _finder_sql(True))
sql("lagrangian_overlap_voids", _finder_sql(True, 0.3 ** (1 / 3)))


@query
def survey_voids(spark, sf_dir):
    inside = "pow(x - 50, 2) + pow(y - 50, 2) + pow(z - 50, 2) < 2300"
    full = tables.tracers(spark, sf_dir)
    turned = [full.select(*[F.pmod(F.col(a) + s, F.lit(BOX)).alias(b) for a, b in zip(order, "xyz")]) for order, s in (("yzx", 0.0), ("zxy", 31.0), ("yxz", 57.0), ("zyx", 83.0), ("xzy", 11.0))]
    randoms = turned[0]
    for other in turned[1:]:
        randoms = randoms.unionByName(other)
    data, randoms = materialise(tables.carved(spark, sf_dir).where(inside)), materialise(randoms.where(inside))
    box, offset = survey.survey_box(randoms, 11.0, 8.0)
    found = finders.survey_finder(rows.translate(data, offset), rows.translate(randoms, offset), GridSpec(32, box), [11.0, 8.0], -0.7)
    return rows.translate(found, tuple(-o for o in offset), ("cx", "cy", "cz"))


@query
def tessellation_volumes(spark, sf_dir):
    tr = tables.table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS idx", "CAST((s_suppkey*7919 + 13) % 1009 AS DOUBLE)/1009.0e0*100.0e0 AS x", "CAST((s_suppkey*104729 + 7) % 1013 AS DOUBLE)/1013.0e0*100.0e0 AS y", "CAST((s_suppkey*1299709 + 3) % 1019 AS DOUBLE)/1019.0e0*100.0e0 AS z")
    return tessellation.tessellate(tr, BOX)[0]


@query
def survey_volume(spark, sf_dir):
    ball = tables.tracers(spark, sf_dir).select(F.col("x") - 50, F.col("y") - 50, F.col("z") - 50).toDF("x", "y", "z").where("x*x + y*y + z*z BETWEEN 400 AND 2400 AND z > 0")
    return spark.createDataFrame([(survey.survey_volume(ball, 16),)], "volume double")


def _walk_inputs(spark):
    radii = [float(r) for r in np.geomspace(40.0, 4.0, 24)]
    df = spark.createDataFrame([(r,) for r in radii], "radius double")
    found = {(r["i"], r["j"]): r["s"] for r in theory.covariance(tables.spectrum(spark), df).collect()}
    n = len(radii)
    cov = np.array([[found[max(i, j), min(i, j)] for j in range(n)] for i in range(n)])[::-1, ::-1]
    sigma = np.sqrt(np.diag(cov))
    return radii, cov, -0.096 * (1 + (1.15 / sigma) ** 0.43) * 5


@query
def first_crossings(spark, sf_dir):
    radii, cov, barrier = _walk_inputs(spark)
    return numeric.crossing_multiplicity(numeric.first_crossing_counts(spark, cov, barrier, 40_000, seed=1), radii, 40_000)


@query
def up_crossings(spark, sf_dir):
    radii, cov, barrier = _walk_inputs(spark)
    df = spark.createDataFrame([(r,) for r in radii], "radius double")
    got = {r["radius"]: r for r in theory.derivative_variance(tables.spectrum(spark), df).collect()}
    r, f = numeric.up_crossing_multiplicity(radii, [got[x]["variance"] for x in radii], [got[x]["slope_variance"] for x in radii], barrier)
    return spark.createDataFrame([(float(a), float(b)) for a, b in zip(r, f)], "radius double, f double")


@query
def spherical_evolution(spark, sf_dir):
    d = spark.range(1, 15).select((F.col("id") * -0.2).alias("delta"))
    return d.select("delta", numeric.spherical_map_nonlinear(F.col("delta"), "eds").alias("eds"), numeric.spherical_map_nonlinear(F.col("delta"), "lcdm").alias("lcdm"))


@query
def peak_function_exact(spark, sf_dir):
    w = spark.range(12).select((F.col("id") * 0.5 - 1).alias("w"))
    return w.select("w", numeric.peak_g_exact(F.lit(0.6), F.col("w")).alias("exact"), theory.peak_g(F.lit(0.6), F.col("w")).alias("fitted"))


@query
def moving_barrier_abundance(spark, sf_dir):
    return numeric.moving_barrier_size_function(tables.spectrum(spark), list(_RADII))


@query
def linspace_sums(spark, sf_dir):
    from .functions import arrays

    return _rounded(arrays.reduce(arrays.linspace(spark, -2.0, 7.0, 91)))


sql("linspace_sums", "SELECT round(sum(v), 6) + 0.0e0 AS sum, min(v) AS min, max(v) AS max FROM (SELECT -2.0e0 + i*0.1e0 AS v FROM range(90) t(i) UNION ALL SELECT 7.0e0)")


@query
def streamed_size_counts(spark, sf_dir):
    """The same counts as a batch query, from a stream of the part table's file."""
    import uuid

    from .core import shared_folder
    from .streaming import incremental

    parts = tables.table(spark, sf_dir, "part")
    stream = spark.readStream.schema(parts.schema).option("pathGlobFilter", "part.parquet").parquet(sf_dir).selectExpr("5.0e0 + p_size/5.0e0 AS r")
    name = f"sizes_{uuid.uuid4().hex}"
    return incremental.run_to_table(incremental.stream_size_counts(stream, 5.0, 16.0, 8), name, f"{shared_folder(spark)}/{name}")


sql("streamed_size_counts", "SELECT least(floor((ln(r) - ln(5.0e0))*(8/(ln(16.0e0) - ln(5.0e0)))), 7)::INT AS bin, count(*) AS counts FROM (SELECT 5.0e0 + p_size/5.0e0 AS r FROM part) WHERE r BETWEEN 5 AND 16 GROUP BY 1")


@query
def joined_prior(spark, sf_dir):
    """A prior catalogue in front, unchanged, and what doesn't collide with it behind."""
    v = tables.voids(spark, sf_dir)
    prior = v.where("void_id % 5 = 0")
    rest = overlap.without_collisions(v.where("void_id % 5 <> 0"), prior, BOX, 0.2, 14.0)
    return prior.select("void_id", F.lit(0).alias("part")).unionByName(rest.select("void_id", F.lit(1).alias("part")))


sql("joined_prior", f"WITH {VO} SELECT void_id, 0 AS part FROM vo WHERE void_id % 5 = 0 UNION ALL SELECT a.void_id, 1 FROM vo a WHERE a.void_id % 5 <> 0 AND NOT EXISTS (SELECT 1 FROM vo b WHERE b.void_id % 5 = 0 AND {_HIT('0.2e0')})")


@query
def weight_check(spark, sf_dir):
    tr = _points(spark, sf_dir)
    rows.check_weights(tr)
    return tr.agg(F.sum("w").alias("w"), F.count("*").alias("n"))


sql("weight_check", f"WITH {TR} SELECT sum(w) AS w, count(*) AS n FROM tr")


@query
def sky_catalogue(spark, sf_dir):
    from .api import Catalogue

    v = Catalogue(tables.voids(spark, sf_dir), BOX).to_sky(observer=(50.0, 50.0, -2000.0))
    return _rounded(v.to_cartesian(observer=(50.0, 50.0, -2000.0)).df, 3)


sql("sky_catalogue", f"WITH {VO} SELECT void_id, round(cx, 3) + 0.0e0 AS cx, round(cy, 3) + 0.0e0 AS cy, round(cz, 3) + 0.0e0 AS cz, round(r, 3) + 0.0e0 AS r FROM vo")


@query
def streamed_daily_values(spark, sf_dir):
    """A histogram of event values by day, from a stream of the events table's file, with a watermark."""
    import uuid

    from .core import shared_folder
    from .streaming import incremental

    events = tables.table(spark, sf_dir, "events")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).select(F.col("ts").cast("timestamp").alias("ts"), "value")
    name = f"values_{uuid.uuid4().hex}"
    counts = incremental.stream_windowed_counts(stream, "ts", "1 day", "2 days", "value", 0.0, 500.0, 5)
    return incremental.run_to_table(counts, name, f"{shared_folder(spark)}/{name}").select(F.unix_timestamp("start").alias("start"), "bin", "counts")


sql("streamed_daily_values", "SELECT epoch(date_trunc('day', ts))::BIGINT AS start, least(floor(value*(5/500.0e0)), 4)::INT AS bin, count(*) AS counts FROM events WHERE value BETWEEN 0 AND 500 GROUP BY 1, 2")


@query
def unoccupied_footprint(spark, sf_dir):
    """Voids by observed share of their sphere: the cut that a caller makes on the footprint columns."""
    found = _Q["survey_footprints"](spark, sf_dir)
    return found.where("footprint >= 0.5").select("void_id", "footprint")


sql("unoccupied_footprint", "SELECT void_id, footprint FROM (" + _SQL["survey_footprints"] + ") WHERE footprint >= 0.5")


@query
def histogram_edges(spark, sf_dir):
    """Rows on the edges of bins: the top edge belongs to the last one, what lies outside to none."""
    values = spark.range(-2, 23).select((F.col("id") * 0.5).alias("v"))
    return _rounded(measure.distribution(values, "v", 0.0, 10.0, 4), 9)


sql("histogram_edges", "WITH v AS (SELECT i*0.5e0 AS v FROM range(-2, 23) t(i)), h AS (SELECT least(floor(v*0.4e0), 3)::INT AS bin, count(*) AS n FROM v WHERE v BETWEEN 0 AND 10 GROUP BY 1) SELECT i::INT AS bin, round(i*2.5e0, 9) AS lo, round((i + 1)*2.5e0, 9) AS hi, coalesce(n, 0)::BIGINT AS n, round(coalesce(n, 0)/(25*2.5e0), 9) + 0.0e0 AS pdf FROM range(4) t(i) LEFT JOIN h ON h.bin = i")


@query
def nonlinear_thresholds(spark, sf_dir):
    """The linear threshold, Lagrangian radius and barrier that belong to non-linear thresholds."""
    d = spark.range(1, 10).select((F.col("id") / -10.0).alias("delta"))
    linear = theory.nonlinear_to_linear(F.col("delta"))
    return _rounded(d.select("delta", linear.alias("linear"), (8.0 * F.pow(1 + F.col("delta"), F.lit(1 / 3))).alias("radius")))


sql("nonlinear_thresholds", "SELECT i/-10.0e0 AS delta, round(1.594e0*(1 - pow(1 - i/10.0e0, -1/1.594e0)), 6) + 0.0e0 AS linear, round(8*pow(1 - i/10.0e0, 1/3.0e0), 6) + 0.0e0 AS radius FROM range(1, 10) t(i)")


@query
def derivative_variances(spark, sf_dir):
    return _rounded(theory.derivative_variance(tables.spectrum(spark), _radii(spark), gaussian=True), 7)


sql("derivative_variances", f"WITH {_PK}, {_RA}, {_WT} SELECT radius, round(sum(weight*pow(k, 3)*pk*exp(-k*k*radius*radius))/({2 * math.pi**2!r}), 7) + 0.0e0 AS variance, round(sum(weight*pow(k, 3)*pk*pow(k*k*radius*exp(-0.5e0*k*k*radius*radius), 2))/({2 * math.pi**2!r}), 7) + 0.0e0 AS slope_variance FROM wt, ra GROUP BY radius")


@query
def high_k_tally(spark, sf_dir):
    """Radii at which the spectrum's upper half carries more than a ten-thousandth of a moment."""
    m = theory.moments(tables.spectrum(spark), _radii(spark))
    return _rounded(rows.tally(m, F.col("high_k_fraction") > 1e-4, worst=F.col("high_k_fraction")))


sql("high_k_tally", f"WITH {_PK}, {_RA}, {_MOMENTS} SELECT count(*) AS n, min(radius) AS r_min, max(radius) AS r_max, round(max(high_k_fraction), 6) + 0.0e0 AS worst FROM mo WHERE high_k_fraction > 1e-4")


@query
def peak_density_exact(spark, sf_dir):
    shapes = theory.peak_shape(theory.moments(tables.spectrum(spark), _radii(spark)))
    return theory.peak_density_above(shapes, -0.5, 256, numeric.peak_g_exact)
