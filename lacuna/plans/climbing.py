"""The hill refinement: centres climb in crossing radius."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..core import GridSpec, materialise
from ..operators.crossing import Crossings, crossing_radius
from ..operators.spatial import cell_key, cell_of, image, reached_cells

_AXES = [(s * (a == 0), s * (a == 1), s * (a == 2)) for a in range(3) for s in (1, -1)]
_AROUND = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1) if (i, j, k) != (0, 0, 0)]
# Centres that climb in one task, how many tracers around them it may hold, and how many are few.
CLIMBERS, CROWD, FEW = 64, 1 << 24, 1 << 21


def climb(voids: DataFrame, tracers: DataFrame, spec: GridSpec, density: float, threshold: float, least: float, reach: float, rounds: int = 1000) -> DataFrame:
    """Centres moved uphill in crossing radius: six steps along the axes a round, from a tenth of the radius down to a hundredth.

    From a climb's end follows the search for a better peak: the best of 26 probes at 0.3 of the radius, and a climb from
    it, which is kept if it ends 0.1 % higher; up to three times. A centre that ends further than half its first radius
    away goes back. Each centre has its own state; rounds is a bound that raises. Centres without a column r get their
    crossing radius first, and those that have none are dropped.

    Neighbouring centres climb to their ends in one task, among the tracers around them; one that gets where these don't
    tell its radius is dealt anew from there. Where a task would hold too many tracers, every round is a plan.
    """
    sized = "r" in voids.columns
    rows = materialise(_begun(voids if sized else voids.withColumn("r", F.lit(None).cast("double"))))
    args = (tracers, spec, density, threshold, least, reach, rounds)
    # Probes are at most 0.3 of a radius away: within wide every centre gets on. Few ever leave 1.5 radii.
    most = max(reach, rows.agg(F.max("r")).first()[0] or 0.0)
    wide = reach + 0.31 * most

    def expected(halo):
        return density * 4 / 3 * math.pi * (halo + reach / 4) ** 3

    if expected(wide) > CROWD:
        if not sized:
            got = crossing_radius(voids, tracers, spec.box, density, threshold, F.lit(least), F.lit(reach), reach)
            rows = _begun(voids.join(got.where("radius IS NOT NULL").select("void_id", F.col("radius").alias("r")), "void_id"))
        ended = _in_plans(rows, *args)
    else:
        halo, ended = 1.5 * most if expected(1.5 * most) <= FEW else 1.01 * reach, None
        climbing = ~F.col("mode").isin("done", "none") & (F.col("rounds") < rounds)
        while ended is None or not rows.isEmpty():
            rows = materialise(_in_tasks(rows, *args, halo))
            now = rows.where(~climbing)
            ended = now if ended is None else ended.unionByName(now)
            rows, halo = rows.where(climbing), max(halo, wide)
    ended = ended.where("mode <> 'none'")
    if not ended.where("mode <> 'done'").isEmpty():
        raise RuntimeError(f"the climb did not settle in {rounds} rounds")
    away = F.sqrt(sum((image(F.col(f"k{c}") - F.col(f"{c}0"), spec.box) ** 2 for c in "xyz"), F.lit(0.0)))
    back = away > 0.5 * F.col("r0")
    return ended.select("void_id", *[F.when(back, F.col(f"{c}0")).otherwise(F.col(f"k{c}")).alias(f"c{c}") for c in "xyz"], "depth", F.when(back, F.col("r0")).otherwise(F.col("kr")).alias("r"))


def _begun(voids: DataFrame) -> DataFrame:
    # kx, ky, kz, kr: the last peak kept; sx, sy, sz, base: where the climb began; search: how many searches did.
    start = {f"{p}{c}": F.col(f"c{c}") for p in "0ks" for c in "xyz"}
    start = {k if k[0] != "0" else f"{k[1]}0": v for k, v in start.items()}
    return voids.withColumns(start | {"r0": F.col("r"), "kr": F.col("r"), "base": F.col("r"), "step": F.lit(0.1), "search": F.lit(0), "mode": F.when(F.col("r").isNull(), "size").otherwise("climb"), "rounds": F.lit(0)})


def _in_tasks(rows: DataFrame, tracers: DataFrame, spec: GridSpec, density: float, threshold: float, least: float, reach: float, rounds: int, halo: float) -> DataFrame:
    """rows as far as the tracers within halo of where they are take them."""
    box, schema = spec.box, rows.schema
    blocks, cells = (max(1, min(512, int(k * box / reach))) for k in (4, 6))
    wrapped = {f"__w{c}": F.pmod(f"c{c}", F.lit(box)) for c in "xyz"}
    block = cell_key(*[cell_of(F.col(f"__w{c}"), box / blocks, blocks) for c in "xyz"], blocks)
    turn = F.row_number().over(Window.partitionBy("__block").orderBy("void_id")) - 1
    dealt = materialise(rows.withColumns(wrapped).withColumn("__block", block).withColumn("__part", F.floor(turn / CLIMBERS).cast("int")).drop(*wrapped))
    by = ["__block", "__part"]
    near = materialise(reached_cells(dealt.select(*by, "cx", "cy", "cz"), F.lit(halo), box, cells).select(*by, "__cell").distinct())
    at = cell_key(*[cell_of(F.pmod(c, F.lit(box)), box / cells, cells) for c in "xyz"], cells)
    around = tracers.select("x", "y", "z", at.alias("__cell")).join(near, "__cell").select(*by, "x", "y", "z")
    groups = dealt.select(*by).distinct().count()
    tasks = max(1, min(2000, 8 * groups))

    def settle(a: pa.Table, b: pa.Table) -> pa.Table:
        a = a.select(schema.names)
        if not len(a):
            return a
        anchors, xyz = ([t.column(c).to_numpy().astype(float, copy=False) for c in names] for t, names in ((a, ("cx", "cy", "cz")), (b, ("x", "y", "z"))))
        crossings = Crossings(xyz, anchors, halo, box, density, threshold, reach)
        return pa.Table.from_pylist([_ascend(v, crossings, box, least, rounds) for v in a.to_pylist()], a.schema)

    met = dealt.repartition(tasks, *by).groupBy(*by).cogroup(around.repartition(tasks, *by).groupBy(*by))
    return met.applyInArrow(settle, schema)


def _ascend(v: dict, crossings: Crossings, box: float, least: float, rounds: int) -> dict:
    """A centre's state after the rounds that the tracers at hand allow; those of _in_plans, to the last bit."""
    if v["mode"] == "size":
        r = crossings.radius((v["cx"], v["cy"], v["cz"]), least)
        if r is None:
            return v
        v = v | (dict.fromkeys(("r", "r0", "kr", "base"), r) | {"mode": "climb"} if r else {"mode": "none"})
    while v["mode"] not in ("done", "none") and v["rounds"] < rounds:
        climbing = v["mode"] == "climb"
        dirs, centre, shift = (_AXES, "c", v["step"] * v["base"]) if climbing else (_AROUND, "k", 0.3 * v["kr"])
        # Only a radius beyond the best so far counts; a climb's first is where it is.
        best, at = (v["r"] if climbing else 0.7 * v["kr"]), None
        for d in dirs:
            place = tuple(_wrapped(v[f"{centre}{c}"] + x / sum(y * y for y in d) ** 0.5 * shift, box) for c, x in zip("xyz", d))
            r = crossings.radius(place, best)
            if r is None:
                return v
            if r:
                best, at = r, place
        v = v | {"rounds": v["rounds"] + 1}
        if at:
            v |= {"cx": at[0], "cy": at[1], "cz": at[2], "r": best}
        elif climbing:
            v["step"] /= 2
        if not climbing:
            v |= {"sx": at[0], "sy": at[1], "sz": at[2], "base": best, "step": 0.1, "search": v["search"] + 1, "mode": "climb"} if at else {"mode": "done"}
        elif v["step"] < 0.01:
            # A climb counts if it is the first, or left its start and gained.
            left = any(v[f"c{c}"] != v[f"s{c}"] for c in "xyz")
            keep = v["search"] == 0 or left and v["r"] > 1.001 * v["kr"]
            if keep:
                v |= {"kx": v["cx"], "ky": v["cy"], "kz": v["cz"], "kr": v["r"]}
            v["mode"] = "probe" if keep and v["search"] < 3 else "done"
    return v


def _wrapped(x: float, box: float) -> float:
    x = math.fmod(x, box)
    return math.fmod(x + box, box) if x < 0 else x


def _in_plans(rows: DataFrame, tracers: DataFrame, spec: GridSpec, density: float, threshold: float, least: float, reach: float, rounds: int) -> DataFrame:
    """rows after their rounds, each of which is one plan for all centres."""

    def probes(dirs, centre: str, shift: Column):
        at = [[F.pmod(F.col(f"{centre}{c}") + F.lit(d / sum(x * x for x in v) ** 0.5) * shift, F.lit(spec.box)).alias(f"c{c}") for c, d in zip("xyz", v)] for v in dirs]
        return F.array(*[F.struct(*a, F.lit(i).alias("dir")) for i, a in enumerate(at)])

    climbing, probing = F.col("mode") == "climb", F.col("mode") == "probe"
    for _ in range(rounds):
        rows = materialise(rows)
        active = rows.where("mode <> 'done'")
        if active.isEmpty():
            break
        tries = F.when(climbing, probes(_AXES, "c", F.col("step") * F.col("base"))).otherwise(probes(_AROUND, "k", 0.3 * F.col("kr")))
        # A search may pass below the rung: its probes count from 0.7 of the radius on, its climb from where it is.
        low = F.when(climbing, F.least(F.lit(float(least)), F.col("r"))).otherwise(0.7 * F.col("kr"))
        tried = materialise(active.select("void_id", low.alias("low"), F.explode(tries).alias("t")).select("void_id", "low", "t.*").withColumn("probe", F.col("void_id") * 32 + F.col("dir")))
        got = crossing_radius(tried, tracers, spec.box, density, threshold, F.col("low"), F.lit(reach), reach, key="probe", count_first=False)
        best = tried.join(got.where("radius IS NOT NULL"), "probe").groupBy("void_id").agg(F.max(F.struct("radius", -F.col("dir"), "cx", "cy", "cz")).alias("b"))
        joined = rows.join(best, "void_id", "left").withColumn("up", F.col("b").isNotNull() & F.when(climbing, F.col("b.radius") > F.col("r")).otherwise(probing))
        moved = joined.withColumns({f"c{c}": F.when(F.col("up"), F.col(f"b.c{c}")).otherwise(F.col(f"c{c}")) for c in "xyz"} | {"r": F.when(F.col("up"), F.col("b.radius")).otherwise(F.col("r")), "step": F.when(climbing & ~F.col("up"), F.col("step") / 2).otherwise(F.col("step"))})
        # A climb ends when its step is short; it counts if it is the first, or left its start and gained.
        left = sum(((F.col(f"c{c}") != F.col(f"s{c}")).cast("int") for c in "xyz"), F.lit(0)) > 0
        moved = moved.withColumn("ends", climbing & (F.col("step") < 0.01)).withColumn("keep", F.col("ends") & ((F.col("search") == 0) | (left & (F.col("r") > 1.001 * F.col("kr")))))
        kept = {f"k{c}": F.when(F.col("keep"), F.col(f"c{c}")).otherwise(F.col(f"k{c}")) for c in "xyz"} | {"kr": F.when(F.col("keep"), F.col("r")).otherwise(F.col("kr"))}
        again = probing & F.col("up")
        begun = {f"s{c}": F.when(again, F.col(f"c{c}")).otherwise(F.col(f"s{c}")) for c in "xyz"} | {"base": F.when(again, F.col("r")).otherwise(F.col("base")), "step": F.when(again, 0.1).otherwise(F.col("step")), "search": F.col("search") + again.cast("int")}
        mode = F.when(again, "climb").when(probing, "done").when(F.col("keep") & (F.col("search") < 3), "probe").when(F.col("ends"), "done").otherwise(F.col("mode"))
        rows = moved.withColumns(kept | begun | {"mode": mode}).drop("b", "up", "ends", "keep")
    return rows
