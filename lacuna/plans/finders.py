"""Void finders: a ladder of radii, from large to small, each rung one plan of smoothing, candidates and acceptance."""

from __future__ import annotations

import json
import logging
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import CatalogueError, GridSpec, materialise, require
from ..operators.assignment import local_minima, trilinear
from ..operators.crossing import crossing_radius, survey_crossing_radius
from ..operators.overlap import accept_in_order, accept_with_displacement, without_collisions
from ..operators.rows import check_weights
from ..operators.smoothing import smooth
from .climbing import climb

log = logging.getLogger("lacuna.finders")
VOIDS = "void_id long, cx double, cy double, cz double, r double"


@dataclass(frozen=True)
class Settings:
    """How tracer_finder() works; the presets are in VARIANTS."""

    overlap_fraction: float = 0.0
    overlap_scale: float = 1.0
    seeds: str = "cells"
    refine: str = "none"
    extend_reach: bool = False
    displace: bool = False
    search_factor: float = 2.0
    scheme: str | None = "cic"
    deconvolve: str = "full"

    def check(self, survey: bool = False) -> None:
        require(0 <= self.overlap_fraction <= 1, f"the overlap fraction is {self.overlap_fraction}")
        require(self.seeds in ("cells", "minima"), f"unknown seeds {self.seeds}")
        require(self.refine in ("none", "gaussian", "tracers", "hill"), f"unknown refinement {self.refine}")
        require(self.search_factor in (1.25, 1.5, 1.75, 2.0), f"the search factor is {self.search_factor}")
        require(self.refine not in ("gaussian", "hill") or self.seeds == "minima" or self.refine == "hill", "the Gaussian refinement needs minima as seeds")
        if survey:
            require(self.seeds == "cells" and self.refine == "none" and not self.extend_reach and not self.displace, "surveys take cells as seeds, without refinement, extension or displacement")


#: Presets; "lagrangian-overlap" shrinks distances by (1 + threshold)^(1/3), which variant() fills in.
VARIANTS = {
    "excursion-set": Settings(),
    "excursion-peak": Settings(overlap_fraction=1.0, seeds="minima", extend_reach=True, displace=True),
    "lagrangian-overlap": Settings(),
}


def variant(name: str, threshold: float) -> Settings:
    require(name in VARIANTS, f"unknown variant {name}; there are {', '.join(VARIANTS)}")
    return replace(VARIANTS[name], overlap_scale=(1 + threshold) ** (1 / 3)) if name == "lagrangian-overlap" else VARIANTS[name]


def check_ladder(radii: list[float], threshold: float) -> list[float]:
    require(bool(radii) and all(r > 0 and r < float("inf") for r in radii), "the radii must be positive and finite")
    require(-1 < threshold < 0, f"the threshold is {threshold}, not between -1 and 0")
    return sorted(set(radii), reverse=True)


def node_candidates(rung: DataFrame, spec: GridSpec, threshold: float) -> DataFrame:
    """void_id (the node's flat index), cx, cy, cz, depth of nodes at or below the threshold."""
    n = spec.n
    low = rung.where(F.col("value") <= threshold)
    return low.select(((F.col("ix").cast("long") * n + F.col("iy")) * n + F.col("iz")).alias("void_id"), *[(F.col(f"i{c}") * F.lit(spec.cell)).alias(f"c{c}") for c in "xyz"], F.col("value").alias("depth"))


def _empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], VOIDS)


def _numbered(voids: DataFrame, start: int, order: str) -> DataFrame:
    """voids with void_id from start on, in order; a rung's accepted voids are few."""
    from pyspark.sql import Window

    return voids.withColumn("__n", F.row_number().over(Window.orderBy(order, "void_id"))).withColumn("void_id", F.col("__n") + F.lit(start - 1)).drop("__n")


def spherical_finder(grid: DataFrame, spec: GridSpec, radii: list[float], threshold: float = -0.7, overlap_fraction: float = 0.0, scheme: str | None = "cic", deconvolve: str = "full") -> DataFrame:
    """void_id, cx, cy, cz, r, depth from a grid of contrasts: nodes whose smoothed contrast is at or below the threshold.

    Nodes are taken from deep to shallow and, at equal depth, by index; a void's radius is its rung.
    """
    spark = grid.sparkSession
    ladder = check_ladder(radii, threshold)
    found, n_found = materialise(_empty(spark).withColumn("depth", F.lit(0.0))), 0
    grid = materialise(grid)
    for r in ladder:
        rung = smooth(grid, spec, [r], scheme=scheme, deconvolve=deconvolve).drop("radius")
        candidates = materialise(node_candidates(rung, spec, threshold).withColumn("r", F.lit(r)))
        if n_found:
            candidates = without_collisions(candidates, found, spec.box, overlap_fraction, ladder[0])
        taken = materialise(accept_in_order(materialise(candidates), "depth", spec.box, overlap_fraction, r).select("void_id", "cx", "cy", "cz", "r", "depth"))
        new = taken.count()
        if new:
            found = materialise(found.unionByName(_numbered(taken, n_found, "depth")))
            n_found += new
    return found


def reach_of(rungs: list[float], i: int, cell: float, factor: float) -> float:
    """How far a rung looks for a crossing: beyond its radius, and at least as far as the rung before."""
    r = rungs[i] + max((factor - 1) * rungs[i], 3 * cell)
    return max(r, rungs[i - 1]) if i else r


def refine_gaussian(minima: DataFrame, rung: DataFrame, spec: GridSpec, threshold: float) -> DataFrame:
    """Minima moved by one Newton step of the smoothed field, by a cell an axis at most; kept in place where its curvature isn't positive."""
    n, h = spec.n, spec.cell
    steps = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1) if abs(i) + abs(j) + abs(k) <= 2]
    near = minima.select("flat", F.explode(F.array(*[F.struct(*[F.pmod(F.col(f"i{c}") + s, F.lit(n)).cast("int").alias(f"i{c}") for c, s in zip("xyz", d)], F.lit(str(d)).alias("at")) for d in steps])).alias("q")).select("flat", "q.*")
    values = near.join(rung, ["ix", "iy", "iz"]).groupBy("flat").agg(*[F.max(F.when(F.col("at") == str(d), F.col("value"))).alias(str(d)) for d in steps])

    def v(*d):
        return F.col(f"`{d}`")

    g = [(v(*[int(a == b) for b in range(3)]) - v(*[-int(a == b) for b in range(3)])) / 2 for a in range(3)]
    hess = [[None] * 3 for _ in range(3)]
    for a in range(3):
        for b in range(3):
            if a == b:
                hess[a][b] = v(*[int(a == c) for c in range(3)]) + v(*[-int(a == c) for c in range(3)]) - 2 * v(0, 0, 0)
            else:
                def corner(s, t, a=a, b=b):
                    return v(*[s if c == a else t if c == b else 0 for c in range(3)])

                hess[a][b] = (corner(1, 1) - corner(1, -1) - corner(-1, 1) + corner(-1, -1)) / 4
    minor = hess[0][0] * hess[1][1] - hess[0][1] * hess[0][1]
    det = hess[0][0] * (hess[1][1] * hess[2][2] - hess[1][2] * hess[1][2]) - hess[0][1] * (hess[0][1] * hess[2][2] - hess[1][2] * hess[0][2]) + hess[0][2] * (hess[0][1] * hess[1][2] - hess[1][1] * hess[0][2])

    def cofactor(a, b):
        r = [x for x in range(3) if x != a]
        c = [x for x in range(3) if x != b]
        return (hess[r[0]][c[0]] * hess[r[1]][c[1]] - hess[r[0]][c[1]] * hess[r[1]][c[0]]) * (-1) ** (a + b)

    ok = (hess[0][0] > 0) & (minor > 0) & (det > 0)
    moved = []
    for a in range(3):
        s = -sum((cofactor(a, b) * g[b] for b in range(3)), F.lit(0.0)) / det
        moved.append(F.when(ok, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), s))).otherwise(0.0).alias(f"s{'xyz'[a]}"))
    return minima.join(values.select("flat", *moved), "flat").select(F.col("flat").alias("void_id"), *[F.pmod((F.col(f"i{c}") + F.coalesce(F.col(f"s{c}"), F.lit(0.0))) * F.lit(h), F.lit(spec.box)).alias(f"c{c}") for c in "xyz"], F.col("value").alias("depth"))


def candidates_of(rung: DataFrame, tracers: DataFrame, spec: GridSpec, threshold: float, settings: Settings, key: str) -> DataFrame:
    """void_id, cx, cy, cz, depth of a rung's candidates by the seeds and refinement asked for."""
    if settings.refine == "tracers" and settings.seeds == "cells":
        at = trilinear(tracers.select(key, "x", "y", "z"), rung, spec, key).where(F.col("value") <= threshold)
        return tracers.join(at, key).select(F.col(key).alias("void_id"), F.col("x").alias("cx"), F.col("y").alias("cy"), F.col("z").alias("cz"), F.col("value").alias("depth"))
    if settings.seeds == "cells":
        return node_candidates(rung, spec, threshold)
    minima = local_minima(rung, spec, threshold)
    if settings.refine == "gaussian":
        return refine_gaussian(minima, rung, spec, threshold)
    on_nodes = node_candidates(minima.drop("flat"), spec, threshold)
    if settings.refine == "tracers":
        from ..operators.spatial import nearest

        snapped = nearest(materialise(on_nodes), tracers, spec.box, "void_id", key, max(1, spec.n // 4)).select(key).distinct()
        at = trilinear(tracers.join(snapped, key).select(key, "x", "y", "z"), rung, spec, key).where(F.col("value") <= threshold)
        return tracers.join(at, key).select(F.col(key).alias("void_id"), F.col("x").alias("cx"), F.col("y").alias("cy"), F.col("z").alias("cz"), F.col("value").alias("depth"))
    return on_nodes


@dataclass
class Checkpoint:
    """A finder's state after a rung: the folder has voids as Parquet and state.json, replaced as one by a rename of its name."""

    folder: str | None
    params: dict = field(default_factory=dict)

    def _fs(self, spark):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path

    def write(self, spark: SparkSession, voids: DataFrame, rung: int) -> None:
        if not self.folder:
            return
        voids.write.mode("overwrite").parquet(f"{self.folder}/voids-{rung}")
        spark.createDataFrame([(json.dumps({"rung": rung, "params": self.params}),)], "state string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/state-{rung}")

    def read(self, spark: SparkSession) -> tuple[DataFrame, int] | None:
        """The voids and the first rung to do, if a run with the same parameters has left any."""
        if not self.folder:
            return None
        fs, path = self._fs(spark)
        if not fs.exists(path):
            return None
        rungs = [int(s.getPath().getName().split("-")[1]) for s in fs.listStatus(path) if s.getPath().getName().startswith("state-")]
        Path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        rungs = [r for r in rungs if fs.exists(Path(f"{self.folder}/state-{r}/_SUCCESS"))]
        if not rungs:
            return None
        last = max(rungs)
        state = json.loads(spark.read.text(f"{self.folder}/state-{last}").first()[0])
        if state["params"] != self.params:
            raise CatalogueError("the checkpoint was made with other parameters")
        return spark.read.parquet(f"{self.folder}/voids-{last}"), last + 1

    def remove(self, spark: SparkSession) -> None:
        if self.folder:
            fs, path = self._fs(spark)
            fs.delete(path, True)


def tracer_finder(grid: DataFrame, tracers: DataFrame, spec: GridSpec, radii: list[float], threshold: float = -0.7, settings: Settings | str = "excursion-set", weight: str | None = None, key: str = "idx", prior: DataFrame | None = None, checkpoint: str | None = None, keep_checkpoint: bool = False) -> DataFrame:
    """void_id, cx, cy, cz, r, depth: candidates of the smoothed grid, each resized to the crossing radius of its tracers.

    grid: contrasts at nodes. tracers: key, x, y, z and the weight. prior: voids that stand before all others, unchanged.
    Rungs go from large to small. Candidates that would collide at the rung's radius are dropped before their radius is
    sought, which changes nothing in the result, as collisions only grow with the radius.
    """
    s = variant(settings, threshold) if isinstance(settings, str) else settings
    s.check()
    require(not (s.refine == "hill" and weight), "the hill refinement takes no weights")
    spark, ladder = grid.sparkSession, check_ladder(radii, threshold)
    if weight:
        check_weights(tracers, weight)
    tracers = materialise(tracers)
    total = tracers.agg(F.sum(weight) if weight else F.count("*").cast("double")).first()[0] or 0.0
    density = total / spec.box**3
    state = Checkpoint(checkpoint, {"radii": ladder, "threshold": threshold, "n": spec.n, "box": spec.box, "settings": asdict(s)})
    found, first = None, 0
    if resumed := state.read(spark):
        found, first = materialise(resumed[0]), resumed[1]
    if found is None:
        found = _empty(spark).withColumn("depth", F.lit(None).cast("double"))
        if prior is not None:
            from pyspark.sql import Window

            found = prior.select("cx", "cy", "cz", "r", F.lit(None).cast("double").alias("depth"), (F.row_number().over(Window.orderBy(F.col("r").desc(), "cx", "cy", "cz")) - 1).cast("long").alias("void_id")).select("void_id", "cx", "cy", "cz", "r", "depth")
        found = materialise(found)
    grid = materialise(grid)
    for i in range(first, len(ladder)):
        r = ladder[i]
        rung = materialise(smooth(grid, spec, [r], scheme=s.scheme, deconvolve=s.deconvolve, extra=0.15 if s.refine == "gaussian" else 0.0).drop("radius"))
        candidates = materialise(candidates_of(rung, tracers, spec, threshold, s, key).withColumn("r", F.lit(r)))
        n_found, largest = found.agg(F.count("*"), F.max("r")).first()
        if n_found and s.seeds == "cells" and not s.displace:
            candidates = materialise(without_collisions(candidates, found, spec.box, s.overlap_fraction, max(largest, r), s.overlap_scale))
        reach = reach_of(ladder, i, spec.cell, s.search_factor)
        if s.refine == "hill" and not s.extend_reach:
            sized = candidates.drop("r")
        else:
            sized = resize(candidates, tracers, spec, density, threshold, r, reach, ladder[0] * s.search_factor if s.extend_reach else reach, weight)
        sized = materialise(climb(sized, tracers, spec, density, threshold, r, reach) if s.refine == "hill" else sized)
        n, most = sized.agg(F.count("*"), F.max("r")).first()
        log.info("rung %g: %d voids so far, %d resized candidates up to %s", r, n_found, n, most)
        if n and most > 2 * r:
            log.warning("rung %g: a candidate grew to %g", r, most)
        if n:
            most = max(most, largest or 0)
            if s.displace:
                kept = accept_with_displacement(sized.withColumn("void_id", -1 - F.col("void_id")), found, "depth", spec.box, s.overlap_fraction, s.overlap_scale)
                old = kept.where("void_id >= 0")
                new = kept.where("void_id < 0").withColumn("void_id", -1 - F.col("void_id"))
                found = materialise(old.unionByName(_numbered(new, (found.agg(F.max("void_id")).first()[0] or 0) + 1 if n_found else 0, "depth")))
            else:
                if n_found:
                    sized = materialise(without_collisions(sized, found, spec.box, s.overlap_fraction, most, s.overlap_scale))
                new = accept_in_order(sized, "depth", spec.box, s.overlap_fraction, most, s.overlap_scale).select("void_id", "cx", "cy", "cz", "r", "depth")
                found = materialise(found.unionByName(_numbered(new, n_found, "depth")))
        state.write(spark, found, i)
    if not keep_checkpoint:
        found = materialise(found)
        state.remove(spark)
    return found


def resize(candidates: DataFrame, tracers: DataFrame, spec: GridSpec, density: float, threshold: float, least: float, reach: float, furthest: float, weight: str | None) -> DataFrame:
    """Candidates with their crossing radius as r; those still underdense at the reach look on in steps of 1.5 up to furthest."""
    done, waiting = None, candidates.drop("r")
    while True:
        got = materialise(crossing_radius(waiting, tracers, spec.box, density, threshold, F.lit(least), F.lit(reach), reach, weight=weight))
        some = waiting.join(got.where("radius IS NOT NULL").select("void_id", F.col("radius").alias("r")), "void_id")
        done = some if done is None else done.unionByName(some)
        if reach >= furthest:
            return done
        waiting = materialise(waiting.join(got.where("reason = 'beyond search'").select("void_id"), "void_id", "left_semi"))
        if waiting.isEmpty():
            return done
        reach = min(reach * 1.5, furthest)


def survey_finder(data: DataFrame, randoms: DataFrame, spec: GridSpec, radii: list[float], threshold: float = -0.7, settings: Settings | str = "excursion-set", weight: str | None = None) -> DataFrame:
    """void_id, cx, cy, cz, r, depth, footprint, footprint_shell in a survey whose data and randoms lie in the box of spec.

    weight: a column of data, randoms or both; a table that lacks it counts by ones. The footprint is where randoms are,
    whatever their weight.
    """
    from ..operators.survey import close, closing_steps, footprint_fractions, occupied, survey_contrast

    s = variant(settings, threshold) if isinstance(settings, str) else settings
    s.check(survey=True)
    ladder = check_ladder(radii, threshold)
    spark, data, randoms = data.sparkSession, materialise(data), materialise(randoms)
    n_data, n_randoms = data.count(), randoms.count()
    require(n_data > 0 and n_randoms > 0, "a survey needs data and randoms")
    require(weight is None or weight in data.columns or weight in randoms.columns, f"neither data nor randoms have a column {weight}")
    sums, columns = [float(n_data), float(n_randoms)], [None, None]
    for k, tracers in enumerate((data, randoms)):
        if weight and weight in tracers.columns:
            check_weights(tracers, weight)
            sums[k], columns[k] = float(tracers.agg(F.sum(weight)).first()[0]), weight
    alpha = sums[0] / sums[1]
    nodes = materialise(occupied(randoms, spec))
    nodes = materialise(close(nodes, closing_steps(n_randoms, nodes.count()), spec))
    grid = materialise(survey_contrast(data, randoms, spec, alpha, s.scheme or "cic", nodes, *columns))
    found = materialise(_empty(spark).withColumn("depth", F.lit(0.0)))
    for i, r in enumerate(ladder):
        rung = smooth(grid, spec, [r], scheme=s.scheme, deconvolve=s.deconvolve).drop("radius").join(nodes, ["ix", "iy", "iz"], "left_semi")
        candidates = materialise(node_candidates(rung, spec, threshold).withColumn("r", F.lit(r)))
        n_found, largest = found.agg(F.count("*"), F.max("r")).first()
        if n_found:
            candidates = materialise(without_collisions(candidates, found, spec.box, s.overlap_fraction, max(largest, r), s.overlap_scale, periodic=False))
        reach = reach_of(ladder, i, spec.cell, s.search_factor)
        got = survey_crossing_radius(candidates.drop("r"), data, randoms, spec.box, alpha, threshold, F.lit(r), F.lit(reach), reach, weight=columns[0], random_weight=columns[1])
        sized = materialise(candidates.drop("r").join(got.where("radius IS NOT NULL").select("void_id", F.col("radius").alias("r")), "void_id"))
        n, most = sized.agg(F.count("*"), F.max("r")).first()
        if n:
            most = max(most, largest or 0)
            if n_found:
                sized = materialise(without_collisions(sized, found, spec.box, s.overlap_fraction, most, s.overlap_scale, periodic=False))
            new = accept_in_order(sized, "depth", spec.box, s.overlap_fraction, most, s.overlap_scale, periodic=False).select("void_id", "cx", "cy", "cz", "r", "depth")
            found = materialise(found.unionByName(_numbered(new, n_found, "depth")))
    return found.join(footprint_fractions(found, nodes, spec), "void_id", "left")
