"""The library by nouns: tracer fields, grids, catalogues, and the finders and measurements on them.

Objects wrap lazy DataFrames and know their units and box. Every spatial operation refuses positions on the sky.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .core import CatalogueError, GridSpec, cells_from_size, finder_mesh_cells, materialise, profile_mesh_cells, require, shared_folder
from .functions import theory
from .operators import assignment, measure, rows, smoothing, survey, tessellation
from .plans import finders

#: Settings of the session; those that steer threads and buffers elsewhere have no meaning here.
_settings: dict = {"grid_cache": False, "log_level": "info"}


def set_setting(key: str, value) -> None:
    require(key in _settings, f"unknown setting {key}; there are {', '.join(_settings)}")
    require(type(value) is type(_settings[key]), f"{key} takes a {type(_settings[key]).__name__}")
    _settings[key] = value


def get_setting(key: str):
    require(key in _settings, f"unknown setting {key}")
    return _settings[key]


@dataclass(frozen=True)
class Field:
    """Tracers: idx, x, y, z and, if present, vx, vy, vz and w; on the sky ra, dec, z instead of x, y, z."""

    df: DataFrame
    box: float | None = None
    units: str = "cartesian"

    @classmethod
    def from_numpy(cls, spark: SparkSession, positions, weights=None, velocities=None, box=None, units="cartesian") -> Field:
        p = np.asarray(positions, float)
        names = ["x", "y", "z"] if units == "cartesian" else ["ra", "dec", "z"]
        table = {"idx": np.arange(len(p))} | {c: p[:, i] for i, c in enumerate(names)}
        if velocities is not None:
            table |= {c: np.asarray(velocities, float)[:, i] for i, c in enumerate(("vx", "vy", "vz"))}
        if weights is not None:
            table["w"] = np.asarray(weights, float)
        import pyarrow as pa

        return cls(spark.createDataFrame(pa.table(table)), box, units)

    def to_numpy(self) -> dict[str, np.ndarray]:
        return {c: v.to_numpy() for c, v in zip(self.df.columns, self.df.orderBy("idx").toArrow().columns)}

    @property
    def weight(self) -> str | None:
        return "w" if "w" in self.df.columns else None

    @property
    def has_velocities(self) -> bool:
        return "vx" in self.df.columns

    def spatial(self) -> Field:
        if self.units != "cartesian":
            raise CatalogueError("positions on the sky must be converted first")
        return self

    def count(self) -> int:
        return self.df.count()

    def wrap(self) -> Field:
        return replace(self.spatial(), df=rows.wrap_periodic(self.df, self.box))

    def translate(self, offset) -> Field:
        return replace(self, df=rows.translate(self.df, offset, units=self.units))

    def bounds(self) -> DataFrame:
        return rows.bounds(self.spatial().df)

    def sort_morton(self) -> Field:
        """Laid out along the Morton curve; idx stays what it was."""
        b = self.bounds().first()
        coded = rows.morton(self.df, [b[f"{c}_min"] for c in "xyz"], [b[f"{c}_max"] for c in "xyz"])
        return replace(self, df=coded.repartitionByRange("morton").sortWithinPartitions("morton", "idx").drop("morton"))

    def convert_sky_coordinates(self, observer=(0.0, 0.0, 0.0), **cosmology) -> Field:
        require(self.units == "sky", "the positions aren't on the sky")
        return replace(self, df=theory.sky_to_cartesian(self.df, observer, **cosmology), units="cartesian")

    def relabel(self, units: str) -> Field:
        require(units in ("cartesian", "sky"), f"unknown units {units}")
        return replace(self, units=units)


@dataclass(frozen=True)
class Grid:
    """ix, iy, iz, value on all nodes; content: "density" or "density contrast"."""

    df: DataFrame
    spec: GridSpec
    content: str = "density"
    assignment: str | None = None
    interlaced: bool = False

    @classmethod
    def assign(cls, tracers: Field, n: int, scheme: str = "cic", interlaced: bool = False) -> Grid:
        tracers.spatial()
        spec, df = GridSpec(n, tracers.box), tracers.df
        if tracers.weight:
            rows.check_weights(df)
        made = lambda: assignment.dense(assignment.deposit(df, spec, scheme, tracers.weight), spec)
        if interlaced:
            grid = smoothing.interlace(assignment.deposit(df, spec, scheme, tracers.weight), assignment.deposit(df, spec, scheme, tracers.weight, 0.5), spec)
        elif _settings["grid_cache"]:
            grid = cached(df, {"n": n, "box": tracers.box, "scheme": scheme}, made)
        else:
            grid = made()
        return cls(grid, spec, "density", scheme, interlaced)

    @classmethod
    def assign_tessellation(cls, samples: DataFrame, n: int, box: float) -> Grid:
        """The weighted samples of a tessellation, by cloud in cell."""
        spec = GridSpec(n, box)
        return cls(assignment.dense(assignment.deposit(samples, spec, "cic", "w"), spec), spec, "density", "cic")

    def to_density_contrast(self) -> Grid:
        require(self.content == "density", "the grid holds contrasts already")
        return replace(self, df=rows.contrast(self.df), content="density contrast")


def cached(df: DataFrame, params: dict, make) -> DataFrame:
    """make()'s table from the shared folder, if one was made of rows with the same content and the same parameters."""
    import hashlib
    import json

    key = df.agg(F.count("*"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first()
    name = hashlib.sha256(json.dumps([list(map(str, key)), params, df.columns], sort_keys=True).encode()).hexdigest()[:32]
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lacuna-cache-{name}"
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    if not jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jpath):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@dataclass(frozen=True)
class Catalogue:
    """Voids: void_id, cx, cy, cz, r, perhaps footprints; and metadata."""

    df: DataFrame
    box: float | None = None
    units: str = "cartesian"
    metadata: dict = field(default_factory=dict)

    @classmethod
    def from_numpy(cls, spark: SparkSession, centres, radii, box=None) -> Catalogue:
        c = np.asarray(centres, float)
        data = [(i, *map(float, p), float(r)) for i, (p, r) in enumerate(zip(c, radii))]
        return cls(spark.createDataFrame(data, finders.VOIDS), box)

    def to_numpy(self) -> dict[str, np.ndarray]:
        return {c: v.to_numpy() for c, v in zip(self.df.columns, self.df.orderBy("void_id").toArrow().columns)}

    def translate(self, offset) -> Catalogue:
        return replace(self, df=rows.translate(self.df, offset, ("cx", "cy", "cz"), self.units))

    def to_sky(self, observer=(0.0, 0.0, 0.0), **cosmology) -> Catalogue:
        require(self.units == "cartesian", "the catalogue is on the sky already")
        named = self.df.withColumnsRenamed({"cx": "x", "cy": "y", "cz": "z"})
        sky = theory.cartesian_to_sky(named, observer, **cosmology).drop("x", "y", "z").withColumnsRenamed({"ra": "cx", "dec": "cy", "redshift": "cz"})
        return replace(self, df=sky.select(*self.df.columns), units="sky")

    def to_cartesian(self, observer=(0.0, 0.0, 0.0), **cosmology) -> Catalogue:
        require(self.units == "sky", "the catalogue isn't on the sky")
        named = self.df.withColumnsRenamed({"cx": "ra", "cy": "dec", "cz": "z"})
        flat = theory.sky_to_cartesian(named, observer, **cosmology).withColumnsRenamed({"x": "cx", "y": "cy", "z": "cz"})
        return replace(self, df=flat.select(*self.df.columns), units="cartesian")

    def set_metadata(self, **values) -> Catalogue:
        for k, v in values.items():
            require(isinstance(v, (int, float, str)) and not isinstance(v, bool), f"{k} has a value of another kind")
        return replace(self, metadata=self.metadata | {k.lower(): v for k, v in values.items()})

    def size_function(self, n_bins: int, volume: float | None = None, low=0.0, high=0.0, logarithmic=True) -> DataFrame:
        require(volume or self.box, "a size function needs a volume")
        return measure.size_function(self.df, volume or self.box**3, n_bins, low, high, logarithmic)

    def profiles(self, tracers: Field, n_bins: int, extent: float, cumulative: bool = True, velocity: bool = False, weighted_velocity: bool = False, periodic: bool = True) -> DataFrame:
        require(self.units == "cartesian", "profiles need cartesian centres")
        require(not velocity or tracers.has_velocities, "the tracers have no velocities")
        tr = materialise(tracers.spatial().df)
        total = tr.agg(F.sum("w") if tracers.weight else F.count("*").cast("double")).first()[0] or 0.0
        most = self.df.agg(F.max("r")).first()[0] or 1.0
        return measure.profiles(self.df, tr, tracers.box, n_bins, extent, total / tracers.box**3, most, cumulative, tracers.weight, velocity, weighted_velocity, periodic)

    def check(self) -> DataFrame:
        return rows.check_catalogue(self.df, self.box, self.units == "sky")

    def mismatches(self, rung: str = "rung") -> DataFrame:
        """How many voids grew to more than twice the radius they were found at, and the largest ratio."""
        ratio = F.col("r") / F.col(rung)
        return self.df.agg(F.count_if(ratio > 2).alias("n"), F.max(ratio).alias("worst"))


def spherical(grid: Grid, radii, threshold=-0.7, overlap_fraction=0.0) -> Catalogue:
    require(grid.content == "density contrast", "the finder needs contrasts")
    return Catalogue(finders.spherical_finder(grid.df, grid.spec, list(radii), threshold, overlap_fraction, grid.assignment), grid.spec.box)


def find_voids(grid: Grid, tracers: Field, radii, threshold=-0.7, variant: str | finders.Settings = "excursion-set", prior: Catalogue | None = None, checkpoint: str | None = None) -> Catalogue:
    require(grid.content == "density contrast", "the finder needs contrasts")
    require(grid.spec.box == tracers.spatial().box, "grid and tracers have different boxes")
    found = finders.tracer_finder(grid.df, tracers.df, grid.spec, list(radii), threshold, variant, tracers.weight, prior=prior.df if prior else None, checkpoint=checkpoint)
    return Catalogue(found, grid.spec.box, metadata={"threshold": threshold})


def find_survey_voids(data: Field, randoms: Field, n: int, radii, threshold=-0.7, search_factor=2.0) -> Catalogue:
    """Voids of a survey in its own coordinates: the box around it is made and undone here."""
    box, offset = survey.survey_box(randoms.spatial().df, max(radii), min(radii), search_factor)
    found = finders.survey_finder(rows.translate(data.spatial().df, offset), rows.translate(randoms.df, offset), GridSpec(n, box), list(radii), threshold, weight=data.weight or randoms.weight)
    return Catalogue(rows.translate(found, tuple(-o for o in offset), ("cx", "cy", "cz")), box)


def tessellate(tracers: Field, per_tracer: int = 32, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    return tessellation.tessellate(tracers.spatial().df, tracers.box, per_tracer, seed=seed)


grid_cells_from_size, suggest_mesh_cells, suggest_profile_cells = cells_from_size, finder_mesh_cells, profile_mesh_cells
