"""Errors, boxes, grids and the shared folder."""

from __future__ import annotations

import atexit
import math
import shutil
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


class CatalogueError(ValueError):
    """Input that an operator refuses."""


@dataclass(frozen=True)
class GridSpec:
    """A cubic grid of n**3 nodes in a box; node i of an axis stands at i * cell."""

    n: int
    box: float

    def __post_init__(self):
        if self.n < 4 or not self.box > 0:
            raise CatalogueError(f"a grid needs 4 cells a side and a positive box, not {self.n} and {self.box}")

    @property
    def cell(self) -> float:
        return self.box / self.n

    @property
    def total(self) -> int:
        return self.n**3


_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="lacuna-")
            atexit.register(shutil.rmtree, _own[app], True)
        root = "file://" + _own[app]
    return root.rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """Writes df into the shared folder and reads it back: later steps start from the files, on any executor."""
    path = f"{shared_folder(df.sparkSession)}/lacuna-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def require(condition: bool, what: str) -> None:
    if not condition:
        raise CatalogueError(what)


def sphere_volume(r: float) -> float:
    return 4.0 / 3.0 * math.pi * r**3


def cells_from_size(box: float, size: float) -> int:
    """Cells a side so that a cell is no larger than size, but for rounding."""
    require(box > 0 and size > 0, "box and size must be positive")
    return max(4, math.ceil(box / size * (1 - 1e-5)))


def mesh_cells(n_tracers: int, per_cell: float, most: int, least: int = 8) -> int:
    """Cells a side that hold about per_cell tracers each."""
    require(n_tracers > 0, "there are no tracers")
    return max(least, min(most, round((n_tracers / per_cell) ** (1 / 3))))


def finder_mesh_cells(n_tracers: int) -> int:
    return mesh_cells(n_tracers, 30.0, 1024)


def profile_mesh_cells(n_tracers: int) -> int:
    return mesh_cells(n_tracers, 36.0, 256)
