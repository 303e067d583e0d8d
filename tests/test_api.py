"""The library by nouns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna import api
from lacuna.core import CatalogueError
from lacuna.functions import arrays


def box_with_hole(spark):
    rng = np.random.default_rng(2)
    p = rng.uniform(0, 40, (6000, 3))
    p = p[((p - 20) ** 2).sum(1) > 64]
    return api.Field.from_numpy(spark, p, box=40.0)


def test_from_field_to_size_function(spark):
    tracers = box_with_hole(spark)
    grid = api.Grid.assign(tracers, 16).to_density_contrast()
    with pytest.raises(CatalogueError):
        grid.to_density_contrast()
    found = api.find_voids(grid, tracers, [7.0, 6.0])
    got = found.to_numpy()
    assert len(got["r"]) == 1 and np.allclose([got[c][0] for c in ("cx", "cy", "cz")], 20, atol=3)
    table = found.size_function(4, low=5.0, high=15.0).collect()
    assert sum(r["counts"] for r in table) == 1
    profile = found.profiles(tracers, 5, 2.0).orderBy("bin").collect()
    assert profile[0]["density"] < -0.9 and profile[-1]["density"] > profile[0]["density"]
    assert len(api.spherical(grid, [6.0]).to_numpy()["r"]) >= 1


def test_sky_is_refused_and_converted(spark):
    sky = api.Field.from_numpy(spark, [[10.0, 5.0, 0.1], [200.0, -40.0, 0.2]], units="sky")
    with pytest.raises(CatalogueError):
        sky.bounds()
    with pytest.raises(CatalogueError):
        sky.translate((1, 1, 1))
    there = sky.convert_sky_coordinates()
    assert set(there.df.columns) >= {"x", "y", "z"}
    v = api.Catalogue.from_numpy(spark, there.df.select("x", "y", "z").toPandas().to_numpy(), [1.0, 2.0])
    back = v.to_sky().df.orderBy("void_id").collect()
    assert [round(r["cx"], 6) for r in back] == [10.0, 200.0] and [round(r["cz"], 6) for r in back] == [0.1, 0.2]


def test_morton_order_keeps_rows(spark):
    f = box_with_hole(spark)
    assert f.sort_morton().df.select("idx").agg(F.countDistinct("idx")).first()[0] == f.count()


def test_cache_is_keyed_by_content(spark):
    f = box_with_hole(spark)
    api.set_setting("grid_cache", True)
    try:
        a, b = api.Grid.assign(f, 8).df, api.Grid.assign(f, 8).df
        c = api.Grid.assign(api.Field(f.df.where("idx > 5"), 40.0), 8).df
        path = lambda df: df.inputFiles()[0].rsplit("/", 1)[0]
        assert path(a) == path(b) != path(c)
    finally:
        api.set_setting("grid_cache", False)
    with pytest.raises(CatalogueError):
        api.set_setting("threads", 4)


def test_sequences(spark):
    assert [r["v"] for r in arrays.linspace(spark, 0, 1, 5).orderBy("i").collect()] == [0, 0.25, 0.5, 0.75, 1]
    assert [r["v"] for r in arrays.arange(spark, 0, 1, 0.3).orderBy("i").collect()] == pytest.approx([0, 0.3, 0.6, 0.9])
    assert [r["v"] for r in arrays.logspace(spark, 0, 2, 3).orderBy("i").collect()] == pytest.approx([1, 10, 100])
    assert tuple(arrays.reduce(arrays.constant(spark, 4, 2.5)).first()) == (10.0, 2.5, 2.5)
