"""Round trips and refusals of file formats."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.core import CatalogueError, GridSpec
from lacuna.operators import assignment
from lacuna.sources import files


def tracers(spark, n=1000):
    rng = np.random.default_rng(1)
    return spark.createDataFrame([(*map(float, rng.uniform(0, 10, 3)), float(rng.integers(1, 9))) for _ in range(n)], "x double, y double, z double, w double")


def test_field_round_trip_and_corruption(spark, tmp_path):
    df = tracers(spark).repartition(3)
    made = files.write_field(df, str(tmp_path / "f"), 10.0)
    back = files.read_field(spark, str(tmp_path / "f"))
    assert sorted(map(tuple, back.drop("idx").collect())) == sorted(map(tuple, df.collect()))
    path = made.first()["path"]
    assert files.describe(path)["kind"] == "field" and files.check(spark, path)[1] == []
    raw = bytearray(open(path, "rb").read())
    raw[70] ^= 1
    open(path, "wb").write(raw)
    assert "checksum" in files.check(spark, path)[1][0]
    open(path, "wb").write(raw[:200])
    with pytest.raises(Exception, match="cut short"):
        files.read_field(spark, path).collect()


def test_grid_round_trip(spark, tmp_path):
    spec = GridSpec(6, 10.0)
    grid = assignment.dense(assignment.deposit(tracers(spark), spec), spec)
    path = files.write_grid(grid, str(tmp_path / "g"), 6, 10.0)
    assert sorted(map(tuple, files.read_grid(spark, path).collect())) == sorted(map(tuple, grid.select("ix", "iy", "iz", "value").collect()))
    assert files.check(spark, path)[1] == []


def test_ascii(spark, tmp_path):
    p = tmp_path / "a.txt"
    p.write_text("# head\n1 2 9 9 3\n4 5 9 9 6\n")
    got = [tuple(r) for r in files.read_ascii(spark, str(p), "x y *2 z").collect()]
    assert got == [(1, 2, 3), (4, 5, 6)]
    p.write_text("1 2 9 9 3\n4 five 9 9 6\n7\n")
    with pytest.raises(Exception, match="doesn't parse"):
        files.read_ascii(spark, str(p), "x y *2 z").collect()
    assert tuple(files.check_ascii(spark, str(p), "x y *2 z").first()) == (3, 1, 1)


def test_catalogue_and_profiles_text(spark, tmp_path):
    v = spark.createDataFrame([(i, float(i), 2.0, 3.0, 1.5) for i in range(5)], "void_id long, cx double, cy double, cz double, r double")
    files.write_catalogue_ascii(v, str(tmp_path / "c"), {"Kind": "x", "n_runs": 3})
    back, meta = files.read_catalogue_ascii(spark, str(tmp_path / "c"))
    assert sorted(map(tuple, back.drop("void_id").collect())) == sorted(map(tuple, v.drop("void_id").collect())) and meta["kind"] == "x" and meta["n_runs"] == 3
    p = spark.createDataFrame([(v_, b, v_ + b / 10) for v_ in range(3) for b in range(4)], "void_id long, bin int, density double")
    files.write_profiles_ascii(p, str(tmp_path / "p"), ["density"])
    assert sorted(map(tuple, files.read_profiles_ascii(spark, str(tmp_path / "p")).collect())) == sorted(map(tuple, p.collect()))


@pytest.mark.parametrize("layout,end,bits", [("rows", "<", 32), ("blocks", ">", 64)])
def test_raw_binary(spark, tmp_path, layout, end, bits):
    v = np.arange(40, dtype=f"{end}f{bits // 8}").reshape(10, 4)
    p = tmp_path / "b.bin"
    p.write_bytes(b"HEAD" + (v if layout == "rows" else v.T.copy()).tobytes())
    got = files.read_binary(spark, str(p), "x y * z", bits, layout, end == ">", 4).orderBy("idx").collect()
    assert [tuple(r)[1:] for r in got] == [tuple(map(float, r[[0, 1, 3]])) for r in v]
    with pytest.raises(CatalogueError):
        files.read_binary(spark, str(p), "x y * z", bits, layout, end == ">", 3)


@pytest.mark.parametrize("labelled", [False, True])
def test_snapshots(spark, tmp_path, labelled):
    counts, table = [40, 100, 30], (0.0, 0.5, 0.0, 0.0, 0.0, 0.0)

    def part(t, a, b):
        g = np.arange(a, b, dtype=float)
        x = 100.0 * t + 0.5 * g + 0.125
        vx = 10.0 * t + 0.25 * g
        return np.stack([x, x + 1000, x + 2000], 1), np.stack([vx, -vx, vx + 1], 1), 1 + g / 1024

    for i, cuts in enumerate([((0, 15), (0, 30), (0, 0)), ((15, 40), (30, 100), (0, 30))]):
        files.write_gadget(f"{tmp_path}/s.{i}", {t: part(t, *c) for t, c in enumerate(cuts)}, 10000.0, 0.25, table, labelled, (0, 2), [*counts, 0, 0, 0])
    got = files.read_gadget(spark, f"{tmp_path}/s.0", 1, velocities=True).orderBy("idx").toPandas()
    pos, vel, _ = part(1, 0, 100)
    assert np.allclose(got[["x", "y", "z"]], pos * 1e-3) and np.allclose(got[["vx", "vy", "vz"]], vel)
    gas = files.read_gadget(spark, f"{tmp_path}/s.0", 2, masses=True, peculiar=True).orderBy("idx").toPandas()
    assert np.allclose(gas["w"], part(2, 0, 30)[2]) and files.sniff(f"{tmp_path}/s.0") == "gadget"


def test_fits(spark, tmp_path):
    df = spark.range(100).select((F.col("id") * 3.5).alias("RA"), (F.col("id") * 0.75 - 45).alias("DEC"), F.col("id").alias("N")).coalesce(1)
    path = files.write_fits(df, str(tmp_path / "t.fits"), "DATA", {"VERSION": 3, "WHO": "me"})
    got = files.read_fits(spark, path, {"ra": "RA", "twice": "2 * N + 1"}, where="N >= 10", hdu="DATA").orderBy("idx").collect()
    assert len(got) == 90 and got[0]["ra"] == 35.0 and got[0]["twice"] == 21.0
    assert files.read_fits(spark, path, {"ra": "RA"}, fraction=0.25).count() == 25
    assert files.fits_key(path, "version") == 3 and files.fits_key(path, "who") == "me"
    assert files.describe(path)["tables"][0]["columns"] == ["RA", "DEC", "N"]
    files.set_fits_key(path, "version", 4)
    files.set_fits_key(path, "extra", "new")
    assert files.fits_key(path, "version") == 4 and files.fits_key(path, "extra") == "new" and files.read_fits(spark, path, {"ra": "RA"}).count() == 100
    with pytest.raises(CatalogueError):
        files.set_fits_key(path, "who", 3)
    with pytest.raises(Exception, match="isn't finite"):
        files.read_fits(spark, path, {"q": "nullif(N, 7)"}).collect()


def test_metadata_and_numbers(spark):
    v = files.set_metadata(spark.range(3), {"Run": 5, "name": "x"})
    assert files.get_metadata(v, "run", int) == 5
    with pytest.raises(CatalogueError):
        files.get_metadata(v, "name", int)
    got = files.numbered(spark.range(1000).select((F.col("id") * 37 % 1000).alias("v")), ["v"]).collect()
    assert all(r["v"] == r["idx"] for r in got)


def test_command_line(spark, tmp_path, capsys):
    import json

    from lacuna import __main__ as cli

    rng = np.random.default_rng(2)
    p = rng.uniform(0, 40, (6000, 3))
    d = p - 20
    p = p[(d * d).sum(1) > 64]
    spark.createDataFrame([tuple(map(float, q)) for q in p], "x double, y double, z double").write.parquet(str(tmp_path / "in"))
    config = {"input": {"path": str(tmp_path / "in"), "box": 40.0}, "finder": {"radii": [7.0]}, "output": str(tmp_path / "out")}
    (tmp_path / "c.json").write_text(json.dumps(config))
    cli.main(["find", str(tmp_path / "c.json"), "--check"])
    cli.find(spark, config)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(got) == 1 and abs(got[0]["cx"] - 20) < 3 and got[0]["metadata"]["variant"] == '"excursion-set"'
    with pytest.raises(SystemExit, match="did you mean threshold"):
        cli.merged({**config, "finder": {"radii": [1.0], "treshold": -0.5}})
    assert cli.even_smooth(17) == 18 and cli.even_smooth(3) == 16


def test_results_in_fits(spark, tmp_path):
    v = spark.createDataFrame([(i, float(i), 2.0, 3.0, 1.5 + i) for i in range(6)], "void_id long, cx double, cy double, cz double, r double")
    back = files.read_catalogue_fits(spark, files.write_catalogue_fits(v.coalesce(1), str(tmp_path / "v.fits")))
    assert sorted(map(tuple, back.select(*v.columns).collect())) == sorted(map(tuple, v.collect()))
    from lacuna.operators import measure

    table = measure.size_function(v, 1000.0, 3)
    again = files.read_size_function_fits(spark, files.write_size_function_fits(table, str(tmp_path / "s.fits")))
    assert sorted(map(tuple, again.select(*table.columns).collect())) == sorted(map(tuple, table.collect()))
    p = spark.createDataFrame([(a, b, a + b / 10) for a in range(2) for b in range(3)], "void_id long, bin int, density double")
    assert sorted(map(tuple, files.read_profiles_fits(spark, files.write_profiles_fits(p, str(tmp_path / "p.fits"))).collect())) == sorted(map(tuple, p.collect()))


def test_columns_of_another_file(spark):
    from lacuna.operators import rows

    a, b = spark.range(4).selectExpr("id AS idx", "id * 2.0 AS x"), spark.range(4).selectExpr("id AS idx", "id + 1.0 AS w")
    assert [r["w"] for r in rows.add_columns(a, b).orderBy("idx").collect()] == [1, 2, 3, 4]
    with pytest.raises(CatalogueError):
        rows.add_columns(a, b.where("idx < 2"))
