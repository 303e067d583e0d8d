"""Closed forms, brute force, invariance and refusals."""

import math
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.core import CatalogueError, GridSpec, cells_from_size
from lacuna.functions import numeric, theory
from lacuna.operators import assignment, crossing, measure, overlap, rows, smoothing, spatial, survey, tessellation
from lacuna.plans import finders


def points(spark, n=4000, box=50.0, seed=1, holes=()):
    rng = np.random.default_rng(seed)
    p = rng.uniform(0, box, (n, 3))
    for *c, r in holes:
        d = p - np.array(c)
        d -= box * np.round(d / box)
        p = p[(d * d).sum(1) >= r * r]
    return p, spark.createDataFrame([(i, *map(float, q), 1.0) for i, q in enumerate(p)], "idx long, x double, y double, z double, w double")


def test_wrap_edges(spark):
    df = spark.createDataFrame([(v, 0.0, 0.0) for v in (-1e-9, 10.0, 10.5, float("nan"), float("inf"), 3.0, -1e-300)], "x double, y double, z double")
    got = [r[0] for r in rows.wrap_periodic(df, 10.0).select("x").collect()]
    assert got[1] == 0 and got[2] == 0.5 and math.isnan(got[3]) and math.isinf(got[4]) and got[5] == 3
    assert 0 <= got[0] < 10 and 0 <= got[6] < 10
    assert tuple(rows.wrap_tally(df, 10.0).first()) == (2, 1, 3)


def test_box_refusal_names_the_first_row(spark):
    df = spark.createDataFrame([(5, 1.0, 1.0, 1.0), (7, 99.0, 1.0, 1.0)], "idx long, x double, y double, z double")
    with pytest.raises(CatalogueError, match="idx 7"):
        rows.accept_box(df, 10.0, "idx")


@pytest.mark.parametrize("scheme", assignment.SCHEMES)
def test_mass_is_kept(spark, scheme):
    _, df = points(spark)
    spec = GridSpec(8, 50.0)
    total = assignment.deposit(df, spec, scheme).agg(F.sum("value")).first()[0] * spec.cell**3
    assert total == pytest.approx(4000)


def test_lattice_tessellation(spark):
    n = 5
    p = [((i * n + j) * n + k, (i + 0.5) * 2.0, (j + 0.5) * 2.0, (k + 0.5) * 2.0) for i in range(n) for j in range(n) for k in range(n)]
    df = spark.createDataFrame(p, "idx long, x double, y double, z double")
    volumes, samples = tessellation.tessellate(df, 10.0, per_tracer=64)
    v = np.array([r["volume"] for r in volumes.collect()])
    assert v.sum() == pytest.approx(1000) and abs(v / 8 - 1).max() < 0.6
    assert samples.agg(F.sum("w")).first()[0] == pytest.approx(125)


def test_profiles_by_brute_force(spark):
    p, df = points(spark)
    centres = [(0, 3.0, 3.0, 48.0, 4.0), (1, 25.0, 25.0, 25.0, 6.0)]
    v = spark.createDataFrame(centres, "void_id long, cx double, cy double, cz double, r double")
    got = {(r["void_id"], r["bin"]): r["n"] for r in measure.profiles(v, df, 50.0, 6, 2.0, 4000 / 50**3, 6.0).collect()}
    for i, *c, r in centres:
        d = p - np.array(c)
        d -= 50 * np.round(d / 50)
        k = np.floor(np.sqrt((d * d).sum(1)) / (2 * r / 6)).astype(int)
        assert [got[i, b] for b in range(6)] == [int((k == b).sum()) for b in range(6)]


def test_crossing_radius_by_sorting(spark):
    holes = [(15.0, 15.0, 15.0, 9.0), (35.0, 35.0, 30.0, 7.0)]
    p, df = points(spark, 9000, holes=holes)
    v = spark.createDataFrame([(i, *h[:3]) for i, h in enumerate(holes)], "void_id long, cx double, cy double, cz double")
    density, threshold = len(p) / 50.0**3, -0.7
    got = {r["void_id"]: r["radius"] for r in crossing.crossing_radius(v, df, 50.0, density, threshold, F.lit(5.0), F.lit(20.0), 20.0).collect()}
    weighted = {r["void_id"]: r["radius"] for r in crossing.crossing_radius(v, df, 50.0, density, threshold, F.lit(5.0), F.lit(20.0), 20.0, weight="w").collect()}
    for i, h in enumerate(holes):
        d = p - np.array(h[:3])
        d -= 50 * np.round(d / 50)
        d = np.sort(np.sqrt((d * d).sum(1)))
        ok = (d > 5) & (d <= 20) & (np.arange(len(d)) <= (1 + threshold) * 4 / 3 * np.pi * density * d**3)
        assert got[i] == pytest.approx(d[ok].max()) and weighted[i] == pytest.approx(got[i])


def test_order_of_acceptance_by_replay(spark):
    rng = np.random.default_rng(4)
    v = [(i, *map(float, rng.uniform(0, 20, 3)), float(rng.uniform(1, 3)), float(rng.integers(0, 9))) for i in range(60)]
    df = spark.createDataFrame(v, "void_id long, cx double, cy double, cz double, r double, depth double")
    for fraction in (0.0, 0.6):
        got = {r["void_id"] for r in overlap.accept_in_order(df, "depth", 20.0, fraction, 3.0).collect()}
        kept = []
        for x in sorted(v, key=lambda x: (x[5], x[0])):
            def hits(y, x=x):
                d = np.array(x[1:4]) - np.array(y[1:4])
                d -= 20 * np.round(d / 20)
                return np.sqrt((d * d).sum()) < x[4] + y[4] - fraction * min(x[4], y[4])

            if not any(map(hits, kept)):
                kept.append(x)
        assert got == {x[0] for x in kept}


def test_long_chains_of_acceptance_settle(spark):
    """In a line where each collides with the next, every second one is taken; a bound that is too low raises."""
    line = spark.createDataFrame([(i, 1.0 + i, 5.0, 5.0, 0.7, float(i)) for i in range(12)], "void_id long, cx double, cy double, cz double, r double, depth double")
    got = {r["void_id"] for r in overlap.accept_in_order(line, "depth", 40.0, 0.0, 0.7).collect()}
    assert got == set(range(0, 12, 2))
    with pytest.raises(RuntimeError, match="did not settle in 4 rounds"):
        overlap.accept_in_order(line, "depth", 40.0, 0.0, 0.7, rounds=4)


def test_smoothing_keeps_a_constant_and_matches_numpy(spark):
    n, box = 8, 16.0
    spec = GridSpec(n, box)
    v = np.random.default_rng(2).normal(size=(n, n, n))
    df = spark.createDataFrame([(i, j, k, float(v[i, j, k])) for i in range(n) for j in range(n) for k in range(n)], "ix int, iy int, iz int, value double")
    got = np.zeros((n, n, n))
    for r in smoothing.smooth(df, spec, [3.0]).collect():
        got[r["ix"], r["iy"], r["iz"]] = r["value"]
    k = np.fft.fftfreq(n, 1 / n) * 2 * np.pi / box
    kk = np.sqrt(k[:, None, None] ** 2 + k[None, :, None] ** 2 + k[None, None, :] ** 2)
    assert np.allclose(got, np.fft.ifftn(np.fft.fftn(v) * smoothing.top_hat(kk * 3.0)).real)
    sigma = smoothing.grid_moments(df, spec, [4.0], 0).first()["sigma"]
    w = np.fft.fftn(v) * smoothing.top_hat(kk * 4.0)
    w[0, 0, 0] = 0
    assert sigma == pytest.approx(np.sqrt((np.abs(w) ** 2).sum() / n**6))


def test_surrogates_keep_power(spark):
    n = 8
    spec = GridSpec(n, 16.0)
    v = np.random.default_rng(3).normal(size=(n, n, n))
    df = spark.createDataFrame([(i, j, k, float(v[i, j, k])) for i in range(n) for j in range(n) for k in range(n)], "ix int, iy int, iz int, value double")
    a, b, c = (smoothing.grid_moments(df, spec, [4.0], 0, surrogate=s, seed=9).first()["sigma"] for s in (None, "phases", "gaussian"))
    assert a == pytest.approx(b) and abs(a / c - 1) > 1e-6


def test_finder_recovers_holes_in_any_partitioning_and_resumes(spark, tmp_path):
    holes = [(15.0, 15.0, 15.0, 9.0), (35.0, 35.0, 30.0, 7.0)]
    _, df = points(spark, 9000, holes=holes)
    spec = GridSpec(16, 50.0)
    grid = rows.contrast(assignment.dense(assignment.deposit(df, spec), spec)).cache()
    args = (spec, [8.0, 6.5], -0.7)
    found = sorted(map(tuple, finders.tracer_finder(grid, df.repartition(7), *args).collect()))
    assert len(found) == 2
    folder = f"file://{tmp_path}/state"
    finders.tracer_finder(grid, df, spec, [8.0, 6.5], -0.7, checkpoint=folder, keep_checkpoint=True)
    again = finders.tracer_finder(grid, df, *args, checkpoint=folder, keep_checkpoint=True)
    assert sorted(map(tuple, again.collect())) == found
    with pytest.raises(CatalogueError, match="other parameters"):
        finders.tracer_finder(grid, df, spec, [8.0, 6.5], -0.6, checkpoint=folder)


def test_climb_by_replay(spark):
    """Every centre climbs until its step is short, and then searches with 26 probes, as a plain loop does."""
    p, df = points(spark, 6000, holes=[(25.0, 25.0, 25.0, 9.0)])
    density, least, reach = len(p) / 50.0**3, 5.0, 18.0

    def radius(c, low):
        d = p - np.array(c)
        d -= 50 * np.round(d / 50)
        d = np.sort(np.sqrt((d * d).sum(1)))
        d = d[d <= reach]
        level = 0.3 * 4 / 3 * np.pi * density
        ok = (d > low) & (np.arange(len(d)) <= level * d**3)
        return d[ok].max() if ok.any() and len(d) > level * reach**3 else -1.0

    def ascend(c, r):
        base, step, n = r, 0.1, 0
        while step >= 0.01:
            n += 1
            tries = [[(x + s * step * base * (a == b)) % 50 for b, x in enumerate(c)] for a in range(3) for s in (1, -1)]
            v = [radius(t, min(least, r)) for t in tries]
            if max(v) > r:
                c, r = tries[int(np.argmax(v))], max(v)
            else:
                step /= 2
        return c, r, n

    def hill(c0, r0):
        c, r, n = ascend(c0, r0)
        for _ in range(3):
            u = [np.array(v) / np.linalg.norm(v) for v in np.ndindex(3, 3, 3) for v in [np.array(v) - 1] if v.any()]
            tries = [list((np.array(c) + 0.3 * r * x) % 50) for x in u]
            v = [radius(t, 0.7 * r) for t in tries]
            if max(v) < 0:
                break
            at = tries[int(np.argmax(v))]
            end, top, _ = ascend(at, max(v))
            if end == at or top <= 1.001 * r:
                break
            c, r = end, top
        d = np.array(c) - c0
        d -= 50 * np.round(d / 50)
        return (c0, r0, n) if np.linalg.norm(d) > 0.5 * r0 else (c, r, n)

    starts = [[25.0, 25.0, 25.0], [27.2, 25.0, 25.0], [26.5, 23.4, 26.1], [22.9, 26.2, 24.0], [24.1, 24.2, 27.3]]
    voids = [(i, *c, radius(c, least), -0.9) for i, c in enumerate(starts)]
    assert all(v[4] > 0 for v in voids)
    want = [hill(list(v[1:4]), v[4]) for v in voids]
    assert max(n for *_, n in want) > 6
    table = spark.createDataFrame([(i, x, y, z, float(r), d) for i, x, y, z, r, d in voids], "void_id long, cx double, cy double, cz double, r double, depth double")
    args = (df, GridSpec(16, 50.0), density, -0.7, least, reach)
    got = {r["void_id"]: r for r in finders.climb(table, *args).collect()}
    for i, (c, r, _) in enumerate(want):
        assert [got[i]["cx"], got[i]["cy"], got[i]["cz"], got[i]["r"]] == pytest.approx([*c, r])
    with pytest.raises(RuntimeError, match="did not settle"):
        finders.climb(table, *args, rounds=6)


def test_climb_writes_few_tables(spark):
    """Climbs of any length take a few plans, whatever the number of their rounds."""
    from lacuna.core import shared_folder

    p, df = points(spark, 6000, holes=[(25.0, 25.0, 25.0, 9.0)])
    voids = spark.createDataFrame([(1, 25.0, 25.0, 25.0, 10.0, -0.9), (2, 26.5, 23.4, 26.1, 8.5, -0.9)], "void_id long, cx double, cy double, cz double, r double, depth double")
    folder = Path(shared_folder(spark).removeprefix("file://"))
    before = len(list(folder.iterdir())) if folder.exists() else 0
    finders.climb(voids, df, GridSpec(16, 50.0), len(p) / 50.0**3, -0.7, 5.0, 18.0).collect()
    assert len(list(folder.iterdir())) - before <= 13


def test_climb_in_tasks_as_in_plans(spark, monkeypatch):
    """States in the tasks are those of a plan a round to the last bit, also of centres that are dealt anew and across the borders."""
    from lacuna.plans import climbing

    p, df = points(spark, 6000, holes=[(1.0, 25.0, 49.0, 9.0), (20.0, 20.0, 20.0, 6.0)])
    starts = [(1, 1.0, 25.0, 49.0, 10.0, -0.9), (2, 48.5, 23.4, 0.3, 8.5, -0.9), (3, 21.0, 20.0, 18.5, 6.2, -0.8), (4, 40.0, 40.0, 20.0, 5.0, -0.7)]
    voids = spark.createDataFrame(starts, "void_id long, cx double, cy double, cz double, r double, depth double")
    args = (df, GridSpec(16, 50.0), len(p) / 50.0**3, -0.7, 5.0, 11.0)
    monkeypatch.setattr(climbing, "FEW", 0)
    monkeypatch.setattr(climbing, "CLIMBERS", 1)
    bare = spark.createDataFrame([(i, *c) for i, c in enumerate([(1.0, 25.0, 49.0), (2.5, 24.0, 48.0), (30.0, 40.0, 20.0), (20.0, 20.0, 20.0)])], "void_id long, cx double, cy double, cz double").withColumn("depth", F.lit(-0.9))
    want = crossing.crossing_radius(bare, df, 50.0, len(p) / 50.0**3, -0.7, F.lit(5.0), F.lit(11.0), 11.0).where("radius IS NOT NULL")
    sizes = climbing._in_tasks(climbing._begun(bare.withColumn("r", F.lit(None).cast("double"))), *args, 1, 12.0).where("mode <> 'none'")
    want, sizes = (sorted(map(tuple, t.collect())) for t in (want.select("void_id", "radius"), sizes.select("void_id", "r0")))
    assert want == sizes and 0 < len(want) < 4
    got = sorted(map(tuple, climbing.climb(voids, *args).collect()))
    rows = climbing._begun(voids)
    tasks, plans = climbing._in_tasks(rows, *args, 4, 30.0), climbing._in_plans(rows, *args, 4)
    columns = [c for c in plans.columns if c != "rounds"]
    a, b = (sorted(map(tuple, df.select(columns).collect())) for df in (tasks, plans))
    assert a == b and len(got) == 4
    again = sorted(map(tuple, climbing._in_tasks(rows, *args, 1000, 30.0).select("void_id", "kx", "ky", "kz", "kr").collect()))
    kept = {v[0]: v[1:4] + (v[5],) for v in got}
    moved = [v for v in again if kept[v[0]] != starts[v[0] - 1][1:5]]
    assert moved and all(kept[v[0]] == v[1:] for v in moved)


def test_settings_are_refused():
    with pytest.raises(CatalogueError):
        finders.Settings(seeds="minima").check(survey=True)
    with pytest.raises(CatalogueError):
        finders.check_ladder([3.0], 0.5)
    assert cells_from_size(100.0, 10.0) == 10


def test_nearest_by_brute_force(spark):
    p, df = points(spark, 500)
    c = np.random.default_rng(8).uniform(0, 50, (60, 3))
    v = spark.createDataFrame([(i, *map(float, q)) for i, q in enumerate(c)], "void_id long, cx double, cy double, cz double")
    got = {r["void_id"]: r["idx"] for r in spatial.nearest(v, df, 50.0, "void_id", "idx", 12).collect()}
    for i, q in enumerate(c):
        d = p - q
        d -= 50 * np.round(d / 50)
        assert got[i] == int((d * d).sum(1).argmin())


def test_survey_volume_of_a_shell(spark):
    rng = np.random.default_rng(6)
    d = rng.normal(size=(60000, 3))
    d /= np.linalg.norm(d, axis=1)[:, None]
    d = d[d[:, 2] > 0.5] * (rng.uniform(8, 64, (d[:, 2] > 0.5).sum()) ** (1 / 3))[:, None]
    df = spark.createDataFrame([tuple(map(float, q)) for q in d], "x double, y double, z double")
    assert survey.survey_volume(df, 16) == pytest.approx(math.pi * (64 - 8) / 3, rel=0.03)


def test_survey_takes_weights(spark):
    """Weight k counts as k tracers in the same place, for data and randoms, in the API as well."""
    from lacuna.api import Field, find_survey_voids

    rng = np.random.default_rng(8)
    p, q = rng.uniform(20, 60, (6000, 3)), rng.uniform(20, 60, (9000, 3))
    p = p[((p - 40) ** 2).sum(1) > 64]
    # Half the survey is seen with half the weight in data and randoms alike; a second hole is there by weight only.
    w = np.where(((p - [30, 30, 30]) ** 2).sum(1) < 49, 0.0, np.where(p[:, 0] < 40, 1.0, 3.0))
    v = np.where(q[:, 0] < 40, 1.0, 3.0)

    def voids(p, q, w=None, v=None):
        found = find_survey_voids(Field.from_numpy(spark, p, w), Field.from_numpy(spark, q, v), 24, [7.0, 6.0]).df
        return sorted([r["depth"], r["cx"], r["cy"], r["cz"], r["r"], r["footprint"]] for r in found.collect())

    got, plain = voids(p, q, w, v), voids(p, q)
    want = voids(np.repeat(p, w.astype(int), 0), q, None, v)
    assert len(got) >= 2 and len(want) == len(got) != len(plain)
    assert np.allclose(got, want)
    with pytest.raises(CatalogueError, match="negative"):
        voids(p, q, w - 1)
    with pytest.raises(CatalogueError, match="nothing"):
        voids(p, q, None, 0 * v)


def test_maps_agree_with_each_other(spark):
    d = spark.createDataFrame([(-0.3,), (-1.0,), (-2.0,)], "d double")
    got = d.select(numeric.spherical_map_nonlinear(F.col("d"), "eds"), numeric.spherical_map_nonlinear(F.col("d"), "lcdm", 1.0, 0.0), theory.linear_to_nonlinear(F.col("d"))).collect()
    for a, b, c in got:
        assert a == pytest.approx(b, abs=2e-3) and a == pytest.approx(c, abs=0.02)


def test_redshifts_far_out_return_or_raise(spark):
    z = [0.01, 1.0, 19.9, 25.0, 70.0]
    df = spark.createDataFrame([(x,) for x in z], "z double")
    for cosmology in ({}, {"omega_m": 0.25, "omega_de": 0.7, "omega_r": 1e-4, "w0": -0.9, "wa": 0.1}):
        far = spark.createDataFrame(df.select(theory.comoving_distance(F.col("z"), **cosmology).alias("d")).collect(), "d double")
        got = [r[0] for r in far.select(theory.redshift_of(F.col("d"), **cosmology)).collect()]
        assert got == pytest.approx(z, rel=1e-6)
    assert spark.range(1).select(theory.redshift_of(F.lit(None).cast("double"))).first()[0] is None
    with pytest.raises(Exception, match="no redshift up to 10000 reaches"):
        spark.range(1).select(theory.redshift_of(F.lit(1e6))).collect()


def test_first_crossings_of_two_steps(spark):
    cov = np.array([[1.0, 0.0], [0.0, 1.0]])
    got = {r["step"]: r["counts"] for r in numeric.first_crossing_counts(spark, cov, np.array([-1.0, -1.0]), 100_000, seed=3).collect()}
    p = 0.5 * math.erfc(1 / math.sqrt(2))
    assert got[0] / 1e5 == pytest.approx(p, abs=5e-3) and got[1] / 1e5 == pytest.approx((1 - p) * p, abs=5e-3)


def test_streamed_size_counts(spark, tmp_path):
    from lacuna.streaming import incremental

    v = spark.createDataFrame([(float(r),) for r in (1.0, 1.5, 2.0, 4.0, 9.0)], "r double")
    v.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(v.schema).parquet(str(tmp_path / "in"))
    got = incremental.run_to_table(incremental.stream_size_counts(stream, 1.0, 8.0, 3), "sizes", str(tmp_path / "state"))
    assert {r["bin"]: r["counts"] for r in got.collect()} == {0: 2, 1: 1, 2: 1}
