"""Sums within distances, against brute force and without a row for each pair."""

import re
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna import queries as named
from lacuna.core import CatalogueError
from lacuna.operators import crossing, measure, shells, spatial

DATA = "/root/testdata/sf0.001"


def squared(p, c, box=None):
    d = p[None] - np.asarray(c)[:, None]
    if box:
        d = d - box * np.floor(d / box + 0.5)
    return d[..., 0] * d[..., 0] + d[..., 1] * d[..., 1] + d[..., 2] * d[..., 2]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("periodic", [True, False])
def test_sums_by_brute_force(spark, monkeypatch, periodic):
    """Crowds in pieces, equal places, tracers exactly at a limit, fractions as weights, and centres outside the box."""
    monkeypatch.setattr(shells, "PIECE", 700)
    rng = np.random.default_rng(3)
    lattice = np.array([(i, j, k) for i in range(0, 40, 4) for j in range(0, 40, 4) for k in range(0, 40, 4)], float)
    p = np.concatenate([rng.uniform(0, 40, (1500, 3)), rng.normal(20, 0.5, (1500, 3)), lattice, np.repeat([[4.0, 8.0, 12.0]], 400, 0)])
    w = rng.uniform(0, 1, len(p))
    c = np.concatenate([[[20.0, 20.0, 20.0], [0.0, 0.0, 0.0], [4.0, 8.0, 12.0], [39.9, 0.1, 20.0], [-3.0, 41.0, 5.0]], rng.uniform(0, 40, (20, 3))])
    edges = np.array([0.0, 4.0, 8.0, 12.0])
    tracers = spark.createDataFrame([(*map(float, q), float(m)) for q, m in zip(p, w)], "x double, y double, z double, w double")
    centres = spark.createDataFrame([(i, *map(float, q)) for i, q in enumerate(c)], "void_id long, cx double, cy double, cz double")
    got = shells.sums_within(centres, tracers, F.array(*[F.lit(float(e * e)) for e in edges]), 4, 40.0, 12.0, ("w",), periodic=periodic).collect()
    got = {r["void_id"]: r for r in got}
    near = squared(p, c, 40.0 if periodic else None)[:, :, None] <= (edges * edges)[None, None]
    for i in range(len(c)):
        if not near[i].any():
            assert i not in got
            continue
        assert [got[i][f"n_{k}"] for k in range(4)] == list(near[i].sum(0))
        assert [got[i][f"w_{k}"] for k in range(4)] == pytest.approx(list(w @ near[i]), rel=1e-12)


def test_spheres_that_reach_around_are_refused(spark):
    one = spark.createDataFrame([(0, 1.0, 1.0, 1.0)], "void_id long, cx double, cy double, cz double")
    with pytest.raises(CatalogueError):
        shells.sums_within(one, one.selectExpr("cx AS x", "cy AS y", "cz AS z"), F.array(F.lit(25.0)), 1, 10.0, 5.0)


def test_sphere_counts_make_no_pairs(spark):
    assert "Join" not in plan(named.queries()["sphere_counts"](spark, DATA))


def test_bin_limits_follow_the_bins_expression():
    """Exactly at and next to each limit the bin is the one that the expression gives."""
    r = 5.0 + np.arange(10)
    limit = measure.bin_limits(r, 10, 3.0)
    scale = (10.0 / (3.0 * r))[:, None]
    for d2, inside in ((limit, True), (np.nextafter(limit, np.inf), False)):
        k = np.floor(np.sqrt(d2) * scale) < np.arange(1, 11)
        k[:, -1] &= d2[:, -1] <= (r * 3.0) ** 2
        assert (k == inside).all()


def test_profiles_cumulative_make_no_pairs(spark):
    """The only joins are by void, none by cell."""
    assert "__cell = __cell" not in re.sub(r"#\d+L?", "", plan(named.queries()["profiles_cumulative"](spark, DATA))) and "FlatMapCoGroupsInArrow" in plan(named.queries()["profiles_cumulative"](spark, DATA))


def test_profiles_that_reach_around_the_box(spark):
    """A sphere beyond half the box counts each tracer once, by its nearest image."""
    p = np.random.default_rng(8).uniform(0, 20, (300, 3))
    tracers = spark.createDataFrame([tuple(map(float, q)) for q in p], "x double, y double, z double")
    void = spark.createDataFrame([(0, 3.0, 4.0, 5.0, 6.0)], "void_id long, cx double, cy double, cz double, r double")
    got = {r["bin"]: r["n"] for r in measure.profiles(void, tracers, 20.0, 4, 2.0, 300 / 8000, 6.0).collect()}
    bins = np.floor(np.sqrt(squared(p, [[3.0, 4.0, 5.0]], 20.0)[0]) * (4 / 12.0))
    assert [got[b] for b in range(4)] == [int((bins == b).sum()) for b in range(4)]


def test_crossings_rank_no_tracer_of_a_shell_that_cannot_cross(spark, monkeypatch):
    """refusal_reasons' rule on even tracers: nothing is ranked, and the reasons are those of a sort."""
    seen, real = [], crossing.within
    monkeypatch.setattr(crossing, "within", lambda *a, **k: seen.append(real(*a, **k)) or seen[-1])
    p = np.random.default_rng(5).uniform(0, 40, (30000, 3))
    tracers = spark.createDataFrame([tuple(map(float, q)) for q in p], "x double, y double, z double")
    c = np.random.default_rng(6).uniform(0, 40, (20, 3))
    centres = spark.createDataFrame([(i, *map(float, q), 6.0) for i, q in enumerate(c)], "void_id long, cx double, cy double, cz double, r double")
    for threshold, ranked in ((-0.3, False), (0.1, True)):
        seen.clear()
        density = len(p) / 40.0**3 * (1.0 if threshold < 0 else 0.9)
        got = {r["void_id"]: r for r in crossing.crossing_radius(centres, tracers, 40.0, density, threshold, F.col("r"), F.col("r") * 1.5, 9.0).collect()}
        assert seen[0].isEmpty() != ranked
        for i, d2 in enumerate(squared(p, c, 40.0)):
            d = np.sort(np.sqrt(d2[d2 <= 81.0]))
            level = (1 + threshold) * 4 / 3 * np.pi * density
            ok = (d > 6) & (np.arange(len(d)) <= level * d**3)
            reason = "beyond search" if len(d) <= level * 729 else None if ok.any() else "below rung"
            assert got[i]["reason"] == reason and (reason or got[i]["radius"] == d[ok].max())


def test_crossings_from_a_least_of_nothing(spark):
    """A rung of 0, a reach below the rung, and centres far from all tracers."""
    tracers = spark.createDataFrame([(5.0 + 0.1 * i, 5.0, 5.0) for i in range(1, 11)], "x double, y double, z double")
    centres = spark.createDataFrame([(0, 5.0, 5.0, 5.0, 0.0, 2.0), (1, 5.0, 5.0, 5.0, 2.0, 1.5), (2, 14.0, 14.0, 14.0, 0.5, 2.0)], "void_id long, cx double, cy double, cz double, a double, b double")
    got = {r["void_id"]: (r["radius"], r["reason"]) for r in crossing.crossing_radius(centres, tracers, 20.0, 0.25, -0.1, F.col("a"), F.col("b"), 2.0).collect()}
    level = 0.9 * 4 / 3 * np.pi * 0.25
    d = np.sqrt(squared(np.array([(5.0 + 0.1 * i, 5.0, 5.0) for i in range(1, 11)]), [[5.0, 5.0, 5.0]], 20.0)[0])
    ok = np.arange(10) <= level * d**3
    assert got == {0: (d[ok].max(), None), 1: (None, "below rung"), 2: (None, "empty")}


def test_stacked_means_are_exact_in_any_order(spark):
    """Halves of the last decimal go away from zero, whatever the order of the sum."""
    rng = np.random.default_rng(1)
    v = rng.integers(-900000, 900000, 99)
    v = np.append(v, 1657150 - v.sum())
    rows = [(b, float(x) / 1e6 * (-1 if b % 2 else 1)) for b in range(24) for x in rng.permutation(v)]
    df = spark.createDataFrame(rows, "bin int, density double")
    got = {r["bin"]: r["density"] for r in measure.stack(df, ["density"], places=6).collect()}
    assert got == {b: -0.016572 if b % 2 else 0.016572 for b in range(24)}
    plain = [F.round(F.lit(float(np.cumsum([x for k, x in rows if k == b])[-1]) / 100), 6) for b in range(24)]
    assert len({abs(x) for x in spark.range(1).select(*plain).first()}) == 2


def test_nearest_meets_few_tracers(spark, monkeypatch):
    """However many tracers there are, a centre meets some tens of them, and finds the nearest by brute force."""
    seen, real = [], spatial.within
    monkeypatch.setattr(spatial, "within", lambda *a, **k: seen.append(real(*a, **k)) or seen[-1])
    p = np.random.default_rng(9).uniform(0, 100, (20000, 3))
    c = np.random.default_rng(10).uniform(0, 100, (50, 3))
    tracers = spark.createDataFrame([(i, *map(float, q)) for i, q in enumerate(p)], "idx long, x double, y double, z double")
    centres = spark.createDataFrame([(i, *map(float, q)) for i, q in enumerate(c)], "void_id long, cx double, cy double, cz double")
    got = {r["void_id"]: (r["idx"], r["d2"]) for r in spatial.nearest(centres, tracers, 100.0, "void_id", "idx", 8).collect()}
    d2 = squared(p, c, 100.0)
    assert got == {i: (int(d2[i].argmin()), d2[i].min()) for i in range(50)}
    assert seen[0].count() < 50 * 40


@pytest.mark.parametrize("weighted", [False, True])
def test_velocities_by_brute_force(spark, weighted):
    """Shells' mean speeds away from the centre, with a tracer at the centre, others beside it and images."""
    rng = np.random.default_rng(12)
    p = np.concatenate([rng.uniform(0, 40, (3000, 3)), [[20.0, 20.0, 20.0]], 20.0 + rng.normal(0, 1e-3, (50, 3))])
    v, w = rng.normal(size=(len(p), 3)), rng.uniform(0.5, 2, len(p))
    tracers = spark.createDataFrame([(*map(float, a), *map(float, b), float(m)) for a, b, m in zip(p, v, w)], "x double, y double, z double, vx double, vy double, vz double, w double")
    c = np.concatenate([[[20.0, 20.0, 20.0], [0.5, 39.5, 1.0]], rng.uniform(0, 40, (10, 3))])
    voids = spark.createDataFrame([(i, *map(float, q), 4.0 + i % 3) for i, q in enumerate(c)], "void_id long, cx double, cy double, cz double, r double")
    df = measure.profiles(voids, tracers, 40.0, 6, 3.0, 1.0, 6.0, weight="w", velocity=True, weighted_velocity=weighted)
    assert "FlatMapCoGroupsInArrow" in plan(df)
    got = {(r["void_id"], r["bin"]): (r["n"], r["v_rad"]) for r in df.collect()}
    for i, q in enumerate(c):
        d = p - q
        d -= 40 * np.floor(d / 40 + 0.5)
        way = np.sqrt((d * d).sum(1))
        speed = np.divide((d * v).sum(1), way, out=np.zeros(len(p)), where=way > 0)
        at = np.floor(way * (6 / (3 * (4.0 + i % 3))))
        for b in range(6):
            m = (w if weighted else np.ones(len(p))) * (at == b)
            assert got[i, b][0] == (at == b).sum() and got[i, b][1] == pytest.approx((speed * m).sum() / m.sum() if m.sum() else 0.0, abs=1e-12)


@pytest.mark.parametrize("name", ["profiles_shell_weighted", "profiles_wide", "profiles_stacked"])
def test_other_profiles_make_no_pairs(spark, name):
    assert "FlatMapCoGroupsInArrow" in plan(named.queries()[name](spark, DATA))


@pytest.mark.parametrize("name", ["profiles_shell_weighted", "profiles_wide", "profiles_stacked"])
def test_limits_are_made_in_the_tasks(spark, name):
    """No Python step makes them before voids are dealt out to blocks, and no array of them is shuffled."""
    text = plan(named.queries()[name](spark, DATA))
    assert "FlatMapCoGroupsInArrow" in text and "ArrowEvalPython" not in text


def test_a_void_without_a_size_has_empty_bins(spark):
    tracers = spark.createDataFrame([(5.0, 5.0, 5.0), (6.0, 5.0, 5.0)], "x double, y double, z double")
    voids = spark.createDataFrame([(0, 5.0, 5.0, 5.0, 1.0), (1, 5.0, 5.0, 5.0, None), (2, 5.0, 5.0, 5.0, float("nan"))], "void_id long, cx double, cy double, cz double, r double")
    got = {(r["void_id"], r["bin"]): r["n"] for r in measure.profiles(voids, tracers, 20.0, 2, 2.0, 1.0, 1.0).collect()}
    assert got == {(0, 0): 1, (0, 1): 1, (1, 0): 0, (1, 1): 0, (2, 0): 0, (2, 1): 0}


def test_comparisons_share_their_arrays():
    """A leaf's pairs leave no array of their own size, and sums of counts, whole and other weights are those of brute force."""
    rng = np.random.default_rng(4)
    p, c = rng.uniform(0, 1, (150, 3)), rng.uniform(-1, 2, (4000, 3))
    limits = rng.uniform(0, 3, (4000, 1))
    near = squared(p, c) <= limits
    for w in (np.ones((150, 1)), np.column_stack([np.ones(150), rng.integers(1, 50, 150)]), np.column_stack([np.ones(150), rng.uniform(0, 1, 150)])):
        tree = shells._Tree(p, w, None)
        tracemalloc.start()
        got = tree.sums(c, np.arange(4000), c, limits)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert got[:, 0, 0].tolist() == near.sum(1).tolist() and got[:, 0] == pytest.approx(near @ w, rel=1e-12)
        assert most < near.size * 2


def test_pieces_seldom_share_a_task(spark):
    """The blocks of 36 million tracers are a piece each, and blocks are dealt to more tasks than there are pieces."""
    assert shells.PIECE > 36_000_000 / 64
    tracers = spark.range(3_000_000).selectExpr("id % 4000 / 100 AS x", "id % 3989 / 100 AS y", "id % 3967 / 100 AS z")
    one = spark.createDataFrame([(0, 20.0, 20.0, 20.0)], "void_id long, cx double, cy double, cz double")
    text = re.sub(r"#\d+L?", "", plan(shells.sums_within(one, tracers, F.array(F.lit(361.0)), 1, 40.0, 19.0)))
    assert all(int(n) > 64 for n in re.findall(r"hashpartitioning\(__cell, __piece, (\d+)\)", text)) and "hashpartitioning(__cell, __piece, " in text
