"""Connected components of a table of links: a spanning forest in each task, then one task, or star steps if many links are left."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, stage

#: Links that a task holds at a time, and that one task may settle; more go through star steps.
FOREST_LINKS = 500_000


def least_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the links in ascending order, and the least node that each reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = np.arange(len(nodes))
    a, b = at[: len(a)], at[len(a) :]
    while True:
        a, b = root[a], root[b]
        apart = a != b
        a, b = a[apart], b[apart]
        if not len(a):
            return nodes, nodes[root]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up


def _forest(batches):
    """Links (u, v), v below u, that connect what the task's links connect; at most FOREST_LINKS and a batch are held."""

    def star(parts):
        nodes, least = least_reachable(*(np.concatenate(x) for x in zip(*parts)))
        below = nodes != least
        return nodes[below], least[below]

    held, n = [], 0
    for batch in batches:
        held.append((batch.column("u").to_numpy(), batch.column("v").to_numpy()))
        n += batch.num_rows
        if n > FOREST_LINKS:
            u, v = star(held)
            held, n = [(u, v)], len(u)
            if 2 * n > FOREST_LINKS:
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])
                held, n = [], 0
    if n:
        u, v = star(held)
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


def _settled(batches):
    parts = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches if b.num_rows]
    if parts:
        nodes, least = least_reachable(*(np.concatenate(x) for x in zip(*parts)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(least)], ["node", "component"])


def _least_neighbour(edges: DataFrame, name: str) -> DataFrame:
    """For each node the least id among itself and its neighbours; sums up before the shuffle."""
    return stage(edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).select(F.col("u").alias("k"), "m"), name)


def components(links: DataFrame, left: str, right: str, most: int = 40, in_one: int = FOREST_LINKS) -> DataFrame:
    """(node, component) for every node that has a link; component is the least node reachable.

    Links may be repeated and in either direction; loops and nulls mean nothing. What is left of the tasks' links goes to
    one task, if that is at most in_one links. Else each step writes its links to the shared folder, and nodes with
    many links are met by minima that are computed before rows are shuffled.
    """
    pairs = links.where(F.col(left) != F.col(right)).select(F.col(left).cast("long").alias("u"), F.col(right).cast("long").alias("v"))
    e = stage(pairs.mapInArrow(lean(_forest), "u long, v long"), "links")
    if e.count() <= in_one:
        return e.coalesce(1).mapInArrow(lean(_settled), "node long, component long")
    last = None
    for _ in range(most):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = _least_neighbour(both, "large")
        e = stage(both.join(m, both["u"] == m["k"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large_star")
        m = _least_neighbour(e, "small")
        joined = e.join(m, e["u"] == m["k"]).select("v", "m").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stage(joined.unionByName(m.select(F.col("k").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct(), "small_star")
        # A forest of stars has as many links as nodes below, and a root is nobody's child.
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == last:
            break
        last = tuple(now)
    else:
        raise RuntimeError("components did not settle")
    pairs = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return pairs.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
