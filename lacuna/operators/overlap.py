"""Suppression of overlapping voids: who collides, and who is accepted in order of depth."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import materialise, require
from .spatial import image, reached_cells, with_cell


def touching(r: Column, other: Column, fraction: float, scale: float = 1.0) -> Column:
    """The distance under which two voids collide: scale * (r + r' - fraction * the smaller)."""
    return F.lit(scale) * (r + other - F.lit(fraction) * F.least(r, other))


def collisions(left: DataFrame, right: DataFrame, box: float, fraction: float, most: float, scale: float = 1.0, periodic: bool = True) -> DataFrame:
    """Colliding pairs: left's columns as they are, right's with the prefix o_. most: the largest radius on either side.

    Both have void_id, cx, cy, cz, r. Pairs come from cells, so the join is on equality.
    """
    require(0 <= fraction <= 1, f"the overlap fraction is {fraction}")
    reach = scale * 2 * most
    n = max(1, min(256, int(box / max(reach, box / 256))))
    a = reached_cells(left, F.lit(scale) * (F.col("r") + F.lit(most)), box, n, periodic)
    b = with_cell(right.select(*[F.col(c).alias(f"o_{c}") for c in right.columns]), box, n, ("o_cx", "o_cy", "o_cz"))
    df = a.join(b, "__cell").drop("__cell", "__reach")
    d2 = F.lit(0.0)
    for c in "xyz":
        d = F.col(f"c{c}") - F.col(f"o_c{c}")
        d2 = d2 + (image(d, box) if periodic else d) ** 2
    return df.where(F.sqrt(d2) < touching(F.col("r"), F.col("o_r"), fraction, scale))


def without_collisions(candidates: DataFrame, accepted: DataFrame, box: float, fraction: float, most: float, scale: float = 1.0, periodic: bool = True) -> DataFrame:
    """Candidates that collide with none of the accepted voids."""
    hit = collisions(candidates, accepted, box, fraction, most, scale, periodic).select("void_id").distinct()
    return candidates.join(hit, "void_id", "left_anti")


def accept_in_order(candidates: DataFrame, order: str, box: float, fraction: float, most: float, scale: float = 1.0, periodic: bool = True, rounds: int | None = None) -> DataFrame:
    """The candidates that a pass in ascending order accepts, each unless it collides with one accepted before.

    In every round the candidates that come before all their undecided neighbours are accepted, and those that collide
    with them are refused; what is left goes on, until nothing is undecided. Equal order values are told apart by void_id.
    A round settles one candidate at least, as the first of the undecided waits for none. rounds: a bound that raises.
    """
    key = F.struct(F.col(order), F.col("void_id"))
    other = F.struct(F.col(f"o_{order}"), F.col("o_void_id"))
    pairs = collisions(candidates, candidates, box, fraction, most, scale, periodic).where("void_id <> o_void_id")
    edges = materialise(pairs.where(other < key).select("void_id", F.col("o_void_id").alias("before")))
    states = materialise(candidates.select("void_id", F.lit(None).cast("boolean").alias("taken")))
    for done in count(1):
        waiting = states.where("taken IS NULL").select("void_id")
        taken = states.where("taken").select(F.col("void_id").alias("before"))
        refused = edges.join(taken, "before").select("void_id").distinct()
        still = edges.join(waiting.withColumnRenamed("void_id", "before"), "before", "left_semi").select("void_id").distinct()
        new = waiting.join(refused.withColumn("no", F.lit(True)), "void_id", "left").join(still.withColumn("wait", F.lit(True)), "void_id", "left")
        new = new.select("void_id", F.when(F.col("no"), False).when(F.col("wait"), None).otherwise(True).alias("taken"))
        states = materialise(states.where("taken IS NOT NULL").unionByName(new))
        if states.where("taken IS NULL").isEmpty():
            break
        if done == rounds:
            raise RuntimeError(f"the order of acceptance did not settle in {rounds} rounds")
    return candidates.join(states.where("taken").select("void_id"), "void_id", "left_semi")


def accept_with_displacement(candidates: DataFrame, accepted: DataFrame, order: str, box: float, fraction: float, scale: float = 1.0, periodic: bool = True) -> DataFrame:
    """Accepted voids after a pass in order in which a candidate larger than all voids it collides with takes their place.

    The pass depends on its own outcome step by step, so one task makes it; only rows that survived the rung come here.
    """
    import numpy as np
    import pandas as pd

    names = ["void_id", "cx", "cy", "cz", "r", order]
    rows = accepted.withColumn("new", F.lit(0)).select(*names, "new").unionByName(candidates.withColumn("new", F.lit(1)).select(*names, "new")).withColumn("one", F.lit(1))

    def sweep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["new", order, "void_id"]).reset_index(drop=True)
        p, r = pdf[["cx", "cy", "cz"]].to_numpy(float), pdf["r"].to_numpy(float)
        live = np.zeros(len(pdf), bool)
        live[pdf["new"].to_numpy() == 0] = True
        for i in np.flatnonzero(pdf["new"].to_numpy() == 1):
            d = p[live] - p[i]
            if periodic:
                d -= box * np.round(d / box)
            hit = np.flatnonzero(live)[np.sqrt((d * d).sum(1)) < scale * (r[i] + r[live] - fraction * np.minimum(r[i], r[live]))]
            if len(hit) == 0 or r[hit].max() < r[i]:
                live[hit] = False
                live[i] = True
        return pdf[live][names]

    schema = rows.select(*names).schema
    return rows.groupBy("one").applyInPandas(sweep, schema)
