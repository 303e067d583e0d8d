"""Sums over the tracers within several distances of each centre, without a row for each pair.

The box is cut into blocks; a block's tracers meet the centres whose spheres touch it, in one task. There a tree of halves
settles whole nodes: one that lies inside a limit adds its sums, one outside adds nothing, and only leaves that a
limit cuts are compared tracer by tracer. A crowded block is dealt in pieces, whose sums add up.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import require
from .spatial import cell_key, reached_cells, with_cell

LEAF = 160
PIECE = 1 << 20
# Pairs that are compared, and places that meet a node, at a time: what a core's cache holds.
PAIRS, STEP = 1 << 16, 1 << 13


def _image(d, box):
    return d - box * np.floor(d / box + 0.5)


def _images(c, reach2, low, high, box):
    """Rows of c and places of them, or of their periodic images, whose spheres touch the tracers' bounds."""
    base = c - box * np.floor(c / box) if box else c
    rows, places = [], []
    for shift in np.ndindex(*[3 if box else 1] * 3):
        at = base + (np.array(shift) - 1.0) * box if box else base
        gap = np.maximum(0.0, np.maximum(low - at, at - high))
        near = np.flatnonzero((gap * gap).sum(1) <= reach2 * (1 + 1e-9))
        rows.append(near)
        places.append(at[near])
    return np.concatenate(rows), np.concatenate(places)


def _exact(x, c, box):
    """Squared distances as the plans' expressions give them, to the last bit."""
    d = x - c
    if box:
        d = _image(d, box)
    return d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2]


class _Tree:
    """Tracers of one block, in the order of a tree of halves, and sums of their columns w within limits around places."""

    def __init__(self, xyz, w, box):
        order, self.cuts = np.arange(len(xyz)), {}
        at = (xyz - box * np.floor(xyz / box) if box else xyz).T.copy()
        self._deal(at, order, 0, len(xyz))
        self.box, self.order, self.orig, self.at, self.w = box, order, xyz[order], at.T.copy(), w[order]
        # Sums of few small whole numbers are exact in single precision, too.
        small = (np.abs(w).max(initial=0.0) * LEAF < 1 << 24) and bool((w == np.rint(w)).all())
        dtype = np.float32 if small else np.float64
        # Columns of ones are counted, not weighed.
        self.columns = [None if LEAF < 256 and (c == 1).all() else np.ascontiguousarray(c, dtype) for c in self.w.T]
        self.weighed = any(c is not None for c in self.columns)
        # Arrays that all nodes share: fresh ones of this size would cost more than what is done in them.
        self.bounded = np.empty((4, STEP), np.float32)
        over, hit, near = (np.empty(PAIRS, kind) for kind in (np.float32, bool, bool))
        self.pairs = over, hit, near, over if small else np.empty(PAIRS, dtype)  # once hits are known, over is free
        self.mid = (at.min(1) + at.max(1)) / 2

    def _deal(self, at, order, start, stop):
        """Sorts places and order into halves along the longest side, down to leaves, and keeps each node's bounds."""
        x = at[:, start:stop]
        low, high = x.min(1), x.max(1)
        leaf = stop - start <= LEAF
        self.cuts[start, stop] = low, high, leaf
        if not leaf:
            half, axis = (stop - start) // 2, int(np.argmax(high - low))
            by = np.argpartition(x[axis], half)
            x[:], order[start:stop] = x[:, by], order[start:stop][by]
            self._deal(at, order, start, start + half)
            self._deal(at, order, start + half, stop)

    def bounds(self):
        return self.at.min(0), self.at.max(0)

    def sums(self, c, rows, places, limits):
        """For each row of c and limit the sums of w over the tracers no further than the limit from its places."""
        m, k = limits.shape
        out = np.zeros((m, k, self.w.shape[1]))
        if not len(rows):
            return out
        self.c, self.t, self.place, self.k = c[rows], limits[rows].ravel(), places.T.copy(), k
        self.out = np.zeros((self.w.shape[1], len(self.t)))
        at = np.repeat((places - self.mid).astype(np.float32).T, k, 1)
        # What single precision may get wrong in a squared distance of this block.
        self.slack = np.float32(2e-6 * float((np.abs(places - self.mid).max() + np.abs(self.at - self.mid).max() + 1e-30) ** 2))
        self._visit(0, len(self.at), np.arange(len(self.t)), at, self.t.astype(np.float32))
        np.add.at(out, rows, self.out.T.reshape(len(rows), k, -1))
        return out

    def _visit(self, start, stop, rows, at, t):
        low, high, leaf = self.cuts[start, stop]
        mid, half = ((low + high) / 2 - self.mid).astype(np.float32), ((high - low) / 2).astype(np.float32)
        inside, cut = np.empty(len(rows), bool), np.empty(len(rows), bool)
        for i in range(0, len(rows), STEP):
            some = slice(i, min(i + STEP, len(rows)))
            off, gap, least, most = self.bounded[:, : some.stop - i]
            most.fill(self.slack)
            least.fill(-self.slack)
            for p, a, h in zip(at, mid, half):
                np.subtract(p[some], a, out=off)
                np.abs(off, out=off)
                np.subtract(off, h, out=gap)
                np.maximum(gap, 0, out=gap)
                np.multiply(gap, gap, out=gap)
                np.add(off, h, out=off)
                np.multiply(off, off, out=off)
                np.add(least, gap, out=least)
                np.add(most, off, out=most)
            np.less(most, t[some], out=inside[some])
            np.less_equal(least, t[some], out=cut[some])
        np.greater(cut, inside, out=cut)
        inside, cut = np.flatnonzero(inside), np.flatnonzero(cut)
        if len(inside):
            inside = rows[inside]
            for out, w in zip(self.out, self.w[start:stop].sum(0)):
                out[inside] += w
        if not len(cut):
            return
        rows = rows[cut]
        if leaf:
            return self._compare(start, stop, rows)
        at, t, half = at.take(cut, 1), t[cut], (stop - start) // 2
        self._visit(start, start + half, rows, at, t)
        self._visit(start + half, stop, rows, at, t)

    def _compare(self, start, stop, rows):
        # Single precision around the leaf's middle; what is nearer to the limit than its error is decided exactly.
        low, high, _ = self.cuts[start, stop]
        o, half = (low + high) / 2, (high - low) / 2
        u, n, t, centre = self.at[start:stop] - o, stop - start, self.t.take(rows), rows // self.k
        left, right = np.empty((n, 5), np.float32), np.empty((5, len(rows)), np.float32)
        vv = np.zeros(len(rows))
        for x, p, a in zip(right, self.place, o):
            v = p.take(centre)
            v -= a
            np.multiply(v, -2, out=x, casting="same_kind")
            v *= v
            vv += v
        rest = vv - t
        left[:, :3], left[:, 3], left[:, 4] = u, 1, (u * u).sum(1)
        right[3], right[4] = rest, 1
        error = np.float32(6e-7 * (np.abs(rest).max() + 2 * np.sqrt(vv.max() * (half @ half)) + half @ half) + 1e-30)
        sums = np.empty((len(self.columns), len(rows)))
        step = max(1, PAIRS // n)
        for i in range(0, len(rows), step):
            m = min(step, len(rows) - i)
            over, hit, near, part = (x[: n * m].reshape(n, m) for x in self.pairs)
            np.matmul(left, right[:, i : i + m], out=over)
            np.less_equal(over, -error, out=hit)
            np.less_equal(over, error, out=near)
            np.not_equal(hit, near, out=near)
            if near.any():
                a, b = np.divmod(np.flatnonzero(near), m)
                hit[a, b] = _exact(self.orig[start + a], self.c[centre[i + b]], self.box) <= t[i + b]
            if self.weighed:
                np.copyto(part, hit)
            for now, w in zip(sums, self.columns):
                now[i : i + m] = np.add.reduce(hit.view(np.uint8), axis=0, dtype=np.uint8) if w is None else w[start:stop] @ part
        for out, now in zip(self.out, sums):
            out[rows] += now

    def flows(self, c, rows, places, limits, vectors):
        """For each row of c and limit the sum of the vectors' components away from its places, between the limit and the one before."""
        out = np.zeros((len(c), limits.shape[1]))
        if len(rows):
            self.c, self.t, self.place, self.v = c[rows], limits[rows], places, vectors[self.order]
            self.out = np.zeros(self.t.shape)
            self._visit_flows(0, len(self.at), np.arange(len(rows)))
            np.add.at(out, rows, self.out)
        return out

    def _visit_flows(self, start, stop, rows):
        low, high, leaf = self.cuts[start, stop]
        off = np.abs(self.place[rows] - (low + high) / 2)
        gap, most = np.maximum(off - (high - low) / 2, 0.0), off + (high - low) / 2
        least, most = np.einsum("ij,ij->i", gap, gap), np.einsum("ij,ij->i", most, most)
        near = np.flatnonzero(least * (1 - 1e-12) <= self.t[rows, -1] + 1e-12)
        if not len(near):
            return
        rows = rows[near]
        if not leaf:
            half = start + (stop - start) // 2
            self._visit_flows(start, half, rows)
            self._visit_flows(half, stop, rows)
            return
        # The first limit that isn't below the leaf, and how many limits cut it; those with most cuts come first.
        t, least, most = self.t[rows], least[near] * (1 - 1e-9) - 1e-12, most[near] * (1 + 1e-9) + 1e-12
        first = (t < least[:, None]).sum(1)
        cuts = (t < most[:, None]).sum(1) - first
        order = np.argsort(-cuts, kind="stable")
        rows, first, cuts = rows[order], first[order], cuts[order]
        step = max(1, (1 << 16) // (stop - start))
        for i in range(0, len(rows), step):
            self._add_flows(start, stop, rows[i : i + step], first[i : i + step], cuts[i : i + step])

    def _add_flows(self, start, stop, rows, first, cuts):
        low, high, _ = self.cuts[start, stop]
        o = (low + high) / 2
        u, p, v = self.at[start:stop] - o, self.place[rows] - o, self.v[start:stop]
        pp = np.einsum("ij,ij->i", p, p)
        d2 = np.column_stack([-2 * p, np.ones(len(p)), pp]) @ np.vstack([u.T, (u * u).sum(1), np.ones(len(u))])
        along = np.column_stack([-p, np.ones(len(p))]) @ np.vstack([v.T, (u * v).sum(1)])
        # Near the place differences of large numbers lose digits; there they are taken one by one.
        scale = pp.max() + (u * u).sum(1).max() + 1e-30
        if d2.min() < 1e-4 * scale:
            a, b = np.divmod(np.flatnonzero(d2.ravel() < 1e-4 * scale), len(u))
            d = self.orig[start + b] - self.c[rows[a]]
            if self.box:
                d = _image(d, self.box)
            near = (d * d).sum(1)
            d2[a, b], along[a, b] = np.where(near > 0, near, np.inf), (d * v[b]).sum(1)  # at the place nothing goes away from it
        along /= np.sqrt(d2)
        ones, t, k = np.ones(len(u)), self.t[rows], self.t.shape[1]
        done = np.zeros(len(rows))
        for j in range(int(cuts.max())):
            m = int(np.searchsorted(-cuts, -j, side="left"))  # rows with more than j cuts
            limit = t[np.arange(m), first[:m] + j]
            over = d2[:m] - limit[:, None]
            hit = over <= 0
            np.abs(over, out=over)
            if over.min() <= 1e-13 * scale:
                a, b = np.divmod(np.flatnonzero(over.ravel() <= 1e-13 * scale), len(u))
                hit[a, b] = _exact(self.orig[start + b], self.c[rows[a]], self.box) <= limit[a]
            np.multiply(along[:m], hit, out=over)
            upto = over @ ones
            self.out[rows[:m], first[:m] + j] += upto - done[:m]
            done[:m] = upto
        last = first + cuts
        inside = last < k
        self.out[rows[inside], last[inside]] += (along @ ones - done)[inside]


def _matrix(table: pa.Table, names: list[str]) -> np.ndarray:
    return np.column_stack([table.column(c).to_numpy().astype(float) for c in names]) if names else np.zeros((len(table), 0))


def sums_within(centres: DataFrame, tracers: DataFrame, limits: Column, n_limits: int, box: float, most_reach: float, weights: tuple[str, ...] = (), key: str = "void_id", periodic: bool = True, flow: tuple[str, ...] = (), reach: Column | None = None, spread: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """key, n_0, n_1, ... and a <weight>_0, <weight>_1, ... for each weight: tracers whose squared distance is at most each limit.

    limits: squared distances of a centre, ascending, as an array of n_limits doubles; with spread, a double of which
    spread makes them in the tasks, none beyond the centre's reach. most_reach: the largest distance.
    Centres near no tracer have no row. Weights are finite; a null weighs nothing. flow: the three parts of a vector, whose
    component away from the centre is summed up between each limit and the one before, as flow_0, flow_1, ...
    """
    require(box > 0 and most_reach > 0, "box and reach must be positive")
    require(not periodic or 2 * most_reach < box, "a sphere reaches around the box")
    n = max(1, min(8, int(2 * box / most_reach)))
    sized = centres.select(key, "cx", "cy", "cz", limits.alias("__t"), (F.sqrt(F.element_at(limits, -1)) if reach is None else reach).alias("__far"))
    left = reached_cells(sized, F.col("__far") * (1 + 1e-9), box, n, periodic).drop("__reach", "__far")
    right = tracers.select("x", "y", "z", *weights, *flow).where("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL")
    if periodic:
        wrapped = [F.least(F.floor(F.pmod(c, F.lit(box)) / F.lit(box / n)), F.lit(n - 1)).cast("int") for c in "xyz"]
        right = right.withColumn("__cell", cell_key(*wrapped, n))
    else:
        right = with_cell(right, box, n)
    # At most 512 numbers: how many pieces a block's tracers make.
    counts = {r["__cell"]: r["count"] for r in right.groupBy("__cell").count().collect()}
    crowds, total = {c: -(-k // PIECE) for c, k in counts.items()}, sum(counts.values())
    pieces = F.element_at(F.create_map(*[F.lit(v).cast(t) for c, k in crowds.items() for v, t in ((c, "long"), (k, "int"))]), F.col("__cell")) if crowds else F.lit(1)
    left = left.where(F.col("__cell").isin(list(crowds))).withColumn("__piece", F.explode(F.sequence(F.lit(0), pieces - 1)))
    right = right.withColumn("__piece", F.pmod(F.xxhash64("x", "y", "z"), pieces).cast("int") if crowds else F.lit(0))
    # Small tables in a few tasks, large ones in so many that pieces seldom share one.
    tasks = max(1, min(2000, 8 * sum(crowds.values()), max(total >> 15, 2 * tracers.sparkSession.sparkContext.defaultParallelism)))
    names = [f"n_{k}" for k in range(n_limits)] + [f"{w}_{k}" for w in weights for k in range(n_limits)] + [f"flow_{k}" for k in range(n_limits) if flow]
    dtype = dict(centres.dtypes)[key]
    schema = f"{key} {dtype}, " + ", ".join(f"{c} double" for c in names)
    wrap = box if periodic else None

    def block(a: pa.Table, b: pa.Table) -> pa.Table:
        if not len(a) or not len(b):
            return pa.table({key: a.column(key).slice(0, 0), **{c: pa.array([], pa.float64()) for c in names}})
        w = np.column_stack([np.ones(len(b)), np.nan_to_num(_matrix(b, list(weights)))])
        tree = _Tree(_matrix(b, ["x", "y", "z"]), w, wrap)
        c = _matrix(a, ["cx", "cy", "cz"])
        t = a.column("__t")
        t = spread(t.to_numpy()) if spread else t.combine_chunks().flatten().to_numpy().reshape(len(a), n_limits)
        places = _images(c, t[:, -1], *tree.bounds(), wrap)
        out = tree.sums(c, *places, t)
        some = out[:, -1, 0] > 0
        cols = {f"n_{k}": out[some, k, 0] for k in range(n_limits)}
        cols |= {f"{w}_{k}": out[some, k, 1 + i] for i, w in enumerate(weights) for k in range(n_limits)}
        if flow:
            flows = tree.flows(c, *places, t, np.nan_to_num(_matrix(b, list(flow))))
            cols |= {f"flow_{k}": flows[some, k] for k in range(n_limits)}
        return pa.table({key: a.column(key).filter(pa.array(some)), **cols})

    by = ["__cell", "__piece"]
    met = left.repartition(tasks, *by).groupBy(*by).cogroup(right.repartition(tasks, *by).groupBy(*by)).applyInArrow(block, schema)
    sums = met.groupBy(key).agg(*[F.sum(c).alias(c) for c in names])
    return sums.withColumns({f"n_{k}": F.col(f"n_{k}").cast("long") for k in range(n_limits)})
