"""Near-duplicate embeddings by spherical k-means cells and blocked cosine products (operator 5).

Vectors meet only under one label, so every label has cells of its own: about a third of the square root of its
rows, fitted on a bounded sample. A vector is at home in the cell of its nearest centre. Two linked unit vectors
are at most sqrt(2 - 2t) apart, so if the bisector of two cells lies between them, one of them is within half of
that of the bisector; such vectors also visit the other cell. Every link is thus seen in some cell, and the
comparison is exact whatever the centres are. Neighbouring cells of a label share a bin, so that a vector travels once
for each bin, not for each cell, in the width of its column. A cell's residents are multiplied with its residents and
visitors; the rows of a large bin are cut into blocks of residents and of visitors, and each block of residents meets
all others. Each call gives its rows' numbers of links and a spanning forest of its links, not the links, and
components follow from the forests, which name one representative for each group.

Rows with a null label, and vectors that are null, zero, or have null or non-finite components, link with nothing;
vectors of different dimensions don't either. Repeated rows, also ones with equal ids, are vectors of their own.
A cosine equal to the bound links. A null vec_id counts as the smallest id. An empty table gives an empty one.
Columns other than vec_id, embedding and label, whatever their names, are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Ids, lean, lean_group, maybe_broadcast, partitions, stage
from .components import components

LEAST = 0.93
#: Rows that k-means sees at most, and centres of all labels together; labels beyond are one cell each.
SAMPLE = 8192
MOST_CENTRES = 8192
#: Rows of a block; a label of more rows has bins of about half as many.
BLOCK = 8192


def cells_for(rows: int) -> int:
    """Cells of a label."""
    return max(1, math.isqrt(rows) // 3)


def fit_centres(x: np.ndarray, k: int, steps: int = 12, seed: int = 5) -> np.ndarray:
    """Spherical k-means on unit vectors."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(steps):
        home = np.argmax(x @ c.T, 1)
        sums = np.zeros_like(c)
        np.add.at(sums, home, x)
        norm = np.linalg.norm(sums, axis=1)
        c = np.where(norm[:, None] > 1e-9, sums / np.maximum(norm, 1e-9)[:, None], c)
    return c


def _units(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, their vectors as they are, unit vectors in double precision) of the usable vectors, for each dimension."""
    kind = pa.float32() if column.type.value_type == pa.float32() else pa.float64()
    lists = column.cast(pa.list_(kind))
    values, offsets = lists.values, lists.offsets.to_numpy()
    flat = values.to_numpy(zero_copy_only=False)  # null components become NaN
    start, width = offsets[:-1], np.diff(offsets)
    width = np.where(lists.is_valid().to_numpy(zero_copy_only=False), width, 0)
    out = []
    for w in np.unique(width[width > 0]).tolist():
        rows = np.flatnonzero(width == w)
        x = flat[start[rows][:, None] + np.arange(w)]
        big = np.abs(x).max(1)
        good = np.isfinite(big) & (big > 0)
        if good.any():
            out.append((rows[good], x[good], _normed(x[good])))
    return out


def _normed(x: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision."""
    x = x.astype(float)
    x /= np.abs(x).max(1)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


def _visits(x: np.ndarray, c: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Each row's home, and rows x cells: whether the row lies within reach / 2 of the bisector between its home and the cell."""
    scores = x @ c.T
    home = np.argmax(scores, 1)
    gaps = np.sqrt(np.maximum(2 - 2 * c @ c.T, 0))
    out = scores[np.arange(len(home)), home][:, None] - scores <= reach / 2 * gaps[home] + 1e-9
    out[np.arange(len(home)), home] = False
    return home, out


def _bins(c: np.ndarray, k: int) -> np.ndarray:
    """A bin, of at most k, for each cell: as many cells to a bin, neighbours along the direction in which centres differ most."""
    k = min(k, len(c))
    rank = np.argsort(np.argsort((c - c.mean(0)) @ np.linalg.svd(c - c.mean(0), full_matrices=False)[2][0], kind="stable"))
    return rank * k // len(c)


def _centres(usable: DataFrame, sample: int, block: int) -> dict[tuple[str, int], tuple[np.ndarray, np.ndarray]]:
    """Centres and their cells' bins by label and dimension, for labels of several cells; MOST_CENTRES vectors in all."""
    counts = usable.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") >= 36).orderBy(F.desc("n"), "label").limit(MOST_CENTRES // 2).collect()
    wanted, left = {}, MOST_CENTRES
    bins = {r["label"]: 1 if r["n"] <= block else -(-2 * r["n"] // block) for r in counts}
    for r in counts:
        wanted[r["label"]] = min(cells_for(r["n"]), left)
        left -= wanted[r["label"]]
    some = usable.orderBy(F.xxhash64("uid")).limit(sample).select("label", "embedding").toArrow() if wanted else None
    out = {}
    if some is not None and some.num_rows:
        labels = np.array(some.column("label").to_pylist(), object)
        for rows, _, x in _units(some.column("embedding").combine_chunks()):
            for label in sorted(set(labels[rows])):
                if wanted.get(label, 0) > 1:
                    c = fit_centres(x[labels[rows] == label], wanted[label])
                    out[label, x.shape[1]] = c, _bins(c, bins[label])
    return out


def links(vectors: DataFrame, least: float = LEAST, sample: int = SAMPLE, block: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(uid, n_links) and (a, b), a spanning forest of the links; vectors: uid long, label, embedding."""
    spark, block = vectors.sparkSession, block or BLOCK
    reach = float(np.sqrt(2 - 2 * least))
    usable = vectors.where(F.col("label").isNotNull() & F.col("embedding").isNotNull()).select("uid", F.col("label").cast("string").alias("label"), "embedding")
    sent = spark.sparkContext.broadcast(_centres(usable, sample, block))

    def assign(wide: bool):
        """(label, bin, guest, ...) for each bin that a vector is sent to; bin: dimension and number, guest: at home in another."""

        def run(batches):
            for batch in batches:
                ids, labels = batch.column("uid").to_numpy(), np.array(batch.column("label").to_pylist(), object)
                for rows, raw, x in _units(batch.column("embedding")):
                    w = x.shape[1]
                    for label in sorted(set(labels[rows])):
                        mine = labels[rows] == label
                        # A label or dimension that has no centres is one cell.
                        c, bin_of = sent.value.get((label, w), (np.eye(1, w), np.zeros(1, np.int64)))
                        home, visits = _visits(x[mine], c, reach)
                        lists = np.stack([(visits[:, bin_of == b]).any(1) | (bin_of[home] == b) for b in range(bin_of.max() + 1)], 1)
                        at, number = np.nonzero(lists)
                        names = [f"{w}:{b}" for b in range(lists.shape[1])]
                        arrays = [pa.array([label] * len(at)), pa.array([names[b] for b in number.tolist()], pa.string()), pa.array(bin_of[home[at]] != number)]
                        if wide:
                            bits = [b.tobytes() for b in np.packbits(visits, 1)]
                            raws = [v.tobytes() for v in raw[mine]]
                            arrays += [pa.array(ids[rows[mine]][at]), pa.array(home[at].astype(np.int32)), pa.array([bits[i] for i in at.tolist()], pa.binary()), pa.array([raws[i] for i in at.tolist()], pa.binary())]
                        yield pa.RecordBatch.from_arrays(arrays, ["label", "bin", "guest", "uid", "home", "visits", "vector"][: len(arrays)])

        return lean(run)

    # Blocks of the bins that have several; counted first, so that vectors travel once.
    sizes = usable.mapInArrow(assign(False), "label string, bin string, guest boolean").groupBy("label", "bin").agg(F.count_if(~F.col("guest")).alias("own"), F.count_if("guest").alias("guests")).where(F.col("own") + F.col("guests") > block)
    blocks = [F.ceil(F.col(c) / block).cast("int").alias(f"{c}_blocks") for c in ("own", "guests")]
    sizes = stage(sizes.select(F.col("label").alias("k_label"), F.col("bin").alias("k_bin"), *blocks), "bin_sizes")
    rows = usable.mapInArrow(assign(True), "label string, bin string, guest boolean, uid long, home int, visits binary, vector binary")
    rows = rows.join(maybe_broadcast(sizes), (F.col("label") == F.col("k_label")) & (F.col("bin") == F.col("k_bin")), "left")
    h, n, m = F.xxhash64("uid"), F.coalesce("own_blocks", F.lit(1)), F.coalesce("guests_blocks", F.lit(0))
    # Blocks of residents come first; visitors meet these alone.
    rows = rows.withColumns({"own": F.when(F.col("guest") & (m > 0), n + F.pmod(h, m)).otherwise(F.pmod(h, F.greatest(n, F.lit(1)))).cast("int"), "met": F.when(F.col("guest") & (m > 0), n).otherwise(n + m)})
    rows = rows.withColumn("other", F.explode(F.when(F.col("met") > 0, F.sequence(F.lit(0), F.col("met").cast("int") - 1))))
    rows = rows.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})

    def compare(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        bin_, i, j = (k.as_py() for k in key[1:])
        w = int(bin_.split(":")[0])
        uid, home, own = (table.column(c).to_numpy() for c in ("uid", "home", "own"))
        raw = b"".join(table.column("vector").to_pylist())
        x = _normed(np.frombuffer(raw, np.float32 if len(raw) == 4 * w * len(uid) else np.float64).reshape(-1, w))
        visits = np.unpackbits(np.frombuffer(b"".join(table.column("visits").to_pylist()), np.uint8).reshape(len(uid), -1), axis=1)
        guest = table.column("guest").to_numpy()
        count, root, forest = np.zeros(len(uid), np.int64), np.arange(len(uid)), []

        def find(a):
            while root[a] != a:
                root[a] = root[root[a]]
                a = root[a]
            return a

        def meet(hosts: np.ndarray, others: np.ndarray, number: int) -> None:
            """Residents of a cell with residents and visitors of it."""
            y = x[others]
            for s in range(0, len(hosts), 256):
                a = hosts[s : s + 256]
                a_, b_ = np.nonzero(x[a] @ y.T >= least)
                a, b = a[a_], others[b_]
                # A pair from two cells may meet in both; the cell of the smaller number has it then. Residents meet once.
                resident = home[b] == number
                once = np.where(resident, (own[a] != own[b]) | (a < b), (number < home[b]) | (visits[a, home[b]] == 0))
                a, b = a[once], b[once]
                count[:] += np.bincount(a, minlength=len(uid)) + np.bincount(b, minlength=len(uid))
                for p, q in zip(a.tolist(), b.tolist()):
                    if root[p] == root[q]:
                        continue
                    p0, q0 = find(p), find(q)
                    if p0 != q0:
                        root[max(p0, q0)] = min(p0, q0)
                        forest.append((uid[p], uid[q]))

        for number in np.unique(home[~guest]).tolist():
            resident, visitor = home == number, (home != number) & (visits[:, number] == 1)
            meet(np.flatnonzero(resident & (own == i)), np.flatnonzero((resident | visitor) & (own == j)), number)
            if i != j:
                meet(np.flatnonzero(resident & (own == j)), np.flatnonzero(visitor & (own == i)), number)
        some = np.flatnonzero(count)
        a = np.concatenate([uid[some], np.array([f[0] for f in forest], np.int64)])
        b = np.concatenate([np.full(len(some), -1), np.array([f[1] for f in forest], np.int64)])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "n": pa.array(np.concatenate([count[some], np.zeros(len(forest), np.int64)]), pa.int64())})

    met = stage(rows.select("label", "bin", "i", "j", "guest", "uid", "home", "own", "visits", "vector").groupBy("label", "bin", "i", "j").applyInArrow(lean_group(compare), "a long, b long, n long"), "cell_links")
    return met.where("b < 0").groupBy(F.col("a").alias("uid")).agg(F.sum("n").alias("n_links")), met.where("b >= 0").select("a", "b")


def deduplicate(vectors: DataFrame, least: float = LEAST, block: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    keys = Ids(vectors, "vec_id")
    rows = stage(vectors.select(keys.key.alias("vec_id"), "embedding", "label").withColumn("uid", F.monotonically_increasing_id()), "vectors")
    counts, forest = links(rows, least, block=block)
    groups = stage(components(forest, "a", "b"), "groups")
    ids = rows.select("uid", "vec_id")
    members = ids.join(groups, ids["uid"] == groups["node"])
    firsts = members.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    found = stage(members.select("uid", "component").join(firsts, "component").select(F.col("uid").alias("k"), "component_id"), "members")
    out = ids.join(counts, "uid", "left").join(found, ids["uid"] == found["k"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(keys.back("vec_id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), keys.back(component).alias("component_id"), (F.col("vec_id") == component).alias("kept"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))
), u AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS norm FROM v WHERE list_dot_product(e, e) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.93),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(least(a, b)) AS c FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(c, vec_id) AS component_id, coalesce(c, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id
"""
