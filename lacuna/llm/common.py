"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import shutil
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Text bytes that a Python worker holds unpacked at a time.
STEP_BYTES = 1 << 20
#: Bytes of a batch that goes to a Python worker; an executor holds several at a time outside its heap.
ARROW_BYTES = 8 << 20
#: Bytes of a worker's memo tables, counting keys, values and ENTRY_BYTES each; what is forgotten costs time only.
MEMO_BYTES = 24 << 20
ENTRY_BYTES = 180
#: Longer keys aren't kept in memo tables.
LONG_KEY = 1024
#: Largest relation, in rows, that is sent to every executor; larger ones are shuffled.
BROADCAST_ROWS = 200_000

_own_root: dict[str, str] = {}
_scratch: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; a temporary one only if that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set: a cluster's executors need a folder that they share")
        app = spark.sparkContext.applicationId
        if app not in _own_root:
            _own_root[app] = tempfile.mkdtemp(prefix="lacuna-")
            atexit.register(shutil.rmtree, _own_root[app], True)
        root = "file://" + _own_root[app]
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    folder = f"{shared_root(spark)}/lacuna-{uuid.uuid4().hex}"
    _scratch.append(folder)
    return f"{folder}/{name}"


def release(spark: SparkSession, since: int = 0, keep: int = 0) -> int:
    """Deletes what this driver has written into the shared folder so far; results that still read it must have been saved.

    since: how many of the first folders stay; keep: how many of the last.
    """
    Path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    gone = _scratch[since : len(_scratch) - keep]
    del _scratch[since : len(_scratch) - keep]
    for name in gone:
        folder = Path(name)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    return len(gone)


def written() -> int:
    """How many folders this driver has written so far and not released."""
    return len(_scratch)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back, which ends its lineage."""
    spark = df.sparkSession
    path = scratch(spark, name)
    bound_batches(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bound_batches(spark: SparkSession) -> None:
    """From now on rows go to Python workers in batches of at most ARROW_BYTES, or fewer if the session says so.

    It stays set, as results that are read later need it, too.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, None)
    if now is None or not now.isdigit() or not 0 < int(now) <= ARROW_BYTES:
        spark.conf.set(name, str(ARROW_BYTES))


def maybe_broadcast(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Marks df for broadcast if it has few enough rows; beyond that the join shuffles. df should be staged."""
    if rows is None:
        rows = df.count()
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df.hint("merge")


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


class Ids:
    """Whole numbers for the ids of a column, in their order and with null as the smallest, so that joins keep null ids.

    Null is -2^63. Where the column holds that number, too, ids up to the first gap above it move up by one. Looking at
    the column takes one pass over it alone.
    """

    LEAST = -(2**63)

    def __init__(self, df: DataFrame, name: str):
        self.id, self.gap, self.nulls = F.col(name).cast("long"), None, True
        rows = df.select(self.id.alias("id"))
        least, self.nulls = rows.agg(F.min("id"), F.count_if(F.col("id").isNull()) > 0).first()
        if least == self.LEAST and self.nulls:
            low = rows.where(F.col("id") <= self.LEAST + rows.count()).distinct()
            self.gap = low.select((F.col("id") + 1).alias("id")).join(low, "id", "left_anti").agg(F.min("id")).first()[0]

    @property
    def key(self) -> Column:
        if not self.nulls:
            return self.id
        up = self.id if self.gap is None else F.when(self.id < F.lit(self.gap), self.id + 1).otherwise(self.id)
        return F.coalesce(up, F.lit(self.LEAST))

    def back(self, key: str | Column) -> Column:
        key = F.col(key) if isinstance(key, str) else key
        if not self.nulls:
            return key
        down = key if self.gap is None else F.when(key <= F.lit(self.gap), key - 1).otherwise(key)
        return F.when(key != F.lit(self.LEAST), down)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df hasn't, made of the given ones."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def parts_for(df: DataFrame, text: str = "text", most: int = 32 << 20) -> int:
    """Partitions for a shuffle of what follows from df's texts: as many as the session says, or more, for most bytes of input each.

    The size is that of df's files, by Spark's statistics, or is counted where Spark doesn't know it.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > 1 << 60:
        size = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(1, partitions(df.sparkSession), -(-size // most))


def utf8(column: pa.Array) -> list[bytes]:
    """The values of a string column as bytes; null is empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def steps(sizes: np.ndarray, most: int = STEP_BYTES):
    """Slices of consecutive rows of about most bytes together; a larger row stands alone."""
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and total + n > most:
            yield slice(start, i)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield slice(start, len(sizes))


def text_steps(batches, text: str = "text", most: int = STEP_BYTES):
    """(batch slice, its texts as bytes) in steps of bounded size."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(text)
        sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        for s in steps(sizes, most):
            part = batch.slice(s.start, s.stop - s.start)
            yield part, utf8(part.column(text))


_kept: dict[str, object] = {}


def kept(name: str, make: Callable[[], object]):
    """What a worker keeps from task to task under a name. Another operator's goes first, as workers are used again."""
    if name not in _kept:
        _kept.clear()
        give_back()
        _kept[name] = make()
    return _kept[name]


def forget() -> None:
    """Drops what kept() holds. A function of its own, as workers get this module's functions by name but copies of its variables."""
    _kept.clear()


def give_back() -> None:
    """Returns freed memory to the system; else a worker goes on holding the most that any of its tasks needed."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def lean(run, keeps: bool = False):
    """A function on batches that leaves its worker without other operators' tables and without freed memory."""

    @functools.wraps(run)
    def wrapped(batches):
        if not keeps:
            forget()
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def lean_group(run):
    """The same for a function on the groups of applyInArrow."""

    def wrapped(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        try:
            return run(key, table)
        finally:
            give_back()

    return wrapped


class Memo:
    """A function's results by key, in two generations of half the bytes each: when the young one is full, the old one goes."""

    def __init__(self, make: Callable[[bytes], bytes], most: int = MEMO_BYTES):
        self.make, self.half, self.held = make, most // 2, 0
        self.young: dict = {}
        self.old: dict = {}

    def __getitem__(self, key):
        found = self.young.get(key)
        if found is None:
            found = self.old.get(key)
            if found is None:
                found = self.make(key)
            if len(key) <= LONG_KEY:
                self.held += len(key) + len(found) + ENTRY_BYTES
                if self.held > self.half:
                    self.old, self.young, self.held = self.young, {}, 0
                self.young[key] = found
        return found

    def all(self, keys: list) -> list:
        found = list(map(self.young.get, keys))
        if None in found:
            for i, x in enumerate(found):
                if x is None:
                    found[i] = self[keys[i]]
        return found


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def mix2(a: np.ndarray, b: np.ndarray, salt: int = 0) -> np.ndarray:
    """One 64-bit id for an ordered pair of ids."""
    return mix(mix(a + np.uint64(0x9E3779B97F4A7C15 + salt & (2**64 - 1))) + b * np.uint64(0xD6E8FEB86659FD93))
