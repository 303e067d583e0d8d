"""Particle, grid and catalogue files: read in ranges by tasks, written as a folder of whole files, one by each task.

Paths may be of any store that pyarrow knows by its scheme; bare paths are local. Nothing is read whole on the driver
but headers.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..core import CatalogueError, require

CHUNK = 1 << 20  # rows of a task

# Layouts of the two binary formats, whose headers have 64 bytes.
FIELD_MAGIC, FIELD_HEADER = b"XFLD", "<4sIQdIIII24x"
GRID_MAGIC, GRID_HEADER = b"XGRD", "<4sIIIQdIIQQI4x"
VERSION = 2
CONTENTS = ["empty", "density", "density contrast"]


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def open_input(path: str):
    store, inner = _store(path)
    return store.open_input_file(inner)


def open_output(path: str):
    store, inner = _store(path)
    store.create_dir(inner.rpartition("/")[0], recursive=True)
    return store.open_output_stream(inner, compression=None)


def listed(path: str | list[str], suffix: str = "") -> list[str]:
    """Files of a path, a folder, or a list of them, in order."""
    from pyarrow import fs

    out = []
    for p in [path] if isinstance(path, str) else path:
        store, inner = _store(p)
        info = store.get_file_info(inner)
        require(info.type != fs.FileType.NotFound, f"{p} doesn't exist")
        if info.type == fs.FileType.Directory:
            scheme = p[: len(p) - len(inner)] if p.endswith(inner) else ""
            found = store.get_file_info(fs.FileSelector(inner))
            out += sorted(scheme + f.path for f in found if f.type == fs.FileType.File and f.path.endswith(suffix) and not f.base_name.startswith(("_", ".")))
        else:
            out.append(p)
    return out


def _ranged(spark: SparkSession, jobs: list[tuple], schema: str, read) -> DataFrame:
    """A row range a job: read(*job) gives a RecordBatch. Jobs are (json arguments, first row, rows)."""
    if not jobs:
        return spark.createDataFrame([], schema)
    plan = spark.createDataFrame([(json.dumps(j),) for j in jobs], "job string").repartition(min(len(jobs), 4096))

    def run(batches):
        for batch in batches:
            for job in batch.column("job").to_pylist():
                yield read(*json.loads(job))

    return plan.mapInArrow(run, schema)


def _ranges(n: int, size: int = CHUNK):
    return [(i, min(size, n - i)) for i in range(0, n, size)]


# --- particle fields -------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class FieldHeader:
    n: int
    box: float
    weights: bool
    velocities: bool
    double: bool
    crc: int

    @property
    def columns(self) -> list[str]:
        return ["x", "y", "z"] + ["vx", "vy", "vz"] * self.velocities + ["w"] * self.weights

    @property
    def dtype(self) -> str:
        return "<f8" if self.double else "<f4"


def read_field_header(path: str) -> FieldHeader:
    with open_input(path) as f:
        raw = f.read(64)
    require(len(raw) == 64, f"{path} is too short for a header")
    magic, version, n, box, w, v, double, crc = struct.unpack(FIELD_HEADER, raw)
    require(magic == FIELD_MAGIC and version in (1, VERSION), f"{path} isn't a particle field")
    return FieldHeader(n, box, bool(w), bool(v), bool(double), crc)


def read_field(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """idx, x, y, z and, if the files have them, velocities and w; idx counts over the files in order."""
    files = [(p, read_field_header(p)) for p in listed(path, ".xfield")]
    require(bool(files) and len({tuple(h.columns) for _, h in files}) == 1, "the files have different columns")
    columns, jobs, start = files[0][1].columns, [], 0
    for p, h in files:
        jobs += [(p, h.n, h.dtype, start, a, k) for a, k in _ranges(h.n)]
        start += h.n

    def read(p, n, dtype, base, first, k):
        size = np.dtype(dtype).itemsize
        with open_input(p) as f:
            parts = [np.frombuffer(f.read_at(k * size, 64 + (c * n + first) * size), dtype).astype(float) for c in range(len(columns))]
        require(all(len(x) == k for x in parts), f"{p} is cut short")
        return pa.RecordBatch.from_arrays([pa.array(base + first + np.arange(k)), *[pa.array(x) for x in parts]], ["idx", *columns])

    return _ranged(spark, jobs, "idx long, " + ", ".join(f"{c} double" for c in columns), read)


def write_field(df: DataFrame, folder: str, box: float, double: bool = True) -> DataFrame:
    """Writes each partition of df as a whole file; returns path, n of the files."""
    columns = ["x", "y", "z"] + ["vx", "vy", "vz"] * ("vx" in df.columns) + ["w"] * ("w" in df.columns)
    dtype = "<f8" if double else "<f4"

    def run(batches):
        parts = [pa.RecordBatch.from_arrays(b.columns, b.schema.names) for b in batches]
        n = sum(b.num_rows for b in parts)
        if not n:
            return
        path, crc = f"{folder}/part-{uuid.uuid4().hex}.xfield", 0
        blocks = [np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in parts]).astype(dtype).tobytes() for c in columns]
        for b in blocks:
            crc = zlib.crc32(b, crc)
        with open_output(path) as f:
            f.write(struct.pack(FIELD_HEADER, FIELD_MAGIC, VERSION, n, box, int("w" in columns), int("vx" in columns), int(double), crc))
            for b in blocks:
                f.write(b)
        yield pa.RecordBatch.from_pydict({"path": [path], "n": pa.array([n], pa.int64())})

    from ..core import materialise

    return materialise(df.select(*[F.col(c).cast("double").alias(c) for c in columns]).mapInArrow(run, "path string, n long"))


def _crc(path: str, start: int) -> int:
    crc = 0
    with open_input(path) as f:
        f.seek(start)
        while piece := f.read(1 << 22):
            crc = zlib.crc32(piece, crc)
    return crc


# --- grids -----------------------------------------------------------------------------------------------------


def write_grid(grid: DataFrame, folder: str, n: int, box: float, content: str = "density", scheme: int = 0) -> str:
    """Writes a dense grid (ix, iy, iz, value) as one file, plane by plane in order, by one task."""
    path = f"{folder}/grid-{uuid.uuid4().hex}.xgrid"
    planes = grid.groupBy("ix").agg(F.transform(F.sort_array(F.collect_list(F.struct("iy", "iz", "value"))), lambda s: s["value"]).alias("v")).coalesce(1).sortWithinPartitions("ix")
    require(content in CONTENTS, f"unknown content {content}")

    def run(batches):
        blocks = [np.asarray(v, "<f8").tobytes() for b in batches for v in b.column("v").to_pylist()]
        if sum(map(len, blocks)) != 8 * n**3:
            raise CatalogueError("the grid isn't dense")
        crc = 0
        for b in blocks:
            crc = zlib.crc32(b, crc)
        with open_output(path) as f:
            f.write(struct.pack(GRID_HEADER, GRID_MAGIC, VERSION, n, 1, n**3, box, crc, CONTENTS.index(content), 0, 0, scheme))
            for b in blocks:
                f.write(b)
        yield pa.RecordBatch.from_pydict({"path": [path]})

    return planes.mapInArrow(run, "path string").collect()[0][0]


def read_grid_header(path: str) -> dict:
    with open_input(path) as f:
        raw = f.read(64)
    require(len(raw) == 64 and raw[:4] == GRID_MAGIC, f"{path} isn't a grid")
    _, version, n, double, total, box, crc, content, k0, k1, scheme = struct.unpack(GRID_HEADER, raw)
    require(total == n**3 and version in (1, VERSION), f"{path} has a bad header")
    return {"n": n, "double": bool(double), "box": box, "crc": crc, "content": CONTENTS[content], "assignment": scheme & 255, "interlaced": bool(scheme >> 8 & 1)}


def read_grid(spark: SparkSession, path: str) -> DataFrame:
    """ix, iy, iz, value; a task reads some planes."""
    h = read_grid_header(path)
    n, dtype = h["n"], "<f8" if h["double"] else "<f4"

    def read(plane):
        size = np.dtype(dtype).itemsize
        with open_input(path) as f:
            v = np.frombuffer(f.read_at(n * n * size, 64 + plane * n * n * size), dtype).astype(float)
        require(len(v) == n * n, f"{path} is cut short")
        return pa.RecordBatch.from_arrays([pa.array(np.full(n * n, plane, np.int32)), pa.array(np.repeat(np.arange(n, dtype=np.int32), n)), pa.array(np.tile(np.arange(n, dtype=np.int32), n)), pa.array(v)], ["ix", "iy", "iz", "value"])

    return _ranged(spark, [(i,) for i in range(n)], "ix int, iy int, iz int, value double", read)


# --- text ------------------------------------------------------------------------------------------------------


def read_ascii(spark: SparkSession, path: str, columns: str, delimiter: str | None = None, skip_lines: int = 0) -> DataFrame:
    """Columns named by a string such as "x y z * w", or "x *3 w"; "*" skips one, "*3" three. A row that doesn't parse is an error.

    Lines that are empty or begin with # are left out.
    """
    names: list[str | None] = []
    for part in columns.split():
        names += [None] * int(part[1:] or 1) if part.startswith("*") else [part]
    wanted = [(i, c) for i, c in enumerate(names) if c]
    require(len({c for _, c in wanted}) == len(wanted) and wanted, f"bad columns {columns!r}")
    lines = spark.read.text(path)
    if skip_lines:
        head = [r[0] for r in lines.limit(skip_lines).collect()]
        lines = lines.where(~F.col("value").isin(head))
    text = F.trim("value")
    parts = F.split(text, r"\s+" if delimiter is None else f"\\s*\\Q{delimiter}\\E\\s*")
    rows = lines.where((text != "") & ~text.startswith("#")).select("value", parts.alias("p"))
    out = [F.expr(f"try_cast(p[{i}] AS DOUBLE)") for i, _ in wanted]
    bad = F.size("p") < len(names)
    for c in out:
        bad = bad | c.isNull()
    return rows.select(*[F.when(bad, F.raise_error(F.concat(F.lit("a line doesn't parse: "), F.col("value"))).cast("double")).otherwise(c).alias(n) for c, (_, n) in zip(out, wanted)])


def check_ascii(spark: SparkSession, path: str, columns: str, delimiter: str | None = None) -> DataFrame:
    """One row: lines, and how many have too few columns or a value that isn't a finite number."""
    width = sum(int(p[1:] or 1) if p.startswith("*") else 1 for p in columns.split())
    text = F.trim("value")
    parts = F.split(text, r"\s+" if delimiter is None else f"\\s*\\Q{delimiter}\\E\\s*")
    rows = spark.read.text(path).where((text != "") & ~text.startswith("#")).select(parts.alias("p"))
    number = F.exists(F.slice("p", 1, width), lambda s: s.try_cast("double").isNull() | F.isnan(s.try_cast("double")) | (F.abs(s.try_cast("double")) == float("inf")))
    return rows.agg(F.count("*").alias("n"), F.count_if(F.size("p") < width).alias("n_short"), F.count_if(number).alias("n_bad"))


def write_catalogue_ascii(voids: DataFrame, path: str, metadata: dict | None = None, sky: bool = False) -> None:
    """A folder of text: #n, metadata, a line of names, and a row for each void."""
    extra = ["footprint", "footprint_shell"] if "footprint" in voids.columns else []
    head = [f"#n={voids.count()}", *[f"#{k.lower()}={json.dumps(v)}" for k, v in (metadata or {}).items()], "#" + " ".join([*(("ra", "dec", "z", "r") if sky else ("cx", "cy", "cz", "r")), *extra])]
    lines = voids.select(F.concat_ws(" ", *[F.col(c).cast("string") for c in ("cx", "cy", "cz", "r", *extra)]).alias("value"), F.lit(1).alias("part"), F.monotonically_increasing_id().alias("at"))
    spark = voids.sparkSession
    first = spark.createDataFrame([(h, 0, i) for i, h in enumerate(head)], "value string, part int, at long")
    first.unionByName(lines).coalesce(1).sortWithinPartitions("part", "at").select("value").write.mode("overwrite").text(path)


def read_catalogue_ascii(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """void_id, cx, cy, cz, r and footprints, in the file's order of rows, and the metadata."""
    lines = spark.read.text(path)
    head = [r[0] for r in lines.where(F.col("value").startswith("#")).collect()]
    names = next((h[1:].split() for h in head if "=" not in h), None)
    require(names is not None, "the catalogue has no line of names")
    metadata = {k: json.loads(v) for k, v in (h[1:].split("=", 1) for h in head if "=" in h)}
    rows = read_ascii(spark, path, " ".join(names)).withColumn("void_id", F.monotonically_increasing_id())
    for a, b in (("ra", "cx"), ("dec", "cy"), ("z", "cz")):
        rows = rows.withColumnRenamed(a, b) if a in rows.columns else rows
    n = rows.count()
    require(metadata.get("n", n) == n, f"the header speaks of {metadata.get('n')} voids; there are {n}")
    return rows.select("void_id", *[c for c in rows.columns if c != "void_id"]), metadata


def write_profiles_ascii(profiles: DataFrame, path: str, columns: list[str]) -> None:
    """One line a void: void_id, then each column's bins in order."""
    wide = profiles.groupBy("void_id").agg(F.sort_array(F.collect_list(F.struct("bin", *columns))).alias("b"), F.count("*").alias("n"))
    values = F.concat(*[F.transform(F.col(f"b.{c}"), lambda v: v.cast("string")) for c in columns])
    n = wide.agg(F.max("n")).first()[0] or 0
    text = wide.select(F.concat_ws(" ", F.array(F.col("void_id").cast("string")), values).alias("value"), F.lit(1).alias("part"), "void_id")
    head = profiles.sparkSession.createDataFrame([("#" + " ".join(["void_id", *[f"{c}_{j}" for c in columns for j in range(n)]]), 0, None)], "value string, part int, void_id long")
    head.unionByName(text).coalesce(1).sortWithinPartitions("part", "void_id").select("value").write.mode("overwrite").text(path)


def read_profiles_ascii(spark: SparkSession, path: str) -> DataFrame:
    """void_id, bin and the columns, a row for each bin."""
    head = spark.read.text(path).where(F.col("value").startswith("#")).first()
    require(head is not None, "the profiles have no header")
    names = head[0][1:].split()
    wide = read_ascii(spark, path, " ".join(names))
    columns = list(dict.fromkeys(c.rpartition("_")[0] for c in names[1:]))
    n = (len(names) - 1) // len(columns)
    bins = F.array(*[F.struct(F.lit(j).alias("bin"), *[F.col(f"{c}_{j}").alias(c) for c in columns]) for j in range(n)])
    return wide.select(F.col("void_id").cast("long"), F.explode(bins).alias("b")).select("void_id", "b.*")


# --- raw binary ------------------------------------------------------------------------------------------------


def read_binary(spark: SparkSession, path: str, columns: str, precision: int = 32, layout: str = "rows", big_endian: bool = False, header_bytes: int = 0, n: int | None = None) -> DataFrame:
    """idx and the named columns of a file of bare floats, row by row or block by block; "*k" skips k values."""
    require(precision in (32, 64) and layout in ("rows", "blocks"), "bad precision or layout")
    names: list[str | None] = []
    for part in columns.split():
        names += [None] * int(part[1:] or 1) if part.startswith("*") else [part]
    dtype = np.dtype(f"{'>' if big_endian else '<'}f{precision // 8}")
    store, inner = _store(path)
    size = store.get_file_info(inner).size - header_bytes
    rows_, rest = divmod(size, dtype.itemsize * len(names))
    require(not rest and rows_ >= 0, f"{path} doesn't hold whole rows")
    wanted = [(i, c) for i, c in enumerate(names) if c]
    width, text = len(names), dtype.str

    def read(first, k):
        with open_input(path) as f:
            if layout == "rows":
                block = np.frombuffer(f.read_at(k * width * dtype.itemsize, header_bytes + first * width * dtype.itemsize), text).reshape(k, width)
                parts = [block[:, i].astype(float) for i, _ in wanted]
            else:
                parts = [np.frombuffer(f.read_at(k * dtype.itemsize, header_bytes + (i * rows_ + first) * dtype.itemsize), text).astype(float) for i, _ in wanted]
        return pa.RecordBatch.from_arrays([pa.array(first + np.arange(k)), *[pa.array(p) for p in parts]], ["idx", *[c for _, c in wanted]])

    return _ranged(spark, _ranges(rows_ if n is None else min(n, rows_)), "idx long, " + ", ".join(f"{c} double" for _, c in wanted), read)


# --- GADGET snapshots ------------------------------------------------------------------------------------------

GADGET_BLOCKS = ("POS", "VEL", "ID", "MASS")


def _gadget_blocks(path: str) -> tuple[dict, dict, str]:
    """Header, (start, bytes) of each block, and byte order of a snapshot file of format 1 or 2."""
    with open_input(path) as f:
        first = f.read_at(4, 0)
        order = next((o for o in "<>" if struct.unpack(o + "i", first)[0] in (8, 256)), None)
        require(order is not None, f"{path} isn't a snapshot")
        labelled = struct.unpack(order + "i", first)[0] == 8
        at, blocks, names, total = 0, {}, iter(("HEAD", *GADGET_BLOCKS)), f.size()
        while at < total:
            label = None
            if labelled:
                label = f.read_at(4, at + 4).decode().strip()
                at += 16
            raw = f.read_at(4, at)
            if len(raw) < 4:
                break
            size = struct.unpack(order + "I", raw)[0]
            require(f.read_at(4, at + 4 + size) == raw, f"{path} has a broken record")
            name = label or next(names, None)
            if name:
                blocks[name] = (at + 4, size)
            at += 8 + size
        require(blocks.get("HEAD", (0, 0))[1] == 256, f"{path} has no header")
        raw = f.read_at(256, blocks["HEAD"][0])
    v = struct.unpack(order + "6i6ddd2i6i2i4d", raw[:160])
    header = {"n": list(v[:6]), "mass_table": list(v[6:12]), "time": v[12], "redshift": v[13], "total": list(v[16:22]), "files": v[23], "box": v[24], "omega0": v[25], "omega_lambda": v[26], "hubble": v[27]}
    return header, blocks, order


def gadget_header(path: str) -> dict:
    return _gadget_blocks(listed(path)[0])[0]


def gadget_files(path: str, files: int) -> list[str]:
    """All files of a snapshot given by its first one, or by the name they share."""
    if files <= 1:
        return [path]
    base = path[: -len("." + path.rpartition(".")[2])] if path.rpartition(".")[2].isdigit() else path
    return [f"{base}.{i}" for i in range(files)]


def read_gadget(spark: SparkSession, path: str, ptype: int = 1, length: str = "kpc", velocities: bool = False, peculiar: bool = False, masses: bool = False) -> DataFrame:
    """idx, x, y, z (in Mpc), velocities and masses as w of one particle type, from all files of a snapshot."""
    require(length in ("kpc", "mpc") and 0 <= ptype < 6, "bad length or particle type")
    scale = 1e-3 if length == "kpc" else 1.0
    first = gadget_header(path)
    jobs, start = [], 0
    for p in gadget_files(path, first["files"]):
        h, blocks, order = _gadget_blocks(p)
        n, before, total = h["n"][ptype], sum(h["n"][:ptype]), sum(h["n"])
        if n:
            own_mass = h["mass_table"][ptype] == 0 and "MASS" in blocks
            mass_before = sum(k for t, k in enumerate(h["n"][:ptype]) if h["mass_table"][t] == 0)
            jobs += [(p, order, blocks, before, total, mass_before, own_mass and masses, start, a, k) for a, k in _ranges(n)]
        start += n
    factor = first["time"] ** 0.5 if peculiar else 1.0
    require(not peculiar or first["time"] > 0, "the scale factor isn't positive")
    weighted = masses and first["mass_table"][ptype] == 0
    names = ["x", "y", "z"] + ["vx", "vy", "vz"] * velocities + ["w"] * weighted

    def read(p, order, blocks, before, total, mass_before, own_mass, base, a, k):
        with open_input(p) as f:
            def vectors(name, by):
                at, size = blocks[name]
                item = size // (3 * total)
                return np.frombuffer(f.read_at(3 * item * k, at + 3 * item * (before + a)), f"{order}f{item}").reshape(k, 3).T.astype(float) * by

            parts = [*vectors("POS", scale)]
            if velocities:
                parts += [*vectors("VEL", factor)]
            if weighted:
                at, size = blocks["MASS"]
                item = 8 if size % 8 == 0 and size // 8 >= mass_before + a + k and blocks["POS"][1] // (3 * total) == 8 else 4
                parts.append(np.frombuffer(f.read_at(item * k, at + item * (mass_before + a)), f"{order}f{item}").astype(float))
        return pa.RecordBatch.from_arrays([pa.array(base + a + np.arange(k)), *[pa.array(x) for x in parts]], ["idx", *names])

    return _ranged(spark, jobs, "idx long, " + ", ".join(f"{c} double" for c in names), read)


def write_gadget(path: str, particles: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray | None]], box: float, time: float, mass_table=(0.0,) * 6, labelled: bool = False, files: tuple[int, int] = (0, 1), totals=None) -> None:
    """One snapshot file of small tables, for exchange and tests: {type: (positions, velocities, masses)}."""
    counts = [len(particles[t][0]) if t in particles else 0 for t in range(6)]
    head = struct.pack("<6i6ddd2i6i2i4d", *counts, *mass_table, time, 1 / time - 1, 0, 0, *(totals or counts), 0, files[1], box, 0.3, 0.7, 0.7)
    pos, vel = (np.concatenate([particles[t][i] for t in sorted(particles)]).astype("<f4").tobytes() for i in (0, 1))
    mass = np.concatenate([particles[t][2] for t in sorted(particles) if mass_table[t] == 0 and particles[t][2] is not None] or [np.zeros(0)]).astype("<f4").tobytes()
    ids = np.arange(1, sum(counts) + 1).astype("<u4").tobytes()
    with open_output(path) as f:
        for name, data in (("HEAD", head.ljust(256, b"\0")), ("POS", pos), ("VEL", vel), ("ID", ids), ("MASS", mass)):
            if labelled:
                f.write(struct.pack("<i4sii", 8, name.ljust(4).encode(), len(data) + 8, 8))
            f.write(struct.pack("<I", len(data)) + data + struct.pack("<I", len(data)))


# --- FITS tables -----------------------------------------------------------------------------------------------

_FITS = {"L": "i1", "B": "u1", "I": ">i2", "J": ">i4", "K": ">i8", "E": ">f4", "D": ">f8", "A": "S"}


def _cards(f, at: int) -> tuple[dict, int]:
    """The keywords of the header at a position, and where its data begin."""
    cards = {}
    while True:
        block = f.read_at(2880, at)
        require(len(block) == 2880, "the header is cut short")
        at += 2880
        for i in range(0, 2880, 80):
            card = block[i : i + 80].decode("ascii", "replace")
            name = card[:8].strip()
            if name == "END":
                return cards, at
            if card[8:10] == "= ":
                value = card[10:].strip()
                if value.startswith("'"):
                    cards[name] = value[1:].split("'")[0].rstrip()
                else:
                    value = value.split("/")[0].strip()
                    cards[name] = value == "T" if value in ("T", "F") else float(value) if any(c in value for c in ".ED") and value[:1] not in "TF" else int(value or 0)


def fits_tables(path: str) -> list[dict]:
    """name, rows, width, start, columns (name, format, offset) and keywords of every table in a file."""
    out, at = [], 0
    with open_input(path) as f:
        end = f.size()
        while at < end:
            cards, data = _cards(f, at)
            size = abs(cards.get("BITPIX", 8)) // 8 * cards.get("PCOUNT", 0)
            dims = [cards[f"NAXIS{i + 1}"] for i in range(cards.get("NAXIS", 0))]
            if dims:
                size = abs(cards["BITPIX"]) // 8 * (int(np.prod(dims)) + cards.get("PCOUNT", 0))
            if cards.get("XTENSION") == "BINTABLE":
                columns, offset = [], 0
                for i in range(cards["TFIELDS"]):
                    form = cards[f"TFORM{i + 1}"]
                    count, kind = int(form[:-1] or 1), form[-1]
                    columns.append((cards.get(f"TTYPE{i + 1}", f"COL{i + 1}"), kind, count, offset))
                    offset += count * (1 if kind == "A" else np.dtype(_FITS[kind]).itemsize)
                out.append({"name": cards.get("EXTNAME", ""), "rows": dims[1], "width": dims[0], "start": data, "columns": columns, "keys": cards})
            at = data + -(-size // 2880) * 2880
    return out


def read_fits(spark: SparkSession, path: str | list[str], columns: dict[str, str], where: str | None = None, hdu: str | int = 0, fraction: float = 1.0, seed: int = 0) -> DataFrame:
    """idx and columns by name, each an expression of the table's columns, of rows that pass `where`; subsampled exactly.

    hdu: a table's name or number. Vector columns are arrays. A value that isn't finite is an error, whether it would
    be subsampled or not.
    """
    import re

    files = listed(path)
    found = [(p, next((t for i, t in enumerate(fits_tables(p)) if hdu in (i, t["name"])), None)) for p in files]
    require(all(t for _, t in found), f"no table {hdu!r}")
    used = set(re.findall(r"\w+", " ".join([*columns.values(), where or ""])))
    names = [c for c in found[0][1]["columns"] if c[0] in used]
    jobs, start = [], 0
    for p, t in found:
        offsets = {c[0]: c for c in t["columns"]}
        require(all(c[0] in offsets for c in names), f"{p} lacks columns")
        jobs += [(p, t["start"], t["width"], [offsets[c[0]] for c in names], start, a, k) for a, k in _ranges(t["rows"])]
        start += t["rows"]
    kinds = {"A": "string", "L": "boolean", "E": "double", "D": "double"}

    def type_of(c):
        return kinds.get(c[1], "long") if c[1] == "A" or c[2] == 1 else f"array<{kinds.get(c[1], 'long')}>"

    def read(p, at, width, cols, base, a, k):
        with open_input(p) as f:
            raw = np.frombuffer(f.read_at(k * width, at + a * width), np.uint8).reshape(k, width)
        arrays = [pa.array(base + a + np.arange(k))]
        for _, kind, count, offset in cols:
            if kind == "A":
                arrays.append(pa.array([bytes(r).split(b"\0")[0].decode().rstrip() for r in raw[:, offset : offset + count]]))
                continue
            item = np.dtype(_FITS[kind]).itemsize
            v = np.ascontiguousarray(raw[:, offset : offset + count * item]).view(_FITS[kind])
            v = v == ord("T") if kind == "L" else v.astype(float if kind in "ED" else np.int64)
            arrays.append(pa.array(v[:, 0]) if count == 1 else pa.array(list(v)))
        return pa.RecordBatch.from_arrays(arrays, ["idx", *[c[0] for c in cols]])

    rows = _ranged(spark, jobs, ", ".join(["idx long", *[f"`{c[0]}` {type_of(c)}" for c in names]]), read)
    if where:
        rows = rows.where(where)
    rows = rows.select("idx", *[F.expr(e).cast("double").alias(k) for k, e in columns.items()])
    checks = [F.when(F.col(k).isNull() | F.isnan(k) | (F.abs(F.col(k)) == float("inf")), F.raise_error(F.concat(F.lit(f"{k} isn't finite in row "), F.col("idx").cast("string"))).cast("double")).otherwise(F.col(k)).alias(k) for k in columns]
    if fraction < 1:
        from ..operators.rows import exact_subsample

        rows = exact_subsample(rows.select("idx", *checks), fraction, ["idx"], seed=seed)
        return rows
    return rows.select("idx", *checks)


def write_fits(df: DataFrame, path: str, name: str = "TABLE", keys: dict | None = None) -> str:
    """One table of the numeric columns of a catalogue, written by one task."""
    columns = [c for c, t in df.dtypes if t in ("double", "float", "int", "bigint")]
    kinds = ["D" if t in ("double", "float") else "K" for c, t in df.dtypes if c in columns]

    def card(k, v):
        text = f"'{v}'" if isinstance(v, str) else ("T" if v else "F") if isinstance(v, bool) else repr(v).upper()
        return f"{k[:8]:<8}= {text:>20}".ljust(80).encode()

    def block(cards):
        raw = b"".join(cards) + b"END".ljust(80)
        return raw.ljust(-(-len(raw) // 2880) * 2880)

    def run(batches):
        parts = []
        for b in batches:
            rec = np.zeros(b.num_rows, [(c, _FITS[k]) for c, k in zip(columns, kinds)])
            for c in columns:
                rec[c] = b.column(c).to_numpy(zero_copy_only=False)
            parts.append(rec.tobytes())
        data, width = b"".join(parts), 8 * len(columns)
        head = [card("XTENSION", "BINTABLE"), card("BITPIX", 8), card("NAXIS", 2), card("NAXIS1", width), card("NAXIS2", len(data) // width), card("PCOUNT", 0), card("GCOUNT", 1), card("TFIELDS", len(columns)), card("EXTNAME", name)]
        for i, (c, k) in enumerate(zip(columns, kinds), 1):
            head += [card(f"TTYPE{i}", c), card(f"TFORM{i}", f"1{k}")]
        head += [card(k.upper(), v) for k, v in (keys or {}).items()]
        with open_output(path) as f:
            f.write(block([card("SIMPLE", True), card("BITPIX", 8), card("NAXIS", 0), card("EXTEND", True)]))
            f.write(block(head))
            f.write(data.ljust(-(-len(data) // 2880) * 2880, b"\0"))
        yield pa.RecordBatch.from_pydict({"path": [path]})

    df.select(*columns).coalesce(1).mapInArrow(run, "path string").collect()
    return path


def write_catalogue_fits(voids: DataFrame, path: str, metadata: dict | None = None) -> str:
    return write_fits(voids, path, "VOIDS", metadata)


def read_catalogue_fits(spark: SparkSession, path: str) -> DataFrame:
    names = [c[0] for c in fits_tables(path)[0]["columns"]]
    return read_fits(spark, path, {c: c for c in names if c != "void_id"}, hdu="VOIDS").withColumnRenamed("idx", "void_id")


def write_profiles_fits(profiles: DataFrame, path: str) -> str:
    """void_id, bin and the measured columns, a row for each bin."""
    return write_fits(profiles.withColumn("bin", F.col("bin").cast("long")), path, "PROFILES")


def read_profiles_fits(spark: SparkSession, path: str) -> DataFrame:
    table = fits_tables(path)[0]
    rows_ = read_fits(spark, path, {c[0]: c[0] for c in table["columns"]}, hdu="PROFILES").drop("idx")
    return rows_.withColumns({"void_id": F.col("void_id").cast("long"), "bin": F.col("bin").cast("int")})


def write_size_function_fits(table: DataFrame, path: str) -> str:
    return write_fits(table.withColumn("bin", F.col("bin").cast("long")), path, "SIZES")


def read_size_function_fits(spark: SparkSession, path: str) -> DataFrame:
    names = [c[0] for c in fits_tables(path)[0]["columns"]]
    return read_fits(spark, path, {c: c for c in names}, hdu="SIZES").drop("idx").withColumns({"bin": F.col("bin").cast("int"), "counts": F.col("counts").cast("long")})


def fits_key(path: str, key: str, hdu: int = 0):
    return fits_tables(path)[hdu]["keys"][key.upper()]


def set_fits_key(path: str, key: str, value, hdu: int = 0) -> None:
    """Replaces a keyword of a table's header, or adds it in the header's free space; the file is written anew."""
    table = fits_tables(path)[hdu]
    with open_input(path) as f:
        raw = bytearray(f.read())
    text = f"'{value}'" if isinstance(value, str) else ("T" if value else "F") if isinstance(value, bool) else repr(value).upper()
    card = f"{key.upper()[:8]:<8}= {text:>20}".ljust(80).encode()
    at = raw.rfind(b"END".ljust(80), 0, table["start"])
    start = raw.rfind(b"XTENSION=", 0, at)
    for i in range(start, at, 80):
        if raw[i : i + 10] == card[:10]:
            require((raw[i + 10 : i + 11] == b"'" or b"'" in raw[i + 10 : i + 80]) == isinstance(value, str), f"{key} is of another kind")
            raw[i : i + 80] = card
            break
    else:
        require(at + 160 <= table["start"], "the header has no free space")
        raw[at : at + 160] = card + b"END".ljust(80)
    with open_output(path) as f:
        f.write(bytes(raw))


# --- HDF5, if its library is there -----------------------------------------------------------------------------


def read_hdf5(spark: SparkSession, path: str | list[str], columns: dict[str, str], length_scale: float = 1.0, fraction: float = 1.0, seed: int = 0) -> DataFrame:
    """idx and columns by name, each a dataset's path, or path[k] for one of its columns; needs h5py on all executors."""
    import re

    import h5py

    specs = {k: re.fullmatch(r"(.+?)(?:\[(\d+)\])?", v).groups() for k, v in columns.items()}
    jobs, start = [], 0
    for p in listed(path):
        with h5py.File(p) as f:
            sizes = {f[d].shape[0] for d, _ in specs.values()}
        require(len(sizes) == 1, f"{p} has datasets of different lengths")
        n = sizes.pop()
        jobs += [(p, start, a, k) for a, k in _ranges(n)]
        start += n

    def read(p, base, a, k):
        parts = []
        with h5py.File(p) as f:
            for name, (d, i) in specs.items():
                v = np.asarray(f[d][a : a + k] if i is None else f[d][a : a + k, int(i)], float)
                parts.append(v * length_scale if name in "xyz" else v)
        return pa.RecordBatch.from_arrays([pa.array(base + a + np.arange(k)), *[pa.array(x) for x in parts]], ["idx", *specs])

    rows_ = _ranged(spark, jobs, "idx long, " + ", ".join(f"{c} double" for c in specs), read)
    if fraction < 1:
        from ..operators.rows import exact_subsample

        return exact_subsample(rows_, fraction, ["idx"], seed=seed)
    return rows_


# --- inspection ------------------------------------------------------------------------------------------------


def sniff(path: str) -> str:
    """What a file seems to be, from its first bytes."""
    with open_input(path) as f:
        head = f.read(4096)
    if head[:9] == b"SIMPLE  =":
        return "fits"
    if head[:4] in (FIELD_MAGIC, GRID_MAGIC):
        return {FIELD_MAGIC: "field", GRID_MAGIC: "grid"}[head[:4]]
    if len(head) >= 4 and any(struct.unpack(o + "i", head[:4])[0] in (8, 256) for o in "<>"):
        return "gadget"
    if head[:8] == b"\x89HDF\r\n\x1a\n":
        return "hdf5"
    if head[:4] == b"PAR1":
        return "parquet"
    odd = sum(b < 32 and b not in (9, 10, 13) for b in head)
    return "text" if b"\0" not in head and odd <= len(head) / 100 else "unknown"


def describe(path: str) -> dict:
    """A file's kind and, if it is known, its header or tables."""
    kind = sniff(path)
    if kind == "field":
        h = read_field_header(path)
        return {"kind": kind, "rows": h.n, "columns": h.columns, "box": h.box}
    if kind == "grid":
        return {"kind": kind, **read_grid_header(path)}
    if kind == "fits":
        return {"kind": kind, "tables": [{"name": t["name"], "rows": t["rows"], "columns": [c[0] for c in t["columns"]]} for t in fits_tables(path)]}
    if kind == "gadget":
        return {"kind": kind, **gadget_header(path)}
    return {"kind": kind}


def check(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """Column statistics of a field or grid file, and its problems."""
    from ..operators.rows import column_check

    kind, problems = sniff(path), []
    require(kind in ("field", "grid"), f"{path} is of kind {kind}, which has no check")
    h = read_field_header(path) if kind == "field" else None
    crc = h.crc if h else read_grid_header(path)["crc"]
    if crc and _crc(path, 64) != crc:
        problems.append("the checksum doesn't fit")
    df = read_field(spark, path) if h else read_grid(spark, path)
    stats = column_check(df, [c for c in df.columns if c not in ("idx", "ix", "iy", "iz")])
    for r in stats.where("n_nonfinite > 0").collect():
        problems.append(f"{r['n_nonfinite']} values of {r['name']} aren't finite")
    if h and h.box > 0:
        from ..operators.rows import outside_box

        if n := outside_box(df, h.box).count():
            problems.append(f"{n} rows lie outside the box")
    return stats, problems


def set_metadata(voids: DataFrame, metadata: dict) -> DataFrame:
    """Metadata kept with a catalogue's rows: an integer, a real number or text by lower-case key, in one map column."""
    for k, v in metadata.items():
        require(isinstance(v, (int, float, str)) and not isinstance(v, bool), f"{k} has a value of another kind")
    entries = [F.lit(x) for k, v in metadata.items() for x in (k.lower(), json.dumps(v))]
    return voids.withColumn("metadata", F.create_map(*entries) if entries else F.create_map().cast("map<string,string>"))


def get_metadata(voids: DataFrame, key: str, kind: type):
    row = voids.select(F.col("metadata")[key.lower()]).first()
    require(row is not None and row[0] is not None, f"there is no {key}")
    value = json.loads(row[0])
    require(isinstance(value, kind), f"{key} is {type(value).__name__}")
    return value


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """df with idx, a gapless number in the given order, from counts by sorted partition."""
    from ..core import materialise

    rows = materialise(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id()))
    counts = rows.groupBy("__p").agg(F.count("*").alias("n"))
    before = counts.select("__p", F.coalesce(F.sum("n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__b"))
    at = F.row_number().over(Window.partitionBy("__p").orderBy(*order)) - 1
    return rows.withColumn("__at", at).join(before, "__p").withColumn("idx", F.col("__at") + F.col("__b")).drop("__p", "__at", "__b")
