"""Web archives (operator 2): WARC records in Zstandard frames with a dictionary in a leading skippable frame.

Each write task makes archives of bounded size. An archive begins with a skippable frame that holds the
dictionary, trained on the archive's own first records; every record is a frame of its own behind it. The
reader streams an archive, loads the dictionary, decodes frame by frame, and checks version line, header fields,
lengths and digests; a record that fails a check raises ValueError.

Of records with equal payloads the one with the largest page_id is a response and the others are revisits of it.
Null html is an empty payload. Rows that repeat the largest page_id of their payload are all responses. A null
page_id stays null and never is the one referred to while its payload has another id. An empty table gives no
archives and no rows. Columns other than page_id, url and html are not read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import maybe_broadcast, partitions, scratch, stage, text_of, text_steps

#: Magic number of the skippable frame that holds a dictionary.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
DICTIONARY_BYTES = 16 << 10
#: Bytes of records from an archive's beginning that its dictionary is trained on.
TRAINING_BYTES = 1 << 20
ARCHIVE_BYTES = 64 << 20
READ_BYTES = 1 << 18
LEVEL = 6
DATE = "2024-01-01T00:00:00Z"


def roles(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, html (never null), refers_to (null for responses)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", text_of("html").alias("html"))
    rows = rows.withColumn("k", F.concat(F.sha1(F.col("html").cast("binary")), F.octet_length("html").cast("string")))
    groups = rows.where(F.octet_length("html") >= least).groupBy("k").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    groups = maybe_broadcast(stage(groups.select(F.col("k").alias("g"), "first"), "warc_groups"))
    joined = rows.join(groups, rows["k"] == groups["g"], "left")
    return joined.select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _id(page_id) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def record(page_id, url, html: bytes, refers_to) -> bytes:
    """One WARC record; a revisit keeps the HTTP header, whose Content-Length is the full payload's, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + html
    url = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha1:{base32(hashlib.sha1(html).digest())}",
        f"WARC-Block-Digest: sha1:{base32(hashlib.sha1(block).digest())}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_id(refers_to)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Archive:
    """Collects records and, once enough are there for a dictionary, writes them as frames."""

    def __init__(self, out):
        self.out, self.waiting, self.packer = out, [], None
        self.waiting_bytes = self.bytes = self.records = 0

    def add(self, raw: bytes):
        self.records += 1
        if self.packer:
            self._put(self.packer.compress(raw))
            return
        self.waiting.append(raw)
        self.waiting_bytes += len(raw)
        if self.waiting_bytes >= TRAINING_BYTES:
            self._start()

    def _put(self, data: bytes):
        self.out.write(data)
        self.bytes += len(data)

    def _start(self):
        import zstandard

        parts = [raw[i : i + 2048] for raw in self.waiting for i in range(0, min(len(raw), 8192), 2048)]
        words = None
        if len(parts) >= 64:
            try:
                words = zstandard.train_dictionary(DICTIONARY_BYTES, parts, level=LEVEL)
            except zstandard.ZstdError:
                words = None
        if words is None:  # too little or too uniform to train on: the first bytes themselves
            words = zstandard.ZstdCompressionDict(b"".join(parts)[:DICTIONARY_BYTES] or b"WARC/1.1\r\n", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        raw = words.as_bytes()
        self._put(struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw)
        self.packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=words, write_checksum=True, write_content_size=True)
        for x in self.waiting:
            self._put(self.packer.compress(x))
        self.waiting = []

    def close(self):
        if not self.packer:
            self._start()
        self.out.close()


def _open(path: str, mode: str):
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    return store.open_output_stream(inner, compression=None) if mode == "w" else store.open_input_stream(inner, compression=None)


def write(records: DataFrame, path: str) -> DataFrame:
    """Writes what roles() gives into archives under path; returns their names and counts, of tasks that succeeded only."""
    from pyspark.sql import SparkSession  # noqa: F401

    spark = records.sparkSession
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(folder)

    def run(batches):
        archive = name = None

        def done():
            archive.close()
            return pa.RecordBatch.from_pydict({"archive": [name], "records": pa.array([archive.records], pa.int64())})

        for part, texts in text_steps(batches, "html"):
            for page_id, url, html, refers_to in zip(part.column("page_id").to_pylist(), part.column("url").to_pylist(), texts, part.column("refers_to").to_pylist()):
                if archive is None:
                    name = f"{path}/{uuid.uuid4().hex}.warc.zst"  # another name each try: a lost task's file is never listed
                    archive = Archive(_open(name, "w"))
                archive.add(record(page_id, url, html, refers_to))
                if archive.bytes >= ARCHIVE_BYTES:
                    yield done()
                    archive = None
        if archive is not None:
            yield done()

    return stage(records.select("page_id", "url", "html", "refers_to").mapInArrow(run, "archive string, records long"), "warc_manifest")


def frames(stream):
    """(dictionary or None, then each record's bytes) of an archive, read piece by piece."""
    import zstandard

    head = stream.read(8)
    if len(head) < 8:
        raise ValueError("the archive is too short")
    magic, size = struct.unpack("<II", head)
    if magic != DICTIONARY_MAGIC:
        raise ValueError("the archive has no dictionary frame")
    raw = stream.read(size)
    if len(raw) != size:
        raise ValueError("the dictionary frame is cut short")
    if raw[:4] == FRAME_MAGIC:
        raw = zstandard.ZstdDecompressor().decompress(raw)
    trained = raw[:4] == b"\x37\xa4\x30\xec"
    words = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT)
    unpacker = zstandard.ZstdDecompressor(dict_data=words)
    rest = b""
    while True:
        one, parts = unpacker.decompressobj(), []
        started = False
        while not one.eof:
            piece = rest or stream.read(READ_BYTES)
            rest = b""
            if not piece:
                break
            started = True
            parts.append(one.decompress(piece))
        if not started:
            return
        if not one.eof:
            raise ValueError("a record's frame is cut short")
        rest = one.unused_data
        yield b"".join(parts)


def parse(raw: bytes) -> dict:
    """Fields of one record, checked."""
    head, gap, body = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not gap or lines[0] != "WARC/1.1":
        raise ValueError("not a WARC 1.1 record")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name or name.lower() in fields:
            raise ValueError(f"bad header line {line!r}")
        fields[name.lower()] = value.strip()
    if missing := {"warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest", "warc-block-digest"} - fields.keys():
        raise ValueError(f"missing {sorted(missing)}")
    if not fields["content-length"].isdigit() or len(body) != int(fields["content-length"]) + 4 or not body.endswith(b"\r\n\r\n"):
        raise ValueError("Content-Length doesn't fit the record")
    block = body[:-4]
    if fields["warc-block-digest"] != "sha1:" + base32(hashlib.sha1(block).digest()):
        raise ValueError("the block's digest doesn't fit")
    http, gap, payload = block.partition(b"\r\n\r\n")
    length = next((int(x.split(b":")[1]) for x in http.split(b"\r\n")[1:] if x.lower().startswith(b"content-length:")), None)
    kind = fields["warc-type"]
    if not gap or length is None or kind not in ("response", "revisit"):
        raise ValueError("bad HTTP header or record type")
    if kind == "response":
        if len(payload) != length or fields["warc-payload-digest"] != "sha1:" + base32(hashlib.sha1(payload).digest()):
            raise ValueError("the payload's length or digest doesn't fit")
    elif payload or "warc-refers-to" not in fields:
        raise ValueError("a revisit has a payload or refers to nothing")
    number = lambda x: int(x[len("<urn:x-page:") : -1]) if len(x) > len("<urn:x-page:>") else None
    return {
        "page_id": number(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "payload_bytes": length, "payload_digest": fields["warc-payload-digest"].removeprefix("sha1:"),
        "record_type": kind, "refers_to": number(fields["warc-refers-to"]) if kind == "revisit" else None, "payload": payload if kind == "response" else None,
    }


def read(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url, and payload (null for revisits) of every record."""
    spark = manifest.sparkSession
    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "url": pa.string()} | ({"payload": pa.binary()} if payloads else {})

    def run(batches):
        for batch in batches:
            for name, n in zip(batch.column("archive").to_pylist(), batch.column("records").to_pylist()):
                rows, held, seen = [], 0, 0
                with _open(name, "r") as stream:
                    for raw in frames(stream):
                        rows.append(parse(raw))
                        held, seen = held + len(raw), seen + 1
                        if held >= 1 << 20 or len(rows) >= 5000:
                            yield pa.RecordBatch.from_pydict({k: pa.array([r[k] for r in rows], t) for k, t in kinds.items()})
                            rows, held = [], 0
                if seen != n:
                    raise ValueError(f"{name} has {seen} records, not {n}")
                yield pa.RecordBatch.from_pydict({k: pa.array([r[k] for r in rows], t) for k, t in kinds.items()})

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string" + ", payload binary" * payloads
    return manifest.repartition(max(1, partitions(spark)), "archive").mapInArrow(run, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    path = scratch(pages.sparkSession, "warc")
    manifest = write(roles(pages), path)
    return read(manifest, payloads=False)


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
g AS (SELECT html, max(page_id) AS first FROM p GROUP BY html),
hexed AS (SELECT page_id, strlen(p.html)::BIGINT AS payload_bytes, sha1(p.html) AS h, first FROM p JOIN g ON p.html = g.html),
d AS (SELECT page_id, payload_bytes, first, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (
  list_sum(list_transform(range(5), lambda b: ((strpos('0123456789abcdef', substr(h, 1 + (i * 5 + b) // 4, 1)) - 1) // (1 << (3 - (i * 5 + b) % 4))) % 2 * (1 << (4 - b)))))::INT, 1)), '') AS payload_digest FROM hexed)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM d
"""
