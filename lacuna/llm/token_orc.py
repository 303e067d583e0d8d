"""Token ids as ORC (operator 4): stripes, integer run-length encoding, row indexes, Bloom filters on doc_id.

Documents are dealt into ranges of doc_id, each range is encoded and written in ascending order as one block
(an ORC file) of rows (doc_id, block, block_start, n_tokens, ids). ORC's writer encodes ids with its run-length
encoding and keeps minimum, maximum and Bloom filter of doc_id for every row group, so that a lookup of a few
ids reads a few stripes; large files are split by stripe among readers. A document's start is its start in its
block plus the lengths of the blocks before, of which there are as many as write tasks.

Null and empty texts hold the end id alone. Null doc_id sorts first. Repeated ids stay separate rows, ordered by
a hash of their text; equal rows are interchangeable. An empty table gives no files' rows. A very long text is one
row of its range; the other ranges don't wait for it. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import byte_letters
from .common import MEMO_BYTES, STEP_BYTES, Memo, bound_batches, kept, lean, parts_for, scratch, text_steps

END_ID = 2
#: Text bytes of a block, about.
BLOCK_BYTES = 64 << 20
#: Chunks of printable ASCII and Latin-1 letters: lower-casing and NFC are plain there.
PLAIN = re.compile("[\x21-\x7eÀ-ÖØ-öø-ÿ]+")
#: Whole texts of the same kind, with white space; "'s" and the like are words of the vocabulary's pattern.
PLAIN_TEXT = re.compile("[\x09-\x0d\x20-\x7eÀ-ÖØ-öø-ÿ]*")
WHITE = re.compile(rb"[\x20\x09-\x0d]")
NOT_PLAIN = bytes([*range(9), *range(14, 32), 127])
AFTER_APOSTROPHE = ((b"s",), (b"t",), (b"m",), (b"d",), (b"r", b"e"), (b"v", b"e"), (b"l", b"l"))
#: What ends a piece and what ends a text where many go to the encoder at once; plain texts hold neither.
PIECE_END, TEXT_END = 1, 2
SPACE, LETTER, DIGIT, OTHER, BREAK = range(5)
ORC = {
    "orc.compress": "ZSTD",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.row.index.stride": "1000",
    "orc.stripe.size": str(8 << 20),
    "orc.create.index": "true",
}


def _classes() -> np.ndarray:
    kind = np.full(256, OTHER, np.uint8)
    kind[[*range(9, 14), 32]] = SPACE
    kind[[*range(ord("a"), ord("z") + 1), *range(128, 256)]] = LETTER
    kind[ord("0") : ord("9") + 1] = DIGIT
    kind[TEXT_END] = BREAK
    return kind


CLASSES = _classes()


def plain_pieces(texts: list[bytes]) -> bytes:
    """The pieces of plain lower-case texts, each with PIECE_END behind, and TEXT_END after each text."""
    end = bytes([TEXT_END])
    b = np.frombuffer(end.join([*texts, b""]) + end * 2, np.uint8)  # two more, so that there is always what follows
    kind = CLASSES[b]
    last = (kind[1:] != kind[:-1]) | (kind[:-1] == DIGIT)
    # An apostrophe that starts a run of signs takes letters behind it along.
    at = np.flatnonzero(b[:-2] == ord("'"))
    at = at[(at == 0) | (kind[at - 1] != OTHER)]
    for letters in AFTER_APOSTROPHE:
        n = len(letters)
        found = at[np.logical_and.reduce([b[np.minimum(at + 1 + k, len(b) - 1)] == ord(x) for k, x in enumerate(letters)])]
        last[found], last[found + n] = False, True
    last &= (kind[:-1] != SPACE) & (kind[:-1] != BREAK)
    b, kind, last = b[:-2], kind[:-2], last[:-1]
    some = kind != SPACE
    return np.insert(b[some], np.flatnonzero(last[some]) + 1, PIECE_END).tobytes()


def _parts(text: bytes):
    """A long text in parts of about STEP_BYTES, cut before white space; words can be longer."""
    start = 0
    while found := WHITE.search(text, start + STEP_BYTES):
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


class WordCoder:
    """Ids of the vocabulary with word ends; white space is dropped, so chunks between it are encoded on their own.

    Plain texts go through the merges many at a time, other texts chunk by chunk, by the library where they must.
    """

    def __init__(self, path: str):
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path) as f:
            spec = json.load(f)
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        end = spec["model"]["end_of_word_suffix"]

        def raw(token: str) -> bytes:
            """A word's end is the byte 255, which is in no UTF-8 text."""
            closed = token.endswith(end)
            return bytes(letters[c] for c in (token[: -len(end)] if closed else token)) + b"\xff" * closed

        ranks = {bytes([b]): b for b in range(256)} | {bytes([b, 255]): 256 + b for b in range(256)}
        self.special_raw = [x.encode() for x in self.special]
        self.id_of = {b: vocab[c] for c, b in letters.items()} | {256 + b: vocab[c + end] for c, b in letters.items()}
        for i, (left, right) in enumerate(m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]):
            ranks[raw(left) + raw(right)] = 512 + i
            self.id_of[512 + i] = vocab[left + right]
        self.core = tiktoken.Encoding("words", pat_str=".+", mergeable_ranks=ranks, special_tokens={})._core_bpe
        # The same merges with PIECE_END as a word's end, for many pieces at once.
        self.many = tiktoken.Encoding("pieces", pat_str=r"\x02|[^\x01\x02]+\x01", mergeable_ranks={b.replace(b"\xff", b"\x01") if b[-1:] == b"\xff" and len(b) > 1 else b: r for b, r in ranks.items() if b != b"\x01\xff"}, special_tokens={})._core_bpe
        self.ids = np.zeros(512 + len(spec["model"]["merges"]), "<u4")
        self.ids[list(self.id_of)] = list(self.id_of.values())
        self.pieces, self.memo = Memo(self._piece, MEMO_BYTES // 2), Memo(self._chunk, MEMO_BYTES // 2)

    def _piece(self, piece: str) -> bytes:
        return np.array([self.id_of[r] for r in self.core.encode_single_piece(piece.encode() + b"\xff")], "<u4").tobytes()

    def _chunk(self, chunk: bytes) -> bytes:
        text = chunk.decode()
        if not PLAIN.fullmatch(text) or any(s in text for s in self.special):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        text = text.lower()
        return self.pieces[text] if text.isalpha() else b"".join(self.pieces.all(self.words.findall(text)))

    def encode(self, text: bytes) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return b"".join(self.memo.all(text.split()))


    def _plain(self, text: bytes) -> bytes | None:
        """The text in lower case if it is plain."""
        if any(s in text for s in self.special_raw):
            return None
        if text.isascii():
            return text.lower() if len(text.translate(None, NOT_PLAIN)) == len(text) else None
        words = text.decode()
        return words.lower().encode() if PLAIN_TEXT.fullmatch(words) else None

    def encode_all(self, texts: list[bytes]) -> list[bytes]:
        """The same for every text; plain ones share a call, and very long ones are cut at white space."""
        if len(texts) == 1 and len(texts[0]) > 2 * STEP_BYTES:
            return [b"".join(self._together([part])[0] for part in _parts(texts[0]))]
        return self._together(texts)

    def _together(self, texts: list[bytes]) -> list[bytes]:
        low = [self._plain(t) for t in texts]
        ranks = np.array(self.many.encode_ordinary(plain_pieces([t for t in low if t is not None]).decode()), np.int64)
        ends = np.flatnonzero(ranks == TEXT_END).tolist()
        ids, starts, k, out = self.ids[ranks], [0, *[e + 1 for e in ends]], 0, []
        for t, plain in zip(texts, low):
            if plain is None:
                out.append(self.encode(t))
            else:
                out.append(ids[starts[k] : ends[k]].tobytes())
                k += 1
        return out


def word_coder(path: str | None) -> WordCoder:
    """The worker's coder of a vocabulary file; by default the public one."""
    import public_tokenizers as vocabularies

    path = path or vocabularies.path("word_bpe_49k.json")
    return kept(f"words {path}", lambda: WordCoder(path))


def write(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = END_ID, blocks: int | None = None) -> None:
    """Writes the ids of every document, each with end_id behind, into ORC files in ascending doc_id order."""
    blocks = blocks or parts_for(docs, most=BLOCK_BYTES)
    ordered = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("h"), "text").repartitionByRange(blocks, "doc_id", "h").sortWithinPartitions("doc_id", "h")

    def run(batches):
        from pyspark import TaskContext

        coder, block, start = word_coder(vocabulary), TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4").tobytes()
        for part, texts in text_steps(batches):
            ids = [x + end for x in coder.encode_all(texts)]
            sizes = np.array([len(x) // 4 for x in ids], np.int64)
            starts = start + np.cumsum(sizes) - sizes
            start += int(sizes.sum())
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            arrays = [part.column("doc_id"), pa.array(np.full(len(sizes), block, np.int32)), pa.array(starts), pa.array(sizes), pa.ListArray.from_arrays(offsets, np.frombuffer(b"".join(ids), "<i4"))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "block", "block_start", "n_tokens", "ids"])

    bound_batches(docs.sparkSession)
    ordered.mapInArrow(lean(run, keeps=True), "doc_id long, block int, block_start long, n_tokens long, ids array<int>").write.options(**ORC).orc(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids of every document; filters on doc_id reach the files' indexes."""
    rows = spark.read.schema("doc_id long, block int, block_start long, n_tokens long, ids array<int>").orc(path)
    lengths = rows.groupBy("block").agg(F.sum("n_tokens").alias("length"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    offsets = lengths.select("block", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"))
    return rows.join(offsets, "block").select("doc_id", (F.col("offset") + F.col("block_start")).alias("start"), "n_tokens", "ids")


def digests(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the CRC-32 of the ids as little-endian unsigned 32-bit integers."""

    def run(batches):
        for batch in batches:
            lists = batch.column("ids")
            values, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            raw = memoryview(np.ascontiguousarray(values, "<i4")).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Writes the files into the shared folder and returns what is read back."""
    spark = docs.sparkSession
    path = scratch(spark, "token_orc")
    write(docs, path, vocabulary)
    return digests(read(spark, path))
