"""BPE encoding and decoding by forced-boundary splitting (operator 10).

A pair of adjacent bytes that occurs inside no token of the vocabulary can never be merged across, so a
token ends between them wherever they meet. Texts are cut at all such pairs where the pre-tokenizer keeps no
context, either; each distinct fragment is encoded once per memo, and the ids are concatenated. Texts with special
tokens, or white space beyond ASCII, which the pre-tokenizer reads with context, go to the library whole.

Null and empty texts give no ids. Repeated rows give equal rows. Very long texts are cut like others;
fragments without a cut inside may be long and are encoded whole. An empty table gives an empty one. Other
columns, whatever their names, are not read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, bound_batches, kept, lean, text_steps

SPACES = b"\t\n\x0b\x0c\r "
#: White space outside ASCII, in UTF-8.
WIDE_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 stands for itself, the rest follows from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def forced_pairs(tokens) -> np.ndarray:
    """256 x 256: whether no token holds the one byte followed by the other."""
    forced = np.ones((256, 256), bool)
    for token in tokens:
        b = np.frombuffer(token, np.uint8)
        forced[b[:-1], b[1:]] = False
    return forced


class Coder:
    """Encodes and decodes with one vocabulary file; one per worker."""

    def __init__(self, path: str, ranks_path: str | None = None, pattern: str | None = None):
        self.path, self._library = path, None
        with open(path) as f:
            spec = json.load(f)
        letters = byte_letters()
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special = [s.encode() for s in special]
        self.bytes_of = {i: bytes(letters[c] for c in t) for t, i in spec["model"]["vocab"].items() if t not in special}
        del spec
        self.forced = forced_pairs(self.bytes_of.values())
        self.bytes_of |= {i: s.encode() for s, i in special.items()}
        self.fast = None
        if ranks_path:
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("fragments", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.cuts = self._cuts()
        #: Ids by fragment, and the few fragments that read otherwise when decoded.
        self.memo, self.odd = Memo(self._entry), {}

    @property
    def library(self):
        """The tokenizers library's own coder, once a text needs it."""
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
            self._library.no_truncation()
            self._library.no_padding()
        return self._library

    def _cuts(self) -> np.ndarray:
        """For every pair of bytes, as a number, whether texts are cut in it: forced pairs that begin white space, or lie outside it.

        Inside a word never before an apostrophe: at the start of a part it would open a contraction, while in the whole it
        may belong to the punctuation before it. All else in the pre-tokenizer's pattern reads the same after a cut. A cut
        stands before a whole character.
        """
        byte = np.arange(256)
        blank = np.isin(byte, list(SPACES))
        begins = blank | (((byte & 0xC0) != 0x80) & (byte != ord("'")))
        return (self.forced & ~blank[:, None] & begins[None, :]).ravel()

    def fragments(self, text: bytes) -> list[bytes]:
        """The text's parts between forced cuts."""
        b = np.frombuffer(text, np.uint8)
        at = (np.flatnonzero(self.cuts[b[:-1].astype(np.uint16) << 8 | b[1:]]) + 1).tolist()
        return [text[i:j] for i, j in zip([0, *at], [*at, len(text)])] if len(text) else []

    def _ids(self, fragment: bytes) -> list[int]:
        if self.fast is None:
            return self.library.encode(fragment.decode(), add_special_tokens=False).ids
        return self.fast.encode_ordinary(fragment.decode())

    def _entry(self, fragment: bytes) -> bytes:
        ids = self._ids(fragment)
        decoded = b"".join(map(self.bytes_of.__getitem__, ids))
        if decoded != fragment:
            self.odd[fragment] = decoded
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: bytes) -> tuple[bytes, bytes]:
        """The ids as little-endian unsigned 32-bit integers, and what they decode to, in UTF-8."""
        if WIDE_SPACE.search(text) or any(s in text for s in self.special):
            ids = self.library.encode(text.decode(), add_special_tokens=False).ids
            return np.array(ids, "<u4").tobytes(), self.decode(ids)
        if len(self.odd) > 10_000:
            self.memo, self.odd = Memo(self._entry), {}
        fragments = self.fragments(text)
        ids = b"".join(self.memo.all(fragments))
        # Fragments are decoded when they are first met; all but the odd ones give themselves.
        return ids, _utf8(b"".join([self.odd.get(f, f) for f in fragments])) if self.odd else text

    def decode(self, ids) -> bytes:
        return _utf8(b"".join([self.bytes_of[int(i)] for i in ids]))


def _utf8(raw: bytes) -> bytes:
    try:
        raw.decode()
    except UnicodeDecodeError:
        return raw.decode(errors="replace").encode()
    return raw


def coder(path: str | None) -> Coder:
    """The worker's coder of a vocabulary file; by default the public one."""
    import public_tokenizers as vocabularies

    if path is None:
        return kept("bpe", lambda: Coder(vocabularies.path("byte_bpe_50k.json"), vocabularies.path("byte_bpe_50k.tiktoken"), vocabularies.PATTERN))
    return kept(f"bpe {path}", lambda: Coder(path))


def encode(docs: DataFrame, path: str | None = None, keep_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and with keep_ids the ids and the decoded text, for every document.

    path: a byte-level BPE file of the tokenizers library; by default the public one with 50k tokens, whose
    fragments are encoded with the equal ranks of tiktoken. Ids outside the vocabulary don't occur.
    """
    bound_batches(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep_ids

    def run(batches):
        c = coder(path)
        for part, texts in text_steps(batches):
            ids, decoded = zip(*map(c.encode, texts))
            sizes = np.array([len(x) // 4 for x in ids], np.int64)
            columns = [part.column("doc_id"), pa.array(sizes), pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(x).hexdigest() for x in decoded])]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                columns += [pa.ListArray.from_arrays(offsets, np.frombuffer(b"".join(ids), "<i4")), pa.array([x.decode() for x in decoded])]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run, keeps=True), schema)
