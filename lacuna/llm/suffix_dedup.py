"""Removal of repeated byte strings by bucket-pointer refinement of suffix buckets (operator 8).

Suffixes are dealt into partitions by content, and in a partition their q-gram buckets are refined by sorting:

1. Of every DEPTH-byte window the GRAM-byte gram with the least id is its anchor; equal windows have equal anchors, so
   the suffixes that begin windows of one anchor are dealt to one task and others never have to meet. Windows in a row
   with one anchor form a run. Runs with the same anchor and class (ids of their first and last windows and their
   length) are equal: all but the earliest are repeats, and only the first goes on.
2. Where runs of different classes share an anchor, the bytes of their suffixes are sorted. All suffixes start in the
   buckets of their first eight bytes, and a pointer leads from each suffix to its bucket. A bucket is refined by the
   pointers found 8, then 16, then 32 bytes on, which by then tell just as many bytes apart, so each round's pointers
   serve the next; buckets of one suffix are left alone. After DEPTH bytes a bucket holds equal windows.
3. Anchors with more than GROUP runs are cut into pieces at random; each piece settles its own repeats, and the first
   windows of the pieces are compared by id across tasks.

Ids are 64 bits wide; runs are held equal if both their anchors' and their classes' ids are, and windows of cut anchors
if theirs are.

Null and empty texts have no bytes. Texts shorter than DEPTH lose nothing. A null doc_id is the smallest. Rows that
share a doc_id are told apart by a 64-bit id of their text and ordered by start alone; a string at an equal start is not
an earlier one, so repeated rows lose what one of them would lose. Long texts are scanned in pieces that overlap by
DEPTH - 1 bytes. An empty table gives an empty one. Columns other than doc_id and text, whatever their names, are not
read, and kept by cut().
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Ids, fresh, give_back, lean, maybe_broadcast, mix, parts_for, stage, text_steps

DEPTH = 100
GRAM = 32
#: Runs of one anchor that one task settles together, about.
GROUP = 2000
#: Runs that are sorted in one call, about.
BATCH = 4000
STEP = 1 << 18
#: Classes that a scanning task remembers as repeated.
REPEATED = 1 << 14
_ONE, _TWO, _THREE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
_COVERED = np.int64(-(2**63))


# --- runs ------------------------------------------------------------------------------------------------------


def _codes(raw: bytes) -> np.ndarray:
    """The first eight bytes of every suffix that has as many, as a number."""
    ids = np.frombuffer(raw, np.uint8).astype(np.uint64)
    for n in (1, 2, 4):
        ids = ids[:-n] | ids[n:] << np.uint64(8 * n)
    return ids


def _joined(ids: np.ndarray, step: int) -> np.ndarray:
    """One id for what two ids, step bytes apart, tell."""
    return mix(ids[:-step] * _ONE + ids[step:] * _TWO)


def window_ids(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all grams and windows; raw has DEPTH bytes at least."""
    ids = mix(_codes(raw))
    for n in (8, 16):
        ids = _joined(ids, n)
    return ids, _joined(_joined(ids, 32), DEPTH - 64)


def _least(ids: np.ndarray, width: int) -> np.ndarray:
    """The least of each width ids in a row."""
    n = 1
    while 2 * n <= width:
        ids = np.minimum(ids[:-n], ids[n:])
        n *= 2
    return np.minimum(ids[: len(ids) - (width - n)], ids[width - n :]) if width > n else ids


def _class(a: np.ndarray, b: np.ndarray, k: np.ndarray) -> np.ndarray:
    return mix(a * _ONE + b * _TWO + k.astype(np.uint64) * _THREE)


def runs(raw: bytes, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Text number, first window, number of windows, anchor's id and class of every run; ends: where texts end in raw."""
    if len(raw) < DEPTH:
        z = np.zeros(0, np.int64)
        return z, z, z, z, z
    grams, full = window_ids(raw)
    least = _least(grams, DEPTH - GRAM + 1)
    n = len(least)
    row = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))[:n]
    whole = np.arange(DEPTH, n + DEPTH) <= ends[row]
    new = np.ones(n, bool)  # another text, a smaller gram came in, or the anchor fell out
    new[1:] = (row[1:] != row[:-1]) | (least[1:] != least[:-1]) | (grams[: n - 1] == least[:-1])
    borders = np.append(np.flatnonzero(new | ~whole), n)
    first = borders[:-1]
    k = np.diff(borders)
    keep = whole[first]
    first, k = first[keep], k[keep]
    return row[first], first, k, least[first].view(np.int64), _class(full[first], full[first + k - 1], k).view(np.int64)


def _pack(lo, k) -> np.ndarray:
    """A run's place: its first window and their number, which is below 128."""
    return np.asarray(lo, np.int64) << 7 | np.asarray(k, np.int64)


def _pieces(batches):
    """(key, t, offset, bytes) of texts in steps of STEP bytes; longer texts come in pieces that have each window once."""
    for part, texts in text_steps(batches, most=STEP):
        key, t = part.column("key").to_numpy(), part.column("t").to_numpy()
        if len(texts) == 1 and len(texts[0]) > 2 * STEP:
            for s in range(0, len(texts[0]) - DEPTH + 1, STEP):
                yield key, t, np.array([s]), [texts[0][s : s + STEP + DEPTH - 1]]
        else:
            yield key, t, np.zeros(len(texts), np.int64), texts


def _firsts(changes: np.ndarray) -> np.ndarray:
    """For each row the index of the first row of its group; changes: whether rows from the second on begin one."""
    starts = np.concatenate([[True], changes])
    return np.maximum.accumulate(np.where(starts, np.arange(len(starts)), 0))


class _Repeated:
    """The earliest place so far of classes that a task has met several times in a step; the oldest go when there are many."""

    def __init__(self):
        z = np.zeros(0, np.int64)
        self.rows = (z, z, z, z)  # m, c, doc, lo, sorted by m and c
        self.key = np.zeros(0, np.uint64)

    @staticmethod
    def _key(m, c):
        return m.view(np.uint64) * _ONE + c.view(np.uint64) * _TWO

    def later(self, m, c, doc, lo) -> np.ndarray:
        """Whether each class is known from an earlier place."""
        if not len(self.key):
            return np.zeros(len(m), bool)
        at = np.minimum(np.searchsorted(self.key, self._key(m, c)), len(self.key) - 1)
        m0, c0, doc0, lo0 = (x[at] for x in self.rows)
        return (m0 == m) & (c0 == c) & ((doc0 < doc) | ((doc0 == doc) & (lo0 < lo)))

    def add(self, m, c, doc, lo) -> None:
        if not len(m):
            return
        m, c, doc, lo = (np.concatenate(x)[-REPEATED:] for x in zip(self.rows, (m, c, doc, lo)))
        key = self._key(m, c)
        order = np.lexsort((lo, doc, key))
        order = order[np.concatenate([[True], key[order][1:] != key[order][:-1]])]
        self.rows, self.key = (m[order], c[order], doc[order], lo[order]), key[order]


_FOUND = "m long, c long, doc long, t long, at long"


def _find(batches):
    """Runs of all texts. Of equal ones in a step only the earliest is compared further; the others are known to be repeats."""
    repeated = _Repeated()
    for keys, ts, offsets, texts in _pieces(batches):
        ends = np.cumsum([len(x) for x in texts])
        row, lo, k, m, c = runs(b"".join(texts), ends)
        if not len(lo):
            continue
        lo = lo - (ends - np.diff(ends, prepend=0))[row] + offsets[row]
        doc, t = keys[row], ts[row]
        order = np.lexsort((lo, doc, c, m))
        m, c, doc, t, lo, k = (x[order] for x in (m, c, doc, t, lo, k))
        first = _firsts((m[1:] != m[:-1]) | (c[1:] != c[:-1]))
        later = (doc != doc[first]) | (lo != lo[first])
        head = np.unique(first[later])  # first places of classes that came again
        later |= repeated.later(m, c, doc, lo)
        repeated.add(m[head], c[head], doc[head], lo[head])
        at = _pack(lo, k)
        m = np.where(later, mix(doc.view(np.uint64) + t.view(np.uint64)).view(np.int64), m)  # dealt out evenly
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (m, c, doc, t, np.where(later, at ^ _COVERED, at))], ["m", "c", "doc", "t", "at"])


_KINDS = "m long, doc long, t long, at long, kind int"


def _rows(m, doc, t, at, kind) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(x, np.int64)) for x in (m, doc, t, at)] + [pa.array(np.full(len(m), kind, np.int32))], ["m", "doc", "t", "at", "kind"])


def _classes(batches):
    """From runs sorted by (m, c, doc, at): kind 1, repeats; kind 0, first runs of classes whose anchor has more classes."""
    last = None  # of the rows so far: m, c, and the doc and start of the class's first run
    classes, waiting = 0, None  # of the last m: number of classes, its first runs while there is one class
    for batch in batches:
        m, c, doc, t, at = (batch.column(x).to_numpy() for x in ("m", "c", "doc", "t", "at"))
        done = at < 0
        if done.any():
            yield _rows(m[done], doc[done], t[done], at[done] ^ _COVERED, 1)
            m, c, doc, t, at = (x[~done] for x in (m, c, doc, t, at))
        if not len(m):
            continue
        lo = at >> 7
        if last is not None:  # the class's first run stands in front
            m, c, doc, lo = (np.concatenate([[v], x]) for v, x in zip(last, (m, c, doc, lo)))
            t, at = np.concatenate([[0], t]), np.concatenate([[0], at])
        own = int(last is not None)
        new_m = m[1:] != m[:-1]
        first = _firsts(new_m | (c[1:] != c[:-1]))
        later = (doc != doc[first]) | (lo != lo[first])
        begins = np.concatenate([[last is None], new_m | (c[1:] != c[:-1])])
        group = np.concatenate([[0], np.cumsum(new_m)])
        count = np.bincount(group, begins).astype(np.int64)
        if own:
            count[0] += classes
        if later.any():
            yield _rows(m[later], doc[later], t[later], at[later], 1)
        kept = ~later
        kept[:own] = False
        several = kept & (count[group] > 1)
        if several.any():
            yield _rows(m[several], doc[several], t[several], at[several], 0)
        if waiting and count[0] > 1:
            yield _rows(*waiting, 0)
            waiting = None
        end = len(m) - 1
        if group[end] > 0 or not own:
            waiting = None
        classes = int(count[group[end]])
        if classes == 1:
            same = kept & (group == group[end])
            more = (m[same], doc[same], t[same], at[same])
            waiting = more if waiting is None else tuple(np.concatenate(x) for x in zip(waiting, more))
            # Equal starts in one doc_id are the only rows to wait with the first, so this stays small.
        last = (m[end], c[end], doc[first[end]], lo[first[end]])


# --- refinement ------------------------------------------------------------------------------------------------


def _numbered(keys: np.ndarray) -> np.ndarray:
    """Bucket numbers in the keys' order, by sorting."""
    order = np.argsort(keys, kind="stable")
    found = keys[order]
    out = np.empty(len(keys), np.int64)
    out[order] = np.cumsum(np.concatenate([[False], found[1:] != found[:-1]])) if len(keys) else found
    return out


def refined(pointers: np.ndarray, step: int, n: int) -> np.ndarray:
    """Pointers of the first n suffixes to buckets that also tell apart the buckets pointed to step bytes on.

    Only the suffixes of buckets with several are sorted anew; a bucket alone gets a number of its own behind them.
    """
    own, later = pointers[:n], pointers[step : step + n]
    several = np.bincount(own)[own] > 1
    out = np.empty(n, np.int64)
    keys = own[several] * np.int64(len(pointers) + 1) + later[several]
    out[several] = _numbered(keys)
    alone = np.flatnonzero(~several)
    out[alone] = np.arange(len(alone)) + int(several.sum())
    return out


def bucket_pointers(raw: bytes) -> np.ndarray:
    """For each window of raw the number of its bucket: equal numbers mean DEPTH equal bytes, and nothing else does."""
    pointers = _numbered(_codes(raw))
    n = len(raw) - 7
    for step in (8, 16, 32):
        n -= step
        pointers = refined(pointers, step, n)
    return refined(pointers, DEPTH - 64, n - (DEPTH - 64))


def _contexts(batches):
    """The bytes of first runs that are to be compared window by window."""
    names = ["m", "salt", "doc", "t", "at", "bytes"]
    rows = []

    def packed():
        columns = list(zip(*rows))
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns[:-1]] + [pa.array(columns[-1], pa.binary())], names)

    for batch in batches:
        for part, texts in text_steps([batch]):
            for doc, t, text, found in zip(part.column("key").to_pylist(), part.column("t").to_pylist(), texts, part.column("found").to_pylist()):
                for x in found:
                    lo, k = x["at"] >> 7, x["at"] & 127
                    rows.append((x["m"], x["salt"], doc, t, x["at"], text[lo : lo + k + DEPTH - 1]))
                    if len(rows) == BATCH:
                        yield packed()
    if rows:
        yield packed()


def _settle(m, salt, doc, t, at, raws):
    """Kind 1: windows that occur earlier, as runs. Kind 2: first windows of anchors that are cut (salt > 0), by their ids."""
    raw = b"".join(raws)
    pointers = bucket_pointers(raw)
    k = at & 127
    size = np.array([len(r) for r in raws])
    starts = np.cumsum(size) - size
    which = np.repeat(np.arange(len(k)), k)
    inside = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
    place = starts[which] + inside
    bucket, doc_, t_, lo, cut = pointers[place], doc[which], t[which], (at[which] >> 7) + inside, salt[which] > 0
    order = np.lexsort((lo, doc_, bucket))
    bucket, doc_, t_, lo, cut, place = (x[order] for x in (bucket, doc_, t_, lo, cut, place))
    first = _firsts(bucket[1:] != bucket[:-1])
    later = (doc_ != doc_[first]) | (lo != lo[first])
    open_ = cut & ~later
    if open_.any():
        h = window_ids(raw)[1][place[open_]].view(np.int64)
        yield _rows(h, doc_[open_], t_[open_], _pack(lo[open_], 1), 2)
    doc_, t_, lo = doc_[later], t_[later], lo[later]
    if len(doc_):
        order = np.lexsort((lo, t_, doc_))
        doc_, t_, lo = doc_[order], t_[order], lo[order]
        begins = np.concatenate([[True], (doc_[1:] != doc_[:-1]) | (t_[1:] != t_[:-1]) | (lo[1:] > lo[:-1] + 1)])
        begins |= (np.arange(len(lo)) - _firsts(begins[1:])) % 64 == 0
        at_ = np.flatnonzero(begins)
        yield _rows(np.zeros(len(at_)), doc_[at_], t_[at_], _pack(lo[at_], lo[np.append(at_[1:], len(lo)) - 1] - lo[at_] + 1), 1)


def _compare(batches):
    """Settles runs with their bytes, sorted by (m, salt), a few thousand at a time, without parting those of one (m, salt)."""
    held = None
    for batch in batches:
        rows = [batch.column(x).to_numpy() for x in ("m", "salt", "doc", "t", "at")] + [np.array(batch.column("bytes").to_pylist() + [None], object)[:-1]]
        if held is not None:
            rows = [np.concatenate(x) for x in zip(held, rows)]
        n = len(rows[0])
        if not n:
            continue
        borders = np.flatnonzero((rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])) + 1
        done = 0
        while n - done > BATCH:
            fit = borders[(borders > done) & (borders <= done + BATCH)]
            upto = fit[-1] if len(fit) else next(iter(borders[borders > done].tolist()), None)
            if upto is None:
                break
            yield from _settle(*[x[done:upto] for x in rows])
            done = int(upto)
        held = [x[done:] for x in rows]
    if held is not None and len(held[0]):
        yield from _settle(*held)


# --- spans -----------------------------------------------------------------------------------------------------


def _spans(batches):
    """From repeats sorted by (doc, t, start): each text's maximal removed spans."""
    held = None
    for batch in batches:
        doc, t, lo, end = (batch.column(x).to_numpy() for x in ("doc", "t", "lo", "end"))
        if held is not None:
            doc, t, lo, end = (np.concatenate(x) for x in zip(held, (doc, t, lo, end)))
        if not len(doc):
            continue
        key = np.concatenate([[True], (doc[1:] != doc[:-1]) | (t[1:] != t[:-1])])
        text = np.cumsum(key) - 1
        reach = np.maximum.accumulate(end + text * (1 << 36)) - text * (1 << 36)
        begins = key.copy()
        begins[1:] |= lo[1:] > reach[:-1]
        at = np.flatnonzero(begins)
        upto = reach[np.append(at[1:], len(doc)) - 1]
        doc, t, lo, text = doc[at], t[at], lo[at], text[at]
        last = text == text[-1]
        held = (doc[last], t[last], lo[last], upto[last])
        yield _span_rows(doc[~last], t[~last], lo[~last], upto[~last], text[~last])
    if held is not None:
        yield _span_rows(*held, np.zeros(len(held[0]), np.int64))


def _span_rows(doc, t, lo, end, text):
    starts = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]])) if len(text) else np.zeros(0, np.int64)
    offsets = np.append(starts, len(text)).astype(np.int32)
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (lo, end)]
    return pa.RecordBatch.from_arrays([pa.array(doc[starts]), pa.array(t[starts]), *lists], ["doc", "t", "lows", "ends"])


def repeats(docs: DataFrame, keys: Ids, group: int = GROUP) -> DataFrame:
    """doc (by keys), t (an id of the text), lows, ends: the maximal spans of bytes that occurred earlier, of texts that have any."""
    n = parts_for(docs)
    texts = docs.select(keys.key.alias("key"), F.xxhash64("text").alias("t"), "text").where(F.octet_length("text") >= DEPTH)
    found = texts.mapInArrow(lean(_find), _FOUND)
    known = stage(found.repartition(n, "m").sortWithinPartitions("m", "c", "doc", "at").mapInArrow(lean(_classes), _KINDS), "suffix_runs")
    # Anchors with many runs are cut: at least group runs each, so there are few of them.
    unsure = known.where("kind = 0").select("m", "doc", "t", "at")
    hot = stage(unsure.groupBy(F.col("m").alias("k_m")).agg(F.count("*").alias("n")).where(F.col("n") > group), "suffix_hot")
    salt = F.when(F.col("n").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64("doc", "t", "at"), F.ceil(F.col("n") / group)))
    salted = unsure.join(maybe_broadcast(hot), F.col("m") == F.col("k_m"), "left").select("doc", "t", F.struct("m", "at", salt.cast("long").alias("salt")).alias("x"))
    lists = stage(salted.groupBy(F.col("doc").alias("k"), F.col("t").alias("k_t")).agg(F.collect_set("x").alias("found")), "suffix_open")
    size = lists.agg(F.count("*"), F.sum(F.size("found"))).first()
    near = maybe_broadcast(lists, max(size[0], (size[1] or 0) // 10))
    contexts = texts.join(near, (F.col("key") == F.col("k")) & (F.col("t") == F.col("k_t"))).select("key", "t", "text", "found")
    contexts = contexts.mapInArrow(lean(_contexts), "m long, salt long, doc long, t long, at long, bytes binary")
    more = stage(contexts.repartition(n, "m", "salt").sortWithinPartitions("m", "salt").mapInArrow(lean(_compare), _KINDS), "suffix_windows")
    windows = more.where("kind = 2").select("m", "doc", "t", "at", F.shiftright("at", 7).alias("lo"))
    firsts = stage(windows.groupBy(F.col("m").alias("h")).agg(F.min(F.struct("doc", "lo")).alias("first"), F.count("*").alias("n")).where("n > 1"), "suffix_firsts")
    large = windows.join(firsts, windows["m"] == firsts["h"]).where("struct(doc, lo) > first").select("m", "doc", "t", "at", F.lit(1).alias("kind"))
    every = known.where("kind = 1").unionByName(more.where("kind = 1")).unionByName(large)
    lo = F.shiftright("at", 7)
    places = every.select("doc", "t", lo.alias("lo"), (lo + F.col("at").bitwiseAND(F.lit(127)) + DEPTH - 1).alias("end"))
    return stage(places.repartition(n, "doc", "t").sortWithinPartitions("doc", "t", "lo").mapInArrow(lean(_spans), "doc long, t long, lows array<long>, ends array<long>"), "suffix_spans")


def _with_spans(docs: DataFrame, spans: DataFrame, keys: Ids, names: list[str]) -> DataFrame:
    """docs with their texts' spans in columns of the given names, null where there are none."""
    size = spans.agg(F.count("*"), F.sum(F.size("lows"))).first()
    doc, t, lows, ends = names
    spans = maybe_broadcast(spans.toDF(doc, t, lows, ends), max(size[0], (size[1] or 0) // 2))
    match = (keys.key == F.col(doc)) & (F.xxhash64("text") == F.col(t))
    return docs.join(spans, match, "left").drop(doc, t)


def _cut(text: bytes, lows: list[int] | None, ends: list[int] | None) -> bytes:
    if not lows:
        return text
    return b"".join([text[a:b] for a, b in zip([0, *ends], [*lows, len(text)])])


def deduplicate(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""

    def run(batches):
        for part, texts in text_steps(batches):
            lows, ends = part.column("lows").to_pylist(), part.column("ends").to_pylist()
            left = [_cut(*x) for x in zip(texts, lows, ends)]
            n, m = (np.array([len(x) for x in y], np.int64) for y in (texts, left))
            arrays = [part.column("key"), pa.array(n), pa.array(n - m), pa.array(np.array([len(x or ()) for x in lows], np.int64)), pa.array([hashlib.sha256(x).hexdigest() for x in left], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["key", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    keys = Ids(docs, "doc_id")
    rows = _with_spans(docs.select("doc_id", "text"), repeats(docs, keys, group), keys, ["doc", "t", "lows", "ends"])
    out = rows.select(keys.key.alias("key"), "text", "lows", "ends").mapInArrow(lean(run), "key long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out.select(keys.back("key").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def cut(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """docs with their texts' repeated bytes removed; what is left of split characters reads as U+FFFD."""

    @F.arrow_udf("string")
    def left(text: pa.Array, lows: pa.Array, ends: pa.Array) -> pa.Array:
        raws = text.cast(pa.large_binary()).to_pylist()
        out = pa.array([None if t is None else _cut(t, a, b).decode(errors="replace") for t, a, b in zip(raws, lows.to_pylist(), ends.to_pylist())], pa.string())
        give_back()
        return out

    keys, names = Ids(docs, "doc_id"), fresh(docs, "doc", "t", "lows", "ends")
    rows = _with_spans(docs, repeats(docs, keys, group), keys, names)
    lows, ends = names[2:]
    return rows.select(*[F.when(F.col(lows).isNull(), F.col(c)).otherwise(left(c, lows, ends)).alias(c) if c == "text" else F.col(c) for c in docs.columns])


ORACLE = """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, md5(substr(h, 2*i + 1, 200)) AS s FROM (SELECT doc_id, h, unnest(range(length(h)//2 - 99)) AS i FROM t WHERE length(h) >= 200)),
d AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM w) WHERE k > 1),
g AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS step FROM d),
q AS (SELECT doc_id, i, sum(CASE WHEN step <= 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS part FROM g),
p AS (SELECT doc_id, part, min(i) AS lo, max(i) + 100 AS hi FROM q GROUP BY ALL),
e AS (SELECT doc_id, count(*) AS n_spans, sum(hi - lo) AS n_removed, list(lo ORDER BY lo) AS los, list(hi ORDER BY lo) AS his FROM p GROUP BY doc_id)
SELECT doc_id, length(h)//2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN n_spans IS NULL THEN h ELSE array_to_string(list_transform(range(n_spans + 1), lambda j: substr(h, CASE WHEN j = 0 THEN 1 ELSE 2*his[j] + 1 END, CASE WHEN j = n_spans THEN length(h) ELSE 2*los[j + 1] END - CASE WHEN j = 0 THEN 0 ELSE 2*his[j] END)), '') END)) AS kept_sha256
FROM t LEFT JOIN e USING (doc_id)
"""
