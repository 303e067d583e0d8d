"""Jaccard join on word shingles by T-occurrence search (operator 9).

A document is the set of its distinct shingles, as 64-bit hashes. A partner y of x with at most x's size shares
T = ceil(0.75 |x|) shingles with it. The join runs in steps that each only drop what can't link:

1. Equal sets become one set. Of each set the |x| - T + l smallest hashes are compared by hash range: at least l of
   them must occur in another set, else the set has no partner (l is SPARE of the size). Hashes that a step of the
   scan holds twice are settled there, and one witness of them is sent on. Ranges are as many as the texts' bytes ask.
2. Among the sets left, exact document frequencies give the rarest-first order; two linked sets share one of their
   first |x| - T + 1 shingles. Sets that share such a one, and whose sizes allow it, are tied to the least of them,
   and the connected components are the blocks of the search.
3. In a block, every set queries the inverted lists of the others by DivideSkip: the L longest lists are set apart, the
   short ones are merged, and sets that occur T - L times or more are looked up in the long lists by binary search.
   Sets already connected needn't be compared. Blocks of many shingles are cut into chunks, each searched by itself;
   then one set of each group found is searched with those of the other chunks, and only where a block still has several
   groups its pairs of chunks are. What leaves a search is a spanning forest of its links.

Null texts and texts without words have no shingles and link with nothing. A null doc_id is the smallest. Rows
with equal ids are separate rows of one id. A similarity equal to the bound links. A very long text is one set like
others, made on its own. An empty table gives an empty one. Columns other than doc_id and text, whatever their names,
are not read, and kept by keep_first().
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Ids, fresh, lean, lean_group, maybe_broadcast, mix, partitions, parts_for, stage, text_steps
from .components import components
from .words import WordTable, split_step, window_hashes, word_hashes

SHINGLE = 5
#: Similarity in hundredths.
LEAST = 75
SPARE = 0.15
#: Sets and shingles of a chunk, about.
CHUNK = 2048
CHUNK_SHINGLES = 2_000_000
#: Shingles that one task counts at a time.
RANGE_SHINGLES = 400_000
#: Shingles of small blocks that are searched in one call.
BIN_SHINGLES = 1_000_000
#: Candidates that are probed at a time.
PROBED = 64
#: The weight of a binary search against a merge step, in DivideSkip's choice of L.
MU = 0.01


def needed(n):
    """T of a set of n shingles."""
    return -(-LEAST * n // 100)


class Shingler:
    def __init__(self):
        self.table = WordTable(lambda words: [word_hashes(words)])

    def sets(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Each text's distinct shingles in ascending order, one text after another, and where they start, with the end."""
        self.table.start()
        words, bounds = split_step([t.lower() for t in texts])
        if not words:
            return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
        ids, (h,) = self.table.of(words)
        shingles, row = window_hashes(h[ids], bounds, SHINGLE)
        inside = row >= 0
        shingles, row = shingles[inside], row[inside]
        n = np.diff(bounds)
        short = np.flatnonzero((n > 0) & (n < SHINGLE))
        whole = np.array([xxhash.xxh3_64_intdigest(b" ".join(words[bounds[i] : bounds[i + 1]]), seed=1) for i in short], np.uint64)
        shingles, row = mix(np.concatenate([shingles, whole])), np.concatenate([row, short])
        order = np.lexsort((shingles, row))
        shingles, row = shingles[order], row[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (shingles[1:] != shingles[:-1])
        shingles, row = shingles[new], row[new]
        return shingles, np.searchsorted(row, np.arange(len(texts) + 1))


def _set_ids(shingles: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(shingles[a:b].tobytes()) for a, b in zip(bounds[:-1], bounds[1:])], np.uint64).view(np.int64)


def _rank(bounds: np.ndarray) -> np.ndarray:
    n = np.diff(bounds)
    return np.arange(n.sum()) - np.repeat(bounds[:-1], n)


_SCAN = "r int, key long, t long, sid long, n int, shared int, low binary, at binary, sids binary"


def _scan(parts: int):
    """A row for every document, and for each hash range the smallest hashes of the step's sets."""

    def run(batches):
        shingler = Shingler()
        for part, texts in text_steps(batches):
            h, bounds = shingler.sets(texts)
            n = np.diff(bounds)
            sid = _set_ids(h, bounds)
            quota = np.where(n > 0, n - needed(n) + np.maximum(1, np.ceil(SPARE * n).astype(np.int64)), 0)
            row = np.repeat(np.arange(len(n)), n)
            first = np.zeros(len(n), bool)
            first[np.unique(sid, return_index=True)[1]] = True
            some = (_rank(bounds) < quota[row]) & first[row]
            h, row = h[some], row[some]
            order = np.argsort(h, kind="stable")
            h, row = h[order], row[order]
            new = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
            at = np.flatnonzero(new)
            count = np.diff(np.append(at, len(h)))
            twice = np.repeat(count > 1, count)
            shared = np.bincount(row[twice], minlength=len(n)).astype(np.int32)
            h, row, witness = h[at], row[at], count > 1
            out = {k: [] for k in ("r", "key", "t", "sid", "n", "shared", "low", "at", "sids")}
            key = part.column("key").to_numpy()
            t = part.column("t").to_numpy()
            deal = mix(key.view(np.uint64) + t.view(np.uint64)) % np.uint64(parts)
            for column, values in zip(out, (deal.astype(np.int64).tolist(), key.tolist(), t.tolist(), sid.tolist(), n.tolist(), shared.tolist())):
                out[column] += values
            for column in ("low", "at", "sids"):
                out[column] += [None] * len(n)
            r = ((h >> np.uint64(32)) & np.uint64(0xFFFFF)) % np.uint64(parts)
            order = np.argsort(r, kind="stable")
            cuts = np.searchsorted(r[order], np.arange(parts + 1, dtype=np.uint64))
            for p in np.flatnonzero(np.diff(cuts)).tolist():
                i = order[cuts[p] : cuts[p + 1]]
                of, where = np.unique(row[i], return_inverse=True)
                where = np.where(witness[i], 0xFFFF, where)
                for column, value in zip(out, (p, None, None, None, None, None, h[i].astype(np.uint32).tobytes(), where.astype(np.uint16).tobytes(), sid[of].tobytes())):
                    out[column].append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[k], t) for k, t in zip(out, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], list(out))

    return run


def _pack_by_set(sid: np.ndarray, groups: int, *columns: np.ndarray) -> tuple[list[int], list[list[bytes]]]:
    """The arrays cut by groups of sets, as bytes: one entry a group, however many sets there are."""
    g = mix(sid.view(np.uint64)) % np.uint64(groups)
    order = np.argsort(g, kind="stable")
    cuts = np.searchsorted(g[order], np.arange(groups + 1, dtype=np.uint64))
    full = np.flatnonzero(np.diff(cuts)).tolist()
    return full, [[c[order[cuts[p] : cuts[p + 1]]].tobytes() for p in full] for c in (sid, *columns)]


_SEEN = pa.schema([("key", pa.int64()), ("t", pa.int64()), ("sid", pa.int64()), ("n", pa.int32()), ("shared", pa.int32()), ("g", pa.int32()), ("sids", pa.binary()), ("counts", pa.binary())])


def _count_shared(groups: int):
    """Passes documents on; tells, by group of sets, how many of their hashes in this range another set has too."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        docs, who, many = _shared_in(table)
        full, (sids, counts) = _pack_by_set(who, groups, many.astype(np.int32))
        k = len(full)
        docs = docs.append_column("g", pa.nulls(len(docs), pa.int32())).append_column("sids", pa.nulls(len(docs), pa.binary())).append_column("counts", pa.nulls(len(docs), pa.binary()))
        more = pa.table([pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int32()), pa.array(full, pa.int32()), pa.array(sids, pa.binary()), pa.array(counts, pa.binary())], schema=_SEEN)
        return pa.concat_tables([docs.cast(_SEEN), more])

    return run


def _sum_shared(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    sid = np.frombuffer(b"".join(table["sids"].to_pylist()), np.int64)
    count = np.frombuffer(b"".join(table["counts"].to_pylist()), np.int32)
    who, at = np.unique(sid, return_inverse=True)
    return pa.table({"sid": pa.array(who), "more": pa.array(np.bincount(at, count, len(who)).astype(np.int64))})


def _shared_in(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    blobs = table.filter(pc.is_valid(table["low"]))
    docs = table.filter(pc.is_null(table["low"])).select(["key", "t", "sid", "n", "shared"])
    low, sid = [], []
    for a, b, c in zip(*(blobs[x].to_pylist() for x in ("low", "at", "sids"))):
        hashes, at, sids = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint16), np.frombuffer(c, np.int64)
        one = at != 0xFFFF
        low += [hashes[one], hashes[~one], hashes[~one]]  # a witness counts as two sets
        sid += [sids[at[one]], np.zeros(2 * int((~one).sum()), np.int64)]
    none = np.zeros(0, np.int64)
    if not low:
        return docs, none, none
    low, sid = np.concatenate(low), np.concatenate(sid)
    order = np.lexsort((sid, low))
    low, sid = low[order], sid[order]
    new = np.ones(len(low), bool)
    new[1:] = (low[1:] != low[:-1]) | (sid[1:] != sid[:-1]) | (sid[1:] == 0)
    low, sid = low[new], sid[new]
    at = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    count = np.diff(np.append(at, len(low)))
    who, many = np.unique(sid[np.repeat(count > 1, count) & (sid != 0)], return_counts=True)
    return docs, who, many


def _sets_of(batches):
    """The sets of texts."""
    shingler = Shingler()
    for _, texts in text_steps(batches):
        h, bounds = shingler.sets(texts)
        raw = h.tobytes()
        yield pa.RecordBatch.from_arrays([pa.array(_set_ids(h, bounds)), pa.array(np.diff(bounds).astype(np.int32)), pa.array([raw[8 * a : 8 * b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())], pa.binary())], ["sid", "n", "hashes"])


def _ranges(parts: int):
    """Sets cut by hash range."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            raws = batch.column("hashes").to_pylist()
            n = batch.column("n").to_numpy().astype(np.int64)
            h, sid = np.frombuffer(b"".join(raws), np.uint64), np.repeat(batch.column("sid").to_numpy(), n)
            size = np.repeat(n, n).astype(np.int32)
            r = ((h >> np.uint64(32)) & np.uint64(0xFFFFF)) % np.uint64(parts)
            order = np.argsort(r, kind="stable")
            cuts = np.searchsorted(r[order], np.arange(parts + 1, dtype=np.uint64))
            full = np.flatnonzero(np.diff(cuts)).tolist()
            spans = [order[cuts[p] : cuts[p + 1]] for p in full]
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), *[pa.array([x[i].tobytes() for i in spans], pa.binary()) for x in (h, sid, size)]], ["r", "hashes", "sids", "ns"])

    return run


def _frequencies(groups: int):
    """Hashes in this range that several sets have, with the number of sets, by group of sets."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        h, sid, n = (np.frombuffer(b"".join(table[c].to_pylist()), t) for c, t in (("hashes", np.uint64), ("sids", np.int64), ("ns", np.int32)))
        _, inverse, count = np.unique(h, return_inverse=True, return_counts=True)
        df = count[inverse]
        full, columns = _pack_by_set(sid[df > 1], groups, h[df > 1], n[df > 1], df[df > 1])
        return pa.table([pa.array(full, pa.int32()), *[pa.array(c, pa.binary()) for c in columns]], names=["g", "sids", "hashes", "ns", "df"])

    return run


def _prefixes(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """The shared shingles among the |x| - T + 1 rarest of each set, if it shares enough to have a partner."""
    sid, h, n, df = (np.frombuffer(b"".join(table[c].to_pylist()), t) for c, t in (("sids", np.int64), ("hashes", np.uint64), ("ns", np.int32), ("df", np.int64)))
    order = np.lexsort((h, df, sid))
    sid, h, n = sid[order], h[order], n[order].astype(np.int64)
    at = np.flatnonzero(np.concatenate([[True], sid[1:] != sid[:-1]])) if len(sid) else np.zeros(0, np.int64)
    shared = np.diff(np.append(at, len(sid)))
    take = shared - needed(n[at]) + 1  # hashes that no other set has come first in the order
    some = np.arange(len(sid)) - np.repeat(at, shared) < np.repeat(take, shared)
    return pa.table({"h": pa.array(h[some].view(np.int64)), "sid": pa.array(sid[some]), "n": pa.array(n[some].astype(np.int32))})


def t_occurrence(sets: list[np.ndarray], chunk: np.ndarray, across: bool, group: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links between the sets of a block, beyond what connects equal groups.

    across: links between different chunks only.
    """
    sizes = np.array([len(s) for s in sets])
    rank = np.argsort(sizes, kind="stable")  # queries from small to large, each against those before
    tokens = np.unique(np.concatenate([sets[i] for i in rank]), return_inverse=True)[1]
    ends = np.cumsum(sizes[rank])
    doc = np.repeat(np.arange(len(rank)), sizes[rank])
    order = np.argsort(tokens, kind="stable")
    postings = doc[order]  # each token's list, in ascending order
    starts = np.searchsorted(tokens[order], np.arange(tokens.max() + 2))
    root = np.arange(len(rank)) if group is None else np.unique(group[rank], return_index=True)[1][np.unique(group[rank], return_inverse=True)[1]]
    n, own = sizes[rank], chunk[rank]

    def find(a):
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    forest, length = [], np.diff(starts)
    for x in range(1, len(rank)):
        mine = tokens[ends[x] - n[x] : ends[x]]
        t = needed(int(n[x]))
        mine = mine[np.argsort(-length[mine], kind="stable")]
        longest = int(length[mine[0]])
        apart = max(0, min(t - 1, int(t / (MU * np.log2(longest) + 1)))) if longest > 1 else 0
        long, short = mine[:apart], mine[apart:]
        # The short lists as one, in order: the sort merges runs that are in order already.
        merged = np.sort(np.concatenate([postings[starts[k] : starts[k + 1]] for k in short.tolist()]), kind="stable")
        merged = merged[: np.searchsorted(merged, x)]
        if not len(merged):
            continue
        at = np.flatnonzero(np.concatenate([[True], merged[1:] != merged[:-1]]))
        found, count = merged[at], np.diff(np.append(at, len(merged)))
        some = (count >= max(1, t - apart)) & (100 * n[found] >= LEAST * n[x])
        if across:
            some &= own[found] != own[x]
        found, count = found[some], count[some]
        while len(found):
            mine_root = find(x)
            other = np.array([find(y) for y in found.tolist()]) != mine_root
            found, count = found[other], count[other]
            if not len(found):
                break
            # The likeliest candidates first; after a link its whole group needn't be looked at.
            best = np.argsort(-count, kind="stable")[:PROBED]
            both = count[best] + _probe(postings, starts, long, found[best])
            linked = 100 * both >= LEAST * (n[x] + n[found[best]] - both)
            for y in found[best][linked].tolist():
                a, b = find(x), find(y)
                if a != b:
                    root[max(a, b)] = min(a, b)
                    forest.append((int(rank[x]), int(rank[y])))
            rest = np.ones(len(found), bool)
            rest[best] = False
            found, count = found[rest], count[rest]
    return forest


def _probe(postings: np.ndarray, starts: np.ndarray, tokens: np.ndarray, sets: np.ndarray) -> np.ndarray:
    """In how many of the tokens' lists each of the sets is, by binary search in the lists."""
    hits = np.zeros(len(sets), np.int64)
    for k in tokens.tolist():
        lists = postings[starts[k] : starts[k + 1]]
        at = np.minimum(np.searchsorted(lists, sets), len(lists) - 1)
        hits += lists[at] == sets
    return hits


def _search(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    blocks, sids, own, group = (table[c].to_numpy() for c in ("block", "sid", "own", "component"))
    raws = table["hashes"].to_pylist()
    across = key[1].as_py() != key[2].as_py()
    order = np.lexsort((sids, blocks))
    cuts = np.flatnonzero(np.concatenate([[True], blocks[order][1:] != blocks[order][:-1], [True]]))
    a, b = [], []
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        i = order[lo:hi]
        if len(i) > 1:
            for x, y in t_occurrence([np.frombuffer(raws[k], np.uint64) for k in i], own[i], across, group[i]):
                a.append(int(sids[i[x]]))
                b.append(int(sids[i[y]]))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _searched(sets: DataFrame, name: str) -> DataFrame:
    """(a, b), links found; sets: bin, i, j, block, sid, own, component, hashes."""
    return stage(sets.select("bin", "i", "j", "block", "sid", "own", "component", "hashes").groupBy("bin", "i", "j").applyInArrow(lean_group(_search), "a long, b long"), name)


def _named(sets: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """sets with the component that the links put them in, by default their own."""
    found = stage(components(links, "a", "b"), name).select(F.col("node").alias("k"), F.col("component").alias("c"))
    return sets.drop("component").join(found, sets["sid"] == found["k"], "left").withColumn("component", F.coalesce("c", "sid")).drop("k", "c")


def _links(blocks: DataFrame, found: DataFrame, chunk: int, bins: int) -> DataFrame:
    """(a, b), a spanning forest of the links; blocks: sid, block."""
    slim = stage(blocks.join(found.select("sid", "n"), "sid"), "jaccard_members")
    sizes = slim.groupBy(F.col("block").alias("b")).agg(F.count("*").alias("members"), F.sum("n").alias("size"))
    chunks = F.greatest(F.ceil(F.col("members") / chunk), F.ceil(F.col("size") / CHUNK_SHINGLES)).cast("int")
    slim = slim.join(sizes.where("members > 1"), F.col("block") == F.col("b")).withColumn("chunks", chunks).select("sid", "block", "chunks")
    slim = stage(slim.withColumn("own", F.pmod(F.xxhash64("sid"), F.col("chunks")).cast("int")), "jaccard_chunks")
    hashes = found.select("sid", "hashes")
    # Each chunk by itself; small blocks share a call.
    first = slim.withColumns({"bin": F.when(F.col("chunks") > 1, F.col("block")).otherwise(F.pmod(F.xxhash64("block"), F.lit(bins))), "i": F.col("own"), "j": F.col("own"), "component": F.col("sid")})
    links = _searched(first.join(hashes, "sid"), "jaccard_links")
    large = stage(slim.where("chunks > 1"), "jaccard_large")
    if large.isEmpty():
        return links
    # One set for each group and chunk, with the others of its block, in bins of about a chunk of them.
    named = stage(_named(large, links, "jaccard_groups"), "jaccard_grouped")
    heads = named.groupBy("block", "own", "component").agg(F.min("sid").alias("sid"))
    heads = heads.withColumns({"bin": F.col("block"), "i": F.pmod(F.xxhash64("component"), F.lit(1 + heads.count() // chunk)).cast("int")}).withColumn("j", F.col("i"))
    links = links.unionByName(_searched(heads.join(hashes, "sid"), "jaccard_heads"))
    # Where a block still has several groups, its pairs of chunks.
    named = stage(_named(large, links, "jaccard_regroups"), "jaccard_regrouped")
    several = named.groupBy(F.col("block").alias("b")).agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("b")
    rest = named.join(several, F.col("block") == F.col("b"), "left_semi")
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).where("own <> other").withColumns({"bin": F.col("block"), "i": F.least("own", "other"), "j": F.greatest("own", "other")})
    return links.unionByName(_searched(rest.join(hashes, "sid"), "jaccard_pairs"))


def join(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs."""
    spark, keys = docs.sparkSession, Ids(docs, "doc_id")
    parts = parts_for(docs)
    groups = max(16, parts // 4)
    texts = docs.select(keys.key.alias("key"), F.xxhash64("text").alias("t"), "text")
    # 1. Sets, and which of them may have a partner.
    seen = texts.mapInArrow(lean(_scan(parts)), _SCAN).groupBy("r").applyInArrow(lean_group(_count_shared(groups)), "key long, t long, sid long, n int, shared int, g int, sids binary, counts binary")
    seen = stage(seen, "jaccard_sets")
    rows = seen.where("key IS NOT NULL").select("key", "sid", "n")
    more = seen.where("key IS NULL").select("g", "sids", "counts").groupBy("g").applyInArrow(lean_group(_sum_shared), "sid long, more long")
    own = seen.where("n > 0").groupBy("sid").agg(F.max("n").alias("n"), F.min(F.struct("key", "t")).alias("first"), F.sum("shared").alias("shared"))
    sets = own.join(more, "sid", "left")
    spare = F.greatest(F.lit(1), F.ceil(F.lit(SPARE) * F.col("n")))
    likely = stage(sets.where(F.col("shared") + F.coalesce("more", F.lit(0)) >= spare).select(F.col("first.key").alias("k"), F.col("first.t").alias("k_t")), "jaccard_likely")
    wanted = texts.join(maybe_broadcast(likely), (F.col("key") == F.col("k")) & (F.col("t") == F.col("k_t")), "left_semi").select("text")
    found = stage(wanted.mapInArrow(lean(_sets_of), "sid long, n int, hashes binary").dropDuplicates(["sid"]), "jaccard_found")
    # 2. Blocks.
    total = found.agg(F.sum("n")).first()[0] or 0
    ranges = max(1, -(-total // RANGE_SHINGLES))
    cut = found.mapInArrow(lean(_ranges(ranges)), "r int, hashes binary, sids binary, ns binary").groupBy("r").applyInArrow(lean_group(_frequencies(ranges)), "g int, sids binary, hashes binary, ns binary, df binary")
    prefixes = stage(cut.groupBy("g").applyInArrow(lean_group(_prefixes), "h long, sid long, n int"), "jaccard_prefixes")
    # Sizes in steps by just over 4/3: sizes that a pair can have are in one step or in neighbouring ones.
    step = F.floor(F.log("n") / F.lit(float(np.log(1.01 * 100 / LEAST)))).cast("int")
    tied = prefixes.select("h", "sid", F.explode(F.array(step, step + 1)).alias("q"))
    leads = tied.groupBy(F.col("h").alias("k_h"), F.col("q").alias("k_q")).agg(F.min("sid").alias("lead"), F.count("*").alias("m")).where("m > 1").select("k_h", "k_q", "lead")
    tied = tied.join(leads, (F.col("h") == F.col("k_h")) & (F.col("q") == F.col("k_q"))).where("sid <> lead").select("sid", "lead")
    blocks = stage(components(tied, "sid", "lead"), "jaccard_blocks").select(F.col("node").alias("sid"), F.col("component").alias("block"))
    # 3. The search in each block.
    bins = max(1, -(-total // BIN_SHINGLES), min(partitions(spark), total // 20_000))
    links = _links(blocks, found, chunk, bins)
    # Components of sets, named by their smallest document.
    classes = stage(components(links, "a", "b"), "jaccard_classes")
    firsts = rows.where("n > 0").groupBy("sid").agg(F.min("key").alias("first"), F.count("*").alias("copies"))
    joined = firsts.join(maybe_broadcast(classes.select(F.col("node").alias("sid"), "component")), "sid", "left")
    named = stage(joined.withColumn("component", F.coalesce("component", "sid")), "jaccard_named")
    least = named.groupBy("component").agg(F.min("first").alias("least"), F.sum("copies").alias("all")).where(F.col("all") > 1)
    members = stage(named.join(least, "component").select(F.col("sid").alias("s"), "least"), "jaccard_least")
    out = rows.join(members, (rows["sid"] == members["s"]) & (rows["n"] > 0), "left")
    return out.select(keys.back("key").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), keys.back(F.coalesce("least", "key")).alias("component_id"))


def keep_first(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """docs with one document of each group: the one with the smallest id. Rows that repeat an id stay or go together."""
    (gone,) = fresh(docs, "gone")
    others = join(docs, chunk).where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(gone)).distinct()
    others = maybe_broadcast(stage(others, "jaccard_gone"))
    return docs.join(others, docs["doc_id"] == others[gone], "left_anti")


ORACLE = """
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(len(w) - 4), lambda i: array_to_string(w[i + 1:i + 5], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM t)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
k AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
l AS (SELECT a, b FROM k UNION ALL SELECT b, a FROM k),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(least(a, b)) AS c FROM r GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(c, doc_id) AS component_id FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.a = doc_id
"""
