"""Each training-data operator against brute force, a library, or SQL, on small tables full of edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lacuna.llm import bpe, embed_dedup, jaccard, license_scan, mixing, quality, sharding, suffix_dedup, token_orc, warc
from lacuna.llm.components import components

SCHEMA = "doc_id long, text string, source string, n_words string, shard int, h0 long, sid long"


def documents(spark, rows):
    """Documents with other columns whose names the operators use inside."""
    full = [(i, t, s, "x", 7, 1, 2) for i, t, s in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9))) for _ in range(150)]
    rows = []
    for i in range(60):
        n = rng.choice([0, 1, 4, 30, 90, 200])
        t = [rng.choice(words) for _ in range(n)]
        rows.append((i * 11, " ".join(t), f"s{i % 4}"))
        if n >= 90:
            u = list(t)
            u[5] = "changed"
            rows.append((i * 11 + 1, "\n".join(u), "s0"))
            rows.append((i * 11 + 2, " ".join(t), None))
    rows += [(2000, None, "s1"), (2001, "", None), (2002, "  \n\t", "s1"), (2003, "a" * 5000, "s2"), (2004, "Under The MIT License. mit license", "s2"), (2005, "word " * 3000, "s3")]
    rows += [(2005, "word " * 3000, "s3"), (None, "no id here, but words enough for one shingle", "s3")]
    return rows


def ids(df, *columns):
    return sorted(df.select(*columns).collect(), key=str)


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_license_scan_equals_sql(spark, corpus, tmp_path):
    extra = [(3000, "Permission is hereby granted, free of charge, to any person obtaining a copy", "s"), (3001, "GNU General  Public-License version 3; Apache License", "s"), (3002, "the licensK mit license" + "K", "s")]
    df = documents(spark, corpus + extra)
    con = duckdb.connect()
    con.register("documents", pd.DataFrame([(i, t) for i, t, _ in corpus + extra], columns=["doc_id", "text"]))
    got = license_scan.scan(df).toPandas().astype(object)
    want = con.sql(license_scan.oracle()).df().astype(object)
    key = lambda d: sorted([tuple(None if pd.isna(v) else v for v in r) for r in d[list(want.columns)].itertuples(index=False)], key=str)
    assert key(got) == key(want)


def test_warc_round_trip(spark, tmp_path):
    pages = [(1, "http://a", "<p>x</p>"), (2, "http://b", "<p>x</p>"), (3, None, None), (4, "u\r\nX: y", ""), (5, "http://c", "é" * 100_000), (None, "http://d", "<p>x</p>"), (2, "http://b", "<p>x</p>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("refers_to", F.lit(9)).repartition(2)
    path = warc.scratch(spark, "t")
    back = warc.read(warc.write(warc.roles(df), path)).collect()
    got = Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in back)

    def row(i, html, first):
        raw = (html or "").encode()
        kind = "response" if first == i else "revisit"
        return i, len(raw), warc.base32(hashlib.sha1(raw).digest()), kind, None if kind == "response" else first

    assert got == Counter(row(i, h, {"<p>x</p>": 2, "": 4}.get(h or "", i)) for i, _, h in pages)
    assert all(r["payload"].decode() == (dict((p[0], p[2]) for p in pages)[r["page_id"]] or "") for r in back if r["record_type"] == "response")


def test_warc_reader_refuses_damage():
    import io

    out = io.BytesIO()
    out.close = lambda: None
    archive = warc.Archive(out)
    for i in range(200):
        archive.add(warc.record(i, "http://x", b"body %d" % i * 50, None))
    archive.close()
    raw = out.getvalue()
    found = [warc.parse(r) for r in warc.frames(io.BytesIO(raw))]
    assert len(found) == 200 and found[7]["payload"] == b"body 7" * 50
    for bad in (raw[:-5], raw[8:], b"\0" * 4 + raw[4:]):
        with pytest.raises(Exception):
            list(warc.frames(io.BytesIO(bad)))
    one = warc.record(1, "u", b"abc", None)
    for bad in (one.replace(b"abc", b"abd"), one[:-1], one.replace(b"WARC/1.1", b"WARC/0.9"), one.replace(b"Content-Length: 3", b"Content-Length: 4")):
        with pytest.raises(ValueError):
            warc.parse(bad)


def test_sharding_is_exact(spark, corpus):
    got = sharding.shard_documents(documents(spark, corpus), 5).toPandas()
    sizes = got.groupby("shard").slot.agg(["count", "min", "max", "nunique"])
    assert len(got) == len(corpus) and sizes["count"].max() - sizes["count"].min() <= 1
    assert (sizes["min"] == 0).all() and (sizes["max"] + 1 == sizes["count"]).all() and (sizes["nunique"] == sizes["count"]).all()
    assert sorted(got.text_crc32) == sorted(zlib.crc32((t or "").encode()) for _, t, _ in corpus)


def test_communication_matrix_has_the_sums_and_the_law():
    rng = np.random.default_rng(0)
    parts, shards = rng.integers(0, 50, 9), None
    shards = np.full(4, parts.sum() // 4) + (np.arange(4) < parts.sum() % 4)
    m = np.array([sharding.communication_matrix(parts, shards, s) for s in range(400)])
    assert (m.sum(2) == parts).all() and (m.sum(1) == shards).all()
    assert np.allclose(m.mean(0), parts[:, None] * shards / parts.sum(), atol=0.5)


def test_token_files(spark, corpus):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    odd = [(4000, "Don't <|endoftext|> É日本 x²\x1cy 'LL", "s"), (4001, "ΣΑΣ ǅ K ﬁ", "s")]
    got = Counter(tuple(r) for r in token_orc.round_trip(documents(spark, corpus + odd)).select("doc_id", "n_tokens", "ids_crc32").collect())
    want = Counter()
    for i, t, _ in corpus + odd:
        x = library.encode(t or "", add_special_tokens=False).ids + [2]
        want[i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())] += 1
    assert got == want
    rows = sorted(token_orc.round_trip(documents(spark, corpus)).collect(), key=lambda r: r["start"])
    assert [r["start"] for r in rows] == [0, *np.cumsum([r["n_tokens"] for r in rows])[:-1].tolist()]
    known = [r["doc_id"] for r in rows if r["doc_id"] is not None]
    assert known == sorted(known)


def test_plain_texts_together_equal_the_library():
    import public_tokenizers as vocabularies
    from tokenizers import Tokenizer

    coder, library = token_orc.word_coder(None), Tokenizer.from_file(vocabularies.path("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    ids = lambda t: np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
    rng = np.random.default_rng(3)
    plain = ["'", "s", "t", "re", "ve", "ll", "d", "m", "'s", "'re", " ", "\n", "\t", "\x0b", "\r", "A", "É", "ß", "ÿ", "1", "23", "!", '"', "''", "<", "word", "The", "..", "_", "The's", "'LL"]
    other = ["\x01", "\x02", "\x7f", "\x1c", "×", "²", "µ", "\xa0", "日本", "<|endoftext|>", "e\u0301"]
    for i in range(150):
        some = plain + other * (i % 3 == 0)
        texts = ["".join(rng.choice(some, rng.integers(0, 30))) for _ in range(20)]
        assert coder.encode_all([t.encode() for t in texts]) == [ids(t) for t in texts]
    long = " ".join(f"{w}'s" for w in rng.choice(plain, 600_000))
    assert len(long) > 2 << 20 and coder.encode_all([long.encode()]) == [ids(long)]
    assert coder.encode_all([]) == [] and coder.encode_all([b"", b" "]) == [b"", b""]


def test_token_files_are_pruned_by_id(spark, corpus):
    path = token_orc.scratch(spark, "t")
    token_orc.write(documents(spark, corpus), path)
    plan = token_orc.read(spark, path).where("doc_id = 11")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(block), IsNotNull(doc_id), EqualTo(doc_id,11)]" in plan or "EqualTo(doc_id,11)" in plan
    import pyarrow.orc
    from glob import glob

    file = pyarrow.orc.ORCFile(glob(path.removeprefix("file://") + "/*.orc")[0])
    assert file.compression == "ZSTD" and file.row_index_stride == 1000


def test_embeddings_equal_sql(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(30, 8))
    rows = []
    for i in range(160):
        v = base[i % 30] + rng.normal(size=8) * rng.choice([0.02, 0.2, 1.0])
        rows.append((i * 3, [float(x) for x in v], int(i % 3) if i % 7 else None))
    rows += [(900, None, 1), (901, [0.0] * 8, 1), (902, [float("nan")] * 8, 1), (903, rows[0][1], rows[1][2]), (904, [1.0, None] + [0.0] * 6, 2), (905, [1.0, 2.0], 2), (906, [2.0, 4.0], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("cell", F.lit("x")).repartition(4)
    assert embed_dedup.cells_for(36) > 1  # these labels have cells
    got = sorted(map(tuple, embed_dedup.deduplicate(df, block=8).collect()))
    con = duckdb.connect()
    con.register("embeddings", df.toArrow())
    assert got == sorted(con.sql(embed_dedup.ORACLE).fetchall())
    assert any(r[1] for r in got)


def test_mixing_meets_targets(spark, corpus):
    df = documents(spark, corpus)
    plan = mixing.mix(df).cache()
    rows = plan.collect()
    assert len(rows) == len(corpus)
    sizes = Counter()
    for _, t, s in corpus:
        sizes[s] += len(words_of(t))
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, capped = {}, set()
    while True:
        rest = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        left = sum(weight[s] for s in order if s not in capped)
        target = {s: 3 * sizes[s] if s in capped else rest * weight[s] / left for s in order}
        over = {s for s in order if target[s] > 3 * sizes[s] and s not in capped}
        if not over:
            break
        capped |= over
    for s in order:
        mine = [r for r in rows if r["source"] == s]
        assert mine[0]["target"] == pytest.approx(target[s]) and mine[0]["source_size"] == sizes[s]
        assert abs(sum(r["taken"] for r in mine) - target[s]) <= 1
    assert all(r["taken"] <= 3 * r["size"] for r in rows)
    blocks = [b for r in rows for b in r["blocks"] or []]
    per = Counter(b["shard"] for b in blocks)
    assert max(per.values()) - min(per.values()) <= 5 and all(sorted(b["slot"] for b in blocks if b["shard"] == k) == list(range(n)) for k, n in per.items())
    key = ["doc_id", "taken", "target"]
    assert ids(mixing.mix(df.repartition(5)), *key) == ids(plan, *key)
    drawn = mixing.draw(df, plan)
    assert drawn.columns == df.columns
    got = Counter()
    for r in drawn.collect():
        got[r["source"]] += len(words_of(r["text"]))
    # Equal rows of several sources can't be told apart here, and there are none but in one source.
    assert {s: n for s, n in got.items()} == {s: sum(r["taken"] for r in rows if r["source"] == s) for s in order if target[s] > 0}


def test_drawn_repeats_keep_their_columns(spark):
    """Rows equal in doc_id and text, in other sources or with another column, come out as often as the plan says, as themselves."""
    rows = [(i % 40, f"one two three {i % 40} five", "abc"[i // 40], f"lang{i}") for i in range(120)] + [(7, "one two three 7 five", "a", "more"), (None, "x y", "b", "none"), (None, "x y", None, "null")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").repartition(5)
    plan = mixing.mix(docs, shards=4)
    got = mixing.draw(docs, plan)
    assert got.columns == docs.columns
    out = [tuple(r) for r in got.collect()]
    own = {(i, s, x) for i, _, s, x in rows}
    assert {(i, s, x) for i, _, s, x in out} <= own
    words = Counter()
    for _, t, s, _ in out:
        words[s] += len(t.split())
    assert words == Counter({r["source"]: r["n"] for r in plan.groupBy("source").agg(F.sum("taken").alias("n")).collect() if r["n"]})
    blocks = Counter()
    for r in plan.collect():
        blocks[r["doc_id"], r["source"]] += len(r["blocks"] or [])
    assert Counter((i, s) for i, _, s, _ in out) == +blocks


def test_splitting_tree_has_the_sums():
    quotas = [100, 37, 0, 5]
    m = np.array([mixing.splitting_tree(quotas, 6, s) for s in range(200)])
    assert (m.sum(2) == quotas).all() and np.ptp(m.sum(1)) <= 1
    assert np.allclose(m.mean(0)[:2], np.array([100, 37])[:, None] / 6, atol=1.0)


def test_quality_base_columns_by_brute_force(spark, corpus):
    extra = [(5000, "a b c d e f g h a b c d e f g h # * $", "s"), (5001, "x\n\nx\n x\nx\n\n", "s"), (5002, "same " * 30, "s"), (5003, "日本 <b> | &", "s")]
    got = {}
    for r in quality.score(documents(spark, corpus + extra), None).collect():
        got.setdefault((r["doc_id"], r["n_words"], r["word_chars"]), []).append(tuple(r)[3:8])
    for i, t, _ in corpus + extra:
        w, lines = words_of(t), [x for x in (t or "").split("\n") if words_of(x)]
        windows = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        marked = {k + j for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for j in range(8)}
        want = (len([c for c in t or "" if c in "#*$%&|<>"]), len(lines) - len(set(lines)), len(marked), len(w) < 20 or 100 * len(marked) > 30 * len(w), not (len(w) < 20 or 100 * len(marked) > 30 * len(w)))
        assert want in got[i, len(w), sum(map(len, w))], (i, want)


def test_quality_model_on_held_out_rows(spark):
    path = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels.where("doc_id % 2 = 0"), 400)
    got = quality.score(docs, model).join(labels.where("doc_id % 2 = 1"), "doc_id").where("NOT base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()
    share = {r["quality"]: r["k"] for r in got}
    assert share[1] > 0.97 and share[0] < 0.1
    kept = quality.keep(docs, model)
    assert kept.columns == docs.columns and kept.count() == quality.score(docs, model).where("kept").count()


def brute_suffixes(rows, depth=100):
    raws = [(i if i is not None else -(2**63), (t or "").encode()) for i, t in rows]
    first = {}
    for d, t in sorted(raws):
        for k in range(len(t) - depth + 1):
            w = t[k : k + depth]
            first[w] = min(first.get(w, (d, k)), (d, k))
    out = []
    for d, t in raws:
        mark = np.zeros(len(t), bool)
        for k in range(len(t) - depth + 1):
            if first[t[k : k + depth]] < (d, k):
                mark[k : k + depth] = True
        kept = np.frombuffer(t, np.uint8)[~mark].tobytes()
        spans = int((mark[1:] & ~mark[:-1]).sum() + mark[:1].sum())
        out.append((d if d != -(2**63) else None, len(t), int(mark.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("group", [2000, 3, 1])
def test_suffixes_by_brute_force(spark, corpus, group):
    rows = [(i, t) for i, t, _ in corpus] + [(1, "ab" * 300), (5, corpus[4][1] + "tail" * 40)]
    df = documents(spark, [(i, t, "s") for i, t in rows])
    assert sorted(map(tuple, suffix_dedup.deduplicate(df, group).collect()), key=str) == brute_suffixes(rows)


def test_cut_texts_keep_the_rest(spark):
    p = "a passage of more than a hundred bytes that two documents share, word for word, from its start to its very end."
    df = documents(spark, [(1, "one: " + p + " two", "s"), (2, "three; " + p + " four", "s"), (3, None, "s")])
    got = {r["doc_id"]: r["text"] for r in suffix_dedup.cut(df).collect()}
    assert got[1] == "one: " + p + " two" and got[2] == "three;four" and got[3] is None


def brute_jaccard(rows):
    sets, root = [], {}
    for i, t in rows:
        w = words_of(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append((i if i is not None else -(2**63), {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
        root.setdefault(sets[-1][0], sets[-1][0])

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for k, (i, s) in enumerate(sets):
        for j, u in sets[:k]:
            both = len(s & u)
            if s and u and 100 * both >= 75 * (len(s) + len(u) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    null = lambda v: None if v == -(2**63) else v
    return sorted(((null(i), len(s), null(find(i))) for i, s in sets), key=str)


@pytest.mark.parametrize("chunk", [2048, 3])
def test_jaccard_by_brute_force(spark, corpus, chunk):
    rows = [(i, t) for i, t, _ in corpus] + [(7000, "One two"), (7001, "one TWO")]
    df = documents(spark, [(i, t, "s") for i, t in rows])
    assert sorted(map(tuple, jaccard.join(df, chunk).collect()), key=str) == brute_jaccard(rows)


def test_t_occurrence_by_brute_force():
    rng = np.random.default_rng(5)
    base = [np.unique(rng.integers(0, 500, rng.integers(2, 60))) for _ in range(8)]
    sets = [np.unique(np.where(rng.random(len(b)) < 0.08, rng.integers(0, 500, len(b)), b)).astype(np.uint64) for b in base for _ in range(9)]
    root = list(range(len(sets)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in jaccard.t_occurrence(sets, np.zeros(len(sets), int), False):
        root[max(find(a), find(b))] = min(find(a), find(b))
    mine = [find(k) for k in range(len(sets))]
    root = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert mine == [find(k) for k in range(len(sets))]


def test_bpe_equals_the_library(spark, corpus):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    odd = [(6000, "à  la <|endoftext|>x  y  z", "s"), (6001, "don't  'll \t\t\r\n x\x1cy 日本語 🙂🙂", "s"), (6002, "ab@@" * 500 + "\n\nA", "s"), (6003, "\x00\x01 　　x", "s")]
    got = Counter(tuple(r) for r in bpe.encode(documents(spark, corpus + odd), keep_ids=False).collect())
    want = Counter()
    for i, t, _ in corpus + odd:
        x = library.encode(t or "", add_special_tokens=False).ids
        want[i, len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(x, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert got == want


def test_bpe_cuts_long_fragments_like_the_library():
    import random

    c, rng = bpe.coder(None), random.Random(5)
    letters = [*"+;{}&>`^@'''smtdrevl.ab1é’”中²_-", "'s", "'ll", "'re"]
    texts = ["function(a,b){return(document.getElementById(a)+'message'+b)}", "a" * 50 + "^'sx", "x" * 50 + "+'m", "x" * 50 + "}'s", "x" * 50 + "”'s"]
    texts += ["".join(rng.choices(letters, k=rng.randint(40, 120))) for _ in range(2000)]
    for t in texts:
        want = c.library.encode(t, add_special_tokens=False).ids
        assert c.encode(t.encode()) == (np.array(want, "<u4").tobytes(), t.encode()), t


def test_forced_pairs():
    f = bpe.forced_pairs([b"ab", b"abc", b"x"])
    assert not f[97, 98] and not f[98, 99] and f[97, 99] and f[120, 97]


@pytest.mark.parametrize("in_one", [1000, 0])
def test_components(spark, in_one):
    edges = [(i, i + 1) for i in range(40) if i % 10 != 9] + [(100, k) for k in range(101, 160)] + [(5, 5), (None, 3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), "b", "a", in_one=in_one).collect()}
    assert got == {i: i // 10 * 10 for i in range(40)} | {k: 100 for k in range(100, 160)}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b", in_one=in_one).collect() == []


def test_least_reachable_and_forests(monkeypatch):
    from lacuna.llm import components as c

    rng = np.random.default_rng(3)
    for n, many in ((30, 20), (300, 290), (300, 900)):
        a, b = rng.integers(-n, n, (2, many))
        want = {int(x): int(x) for x in np.concatenate([a, b])}
        for _ in want:
            for x, y in zip(a.tolist(), b.tolist()):
                want[x] = want[y] = min(want[x], want[y])
        nodes, least = c.least_reachable(a, b)
        assert dict(zip(nodes.tolist(), least.tolist())) == want
        # Folded in small steps, the links left connect the same nodes.
        monkeypatch.setattr(c, "FOREST_LINKS", 25)
        batches = [pa.record_batch([pa.array(a[i : i + 10]), pa.array(b[i : i + 10])], ["u", "v"]) for i in range(0, many, 10)]
        left = list(c._forest(batches))
        nodes, least = c.least_reachable(*(np.concatenate([x.column(k).to_numpy() for x in left]) for k in "uv"))
        assert {k: v for k, v in want.items() if list(want.values()).count(v) > 1} == dict(zip(nodes.tolist(), least.tolist()))


def test_release_deletes_scratch(spark):
    import os

    from lacuna.llm import common

    df = common.stage(spark.range(5), "t")
    path = df.inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path) and common.release(spark) >= 1 and not os.path.exists(path)


def test_empty_tables(spark):
    docs = documents(spark, [])
    runs = [license_scan.scan(docs), sharding.shard_documents(docs), token_orc.round_trip(docs), mixing.mix(docs), quality.score(docs, None), suffix_dedup.deduplicate(docs), jaccard.join(docs), bpe.encode(docs)]
    runs.append(embed_dedup.deduplicate(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")))
    runs.append(warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")))
    for df in runs:
        assert df.count() == 0


def test_equal_rows_are_dealt_apart(spark):
    """Where 2000 of 6000 rows are equal, each shard gets about its share of them, and few lie side by side."""
    rows = [(i if i >= 2000 else 7, "same" if i < 2000 else f"row {i}") for i in range(6000)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), 12).toPandas()
    assert Counter(zip(got.doc_id, got["size"], got.text_crc32)) == Counter((i, len(t) + 8, zlib.crc32(t.encode())) for i, t in rows)
    equal = got[got.doc_id == 7]
    shares = equal.groupby("shard").size()
    assert len(shares) == 12 and ((shares - 2000 / 12) ** 2 / (2000 / 12)).sum() < 33
    places = set(zip(equal.shard, equal.slot))
    assert 0.25 < sum((s, k + 1) in places for s, k in places) / len(places) < 0.42


def test_large_hypergeometric_draws():
    from lacuna.llm.draws import hypergeometric

    rng = np.random.default_rng(2)
    for good, bad, n in ((3 * 10**11, 10**12, 5 * 10**10), (10**9, 40, 5 * 10**8), (2 * 10**9, 10**9, 3 * 10**9 - 1000)):
        x = np.array([hypergeometric(rng, good, bad, n) for _ in range(3000)], float)
        total = good + bad
        mean, spread = n * good / total, (n * good / total * bad / total * (total - n) / (total - 1)) ** 0.5
        assert abs(x.mean() - mean) < 5 * spread / 3000**0.5 and abs(x.std() / spread - 1) < 0.1


def test_sample_of_labels_is_bounded(spark):
    docs = spark.createDataFrame([(1, f"text {i % 3}") for i in range(500)] + [(2, "other text")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, quality int")
    rows, good = quality.sample(docs, labels, 1)
    assert len(rows) <= 2 and sorted(good) in ([0, 1], [1])


def test_least_id_and_null_stay_apart(spark):
    least = -(2**63)
    text = "six words are enough for this"
    docs = spark.createDataFrame([(least, text), (least + 1, text), (5, text), (9, "nothing like it at all here")], "doc_id long, text string")
    assert {tuple(r)[::2] for r in jaccard.join(docs).collect()} == {(least, least), (least + 1, least), (5, least), (9, 9)}
    more = docs.unionByName(spark.createDataFrame([(None, text)], "doc_id long, text string"))
    assert {tuple(r)[::2] for r in jaccard.join(more).collect()} == {(None, None), (least, None), (least + 1, None), (5, None), (9, 9)}


def test_long_texts_and_shared_ids_in_suffixes(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    old, suffix_dedup.STEP = suffix_dedup.STEP, 500
    try:
        p = word(150)
        rows = [(1, p), (2, p + word(30)), (2, word(20) + p + word(40)), (3, word(3000) + p + word(2500)), (None, word(200)), (None, word(210) + p)]
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
        keys = suffix_dedup.Ids(df, "doc_id")
        found = list(suffix_dedup._pieces([df.select(keys.key.alias("key"), F.xxhash64("text").alias("t"), "text").toArrow().combine_chunks().to_batches()[0]]))
        assert any(o[0] > 0 for _, _, o, _ in found) and sum(max(0, len(x) - 99) for *_, xs in found for x in xs) == sum(max(0, len(t) - 99) for _, t in rows)
        assert sorted(map(tuple, suffix_dedup.deduplicate(df).collect()), key=str) == brute_suffixes(rows)
    finally:
        suffix_dedup.STEP = old


def test_bucket_pointers_by_brute_force():
    rng = random.Random(6)
    raw = bytes(rng.choices(b"ab", k=400)) * 3 + bytes(rng.choices(b"abc", k=300))
    got = suffix_dedup.bucket_pointers(raw)
    first = {}
    want = [first.setdefault(raw[i : i + 100], i) for i in range(len(raw) - 99)]
    assert len(got) == len(want) and len(set(zip(got.tolist(), want))) == len(set(want)) == len(set(got.tolist()))


def test_memos_are_bounded():
    from lacuna.llm.common import Memo

    memo = Memo(lambda k: k[::-1], 100_000)
    for i in range(5000):
        k = b"%d" % (i * 7919 % 4001)
        assert memo.all([k, b"x"]) == [k[::-1], b"x"]
    assert len(memo.young) + len(memo.old) < 1200
