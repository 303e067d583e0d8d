"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree (operator 6).

A block is one document in one pass over its source. Targets in words follow from the sources' weights and are
capped at REPEATS times a source's size; a source is passed over whole as often as its target allows, and the
rest is drawn from the beginning of a permutation of its documents, the last one in part. The blocks drawn from
each source are the quotas; a binary tree over the output shards splits all sources' quotas at once by the
multivariate hypergeometric law, so that every shard gets an exact number of blocks of every source, as a
uniform shuffle of the whole mix would give. Shards draw disjoint runs of the permuted blocks and shuffle them;
draw() writes the documents out by shard, in the order of their slots.

Everything on rows is DataFrame functions; the driver sees one total per source, and draws the tree's numbers.

Null texts have size 0, as empty ones; a null source is a source of its own, last. Repeated rows are separate
documents, told apart by a number, and each keeps its own columns. Without any words nothing is taken. A very long
text is one document like others, cut by words where its block is. An empty table gives empty ones. Extra columns,
whatever their names, are kept by draw() and never read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, fresh, partitions, stage, text_of
from .draws import multivariate

# The weights of the sources in order, repeating, and the most passes over a source.
WEIGHTS = (5, 2, 1)
REPEATS = 3
SHARDS = 16
#: Rows of a source's permutation, or of a shard, that a task orders at a time, about.
PIECE_ROWS = 1 << 14
#: Neighbouring slots of a shard that draw() keeps together.
SLOTS = 512


def size_of(text: str = "text") -> Column:
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("long")


def _row_hash(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), F.col("text"))


def targets(sizes: DataFrame, weights=WEIGHTS, repeats: int = REPEATS, share: float = 1.0) -> DataFrame:
    """source, source_size, target from source, source_size: the total by weight, under the caps.

    Sources sorted by cap over weight reach their caps first; a source is capped if the words left, divided by
    the weights left, would give it more. One row per source, in one task.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(repeats)))
    everything = Window.partitionBy()
    first = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"total": F.sum("source_size").over(everything) * F.lit(share), "w_all": F.sum("w").over(everything)})
    rows = rows.withColumns({"level": (F.col("total") - F.coalesce(F.sum("cap").over(first), F.lit(0.0))) / (F.col("w_all") - F.coalesce(F.sum("w").over(first), F.lit(0.0)))})
    rows = rows.withColumn("capped", F.col("cap") <= F.col("level") * F.col("w"))
    # Capped sources form a beginning of the order; the first one that isn't gives the level for the rest.
    rows = rows.withColumn("rest", F.min(F.when(~F.col("capped"), F.struct((F.col("cap") / F.col("w")).alias("r"), F.col("level").alias("level")))).over(everything)["level"])
    return rows.select("source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(F.least("cap", F.col("rest") * F.col("w"))).alias("target"))


def splitting_tree(quotas: list[int], shards: int, seed: int) -> np.ndarray:
    """Blocks by source and shard: the quotas split in two, and again, down to single shards of nearly equal size."""
    rng = np.random.default_rng(seed)
    out = np.zeros((len(quotas), shards), np.int64)

    def split(at: np.ndarray, low: int, high: int):
        if high - low == 1:
            out[:, low] = at
            return
        middle = (low + high) // 2
        left = multivariate(rng, at, int(at.sum()) * (middle - low) // (high - low))
        split(left, low, middle)
        split(at - left, middle, high)

    if quotas:
        split(np.array(quotas, np.int64), 0, shards)
    return out


def _place(rows: DataFrame, of: list[str], order: list[str], measures: dict[str, str], pieces: int) -> DataFrame:
    """Adds, for each name: sum, the running sum of a column before the row in the given order within the groups of `of`.

    The groups are cut by the first order column, a uniform hash, into pieces that tasks sort on their own.
    """
    rows = rows.withColumn("__piece", F.pmod(F.shiftright(order[0], 24), F.lit(pieces)).cast("int"))
    sums = rows.groupBy(*of, "__piece").agg(*[F.sum(x).alias(f"__{k}") for k, x in measures.items()])
    before = Window.partitionBy(*of).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*[F.col(c).alias(f"__k_{c}") for c in of], F.col("__piece").alias("__k_piece"), *[F.coalesce(F.sum(f"__{k}").over(before), F.lit(0)).alias(f"__{k}") for k in measures])
    inside = Window.partitionBy(*of, "__piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({k: F.coalesce(F.sum(x).over(inside), F.lit(0)) for k, x in measures.items()})
    match = F.col("__piece") == F.col("__k_piece")
    for c in of:
        match = match & F.col(c).eqNullSafe(F.col(f"__k_{c}"))
    rows = rows.join(offsets, match)
    return rows.withColumns({k: F.col(k) + F.col(f"__{k}") for k in measures}).drop("__piece", "__k_piece", *[f"__k_{c}" for c in of], *[f"__{k}" for k in measures])


def mix(docs: DataFrame, weights=WEIGHTS, repeats: int = REPEATS, share: float = 1.0, shards: int = SHARDS, seed: int = 11) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, and blocks, a list of (pass, words, shard, slot), for every document.

    docs needs doc_id, text and source. slot: the block's place in its shard.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size_of().alias("size"), _row_hash(seed).alias("h0"))
    # Equal rows are told apart by a number, so that each is a document of its own.
    slim = stage(slim.withColumn("copy", F.row_number().over(Window.partitionBy("h0").orderBy("doc_id", "source", "size"))).withColumn("h", F.xxhash64("h0", "copy")), "mix_sizes")
    pieces = max(1, slim.count() // PIECE_ROWS)
    known = stage(targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, repeats, share), "mix_targets")
    rows = slim.join(known.withColumnRenamed("source", "k_source"), F.col("source").eqNullSafe(F.col("k_source"))).drop("k_source")
    rows = _place(rows, ["source"], ["h", "doc_id", "copy"], {"before": "size"}, pieces)
    whole = F.when(F.col("source_size") > 0, F.floor(F.round("target") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.round("target") - F.col("whole") * F.col("source_size")
    rows = rows.withColumn("whole", whole.cast("long")).withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), rest.cast("long") - F.col("before"))))
    rows = stage(rows.withColumn("taken", F.col("whole") * F.col("size") + F.col("part")).drop("before"), "mix_taken")
    # Blocks, their quotas by source, and the tree.
    passes = F.when(F.col("size") > 0, F.sequence(F.lit(0), F.col("whole") - F.when(F.col("part") > 0, 0).otherwise(1))).otherwise(F.array().cast("array<long>"))
    passes = F.when(F.col("taken") > 0, passes).otherwise(F.array().cast("array<long>"))
    blocks = rows.select("doc_id", "copy", "h", "source", F.explode(passes).alias("pass"), "whole", "size", "part")
    blocks = blocks.withColumn("words", F.when(F.col("pass") < F.col("whole"), F.col("size")).otherwise(F.col("part"))).withColumn("r", F.xxhash64(F.lit(seed + 1), "h", "pass")).withColumn("one", F.lit(1).cast("long")).drop("whole", "size", "part")
    quotas = sorted(((r["source"], r["n"]) for r in blocks.groupBy("source").agg(F.count("*").alias("n")).collect()), key=lambda x: (x[0] is None, x[0]))
    tree = splitting_tree([n for _, n in quotas], shards, seed)
    ends = spark.createDataFrame([(s, x) for (s, _), x in zip(quotas, np.cumsum(tree, 1).tolist())], "q_source string, ends array<long>")
    placed = _place(blocks, ["source"], ["r", "doc_id", "copy", "pass"], {"rank": "one"}, max(1, sum(n for _, n in quotas) // PIECE_ROWS))
    placed = placed.join(ends, F.col("source").eqNullSafe(F.col("q_source")))
    placed = placed.withColumn("shard", F.size(F.filter("ends", lambda e: e <= F.col("rank")))).withColumn("r", F.xxhash64(F.lit(seed + 2), "r")).drop("ends", "q_source", "rank")
    placed = _place(stage(placed, "mix_blocks"), ["shard"], ["r", "doc_id", "copy", "pass"], {"slot": "one"}, max(1, sum(n for _, n in quotas) // (PIECE_ROWS * shards)))
    listed = placed.groupBy("h", "doc_id", "copy").agg(F.sort_array(F.collect_list(F.struct("pass", "words", "shard", "slot"))).alias("blocks"))
    match = rows["h"].eqNullSafe(listed["h"]) & rows["doc_id"].eqNullSafe(listed["doc_id"]) & (rows["copy"] == listed["copy"])
    return rows.join(listed, match, "left").select(rows["doc_id"], "h0", "source", rows["copy"], "size", "source_size", "target", "taken", "blocks")


def draw(docs: DataFrame, plan: DataFrame, seed: int = 11) -> DataFrame:
    """The mixed documents, with docs' columns: a document once for each block that was drawn of it, cut to the block's words.

    Rows come out by shard, in the order of their slots within it, as many neighbouring slots to a partition as fit.
    Rows equal in doc_id and text are numbered by source, as in mix(), and each keeps its own columns and blocks; seed
    must be mix()'s.
    """
    names = docs.columns
    h0, source, copy, h, k_source, k_copy, blocks, block, shard, run, slot = fresh(docs, "h0", "source0", "copy0", "h", "k_source", "k_copy", "blocks", "block", "shard", "run", "slot")
    lists = plan.where("taken > 0").select(F.col("h0").alias(h), F.col("source").alias(k_source), F.col("copy").alias(k_copy), F.col("blocks").alias(blocks))
    keyed = docs.withColumns({h0: _row_hash(seed), source: F.col("source").cast("string")})
    # Of equal sources it doesn't matter to mix() which row comes first; the other columns' hash makes it the same one each time.
    rest = [c for c, kind in docs.dtypes if c not in ("doc_id", "text", "source") and "map<" not in kind and "variant" not in kind]
    order = [F.col("doc_id").cast("long"), F.col(source), *([F.xxhash64(*rest)] if rest else [])]
    keyed = keyed.withColumn(copy, F.row_number().over(Window.partitionBy(h0).orderBy(*order)))
    # Numbers are compared by their difference, so that the hash alone is the join's key and texts, dealt by it for the numbering, stay where they are.
    match = (F.col(h0) == F.col(h)) & ((F.col(copy) - F.col(k_copy)) == 0)
    joined = keyed.join(lists, match).select(*names, F.explode(blocks).alias(block))
    pieces = F.regexp_extract_all(F.col("text"), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    words = F.col(f"{block}.words")
    cut = F.when(words < size_of(), F.array_join(F.slice(pieces, F.lit(1), words.cast("int")), "")).otherwise(F.col("text"))
    placed = joined.withColumns({"text": cut, shard: F.col(f"{block}.shard"), slot: F.col(f"{block}.slot")}).withColumn(run, F.floor(F.col(slot) / SLOTS))
    return placed.repartition(partitions(docs.sparkSession), shard, run).sortWithinPartitions(shard, run, slot).select(*names)


def digests(plan: DataFrame) -> DataFrame:
    blocks = F.when(F.col("blocks").isNull(), 0).otherwise(F.size("blocks"))
    first = F.get(F.col("blocks"), F.lit(0))
    return plan.select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), "taken", blocks.cast("long").alias("n_blocks"), first["shard"].cast("int").alias("first_shard"), first["slot"].alias("first_slot"))
