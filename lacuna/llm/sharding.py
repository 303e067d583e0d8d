"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix (operator 3).

The rows of part p that go to shard s are drawn, for all parts and shards at once, from the multivariate
hypergeometric law that a uniform permutation of all rows would give: row p of the matrix sums to the part's
rows, column s to the shard's size. Each part permutes its rows and deals them out by its row of the matrix;
after the exchange every shard permutes what it received. Only counts come to the driver: a number for each part
and shard, and parts grow with the table once they hold PART_ROWS each.

Both permutations order rows by a hash of their place in the staged table, never of their values, so rows that
repeat are dealt apart like any others. Null and empty texts count as empty. Null ids are rows like others. Very
long texts count by their bytes and aren't held. An empty table gives no rows. Columns other than those chosen
by the caller aren't read; extra columns of rows, whatever their names, are kept by shuffle().
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, stage, text_of
from .draws import multivariate

#: Rows that one task orders at a time after the exchange.
BUCKET_ROWS = 1 << 13
#: Rows of a part of the matrix, at least, where the table's own partitions are smaller.
PART_ROWS = 1 << 16


def communication_matrix(parts: np.ndarray, shards: np.ndarray, seed: int) -> np.ndarray:
    """Counts by part and shard, with the given sums, as a uniform permutation has them."""
    rng = np.random.default_rng(seed)
    left, out = np.array(shards, np.int64), np.zeros((len(parts), len(shards)), np.int64)
    for p, n in enumerate(parts):
        out[p] = multivariate(rng, left, int(n))
        left -= out[p]
    return out


def shuffle(rows: DataFrame, n_shards: int, seed: int = 7) -> DataFrame:
    """rows with shard (0 to n_shards - 1) and slot (gapless from 0 within the shard) in a uniformly random order.

    Shards differ by one row at most. rows must not have columns named shard and slot.
    """
    spark = rows.sparkSession
    names = rows.columns
    part, place, at, ends, random, bucket, offset, key_part, key_bucket, key_shard = fresh(rows.withColumns({"shard": F.lit(0), "slot": F.lit(0)}), "part", "place", "at", "ends", "random", "bucket", "offset", "key_part", "key_bucket", "key_shard")
    # A row's place, once and for all: the staged part that it is in, and its number there.
    rows = stage(rows.withColumn(place, F.monotonically_increasing_id()), "shard_rows")
    whole = F.shiftright(place, 33)
    total, last = rows.agg(F.count("*"), F.max(whole)).first()
    n_parts = (last or 0) + 1
    several = max(1, -(-n_parts // max(1, total // PART_ROWS)))  # small partitions in a row make one part
    rows = rows.withColumn(part, F.floor(whole / several).cast("long"))
    counts = sorted((r[part], r["n"]) for r in rows.groupBy(part).agg(F.count("*").alias("n")).collect())
    sizes = np.full(n_shards, total // n_shards) + (np.arange(n_shards) < total % n_shards)
    matrix = communication_matrix(np.array([n for _, n in counts], np.int64), sizes, seed)
    dealt = spark.createDataFrame([(p, x) for (p, _), x in zip(counts, np.cumsum(matrix, 1).tolist())], f"{key_part} long, {ends} array<long>")
    first = Window.partitionBy(part).orderBy(F.xxhash64(F.lit(seed), place), place)
    rows = rows.withColumn(at, F.row_number().over(first)).join(dealt, F.col(part) == F.col(key_part))
    rows = rows.withColumn("shard", F.size(F.filter(ends, lambda e: e < F.col(at))))
    # The second permutation: by a random number, cut into buckets that tasks order on their own.
    buckets = max(1, -(-total // (n_shards * BUCKET_ROWS)))
    number = F.xxhash64(F.lit(seed + 1), place)
    rows = rows.select(*names, "shard", place, number.alias(random)).withColumn(bucket, F.pmod(F.shiftright(random, 20), F.lit(buckets)).cast("int"))
    rows = stage(rows, "shard_exchanged")
    sums = rows.groupBy(F.col("shard").alias(key_shard), F.col(bucket).alias(key_bucket)).agg(F.count("*").alias("n"))
    before = Window.partitionBy(key_shard).orderBy(key_bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(key_shard, key_bucket, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(offset))
    second = Window.partitionBy("shard", bucket).orderBy(random, place)
    rows = rows.withColumn(at, F.row_number().over(second)).join(offsets, (F.col("shard") == F.col(key_shard)) & (F.col(bucket) == F.col(key_bucket)))
    return rows.select(*names, "shard", (F.col(offset) + F.col(at) - 1).alias("slot"))


def shard_documents(docs: DataFrame, n_shards: int = 24, seed: int = 7) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document, by the law of rows."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text_of()) + 8).cast("long").alias("size"), F.crc32(text_of().cast("binary")).alias("text_crc32"))
    out = shuffle(slim, n_shards, seed)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
