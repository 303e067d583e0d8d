"""One query for each operator, over its whole table with production parameters, and SQL where SQL can tell."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, embed_dedup, jaccard, license_scan, mixing, quality, sharding, suffix_dedup, token_orc, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark, sf_dir):
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def op2_warc(spark, sf_dir):
    return warc.round_trip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_sharding(spark, sf_dir):
    return sharding.shard_documents(_table(spark, sf_dir, "documents"))


def op4_token_orc(spark, sf_dir):
    return token_orc.round_trip(_table(spark, sf_dir, "documents"))


def op5_embedding_dedup(spark, sf_dir):
    return embed_dedup.deduplicate(_table(spark, sf_dir, "embeddings"))


def op6_mixing(spark, sf_dir):
    return mixing.digests(mixing.mix(_table(spark, sf_dir, "documents")))


def op7_quality_rules(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


def op8_suffix_dedup(spark, sf_dir):
    return suffix_dedup.deduplicate(_table(spark, sf_dir, "documents"))


def op9_jaccard_join(spark, sf_dir):
    return jaccard.join(_table(spark, sf_dir, "documents"))


def op10_bpe(spark, sf_dir):
    return bpe.encode(_table(spark, sf_dir, "documents"), keep_ids=False)


def queries():
    return {f.__name__: f for f in (op1_license_scan, op2_warc, op3_sharding, op4_token_orc, op5_embedding_dedup, op6_mixing, op7_quality_rules, op8_suffix_dedup, op9_jaccard_join, op10_bpe)}


def oracle_sql():
    return {"op1_license_scan": license_scan.oracle(), "op2_warc": warc.ORACLE, "op5_embedding_dedup": embed_dedup.ORACLE, "op8_suffix_dedup": suffix_dedup.ORACLE, "op9_jaccard_join": jaccard.ORACLE}
