"""A corpus from raw documents to token ids: five stages, each on what the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the
next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.llm import bpe, jaccard, mixing, quality, suffix_dedup
from lacuna.llm.common import release, stage, written


def _counted(docs: DataFrame) -> DataFrame:
    """docs with n_chars of the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep(docs, model)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    return jaccard.keep_first(docs)


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte strings that an earlier document holds are cut out of the texts; every document stays, if only empty."""
    return _counted(suffix_dedup.cut(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn by their source's target, some in part, some several times, some not, and mixed: by shard, in slot order."""
    return _counted(mixing.draw(docs, stage(mixing.mix(docs), "mix_plan")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests, ids and decoded text of every drawn document."""
    return bpe.encode(docs)


STAGES = [("quality_rules", quality_rules), ("jaccard_join", jaccard_join), ("suffix_dedup", suffix_dedup_stage), ("mix_sources", mix_sources), ("bpe", encode)]

#: No SQL expresses a trained classifier, the drawing of a mix, or byte-pair encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = written()
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline_{name}")
        release(spark, since=before, keep=1)  # what led to the stage's rows; the rows stay
    return STAGES[-1][1](spark, docs, sf_dir)
