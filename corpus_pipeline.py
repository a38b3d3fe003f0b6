"""Documents to shards: quality rules, near duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir), works on all documents that the stage before kept, and returns the columns of docs
(their values untouched, extra columns kept); the last adds size, shard and slot. Null texts count as empty, so the quality
rules reject them; an empty table passes through. Mixing repeats a document that it takes more than once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm import decontaminate, mixing, near_dedup, quality, sharding
from tallymark.llm.common import shared_path, written


def _matching(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """docs whose doc_id and text are (left_semi) or are not (left_anti) among keys (doc_id, text_key)."""
    keys = keys.select(F.col("doc_id").alias("_id"), "text_key").distinct()
    own = F.xxhash64(docs["text"])
    return docs.join(keys, docs["doc_id"].eqNullSafe(keys["_id"]) & (own == keys["text_key"]), how)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    scores = written(quality.measured(docs), "quality")
    return _matching(docs, quality.judged(scores).where("kept"), "left_semi")


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one of smallest doc_id."""
    return near_dedup.first_of_each(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    hit = decontaminate.marked(keyed, benchmark, ("doc_id", "text_key")).where("n_hit > 0")
    return _matching(docs, hit, "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents, repeated or left out so that the sources meet their target weights."""
    return mixing.mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the shard that they are in and their slot there."""
    return sharding.assign_shards(docs)


STAGES = [("quality", good), ("near_dedup", unlike), ("decontaminate", clean), ("mixing", mix), ("sharding", shard)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
