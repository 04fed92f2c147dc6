"""Corpus preparation in five stages, each over what the one before it kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackgraph.functions.storage import scratch, shared_dir
from trackgraph.llm import decontamination, language_id, mixing, ngram_join, sharding
from trackgraph.llm.queries import held_out

#: A document whose best language has a smaller share than this is rejected.
LEAST_LANGUAGE_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language; those without letters or with an unsure language go. Columns of documents."""
    model = language_id.fit(docs.where(~held_out()))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")  # columns of any name pass
    found = language_id.identify(docs, model, whole)
    return found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select("row.*")


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of every group of documents that link by five-word shingles at a similarity of 0.8."""
    return ngram_join.one_of_each(docs, width=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return decontamination.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed(docs, weights=[5, 2, 1], share=1.5, most=2)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with size, text_crc32, law, shard (0 to 39), slot and grown_shard."""
    return sharding.sharded(docs, shards=40)


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", join_near_duplicates),
    ("benchmark_decontamination", decontaminate),
    ("source_mixing", mix_sources),
    ("sharding", shard),
]

#: Edit distances, set joins and seeded draws have no SQL form here. The operators have tests of their own (the n-gram join against brute
#: force); the rows that each stage keeps are not compared with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again.

    The tables that a stage keeps there for itself are removed once its result is written.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
