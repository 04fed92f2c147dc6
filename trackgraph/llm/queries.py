"""The operators of this folder as queries over the corpus tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackgraph.llm import oracles
from trackgraph.llm import decontamination, fill_in_middle, language_id, line_dedup, mixing, ngram_join, page_text, quality_classifier, quality_rules, sharding, token_records, whitening, window_dedup


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id"):
    """Every fourth document by the checksum of its id; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def op1_co_training_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality_classifier.scored(docs, quality_classifier.fit(docs, _table(spark, sf_dir, "labels")))


def op2_shard_by_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_table(_table(spark, sf_dir, "documents"), shards=40)


def op3_risk_controlled_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_super_kmer_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_dedup.without_repeats_digest(_table(spark, sf_dir, "documents"), width=20)


def op5_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_table(_table(spark, sf_dir, "documents"), weights=[5, 2, 1], share=1.5, most=2)


def op6_deletion_neighbourhood_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(_table(spark, sf_dir, "documents"), short_edits=1)


def op7_qgram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminations(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_records.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op9_word_first_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(~held_out()))
    return language_id.identify(docs, model, "doc_id", held_out().alias("held_out"))


def op10_token_group_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(_table(spark, sf_dir, "documents"), width=3, percent=90)


def op11_tiled_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", most=8)


def op12_site_template_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.main_texts(_table(spark, sf_dir, "pages"))


def op13_escaped_marker_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.digests(_table(spark, sf_dir, "documents"), fill_in_middle.Form(seed=7, share=100, spm=50))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [
        op1_co_training_quality, op2_shard_by_label_propagation, op3_risk_controlled_rules, op4_super_kmer_dedup, op5_pivotal_mix,
        op6_deletion_neighbourhood_lines, op7_qgram_decontamination,
        op8_token_records, op9_word_first_language, op10_token_group_join, op11_tiled_whitening, op12_site_template_text, op13_escaped_marker_fim]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return oracles.sql()
