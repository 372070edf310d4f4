"""The thin queries of the text operators; each runs over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, classlm, imatch, jaccard, language, licenses, negatives, neighbours, packing, quality, repair, resampling, toxicity
from .common import table


def vocabulary_path(name: str) -> str:
    """Where a public vocabulary file lies; operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"))


def op2_repair_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.read_shards(repair.write_shards(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"), end_id=2))


def op3_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprints(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licenses(table(spark, sf_dir, "documents"))


def op6_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    names, model = language.fit(table(spark, sf_dir, "documents"))
    return language.identify(language.page_rows(table(spark, sf_dir, "pages")), names, model)


def op9_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classlm.score(table(spark, sf_dir, "documents"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine(table(spark, sf_dir, "embeddings"))


def op12_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_neighbours": op1_neighbours,
    "op2_repair_shards": op2_repair_shards,
    "op3_imatch": op3_imatch,
    "op4_packing": op4_packing,
    "op5_licenses": op5_licenses,
    "op6_tree_bpe": op6_tree_bpe,
    "op7_toxicity": op7_toxicity,
    "op8_language": op8_language,
    "op9_class_lm": op9_class_lm,
    "op10_near_duplicates": op10_near_duplicates,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_quality_gam": op12_quality_gam,
    "op13_resampling": op13_resampling,
    "pipeline": pipeline,
}

#: The others can't be written as SQL that DuckDB runs: tests hold them against brute force instead.
ORACLES: dict[str, str] = {"op11_hard_negatives": negatives.ORACLE, "op13_resampling": resampling.ORACLE}
