"""A training-data pipeline over documents: language ID, toxicity, near duplicates, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before it kept, and returns a DataFrame that is
written as Parquet and read again as the docs of the next stage. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm import jaccard, language, packing, toxicity
from ledgerlake.llm.common import save, table
from ledgerlake.llm.queries import vocabulary_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents of one of the corpus's languages; texts without letters and of no known language go.

    The declared language is the column lang, the host the column source. A null text has no letters and goes.
    """
    names, model = language.fit(docs)
    key = F.xxhash64("text").alias("text_hash")
    rows = docs.select("doc_id", key, F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"), "text", F.col("lang").cast("string").alias("declared"), F.col("source").cast("string").alias("host"), F.lit(None).cast("string").alias("suffix"))
    found = language.identify(rows, names, model)
    gone = save(found.where((F.col("lang") == language.UNKNOWN) | ~F.col("letters")).select(F.col("doc_id").alias("gone_id"), "text_hash").distinct(), "rejected")
    kept = docs.select(*COLUMNS, key).join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.xxhash64("text") == gone["text_hash"]), "left_anti")
    return kept.select(*COLUMNS)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose score is under the threshold; the network learns from labelled rows of docs.

    Null and empty texts score 0 and stay; equal texts have equal scores, so repeated rows stay or go together. Where docs
    have no labels of both kinds, or are empty, nothing goes.
    """
    net = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select(*COLUMNS), net).where(F.col("score") < toxicity.THRESHOLD).drop("score")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of linked documents the one with the least doc_id (null first, of several the least hash of the row).

    A document is a doc_id with a text: different texts under one doc_id are documents of their own, and of rows that
    repeat one all are linked, so one stays. Documents without a word are linked with nothing; of their repeats one stays,
    too. An empty table stays empty.
    """
    keyed = docs.select(*COLUMNS, F.xxhash64("doc_id", "text").alias("_key"))
    groups = jaccard.near_duplicates(keyed.select(F.col("_key").alias("doc_id"), "text")).select(F.col("doc_id").alias("_key"), "component_id").distinct()
    ids = keyed.select("_key", "doc_id").distinct()
    first = groups.join(ids, "_key").groupBy("component_id").agg(F.min(F.struct("doc_id", "_key")).alias("first")).select(F.col("first._key").alias("_key"))
    kept = keyed.join(first, "_key", "left_semi")
    # rows that repeat are few or none: only they are compared as a whole
    again = keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_key")
    once = kept.join(again, "_key", "left_anti").unionByName(kept.join(again, "_key", "left_semi").dropDuplicates(["_key"]))
    return once.select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents left, packed into sequences of at most 1024 ids.

    Null and empty texts are their end id; rows that share a doc_id are packed one by one; no documents give no pieces.
    """
    return packing.pack(docs, vocabulary_path("byte_bpe_50k.json"))


STAGES = [("language ID", language_id), ("toxicity", toxic), ("n-gram Jaccard join", near_duplicates), ("packing", pack)]

#: Neither the network nor the language models nor the tokenizer can be written as SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = save(docs, "stage")
    return docs
