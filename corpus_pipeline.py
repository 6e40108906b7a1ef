"""The corpus pipeline: stages over ``documents``, each written and read again between.

Documents of low quality go, then those in no known language, then near duplicates but one, then those
that contain an item of the benchmark; the rest is packed into windows of ids.

Every stage but the last returns rows of its input with all their columns.  Tables without rows pass through; columns
beside doc_id, text and lang are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestrata.llm import decontam, langid, minhash, packing, quality, store, vocab


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the scorer trained on these documents' weak labels keeps.

    Null, empty and blank texts go; rows that repeat are judged alike; rows without an id are judged, but teach nothing."""
    return quality.keep_good(docs, quality.train(quality.features(docs)))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that ``lang`` names.

    Texts without a letter go; a null lang teaches nothing, and the row is judged like others; rows that repeat stay or go together."""
    return langid.keep_identified(docs, langid.train(docs))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one of least doc_id.

    Rows without an id and texts without a word link with nothing and stay; of rows that repeat one stays."""
    return minhash.keep_one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no item of the benchmark.

    Null and empty texts stay, as do all if the benchmark is empty; rows that repeat stay or go together."""
    return decontam.without_contamination(docs, store.spark_table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences of 4096 ids.

    A null or empty text is one piece of the end id; null ids stay null; long texts are cut into full windows; rows that repeat are packed as often as they come."""
    return packing.pack_documents(docs, vocab.vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_stage),
    ("language ID", language_stage),
    ("MinHash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("packing", packing_stage),
]
#: Stages here rest on trained models and tokenizers, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = store.spark_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = store.materialize(docs, f"stage-{k + 1}")
    return docs
