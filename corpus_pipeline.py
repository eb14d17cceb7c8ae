"""From raw documents to packed training sequences, in five stages.

Each stage reads what its predecessor kept, as Parquet, whose table goes when the next one has been written. All but the
last return the columns of documents; the last returns the place of every piece of every document that is left.

Edge cases: a null text counts as empty in every stage, and as empty texts are equal, one of them stays, the one with the
smallest id, and is packed as an end mark alone. A null id sorts last. Of rows that repeat a text one stays, whichever
their ids are; rows that repeat an id with other texts are documents of their own. Without ratings the classifier keeps
everything, without items the decontamination does. Texts of any length go through whole; ones of more than 4096 tokens
are packed in pieces. An empty table gives an empty result. Other columns are kept up to the last stage, whatever their
names; the last leaves them out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronofold.llm import best_fit_packing, decontaminate, exact_dedup, quality, simhash_dedup
from chronofold.llm.common import drop_stored, stored, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the ratings, keeps."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the smallest id."""
    return exact_dedup.keep_first(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked fingerprints, the document with the smallest id."""
    return simhash_dedup.keep_one(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage that holds question and answer of a test item."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each piece in sequences of 4096 tokens."""
    return best_fit_packing.best_fit_packing(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("SimHash near-dedup", near_stage),
    ("benchmark decontamination", benchmark_stage),
    ("best-fit packing", packing_stage),
]

#: A fitted model, fingerprints and a tokenizer are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES[:-1]):
        kept = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if n:
            drop_stored(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
