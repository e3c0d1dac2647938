"""A training corpus from raw documents: five operators, one after another, each over all that its predecessor kept.

Every stage but the last gives rows of the table that it was given, with all
their columns, whatever else these are called; repeated rows and ids count as
rows of their own unless a stage says otherwise; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import cotrain, near_dedup, packing, quality_rules, suffix_dedup
from tessera.llm.common import stored

#: Repeated passages of more words than this are cut.
REPEAT_WORDS = 50
#: The shortest such passage: one byte a word and one between two.
LEAST_BYTES = 2 * REPEAT_WORDS + 1
#: A repeated passage of so many bytes is cut however few words it has.
REPEAT_BYTES = 300


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no learned rule and no base rule rejects.

    Null, empty and blank texts have no ten words and go; texts of any length are counted whole.
    """
    return quality_rules.filter_by_rules(docs, quality_rules.learn_rules(docs, _labels(spark, sf_dir)))


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier takes for good.

    Null texts count as empty ones and null metadata as a value of its own;
    without labels of both kinds for these documents, all stay.
    """
    return cotrain.filter_good(docs, cotrain.fit(docs, _labels(spark, sf_dir)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose sets of five-word shingles overlap by four fifths or more.

    The row of the least id stays, known ids before null ones; rows equal to it
    in id and text go too.  Texts without a word, null ones included, all stay.
    """
    return near_dedup.drop_near_duplicates(docs, width=5, percent=80)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of more than ``REPEAT_WORDS`` words that stand in several places.

    Null texts stay null; of equal texts all lose what they share, so copies are for the stage before.
    """
    return suffix_dedup.remove_repeats(docs, length=LEAST_BYTES, over_words=REPEAT_WORDS, or_bytes=REPEAT_BYTES)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 ids; a null or empty text is its end id alone."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", rules),
    ("quality_classifier", classifier),
    ("near_dedup", near_duplicates),
    ("suffix_dedup", repeats),
    ("packing", packed),
]

#: Learned rules, a trained classifier and exact text surgery aren't SQL; tests compare the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs
