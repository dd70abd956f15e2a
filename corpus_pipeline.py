"""A corpus from raw documents: two filters, two deduplications and packing, one operator per stage.

Each stage gets what the one before kept, written as Parquet in the shared folder and read again; a
filter is fitted on the documents it gets.  All but the last return the columns of ``documents``.  A null
text is the empty text: not toxic, but in no language, so the second stage rejects it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from public_tokenizers import path as tokenizer_path

from oppflow.llm import language, toxicity
from oppflow.llm.exact_dedup import drop_exact_copies
from oppflow.llm.near_dedup import drop_near_copies
from oppflow.llm.packing import pack_documents
from oppflow.llm.tables import table, written


#: Rows per batch that a task hands to Python.  Texts are long, and batches of the usual size would hold tens of
#: megabytes several times over, in the JVM as in Python.
BATCH_ROWS = "500"


def _short_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator does not reject."""
    _short_batches(spark)
    return toxicity.drop_toxic(docs, toxicity.fit_on_labels(docs, table(spark, sf_dir, "labels")))


def in_a_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents for which language identification finds a language."""
    _short_batches(spark)
    return language.drop_unknown(docs, language.fit_on_rows(docs))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    _short_batches(spark)
    return drop_exact_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) the document with the smallest id."""
    _short_batches(spark)
    return drop_near_copies(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 2048 tokens."""
    _short_batches(spark)
    return pack_documents(docs, tokenizer_path("word_bpe_49k.json"), end_id=0)


STAGES = [
    ("toxicity", clean), ("language", in_a_language), ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies), ("packing", packed),
]
ORACLE_SQL = None  # trained filters and a tokenizer are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``, each written and read back for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
