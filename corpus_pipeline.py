"""A pretraining-corpus pipeline: five stages, each a DataFrame of documents in and out.

``STAGES`` lists them in order. Each takes ``(spark, docs, sf_dir)``; what it returns is written as
Parquet and read again as the next stage's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexframe.llm import linededup, mixing, packing, quality, simhash
from codexframe.llm.common import discard, materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every quality rule; the others go, null and empty texts too. Repeated rows are judged each."""
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the boilerplate lines of their source; ``n_chars`` follows the text.

    A null text stays null; documents of a null source are one site. Repeated rows stay repeated.
    """
    cleaned = linededup.drop_boilerplate(docs)
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: five-word shingles, similarity 0.8 or more.

    The smallest id stays, null ids last. Texts without words, null too, are one class; of repeated rows one stays.
    """
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix reads them, in training order; those it doesn't reach go.

    A reading that the target cuts counts if at least half of the document lies within the target.
    Documents without words go; a null source is a source; repeated rows are read each.
    """
    return mixing.repeat_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents, placed in sequences of 1024. A null text counts as empty; repeated rows are packed each."""
    return packing.pack_documents(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("best_fit_packing", pack),
]

#: Tokenization and near-duplicate classes have no SQL form; tests check properties of each stage, and its operator against brute force on its own.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the ``documents`` table of ``sf_dir``. A stage's table goes when the next one's is written.

    An empty table gives an empty result; nulls, repeated rows and further columns are as each stage says.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (name, stage) in enumerate(STAGES):
        given, docs = docs, stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = materialize(docs, name)
            if at:
                discard(given)
    return docs
