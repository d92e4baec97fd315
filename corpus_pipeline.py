"""From raw documents to packed sequences: each stage works on all that the one before it kept.

Language ID drops documents without a known language; SimHash near-dedup keeps one document of each
group; secret scans mask live secrets; mixing repeats or drops documents to reach the sources' target
weights; best-fit packing places the ids of what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evidentia.llm import langid, mixing, packing, secrets, simhash
from evidentia.llm.store import short_batches, written


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a learned language; those that language ID rejects go.

    Null, empty and letterless texts go, and texts whose n-grams hardly any language has. Rows that stay keep all
    their columns, whatever these are called; rows repeated whole stay or go together; very long texts are read
    whole; an empty table stays empty.
    """
    short_batches(spark)
    return langid.keep_known(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, Jaccard similarity of 0.8 or more): the smallest id.

    Null ids come last, ties go by a hash of the text, rows repeated whole are one; all texts without words are one
    group. Columns keep their names and values; an empty table stays empty.
    """
    short_batches(spark)
    return simhash.keep_one(docs)


def masked_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with live secrets in their text replaced by a mark; no row goes.

    Null and empty texts stay as they are; rows repeated whole are masked alike; very long texts are rebuilt by
    pieces. Other columns keep their names and values; an empty table stays empty.
    """
    return secrets.redact(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight asks: up to three times, or not at all.

    Null and empty texts have size zero and rates like the rest of their source; a null source is a source; rows
    repeated whole are drawn each for itself. Columns keep their names and values; an empty table stays empty.
    """
    return mixing.emit(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of at most 4096 tokens.

    Null text is empty (its end id alone); rows repeated whole are packed each; longer documents are cut; an empty
    table gives no sequence; other columns are not looked at.
    """
    short_batches(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", known_languages),
    ("simhash_near_dedup", one_of_each_group),
    ("secret_scans", masked_secrets),
    ("source_mixing", mixed_sources),
    ("best_fit_packing", packed_sequences),
]

#: Language ID, SimHash and tokenizing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
