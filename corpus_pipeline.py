"""A training corpus from raw documents: drop toxic ones, keep one of near copies, hide secrets, pack into sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docstrata.llm import ngram_join, packing, secrets, toxicity
from docstrata.llm.shared import collected, forget, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among all documents, does not mark as toxic.

    Null and empty texts stay unless empty text is what the labels call toxic; null and repeated ids are rows like
    others; an empty table gives an empty result; without labels all documents stay.
    """
    source = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = toxicity.fit_on_labels(source, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_ordinary(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group that links of 0.8 and more connect.

    Texts without words stay; of rows that repeat the first id all stay; a row without an id goes only if a document with
    an id is in its group; an empty table gives an empty result.
    """
    return ngram_join.keep_first(docs)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret in their texts replaced. Null texts stay null; an empty table gives an empty result."""
    return secrets.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes: bin, capacity and offset, in byte tokens.

    A null or empty text is packed as one separator; each row, whatever its id, is packed by itself; an empty table gives
    an empty result.
    """
    return packing.best_fit(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("secrets", hide_secrets),
    ("best_fit_packing", pack_sequences),
]

ORACLE_SQL = None  # compression lengths, p-values and packing are beyond SQL; tests use brute force instead


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written to the shared folder and read again.

    Once a stage is written, the tables it was made of are deleted; the last one stays, as the result reads it.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for _, stage in STAGES:
        with collected() as paths:
            docs, path = table(stage(spark, docs, sf_dir))
        forget(spark, *(x for x in paths if x != path), *([before] if before else []))
        before = path
    return docs
