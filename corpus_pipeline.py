"""A corpus pipeline: toxicity, line dedup, near-duplicate documents, secrets, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before
kept, and returns a DataFrame; all but the last return the columns of documents.

In every stage null texts count as empty and stay null; texts are read whole,
however long; extra columns stay, whatever their names; an empty table gives no
rows. Rows that repeat a doc_id are one document for the dedup stages: their
lines don't remove one another, and all of them stay or go. Other stages take
them one by one. Rows with a null doc_id are judged by their text, and the
near-dedup stage keeps them. Of equals the smallest doc_id, and in a text the
earliest line, stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomwork.llm import bpe, lines, packing, secrets, simhash, toxicity
from loomwork.llm.base import store, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a classifier trained on their labels doesn't reject."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that equal or resemble an earlier one."""
    return lines.remove_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of linked fingerprints."""
    return simhash.keep_first(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences."""
    return packing.pack_documents(docs, bpe.tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("SimHash near-dedup", drop_near_duplicates),
    ("secret scans", redact_secrets),
    ("packing", pack),
]

#: SQL can express neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder before the next stage reads it."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = store(docs, f"stage-{k}")
    return docs
