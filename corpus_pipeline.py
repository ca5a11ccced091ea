"""A corpus pipeline: language ID, near-dedup, decontamination, secret scans, mixing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet and
read again as the next one's ``docs``. All but the last return the columns of ``documents``; the
last returns how many words of each document the mix takes.

Every stage takes nulls in any column, repeated rows and further columns of any names, which it
hands on, and makes an empty table of an empty one. A null text has no letters and ends at the
first stage; rows that repeat are near copies, of which the second stage keeps one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, language_id, mixing, near_dup, secret_scan
from tessera.llm.common import table
from tessera.sources.scratch import delete, scratch, stored


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without letters and those whose words don't fit the languages of labelled rows.

    Of what stays, a null ``lang`` becomes the language of most letters. Without labelled rows
    there is no language to fit, and all texts go.
    """
    return language_id.accepted(docs, language_id.calibrated(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of near duplicates: five-word shingles, 0.8 or more.

    The smallest doc_id stays, a null one only if there is no other.
    """
    return near_dup.deduplicated(docs, shingle=5, num=80, den=100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold an item of the benchmark; null and blank items are not looked for."""
    return decontaminate.uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps all documents, with each secret replaced by the name of its kind and ``n_chars`` to match."""
    return secret_scan.redacted(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken`` of every document of the mix."""
    return mixing.mixed_documents(docs).select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [
    ("language_id", language),
    ("near_dedup", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secrets),
    ("mixing", mixture),
]

#: SQL can't express the language model, nor edit distances within whole texts.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of ``documents`` after all stages; a stage's tables go when the next one's are written."""
    docs = table(spark, sf_dir, "documents")
    with scratch(spark) as whole:
        before = None
        for _, stage in STAGES[:-1]:
            with scratch(spark) as s:
                docs = stored(stage(spark, docs, sf_dir))
                s.keep(docs)
            if before:
                delete(spark, before)
            before = docs.stored_at
        with scratch(spark) as s:
            mixed = stored(STAGES[-1][1](spark, docs, sf_dir))
            s.keep(mixed)
        whole.keep(mixed)
    return mixed
