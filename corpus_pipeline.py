"""Corpus pipeline: documents in, packed sequences out. Each stage works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evalweave.llm import decontaminate, packing, quality, secret_scan, simhash
from evalweave.llm.common import materialize, table
from evalweave.llm.tokens import default_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go.

    Null and empty texts are rejected, as they have no words. Null doc_id, lang or source: judged like any other. Repeated rows
    are judged alike, and all kept or none. An empty table, or one with too few rows for an estimate: base rules alone.
    """
    return quality.filter_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by fingerprints within 2 bits the one with the smallest doc_id stays; edited copies mostly lie further apart and stay.

    Ties (rows that share this doc_id, repeated rows): one stays. A group whose doc_ids are all null: one stays; else a null is
    never the smallest. Texts without words link with one another. An empty table: no rows.
    """
    return simhash.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages go from the texts, again and again until none is left; n_chars follows.

    All rows stay, repeated ones and those with null doc_id included. Null text: stays null. A benchmark that is empty or has
    null or empty texts: nothing goes for these. An empty table: no rows.
    """
    return decontaminate.remove_passages(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts; n_chars follows.

    All rows stay, repeated ones and those with null doc_id included. Null text: stays null. Null source: an owner of its own.
    Spans that overlap are replaced as one. An empty table: no rows.
    """
    return secret_scan.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, each with its sequence.

    Null text: the end id alone. Each row is a document, repeated ones and those with null doc_id included. Lengths that tie are
    placed in the order of tasks and rows. An empty table: no rows.
    """
    return packing.pack(docs, default_path("byte_bpe_50k.json"))


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("decontamination", decontamination), ("secrets", secrets), ("packing", pack)]

#: Estimates, trees and tokenizers aren't SQL: tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs, name)
    return docs
