"""From raw documents to packed training windows: five stages, each on all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet in the shared folder and
rereads as the next stage's docs. All but the last return the columns of docs as they came, extra ones included, whatever
their names. An empty table gives an empty table in every stage. A stage's own tables go when its result is written.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

from graphloom.llm import common, decontaminate, language, lines, packing, simhash  # noqa: E402


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters or in none of the corpus's languages go: null and empty texts too. Repeated rows, and rows
    with a null doc_id or lang, are judged by their text like others."""
    return language.keep_known(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cross-site boilerplate lines go; so do documents of which nothing else is left. Null and empty texts and rows with a
    null doc_id stay as they are; a null source is no site; of repeated rows each keeps a line's first place."""
    return lines.without_boilerplate(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the least doc_id. Null and empty texts resemble nothing, rows
    with a null doc_id stay, and of rows that share a doc_id the one with the least hash stays."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go: all rows of such a doc_id. Null and empty texts hold none, rows with a null
    doc_id stay."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all remaining documents in windows of several lengths. Null and empty texts and rows with a null doc_id have
    none; repeated rows are packed each."""
    return packing.pack_documents(docs)


STAGES = [("language ID", language_id), ("line dedup", line_dedup), ("near-dedup", near_dedup), ("decontamination", decontamination), ("packing", pack)]
#: SQL cannot express hyperdimensional profiles, a SimHash forest or best-fit packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = common.tables()
    for name, stage in STAGES:
        docs = common.written(spark, stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        common.release(spark, before, keep=1)
    return docs
