"""The corpus pipeline: quality rules, near-duplicate removal, mixing and tokenisation of documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes what a stage returns in
the shared folder and reads it again as the next one's docs.

Defined cases, of which the modules of the stages say more. A null, empty or short text fails the quality rules, so
later stages meet none in run(); alone they take them. Rows alike in all columns are copies, of which one stays. A row
without a doc_id stays if no other row has its text; a null source is a source of its own. Other columns go through
unchanged, whatever their names, but that a column `ids` gives way in the last stage. An empty table gives an empty
one. A column text, doc_id, lang or source that is missing is an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evspark.llm import dart, fertility, mixing, spm
from evspark.llm.common import drop_written, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the tokeniser fertility rules keep."""
    return fertility.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: the one with the least doc_id."""
    return dart.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources by weight takes them; a repeat is a row."""
    return mixing.mixed(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the ids of their SentencePiece encoding in place of their text."""
    return spm.encode_column(docs).drop("text")


STAGES = [("quality rules", quality), ("near duplicates", near_duplicates), ("mixing sources", mix), ("sentencepiece", tokenise)]

#: No stage but the first part of the rules can be put in SQL: vocabularies, signatures and flows
#: can't. tests/llm tests every stage and run() against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, tables = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        drop_written(*tables)
        tables = [docs]
    return docs
