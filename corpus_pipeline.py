"""The corpus pipeline: five stages over `documents`, each on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evidra.llm import bpe, cpjoin, decontam, langid, windows
from evidra.llm.common import settle, stored
from evidra.session import ship

#: Least calibrated score of a document's language; below it, and without a letter, a document goes.
LEAST_LANGUAGE_SCORE = 0.4


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known.

    Null and empty texts and those without a letter go. Repeated rows are judged alike, very long texts as a whole.
    An empty table stays empty, and all columns stay, whatever their names; so in all stages but the last.
    """
    settle(spark)
    return langid.accepted(docs, LEAST_LANGUAGE_SCORE)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id, and of equal ids the first.

    Texts without words, null ones among them, are groups of their own and stay.
    """
    settle(spark)
    return cpjoin.distinct(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that an earlier one holds; n_chars counts what is left.

    No row goes: of equal texts the first stays whole. Null, empty and short texts stay as they are.
    """
    settle(spark)
    return windows.dedupe(docs, size_col="n_chars")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a word inside a benchmark window. Null and empty texts have none and stay."""
    settle(spark)
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, ids of each row left. Null and empty texts have no ids."""
    settle(spark)
    return bpe.digests(docs, with_ids=True)


STAGES = [("language ID", identified), ("n-gram Jaccard join", distinct), ("substring dedup", without_repeats), ("benchmark decontamination", decontaminated), ("BPE encoding and decoding", encoded)]

#: Stages 3, 5, 7 and 9 can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; the result of each but the last is written as Parquet and read again."""
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, name.replace(" ", "-"))
    return docs
