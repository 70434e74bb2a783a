"""A corpus for training from ``documents``: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rosterspark.llm import exact_dedup, near_dedup, packing, secret_scan, toxicity
from rosterspark.llm.queries import PATTERN, RANKS, VOCABULARY, table
from rosterspark.llm.shared import materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score rejects go.

    A null or empty text stays, and so do all documents where no label can be learnt from. Repeated rows go or stay
    alike. All columns pass unchanged, whatever their names. An empty table gives an empty result.
    """
    return toxicity.keep_ordinary(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one stays: that with the largest id, and of rows that share it and the text one.

    Null and empty texts are equal. All columns pass unchanged. An empty table gives an empty result.
    """
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one stays: a text goes if a five-word similarity of 0.8 with one that stays is confirmed.

    Candidates share bands of minima (see the README). Null, empty and wordless texts stay; rows of equal texts go or
    stay alike. All columns pass unchanged. An empty table gives an empty result.
    """
    return near_dedup.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Found secrets are replaced in the texts; every document stays.

    Null and empty texts stay as they are, equal texts are changed alike, other columns pass unchanged. An empty table
    gives an empty result.
    """
    return secret_scan.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences, with their ids.

    Null and empty texts are pieces of one id; repeated rows are packed each; other columns are left out. An empty table
    gives an empty result.
    """
    return packing.pack(docs, RANKS, PATTERN, VOCABULARY)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near-dedup", drop_near_copies),
    ("secret scan", redact_secrets),
    ("packing", pack),
]

#: SQL cannot express scores, fingerprints or packing; tests hold each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, in order, over ``documents``; each is written to the shared folder and read again by the next.

    Nulls, empty and long texts, repeated rows and other columns are treated as each stage says. An empty table gives
    an empty result.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
