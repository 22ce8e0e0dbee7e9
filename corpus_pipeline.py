"""The corpus pipeline: quality, line dedup, near-duplicates, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's docs. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photocat.llm import bpe, chosenpath, lines, mixing, weaklabel
from photocat.llm.common import shared_dir
from photocat.llm.queries import BPE_FILE

#: Every document comes at least once, and none more often than this.
MOST_REPEATS = 1.25


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return weaklabel.judge(docs).where("keep").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten sources or more share stay in one document; n_chars follows the text."""
    kept = lines.dedup_lines(docs, site="source")
    chars = F.when(F.col("lines_removed") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", chars).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents stays."""
    return chosenpath.keep_one(docs).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are repeated towards even shares; the budget is the least that
    leaves every document in."""
    return mixing.mix(docs, budget=None, max_repeats=MOST_REPEATS).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document's text, and digests of the ids and of what they decode to."""
    decoded = bpe.round_trip(docs.select("doc_id", "source", "text"), public_tokenizers.path(BPE_FILE), public_tokenizers.PATTERN)
    return decoded.select("doc_id", "source", *bpe.digests(decoded))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("mixture", mixture), ("tokens", tokens)]

#: Learned scores, chosen paths and byte-level BPE have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
