"""Sources and sinks: listings, allow-lists, votes, vectors, tables, reports."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..operators.catalog import upsert

EXTENSIONS = (".jpg", ".jpeg", ".png", ".webp")


def image_suffix(path: Column) -> Column:
    """True for suffixes of EXTENSIONS that are all lower or all upper case."""
    plain = "|".join(e[1:] for e in EXTENSIONS)
    return path.rlike(rf"\.({plain}|{plain.upper()})$")


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, file_size, file_modified) of the pictures below ``root``; contents are not
    read. A folder that tasks can open is walked by them. What else Spark can read (a
    pattern, a single file, a file system that Arrow has not) is listed by Spark: the
    driver holds that listing, and empty and hidden files are passed over."""
    from . import walk  # uses this module

    if walk.walkable(spark, root):
        return walk.walk_files(spark, root)
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = F.regexp_replace("path", "^file:/+", "/")
    return rows.select(path.alias("path"), F.col("length").alias("file_size"), F.col("modificationTime").alias("file_modified")).where(image_suffix(F.col("path")))


def newest_first(files: DataFrame) -> DataFrame:
    """An order for output only."""
    return files.orderBy(F.desc("file_modified"), "path")


def read_allowlist(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, folder): trimmed lines that are not blank and no comment."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "folder"))
    lines = lines.withColumn("folder", F.regexp_replace("folder", r"^\s+|\s+$", ""))
    return lines.where((F.col("folder") != "") & ~F.col("folder").startswith("#"))


def read_votes(spark: SparkSession, path: str) -> DataFrame:
    """(vote_id, choice, a, b) of a JSON list; the place in the list is the id."""
    votes = "array<struct<choice:string,a:string,b:string>>"
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", votes)).alias("vote_id", "v"))
    return rows.select(F.col("vote_id").cast("long").alias("vote_id"), "v.choice", "v.a", "v.b")


def read_tier_labels(spark: SparkSession, labels_path: str, key_path: str) -> DataFrame:
    """(n, tier, image_id): a map of photo number to tier, joined to its key list."""
    labels = spark.read.text(labels_path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("n", "tier"))
    key = spark.read.schema("n int, image_id string").json(key_path, multiLine=True)
    return labels.withColumn("n", F.col("n").try_cast("int")).join(key, "n")


def decode_vectors(df: DataFrame, blob: str, out: str) -> DataFrame:
    """float32 little-endian bytes to array<float>; a null stays null."""

    @F.pandas_udf("array<float>")
    def decoded(blobs: pd.Series) -> pd.Series:
        return blobs.map(lambda b: None if b is None else np.frombuffer(b, "<f4"))

    return df.withColumn(out, decoded(blob))


def encode_vectors(df: DataFrame, vector: str, out: str) -> DataFrame:
    """array<float> to float32 little-endian bytes."""

    @F.pandas_udf("binary")
    def encoded(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())

    return df.withColumn(out, encoded(vector))


def blob_dimension(blob: Column) -> Column:
    """Without decoding."""
    return (F.octet_length(blob) / 4).cast("int")


def write_catalog(df: DataFrame, base: str) -> str:
    """Write a new version under ``base`` and return its path. The version that
    is being read stays untouched; the caller switches when it wants to."""
    path = f"{base.rstrip('/')}/version-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    return schema.evolve_schema(spark.read.parquet(path))


def build_vector_table(embeddings: DataFrame) -> DataFrame:
    """The rows that have a vector; ids travel with their vectors."""
    return embeddings.where("embedding is not null").select("image_id", "embedding")


def review_rows(triaged: DataFrame, images: DataFrame) -> DataFrame:
    """(image_id, suggested_rotation_ccw, margin, filepath) of the rows to review, best first."""
    paths = images.select("image_id", "filepath")
    rows = triaged.where("action = 'review'").join(paths, "image_id", "left")
    return rows.orderBy(F.desc("gain"), "image_id").select(
        "image_id", F.col("rotation").alias("suggested_rotation_ccw"), F.format_string("%.4f", "gain").alias("margin"), F.coalesce("filepath", F.lit("")).alias("filepath"))


def write_review_csv(triaged: DataFrame, images: DataFrame, path: str) -> None:
    review_rows(triaged, images).coalesce(1).write.csv(path, header=True, mode="overwrite")


def put_run_metadata(table: DataFrame, new: DataFrame) -> DataFrame:
    """Key and value; the new value of a key replaces the old one."""
    return upsert(table, new, "key")


def json_metadata(key: str, row: DataFrame) -> DataFrame:
    """One row's columns as a JSON value of ``key``."""
    return row.select(F.lit(key).alias("key"), F.to_json(F.struct("*")).alias("value"))
