"""Listings that arrive as files: keep what is new or changed, upsert, repeat safely."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions.scalars import filename, image_id
from ..operators.catalog import detect_changes, upsert
from ..sources.files import write_catalog


def catalogue_rows(files: DataFrame) -> DataFrame:
    """What a listing alone says of an image."""
    return files.select(
        image_id(F.col("path")).alias("image_id"), F.col("path").alias("filepath"), filename(F.col("path")).alias("filename"), "file_size", "file_modified")


def newest_per_path(files: DataFrame) -> DataFrame:
    """The latest version of each path in one batch."""
    return files.groupBy("path").agg(F.max_by(F.struct("file_size", "file_modified"), F.struct("file_modified", "file_size")).alias("f")).select("path", "f.*")


def ingest_batch(files: DataFrame, images: DataFrame) -> DataFrame:
    """``images`` after one listing. Applying it twice changes nothing more."""
    changed = detect_changes(newest_per_path(files), images)
    return upsert(images, catalogue_rows(changed), "image_id")


def ingest_stream(spark: SparkSession, incoming: str, base: str, checkpoint: str) -> str | None:
    """Apply all listings (Parquet, schema FILES) below ``incoming`` that were not
    seen yet; the catalogue's current version is named by a small table below
    ``base``. Returns the path of the current version."""
    current = f"{base.rstrip('/')}/current"

    def version() -> str | None:
        try:
            rows = spark.read.parquet(current).collect()  # one row per batch
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise
        return max(rows, key=lambda r: r["batch"])["path"] if rows else None

    def apply(batch: DataFrame, number: int) -> None:
        at = version()
        images = schema.evolve_schema(spark.read.parquet(at)) if at else spark.createDataFrame([], schema.IMAGES)
        path = write_catalog(ingest_batch(batch, images), base)
        spark.createDataFrame([(number, path)], "batch long, path string").write.mode("append").parquet(current)

    stream = spark.readStream.schema(schema.FILES).parquet(incoming)
    stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return version()
