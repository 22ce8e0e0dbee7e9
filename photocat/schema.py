"""Column types of the catalogue and schema evolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

IMAGES = T.StructType([
    T.StructField("image_id", T.StringType(), False), T.StructField("filepath", T.StringType(), False), T.StructField("filename", T.StringType(), False),
    T.StructField("folder", T.StringType()), T.StructField("file_hash", T.StringType()), T.StructField("file_size", T.LongType()),
    T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("date_taken", T.TimestampNTZType()),
    T.StructField("camera_make", T.StringType()), T.StructField("camera_model", T.StringType()), T.StructField("lens_model", T.StringType()),
    T.StructField("focal_length", T.DoubleType()), T.StructField("aperture", T.DoubleType()), T.StructField("iso", T.IntegerType()),
    T.StructField("shutter_speed", T.StringType()), T.StructField("gps_latitude", T.DoubleType()), T.StructField("gps_longitude", T.DoubleType()),
    T.StructField("orientation", T.IntegerType()), T.StructField("file_modified", T.TimestampType()), T.StructField("file_created", T.TimestampType()),
    T.StructField("indexed_at", T.TimestampType()), T.StructField("long_edge_px", T.IntegerType()), T.StructField("aesthetic_score", T.DoubleType()),
    T.StructField("source_class", T.StringType()), T.StructField("taste_score", T.DoubleType()), T.StructField("rotation_fix", T.IntegerType())])

EMBEDDINGS = T.StructType([T.StructField("image_id", T.StringType(), False), T.StructField("embedding", T.ArrayType(T.FloatType()))])
FILES = T.StructType([T.StructField("path", T.StringType(), False), T.StructField("file_size", T.LongType()), T.StructField("file_modified", T.TimestampType())])
VOTES = T.StructType([T.StructField("vote_id", T.LongType()), T.StructField("choice", T.StringType()), T.StructField("a", T.StringType()), T.StructField("b", T.StringType())])

#: Columns that came later and may be missing from old tables.
ADDED_LATER = ("long_edge_px", "aesthetic_score", "source_class", "taste_score", "rotation_fix")


def evolve_schema(images: DataFrame, columns: tuple[str, ...] = ADDED_LATER) -> DataFrame:
    """``images`` with the missing ones of ``columns`` as typed nulls."""
    missing = {f.name: F.lit(None).cast(f.dataType) for f in IMAGES if f.name in columns and f.name not in images.columns}
    return images.withColumns(missing) if missing else images


def few_rows(spark: SparkSession, rows: list[tuple], names_and_types: list[tuple[str, str]]) -> DataFrame:
    """A table of a few given rows as literals of the plan, so that no job ships them."""
    if not rows:
        return spark.range(0).select(*[F.lit(None).cast(t).alias(n) for n, t in names_and_types])
    given = [F.struct(*[F.lit(x).cast(t).alias(n) for (n, t), x in zip(names_and_types, row, strict=True)]) for row in rows]
    return spark.range(0, 1, 1, 1).select(F.inline(F.array(*given)))
