"""What the operators on embeddings share: which vectors count, and classes of equal ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

NULL_ID = -(2**63)


def usable(vector: Column) -> Column:
    """Not null, not zero, every component finite and not null."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zero = F.forall(vector, lambda x: x == 0)
    return F.coalesce(~odd & ~zero, F.lit(False))


def numbered(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(row, id, dim, v, h1, h2), written: v and dim are null where a vector is not
    usable; h1, h2 are 128 bits of a hash of v, by which equal vectors meet. v
    keeps floats as floats; all other numbers are doubles."""
    kind = "array<float>" if df.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"
    v = F.col(vector).cast(kind)
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(key).cast("long"), F.lit(NULL_ID)).alias("id"), F.when(usable(v), v).alias("v"))
    some = F.col("v").isNotNull()
    return cut(rows.select("row", "id", F.when(some, F.size("v")).alias("dim"), "v", F.when(some, F.xxhash64("v")).alias("h1"), F.when(some, F.xxhash64("v", F.lit("second"))).alias("h2")))


def classes_of(rows: DataFrame) -> DataFrame:
    """(h1, h2, cls, least_id, n, dim), written: cls is the first row of equal vectors, n their number."""
    found = rows.where("dim is not null").groupBy("h1", "h2")
    return cut(found.agg(F.min("row").alias("cls"), F.min("id").alias("least_id"), F.count(F.lit(1)).alias("n"), F.first("dim").alias("dim")))


def dimensions(rows: DataFrame) -> list[int]:
    """Vectors of different lengths are never compared; there are few lengths."""
    return sorted(r[0] for r in rows.where("dim is not null").select("dim").distinct().collect())


def shown(c: Column) -> Column:
    return F.nullif(c, F.lit(NULL_ID))
