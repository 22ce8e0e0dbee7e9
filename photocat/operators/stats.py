"""Statistics of the catalogue, details of an image, and rank correlation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranks import in_order, running


def archive_stats(images: DataFrame) -> DataFrame:
    """One row: total_images, oldest, newest, total_size_gb (GiB, 2 decimals)."""
    return images.agg(
        F.count(F.lit(1)).alias("total_images"), F.min("date_taken").alias("oldest"), F.max("date_taken").alias("newest"),
        F.round(F.coalesce(F.sum("file_size"), F.lit(0)) / F.lit(1024.0**3), 2).alias("total_size_gb"))


def top_cameras(images: DataFrame, n: int = 5) -> DataFrame:
    return images.where("camera_model is not null").groupBy("camera_model").agg(F.count(F.lit(1)).alias("images")).orderBy(F.desc("images"), "camera_model").limit(n)


def top_folders(images: DataFrame, n: int = 10) -> DataFrame:
    """No folder is a group too."""
    return images.groupBy("folder").agg(F.count(F.lit(1)).alias("images")).orderBy(F.desc("images"), F.asc_nulls_first("folder")).limit(n)


def image_tag_lists(image_tags: DataFrame, tags: DataFrame) -> DataFrame:
    named = image_tags.join(tags, "tag_id")
    return named.groupBy("image_id").agg(F.array_sort(F.collect_set("tag_name")).alias("tags"))


def image_info(images: DataFrame, ids: DataFrame, image_tags: DataFrame, tags: DataFrame) -> DataFrame:
    """The rows of ``ids`` with their tags; an id that is unknown has found = false."""
    own = ids.select("image_id").distinct()
    rows = own.join(images.withColumn("found", F.lit(True)), "image_id", "left").join(image_tag_lists(image_tags.join(own, "image_id", "left_semi"), tags), "image_id", "left")
    return rows.withColumn("found", F.coalesce("found", F.lit(False))).withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def value_places(df: DataFrame, value: str) -> DataFrame:
    """(_v, _n, _before): distinct values, how many rows have each, and how many
    have a smaller one. Values are counted, then sorted in ranges, and each range
    starts with the sum of those before it, so no task sees all of them."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    own = in_order(counts, F.col("_v"))
    starts = running(own.groupBy("_part").agg(F.sum("_n").alias("_t")), "_part", "_t", "_start")
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return own.withColumn("_own", before).join(F.broadcast(starts), "_part").select("_v", "_n", (F.col("_start") + F.col("_own")).alias("_before"))  # a row for each range


def average_ranks(df: DataFrame, value: str, out: str) -> DataFrame:
    """``df`` with the average rank (from 1) of ``value``."""
    ranks = value_places(df, value).select("_v", (F.col("_before") + (F.col("_n") + 1) / 2).alias(out))
    return df.join(ranks, df[value] == ranks["_v"], "left").drop("_v")


def quantile(df: DataFrame, value: str, q: float, out: str) -> DataFrame:
    """One row: the exact quantile, interpolated between its neighbours; null without rows."""
    places = value_places(df, value)
    at = (df.agg(F.count(value)).first()[0] - 1) * q
    low, part = int(max(at, 0)), max(at, 0) % 1
    holds = lambda k: (F.col("_before") <= k) & (F.col("_before") + F.col("_n") > k)
    a, b = F.max(F.when(holds(low), F.col("_v"))), F.max(F.when(holds(low + 1), F.col("_v")))
    return places.agg(a.alias("_a"), b.alias("_b")).select((F.col("_a") + F.coalesce((F.col("_b") - F.col("_a")) * part, F.lit(0.0))).alias(out))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: rho, null where one column is constant; rows with a null do not count."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    ranked = average_ranks(average_ranks(rows, "x", "rx"), "y", "ry")
    spread = F.stddev_pop("rx") * F.stddev_pop("ry")
    return ranked.agg(F.when(spread > 0, F.covar_pop("rx", "ry") / spread).alias("rho"))


def zscore(df: DataFrame, value: str, out: str) -> DataFrame:
    """By the mean and population deviation of all rows; null without spread."""
    moments = df.agg(F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_sd"))
    return df.crossJoin(F.broadcast(moments)).withColumn(out, F.when(F.col("_sd") > 0, (F.col(value) - F.col("_mean")) / F.col("_sd"))).drop("_mean", "_sd")  # one row
