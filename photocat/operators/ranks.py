"""Exact places in a total order without one task that sorts all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut, discard

#: Ranges whose sums are accumulated by one task.
GROUP = 1000


def running(sums: DataFrame, part: str, value: str, out: str) -> DataFrame:
    """(part, out): the sum of ``value`` over all smaller parts, which are numbers. In
    two levels: the sums of groups of parts are accumulated first, then those within
    each group, so a task sees GROUP parts, and one a row for each group."""
    grouped = sums.withColumn("_g", F.floor(F.col(part) / GROUP))
    before = lambda keys, order: Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    groups = grouped.groupBy("_g").agg(F.sum(value).alias("_t"))
    groups = groups.select("_g", F.coalesce(F.sum("_t").over(before([], "_g")), F.lit(0)).alias("_start"))
    own = F.coalesce(F.sum(value).over(before(["_g"], part)), F.lit(0))
    return grouped.withColumn("_own", own).join(groups, "_g").select(part, (F.col("_start") + F.col("_own")).alias(out))


def in_order(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` sorted by ``order``, written, with ``_part`` and ``_at``: the range that a
    row is in and its place there. Ranges are as many and as large as Spark makes
    them for the table, so they follow the number of rows."""
    return cut(df.orderBy(*order).select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")))


def positions(df: DataFrame, order: list[Column], out: str = "position") -> DataFrame:
    """``df``, written, with its exact place (from 0) in ``order``; rows that tie are
    in any order, so it should name enough columns."""
    own = in_order(df, *order)
    starts = running(own.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")), "_part", "_n", "_start")
    found = cut(own.join(F.broadcast(starts), "_part").withColumn(out, F.col("_start") + F.col("_at")).drop("_part", "_at", "_start"))  # a row for each range
    discard(own)
    return found
