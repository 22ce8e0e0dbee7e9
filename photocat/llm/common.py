"""Helpers shared by the operators: ranking without one task per key, joins that
split frequent keys, and connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut, discard, few, shared_dir

__all__ = ["components", "cut", "discard", "few", "join_split", "piece", "shared_dir", "spread_rank", "unit", "unused", "within_bytes"]

#: Rows that one task ranks at a time in ``spread_rank``.
RANK_ROWS = 10_000
#: A key is frequent if it has more rows than this, and more than its share of
#: all rows if HOT_KEYS keys shared them, so there are never more than HOT_KEYS.
HOT_ROWS, HOT_KEYS = 2_000, 2_000


def unit(hash64: Column) -> Column:
    """A signed 64-bit hash as a double in [0, 1), in the same order."""
    return F.least(hash64.cast("double") / F.lit(2.0**64) + 0.5, F.lit(1 - 2.0**-52))


def spread_rank(df: DataFrame, keys: list[str], order: str, ties: list[str], weight: str | None = None, parts: int | None = None) -> DataFrame:
    """Add ``rank`` (from 0) and, for a ``weight``, ``before``: the sum of the
    weights ranked earlier. Both are exact and hold within ``keys``, by the
    64-bit hash column ``order``, then ``ties``.

    A key's rows are split into ``parts`` ranges of the hash, so a key that
    holds a third of all rows is ranked by many tasks: ranges are summed first,
    the sums are accumulated (a row for each key and group of a thousand ranges,
    then within each group), and rows are ranked within their range. ``df`` is
    read twice and should be a written table.
    """
    parts = parts or max(64, df.count() // RANK_ROWS)
    rows = df.withColumn("_range", F.floor(unit(F.col(order)) * parts).cast("long"))
    total = [F.count(F.lit(1)).alias("_n"), F.sum(F.col(weight) if weight else F.lit(0)).alias("_w")]
    ranges = rows.groupBy(*keys, "_range").agg(*total).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_range").alias("_r"), F.floor(F.col("_range") / 1000).alias("_g"), "_n", "_w")
    own = [f"_{k}" for k in keys]
    if parts > 1000:  # the sums of groups first, so that no task accumulates all ranges
        ranges = cut(ranges)
        groups = ranges.groupBy(*own, "_g").agg(F.sum("_n").alias("_gn"), F.sum("_w").alias("_gw"))
        earlier = Window.partitionBy(*own).orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
        groups = groups.select(*[F.col(k).alias(f"_{k}") for k in own], F.col("_g").alias("__g"), F.coalesce(F.sum("_gn").over(earlier), F.lit(0)).alias("_gn0"), F.coalesce(F.sum("_gw").over(earlier), F.lit(0)).alias("_gw0"))
        same = ranges["_g"] == groups["__g"]
        for k in own:
            same = same & ranges[k].eqNullSafe(groups[f"_{k}"])
        ranges = ranges.join(groups, same)
    else:
        ranges = ranges.withColumns({"_gn0": F.lit(0), "_gw0": F.lit(0)})
    earlier = Window.partitionBy(*own, "_g").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select(*own, "_r", (F.col("_gn0") + F.coalesce(F.sum("_n").over(earlier), F.lit(0))).alias("_n0"), (F.col("_gw0") + F.coalesce(F.sum("_w").over(earlier), F.lit(0))).alias("_w0"))
    same = rows["_range"] == starts["_r"]
    for k in keys:
        same = same & rows[k].eqNullSafe(starts[f"_{k}"])
    within = Window.partitionBy(*keys, "_range").orderBy(order, *ties)
    out = rows.join(starts, same).withColumn("rank", F.col("_n0") + F.row_number().over(within) - 1)
    if weight:
        before = F.sum(weight).over(within.rowsBetween(Window.unboundedPreceding, -1))
        out = out.withColumn("before", F.col("_w0") + F.coalesce(before, F.lit(0)))
    return out.drop("_range", "_r", "_n0", "_w0", *own)


def join_split(rows: DataFrame, by_key: DataFrame, keys: list[str], spread: list[str], n: str = "n", how: str = "inner", counted: tuple[int, int] | None = None) -> DataFrame:
    """``rows`` joined with ``by_key``, a written table with one row for each key
    and ``n``, the number of its rows in ``rows``, which the result keeps.

    The rows of a frequent key are dealt over parts by a hash of ``spread``, and
    the key's row is repeated for each part. Rows learn that their key is
    frequent from a broadcast of these keys, of which there are HOT_KEYS at most.
    ``counted``: the sum of ``n`` and the largest, if the caller knows them.
    """
    total, most = counted or by_key.agg(F.coalesce(F.sum(n), F.lit(0)), F.coalesce(F.max(n), F.lit(0))).first()
    limit = max(HOT_ROWS, total // HOT_KEYS)
    if most <= limit:
        return rows.join(by_key, keys, how)
    parts = F.ceil(F.col(n) / limit).cast("int")
    hot = by_key.where(F.col(n) > limit).select(*keys, parts.alias("_parts"))
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64(*spread), F.col("_parts")).cast("int"), F.lit(0))).drop("_parts")
    single = by_key.withColumn("_part", F.explode(F.sequence(F.lit(0), F.when(F.col(n) > limit, parts - 1).otherwise(0))))
    return dealt.join(single, [*keys, "_part"], how).drop("_part")


def within_bytes(sample: DataFrame, order: list[str], size: str, limit: int) -> DataFrame:
    """Of a sample of bounded rows, those up to which the sizes sum to ``limit`` at
    most. A row that is larger by itself is skipped and costs only itself; where
    every row is, the first stays, of whose text ``piece`` takes what fits."""
    fits = F.col(size) <= limit
    sum_to = F.sum(F.when(fits, F.col(size)).otherwise(0)).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    first = F.row_number().over(Window.orderBy((~fits).cast("int"), *order))
    return sample.withColumns({"_sum": sum_to, "_first": first}).where((fits & (F.col("_sum") <= limit)) | (F.col("_first") == 1)).drop("_sum", "_first")


def piece(text: Column, limit: int) -> Column:
    """The text, or its beginning where it has more bytes than ``limit``."""
    return F.when(F.octet_length(text) > limit, F.substring(text, 1, max(1, limit // 4))).otherwise(text)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with a number where a column of ``df`` is called so already."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        free, n = name, 0
        while free.lower() in taken:
            n += 1
            free = f"{name}{n}"
        taken.add(free.lower())
        out.append(free)
    return out


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """Connected components of ``edges`` (a, b): rows (id, root), written, root
    being the smallest id that links reach. Nodes without an edge are not listed.

    Alternating large-star and small-star steps until each component is a star
    around its smallest id: every step is an aggregation of each node's smallest
    neighbour and a join back, in which the neighbours of a frequent node are
    split, and the number of edges never grows. Each round is cut, and the
    tables of the one before are deleted. ``rows``: edges at most, if known; steps
    then take as many tasks as these ask for.
    """
    sized = (lambda df, times=1: few(df, times * rows)) if rows is not None else (lambda df, times=1: df)
    now = cut(sized(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()))
    while True:
        # done when each node has one link and no end of a link starts another
        ends = sized(now.groupBy("a").count()).agg(F.coalesce(F.sum("count") == F.count(F.lit(1)), F.lit(True))).first()[0]
        if ends and now.select("b").join(now.select(F.col("a").alias("b")), "b", "left_semi").isEmpty():
            break
        both = now.union(now.select("b", "a"))
        least = cut(sized(both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select("a", F.least("a", "m").alias("m"), "n"), 2))
        # large star: neighbours above a node move to the least of its neighbourhood
        large = cut(sized(join_split(both, least, ["a"], ["b"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b"), 2))
        # small star: a node and its lower neighbours move to the lowest of them
        low = cut(sized(large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))))
        moved = sized(join_split(large, low, ["a"], ["b"])).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        before, now = now, cut(sized(moved.where("a <> b").distinct()))
        discard(before, least, large, low)
    nodes = now.select(F.col("a").alias("id"), F.col("b").alias("root"))
    out = cut(nodes.union(sized(now.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())))
    discard(now)
    return out
