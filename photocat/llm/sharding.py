"""Sharding by balanced label propagation; the law that holds is ``rows``.

Documents with equal texts are linked: each to the smallest document of its
group, or, in a group that is larger than a quarter of a shard, to the smallest
of its part of the group, whose heads are linked in turn. Shards start from an
even deal. In each round, joins of links with shards count every document's
neighbours in each shard; those with more neighbours elsewhere want to move.
The links of a group are a tree, so its documents have two sides and every link
joins one of each; in a round only one side of a group, drawn by hash, asks, so
the two ends of a link never pass each other and every move cuts fewer links.
The matrix of askers (shards x shards, read by the driver) sets quotas: as many
rows move from a to b as from b to a, where unlinked documents fill what the
askers leave, so counts stay at most one apart after every round. Rounds end
when no document wants to move, or when in several rounds, with both sides of
every group drawn again, none can.

Edge cases. Null text: size 1, crc of the empty text, linked with nothing.
Empty texts are equal texts. Null ids and repeated rows: each row is placed by
itself. Ties: by a hash of the row. Fewer rows than shards: some shards have
one row, the others none. Empty table: no rows. Other columns: ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, join_split, spread_rank

#: Rounds without a move after which propagation ends; two rounds give each side of a group a turn.
IDLE = 6


def sized(docs: DataFrame) -> DataFrame:
    """(row, doc_id, size, text_crc32, g1, g2): a written table, so that row
    numbers last; g1, g2 is the hash of the text."""
    text = F.coalesce("text", F.lit(""))
    return cut(docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.when(F.col("text").isNotNull(), F.xxhash64("text")).alias("g1"), F.when(F.col("text").isNotNull(), F.xxhash64("text", F.lit("second"))).alias("g2")))


def equal_text_links(rows: DataFrame, shards: int) -> DataFrame:
    """Links (a, b, top, side), one for each row of a group but one. top: the
    group's smallest row; side: that of a, 0 or 1, while b is on the other."""
    part_rows = max(1, rows.count() // (4 * shards))
    groups = cut(rows.where("g1 is not null").groupBy("g1", "g2").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    parts = F.ceil(F.col("n") / part_rows).cast("int")
    member = cut(join_split(rows.select("row", "g1", "g2"), groups, ["g1", "g2"], ["row"]).select("row", "g1", "g2", F.pmod(F.xxhash64("row"), parts).cast("int").alias("part")))
    heads = cut(member.groupBy("g1", "g2", "part").agg(F.min("row").alias("head"), F.count(F.lit(1)).alias("n")))
    tops = heads.groupBy("g1", "g2").agg(F.min("head").alias("top"))
    led = cut(heads.join(tops, ["g1", "g2"]))
    inner = join_split(member, led, ["g1", "g2", "part"], ["row"]).where("row <> head").select(F.col("row").alias("a"), F.col("head").alias("b"), "top", (F.col("head") == F.col("top")).cast("int").alias("side"))
    outer = led.where("head <> top").select(F.col("head").alias("a"), F.col("top").alias("b"), "top", F.lit(1).alias("side"))
    return cut(inner.union(outer))


def quotas(asked: dict[tuple[int, int], int], free: dict[int, int]) -> tuple[dict, dict]:
    """How many askers and how many unlinked rows move, by (from, to): what
    leaves a for b equals what leaves b for a."""
    askers, fillers, free = {}, {}, dict(free)
    for (a, b), n in sorted(asked.items()):
        back = asked.get((b, a), 0)
        extra = max(0, min(n - back, free.get(b, 0)))
        askers[a, b] = min(n, back) + extra
        if extra:
            fillers[b, a] = extra
            free[b] -= extra
    return askers, fillers


def propagate(rows: DataFrame, links: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """(row, shard) with counts at most one apart. ``rows``: a written table
    with ``row``; ``links``: (a, b, top, side) of rows, one direction."""
    both = links.select("a", "b", "top", "side").union(links.select("b", "a", "top", 1 - F.col("side")))
    linked = both.select(F.col("a").alias("row")).distinct()
    degree = cut(both.groupBy("b").agg(F.count(F.lit(1)).alias("n")))
    base = rows.select("row", F.xxhash64(F.lit(seed), "row").alias("h"))
    now = cut(spread_rank(base, [], "h", ["row"]).select("row", (F.col("rank") % shards).cast("int").alias("shard")))
    unlinked = cut(rows.select("row").join(linked, "row", "left_anti"))
    spark = rows.sparkSession
    turn = idle = 0
    wants = None
    while idle < IDLE:
        if wants is None:
            at = cut(degree.join(now.select(F.col("row").alias("b"), F.col("shard").alias("there")), "b"))
            seen = join_split(both, at, ["b"], ["a"]).groupBy("a", "there").agg(F.count(F.lit(1)).alias("n"), F.first("top").alias("top"), F.first("side").alias("side")).withColumnRenamed("a", "row").join(now, "row")
            most = seen.groupBy("row", "shard", "top", "side").agg(F.max_by("there", F.struct("n", -F.col("there"))).alias("to"), F.max("n").alias("most"), F.coalesce(F.max(F.when(F.col("there") == F.col("shard"), F.col("n"))), F.lit(0)).alias("own"))
            wants = cut(most.where("most > own and to <> shard").select("row", "shard", "to", "top", "side"))
            discard(at)
        key = F.xxhash64(F.lit(seed), F.lit(turn), "row").alias("h")
        drawn = F.pmod(F.xxhash64(F.lit(seed), F.lit(turn // 2), "top") + turn, F.lit(2)) if turn else F.lit(1)  # at first the leaves go to their heads
        n_asked, n_all = {}, 0
        for r in wants.groupBy("shard", "to").agg(F.count_if(F.col("side") == drawn).alias("n"), F.count(F.lit(1)).alias("all")).collect():  # shards x shards
            n_all += r["all"]
            if r["n"]:
                n_asked[r["shard"], r["to"]] = r["n"]
        if not n_all:
            break
        fill = unlinked.join(now, "row").select("row", "shard", key)
        n_free = {r[0]: r[1] for r in fill.groupBy("shard").count().collect()} if n_asked else {}
        most, filled = quotas(n_asked, n_free)
        if not any(most.values()):
            turn, idle = turn + 1, idle + 1
            continue
        limit = spark.createDataFrame([(a, b, n) for (a, b), n in most.items() if n], "shard int, to int, quota long")
        askers = cut(wants.where(F.col("side") == drawn).select("row", "shard", "to", key))
        moved = spread_rank(askers, ["shard", "to"], "h", ["row"]).join(F.broadcast(limit), ["shard", "to"]).where("rank < quota").select("row", "to")
        ranges, start = [], {}
        for (b, a), n in filled.items():
            ranges.append((b, a, start.get(b, 0), start.get(b, 0) + n))
            start[b] = start.get(b, 0) + n
        if ranges:
            spans = spark.createDataFrame(ranges, "shard int, to int, lo long, hi long")
            filler = spread_rank(cut(fill), ["shard"], "h", ["row"]).join(F.broadcast(spans), "shard").where("rank >= lo and rank < hi").select("row", "to")
            moved = moved.union(filler)
        before, now = now, cut(now.join(moved, "row", "left").select("row", F.coalesce("to", "shard").alias("shard")))
        discard(before, wants)
        turn, idle, wants = turn + 1, 0, None
    return now


def shard_documents(docs: DataFrame, shards: int = 16, seed: int = 0) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard)."""
    rows = sized(docs)
    placed = propagate(rows, equal_text_links(rows, shards), shards, seed)
    out = cut(rows.join(placed, "row").withColumn("h", F.xxhash64(F.lit(seed), "row")))
    out = spread_rank(out, ["shard"], "h", ["row"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("rank").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
