"""Mixing sources to target weights, with DataFrame and SQL functions only.

A source's share of the tokens is raised to an exponent and the results are
normalised to weights: 1 keeps the shares, 0 makes all sources equal. The
exponent is bisected, each step being an aggregation over the table of sources,
until the weights meet a target entropy, or until no source is repeated more
often than a limit. A token budget then gives each source a quota. A source
fills its quota by passes over its documents, each pass in an order of its own
(a permutation by hash); the last pass may stop early. The stream of every
source is cut into as many blocks as the others', so each block has the target
weights, and within a block the documents of all sources are permuted again.

Edge cases. Null source: a source of its own. Null or blank text: no tokens.
Rows with equal (doc_id, source), and null ids of a source, are one unit that
is scheduled whole. A source without tokens has weight 0; its units come once,
dealt over all blocks. A limit that no exponent meets: an error.
Ties of the permutation: by id. Empty table: no rows. Other columns pass
through ``mix``; clashing names ("copy", "block", "slot") are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import RANK_ROWS, cut, spread_rank, unit, unused

#: Exponents that one aggregation tries: three halvings at once.
SECTIONS = 8
#: Tokens of a block.
BLOCK_TOKENS = 250_000


def word_tokens(text: Column) -> Column:
    """Tokens as maximal runs of characters that are no white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def permutation(*parts: Column) -> Column:
    """60 bits of an MD5 as a signed 64-bit number."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long") - 2**59) * 16


def units(docs: DataFrame, tokens: Column | None = None) -> DataFrame:
    """(doc_id, source, n_tokens), a row for each pair."""
    count = word_tokens(F.col("text")) if tokens is None else tokens
    return docs.select("doc_id", "source", count.alias("n_tokens")).groupBy("doc_id", "source").agg(F.sum("n_tokens").alias("n_tokens"))


def fit_exponent(shares: DataFrame, budget: float | None, target_entropy: float | None, max_repeats: float | None) -> float:
    """The exponent, by bisection over aggregations of (share).

    target_entropy: share of the highest possible entropy, log(sources); the
    largest exponent up to 8 that reaches it. max_repeats: the least exponent
    up to 1 under which no source is passed over more often; 1 if none is.
    budget is in units of all tokens; None: every document appears once or more.
    """
    if (target_entropy is None) == (max_repeats is None):
        raise ValueError("give a target entropy or a limit of repetitions")
    if (max_repeats if target_entropy is None else 1.0) < (budget or 1.0 if target_entropy is None else target_entropy):
        raise ValueError("no exponent meets the limit")
    low, high = 0.0, 8.0 if max_repeats is None else 1.0
    sources = shares.count()
    for _ in range(16):
        points = [low + (high - low) * i / SECTIONS for i in range(1, SECTIONS)]
        found = []
        for i, x in enumerate(points):
            p = F.pow("share", F.lit(x))
            found += [F.sum(p).alias(f"z{i}"), F.sum(p * F.log(p)).alias(f"s{i}"), F.max(p / F.col("share")).alias(f"most{i}"), F.min(p / F.col("share")).alias(f"least{i}")]
        row = shares.agg(*found).first()
        for i, x in enumerate(points):  # the lower points fail a limit, the higher ones an entropy
            z = row[f"z{i}"]
            if max_repeats is None:
                good = math.log(z) - row[f"s{i}"] / z >= target_entropy * math.log(max(sources, 2))
                low, high = (x, high) if good else (low, min(high, x))
            else:
                repeats = row[f"most{i}"] / row[f"least{i}"] if budget is None else budget * row[f"most{i}"] / z
                good = repeats <= max_repeats
                low, high = (low, min(high, x)) if good else (x, high)
            low = min(low, high)
    return low if max_repeats is None else high


def rates(unit_table: DataFrame, *, budget: float | None = 1.0, target_entropy: float | None = None, max_repeats: float | None = None) -> DataFrame:
    """(source, total, weight, rate): rate is quota over tokens, the number of
    passes, rounded to 9 decimals so that a whole pass is a whole number."""
    totals = cut(unit_table.groupBy("source").agg(F.sum("n_tokens").alias("total")))
    everything = totals.agg(F.sum("total")).first()[0] or 0
    shares = totals.where("total > 0").withColumn("share", F.col("total") / F.lit(float(everything or 1)))
    if not everything:
        return totals.withColumns({"weight": F.lit(0.0), "rate": F.lit(1.0)})
    x = fit_exponent(shares.select("share"), budget, target_entropy, max_repeats)
    p = F.pow("share", F.lit(x))
    z, least = shares.agg(F.sum(p), F.min(p / F.col("share"))).first()
    weight = F.when(F.col("total") > 0, F.pow(F.col("total") / float(everything), F.lit(x)) / z).otherwise(0.0)
    full = z / least if budget is None else budget
    rate = F.when(F.col("total") > 0, F.round(F.col("weight") * full / (F.col("total") / float(everything)), 9)).otherwise(1.0)
    return totals.withColumn("weight", weight).withColumn("rate", rate)


def schedule(unit_table: DataFrame, rate_table: DataFrame, seed: int = 0, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(doc_id, source, n_tokens, copy, block, slot): each appearance of a unit."""
    r = rate_table.select(F.col("source").alias("_s"), "total", "rate")
    passes = F.explode(F.sequence(F.lit(0), F.greatest(F.ceil("rate").cast("int") - 1, F.lit(0)))).alias("copy")
    rows = unit_table.join(r, unit_table["source"].eqNullSafe(r["_s"])).where("rate > 0").drop("_s").select("*", passes)
    rows = cut(rows.withColumn("_order", permutation(F.lit(seed), F.col("source"), F.col("copy"), F.col("doc_id"))))
    rows = spread_rank(rows, ["source", "copy"], "_order", ["doc_id"], "n_tokens")
    part = (F.col("rate") - F.floor("rate")) * F.col("total")
    rows = rows.where((F.col("copy") < F.floor("rate")) | (F.col("before") < part))
    quota = rate_table.agg(F.sum(F.col("rate") * F.col("total"))).first()[0] or 0
    blocks = max(1, int(quota // block_tokens))
    place = F.when(F.col("total") > 0, (F.col("copy") * F.col("total") + F.col("before")) / (F.col("rate") * F.col("total"))).otherwise(unit(F.col("_order")))
    rows = rows.withColumn("block", F.least(F.floor(place * blocks), F.lit(blocks - 1)).cast("int"))
    rows = cut(rows.select("doc_id", "source", "n_tokens", "copy", "block").withColumn("_again", permutation(F.lit(seed), F.col("block"), F.col("copy"), F.col("doc_id"), F.col("source"))))
    most = rows.groupBy("block").count().agg(F.max("count")).first()[0] or 0
    rows = spread_rank(rows, ["block"], "_again", ["doc_id", "copy", "source"], parts=max(1, most // RANK_ROWS))
    return rows.withColumn("slot", F.col("rank").cast("int")).select("doc_id", "source", "n_tokens", "copy", "block", "slot")


def mix(docs: DataFrame, *, seed: int = 0, **target) -> DataFrame:
    """``docs`` as scheduled: their columns and copy, block, slot."""
    table = cut(units(docs))
    plan = schedule(table, rates(table, **target), seed)
    own = docs.drop("copy", "block", "slot")
    d, s = unused(own, "_d", "_s")
    plan = plan.select(F.col("doc_id").alias(d), F.col("source").alias(s), "copy", "block", "slot")
    return own.join(plan, own["doc_id"].eqNullSafe(plan[d]) & own["source"].eqNullSafe(plan[s])).drop(d, s)
