"""Near-duplicates across the whole library, and the best copy of each picture."""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, log, log2, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import dot
from ..lineage import cut
from .ranking import DUPLICATE_COSINE

#: The share of pairs at the very threshold that no band may bring together, and
#: the rows of a key that are compared with each other in one piece.
MISSED, KEY_ROWS = 1e-4, 512


def band_plan(n: int, threshold: float) -> tuple[int, int]:
    """(bits of a band, bands). A band has as many bits as it takes to number
    the vectors, so two that have nothing to do with each other meet about once
    per vector and band at any size; there are enough bands for a pair at the
    threshold to meet in one but for MISSED."""
    bits = min(60, max(8, ceil(log2(max(n, 2)))))
    meet = (1 - acos(threshold) / pi) ** bits
    return bits, ceil(log(MISSED) / log(1 - meet))


def banded(vectors: DataFrame, bits: int, bands: int, seed: int) -> DataFrame:
    """(row, band, key): signs of projections on ``bits`` random directions a band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        powers = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            sizes = batch.column("embedding").value_lengths().to_numpy()
            flat = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float32)
            first = np.concatenate([[0], np.cumsum(sizes)])[:-1]
            for size in np.unique(sizes):
                if size not in planes:
                    planes[size] = np.random.default_rng((seed, int(size))).normal(size=(size, bits * bands)).astype(np.float32)
                own = np.flatnonzero(sizes == size)
                signs = flat[first[own][:, None] + np.arange(size)] @ planes[size] > 0
                keys = signs.reshape(len(own), bands, bits) @ powers
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").take(pa.array(np.repeat(own, bands))), pa.array(np.tile(np.arange(bands, dtype=np.int32), len(own))), pa.array(keys.ravel())], names=["row", "band", "key"])

    return vectors.select("row", F.col("embedding").cast("array<float>").alias("embedding")).mapInArrow(run, "row long, band int, key long")


def met_in_bands(keys: DataFrame) -> DataFrame:
    """(a, b), a < b: rows of ``keys`` (row, band, key), a written table, that share a
    key of a band. The rows of a key are dealt over parts of KEY_ROWS or so, and
    every pair of parts is compared by itself, so a cluster that has one key is
    spread over tasks; rows that are alone with their key go first."""
    parts = F.ceil(F.col("n") / KEY_ROWS).cast("int")
    sizes = keys.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    dealt = keys.join(sizes, ["band", "key"]).select("row", "band", "key", parts.alias("parts"), F.pmod(F.xxhash64("row", "band"), parts).cast("int").alias("part"))
    one = dealt.select(F.col("row").alias("a"), "band", "key", F.col("part").alias("pa"), F.explode(F.sequence("part", F.col("parts") - 1)).alias("pb"))
    two = dealt.select(F.col("row").alias("b"), "band", "key", F.explode(F.sequence(F.lit(0), "part")).alias("pa"), F.col("part").alias("pb"))
    return one.join(two, ["band", "key", "pa", "pb"]).where("pa < pb or a < b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicate_pairs(embeddings: DataFrame, threshold: float = DUPLICATE_COSINE, seed: int = 0) -> DataFrame:
    """(a, b, cosine) of unit vectors, a < b. Identical vectors are joined to the
    first of them; only different ones are hashed to bands, and ids that meet in
    a band are verified in double precision. A copy's pairs are those of its first."""
    rows = embeddings.where("embedding is not null").select("image_id", "embedding")
    firsts = cut(rows.groupBy("embedding").agg(F.min("image_id").alias("first")).withColumn("row", F.monotonically_increasing_id()))
    same = rows.join(firsts.select("embedding", "first"), "embedding").where("image_id <> first").select(F.col("first").alias("a"), F.col("image_id").alias("b"), dot(F.col("embedding"), F.col("embedding")).alias("cosine"))
    keys = cut(banded(firsts, *band_plan(firsts.count(), threshold), seed))
    met = met_in_bands(keys)
    one, two = firsts.select(F.col("row").alias("a"), F.col("first").alias("ia"), F.col("embedding").alias("va")), firsts.select(F.col("row").alias("b"), F.col("first").alias("ib"), F.col("embedding").alias("vb"))
    pairs = met.join(one, "a").join(two, "b").where(F.size("va") == F.size("vb"))
    pairs = pairs.select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"), dot(F.col("va"), F.col("vb")).alias("cosine"))
    return pairs.where(F.col("cosine") >= threshold).union(same)


def keep_best_copies(ranked: DataFrame, pairs: DataFrame) -> DataFrame:
    """(image_id, kept, twin): a row is dropped if it is a near-duplicate of a
    better-ranked kept row; twin is the most similar of those.

    ranked: (image_id, rank_key), higher is better, ties to the smaller id.
    Each round keeps every undecided row without a better-ranked undecided
    neighbour and drops its neighbours, which gives what going through the
    rows in order would.
    """
    order = F.struct(-F.col("rank_key"), F.col("image_id"))
    place = ranked.select("image_id", order.alias("place"))
    both = pairs.select("a", "b", "cosine").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "cosine"))
    edges = both.join(place.select(F.col("image_id").alias("a"), F.col("place").alias("pa")), "a").join(place.select(F.col("image_id").alias("b"), F.col("place").alias("pb")), "b")
    worse = cut(edges.where("pb < pa").select(F.col("a").alias("image_id"), F.col("b").alias("better"), "cosine"))
    open_edges, dropped = worse, None
    nodes = cut(worse.select("image_id").union(worse.select(F.col("better").alias("image_id"))).distinct())
    kept = None
    while True:
        waiting = open_edges.select("image_id").distinct()
        now = cut(nodes.join(waiting, "image_id", "left_anti"))
        kept = now if kept is None else cut(kept.union(now))
        gone = cut(open_edges.join(now.select(F.col("image_id").alias("better")), "better", "left_semi").select("image_id").distinct())
        dropped = gone if dropped is None else cut(dropped.union(gone))
        nodes = cut(nodes.join(now, "image_id", "left_anti").join(gone, "image_id", "left_anti"))
        if nodes.isEmpty():
            break
        open_edges = cut(open_edges.join(nodes, "image_id", "left_semi").join(nodes.select(F.col("image_id").alias("better")), "better", "left_semi").select("image_id", "better", "cosine"))
    twins = worse.join(dropped, "image_id", "left_semi").join(kept.select(F.col("image_id").alias("better")), "better", "left_semi")
    rank_of = ranked.select(F.col("image_id").alias("better"), F.struct(F.col("rank_key"), F.col("image_id")).alias("_r"), "rank_key")
    best = twins.join(rank_of, "better").groupBy("image_id").agg(F.min_by("better", F.struct(-F.col("cosine"), -F.col("rank_key"), F.col("better"))).alias("twin"))
    return ranked.select("image_id").join(best, "image_id", "left").select("image_id", F.col("twin").isNull().alias("kept"), "twin")
