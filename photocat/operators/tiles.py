"""All near-duplicate pairs, exactly: a self join of tiles, of which those that
cannot hold a pair are ruled out.

A vector's angles to some reference vectors place it: by the triangle inequality
two vectors whose angles to one reference differ by more than the angle of the
threshold are no pair. Vectors with the same nearest reference, in order of their
angle to it, make tiles of bounded size; a tile has the range of its angles to
every reference, and a pair of tiles whose ranges lie too far apart is ruled out.
What is left is multiplied, one tile with some others in each task. The share that
is ruled out depends on the data: tight clusters leave few pairs of tiles, vectors
without any structure leave nearly all, and then this is the square of the table,
in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import dot
from ..lineage import cut, discard
from .ranking import DUPLICATE_COSINE

#: Reference vectors, rows of a tile aimed at, tiles at most (above, tiles grow),
#: tiles that one tile meets in a task, scores that are computed at once.
REFERENCES, TILE, TILES, GROUP, SCORES = 32, 4096, 16_384, 8, 1 << 21
#: More than the error of an angle in double precision.
SLACK = 1e-6


def _unit(x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(length > 0, length, 1)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def placed(vectors: DataFrame, references: np.ndarray) -> DataFrame:
    """(image_id, embedding, home, angles): the nearest reference and the angles to all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            angles = np.arccos(np.clip(_unit(_matrix(batch.column("embedding"))) @ references.T, -1, 1))
            flat = pa.FixedSizeListArray.from_arrays(pa.array(angles.ravel()), len(references)).cast(pa.list_(pa.float64()))
            home = angles.argmin(axis=1) if len(angles) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([batch.column("image_id"), batch.column("embedding"), pa.array(home.astype(np.int32)), flat], names=["image_id", "embedding", "home", "angles"])

    return vectors.select("image_id", "embedding").mapInArrow(run, f"image_id string, embedding {dict(vectors.dtypes)['embedding']}, home int, angles array<double>")


def tiled(rows: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(rows with ``tile``, written; tiles: tile, low, high, n, written), low and high
    being the ranges of angles. Tiles follow quantiles of the angle to the nearest
    reference; where many share a value, they are dealt by hash."""
    size = max(TILE, -(-n // TILES))
    own = F.get("angles", F.col("home"))
    cuts = rows.groupBy("home").agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx(own, [i / 64 for i in range(1, 64)], 1000).alias("_at"))
    # of 64 quantiles as many as the reference needs
    every = F.greatest(F.lit(1), F.floor(F.lit(64) / F.greatest(F.lit(1), F.ceil(F.col("_n") / size)))).cast("int")
    cuts = cuts.select("home", F.filter("_at", lambda x, i: (i + 1) % every == 0).alias("_at"))
    part = rows.join(F.broadcast(cuts), "home").withColumn("_part", F.size(F.filter("_at", lambda x: x <= own))).drop("_at")
    part = cut(part)
    counts = part.groupBy("home", "_part").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("_k"))
    named = part.join(F.broadcast(counts), ["home", "_part"]).withColumn("_hash", F.pmod(F.xxhash64("image_id"), F.col("_k")).cast("int"))
    keyed = cut(named.select("image_id", "embedding", "angles", F.struct("home", "_part", "_hash").alias("_key")))
    k = len(keyed.select("angles").first()["angles"])
    ranges = keyed.groupBy("_key").agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.min(F.get("angles", F.lit(i))) for i in range(k)]).alias("low"), F.array(*[F.max(F.get("angles", F.lit(i))) for i in range(k)]).alias("high"))
    keys = ranges.agg(F.array_sort(F.collect_list("_key")).alias("_keys"))  # a key for each tile, TILES or so
    tiles = cut(ranges.crossJoin(F.broadcast(keys)).select("_key", (F.array_position("_keys", F.col("_key")) - 1).cast("int").alias("tile"), "low", "high", "n"))  # one row
    out = cut(keyed.join(F.broadcast(tiles.select("_key", "tile")), "_key").select("tile", "image_id", "embedding"))
    discard(part, keyed)
    return out, tiles.drop("_key")


def tile_pairs(tiles: DataFrame, threshold: float) -> DataFrame:
    """(a, b), a <= b: pairs of tiles that may hold a pair of the threshold."""
    table = tiles.orderBy("tile").toPandas()  # TILES or so
    low, high, limit = np.stack(table["low"]), np.stack(table["high"]), acos(max(-1.0, min(1.0, threshold))) + SLACK
    shared = tiles.sparkSession.sparkContext.broadcast((low, high))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        low, high = shared.value
        for frame in frames:
            for a in frame["tile"]:
                near = (np.maximum(low[a] - high[a:], low[a:] - high[a]) <= limit).all(axis=1)
                b = a + np.flatnonzero(near)
                yield pd.DataFrame({"a": np.full(len(b), a, np.int32), "b": b.astype(np.int32)})

    return tiles.select("tile").repartition(max(1, len(table) // 64)).mapInPandas(run, "a int, b int")


def _products(rows: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """(a, b, cosine), ids of two rows with a < b, of all pairs of tiles."""
    grouped = pairs.withColumn("group", F.floor(F.col("b") / GROUP).cast("int"))
    left = rows.join(grouped.select(F.col("a").alias("tile"), "group").distinct(), "tile").select(F.col("tile").alias("a"), "group", "image_id", "embedding")
    # other names of the same columns, so that the two sides are told apart
    met = grouped.select(F.col("a").alias("_a"), F.col("group").alias("_group"), F.col("b").alias("tile"))
    right = rows.join(met, "tile").select(F.col("_a").alias("a"), F.col("_group").alias("group"), *[F.col(c).alias(c) for c in ("tile", "image_id", "embedding")])

    def run(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        out = {"a": [np.zeros(0, object)], "b": [np.zeros(0, object)], "cosine": [np.zeros(0)]}
        if len(one) and len(two):
            x, y = (np.stack(f["embedding"].to_numpy()).astype(np.float64) for f in (one, two))
            n, m, own = one["image_id"].to_numpy(), two["image_id"].to_numpy(), two["tile"].to_numpy() == one["a"].iloc[0]
            for lo in range(0, len(x), step := max(1, SCORES // len(y))):
                i, j = np.nonzero(x[lo : lo + step] @ y.T >= threshold - 1e-9)
                i += lo
                keep = ~own[j] | (n[i] < m[j])  # within a tile each pair once, no row with itself
                i, j = i[keep], j[keep]
                # the sum in the order of the components, as elsewhere
                cosine = np.cumsum(x[i] * y[j], axis=1)[:, -1] if len(i) else np.zeros(0)
                keep = cosine >= threshold
                i, j, cosine = i[keep], j[keep], cosine[keep]
                swap = n[i] > m[j]
                out["a"].append(np.where(swap, m[j], n[i]))
                out["b"].append(np.where(swap, n[i], m[j]))
                out["cosine"].append(cosine)
        return pd.DataFrame({c: np.concatenate(v) for c, v in out.items()})

    return left.groupBy("a", "group").cogroup(right.groupBy("a", "group")).applyInPandas(run, "a string, b string, cosine double")


def exact_pairs(embeddings: DataFrame, threshold: float = DUPLICATE_COSINE) -> tuple[DataFrame, DataFrame]:
    """((a, b, cosine) of unit vectors with a < b and at least ``threshold``, none
    missing; (dimension, tiles, pairs, multiplied): how many pairs of tiles there
    are and how many were not ruled out). Identical vectors are joined to the
    first of them, whose pairs are theirs; vectors of different lengths are no pair."""
    spark = embeddings.sparkSession
    rows = embeddings.where("embedding is not null").select("image_id", "embedding")
    firsts = cut(rows.groupBy("embedding").agg(F.min("image_id").alias("image_id")))
    out = rows.join(firsts.withColumnRenamed("image_id", "first"), "embedding").where("image_id <> first").select(F.col("first").alias("a"), F.col("image_id").alias("b"), dot(F.col("embedding"), F.col("embedding")).alias("cosine"))
    report = []
    for dimension, n in sorted((r[0], r[1]) for r in firsts.groupBy(F.size("embedding")).count().collect() if r[0] > 0):  # few lengths
        own = firsts.where(F.size("embedding") == dimension)
        sample = own.orderBy(F.xxhash64("image_id"), "image_id").limit(REFERENCES).select("embedding").collect()
        dealt, tiles = tiled(placed(own, _unit(np.array([r[0] for r in sample], np.float64))), n)
        pairs = cut(tile_pairs(tiles, threshold))
        k = tiles.count()
        report.append((dimension, k, k * (k + 1) // 2, pairs.count()))
        out = out.union(_products(dealt, pairs, threshold))
    return out, spark.createDataFrame(report, "dimension int, tiles long, pairs long, multiplied long")
