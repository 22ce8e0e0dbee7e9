"""Nearest neighbours by cosine of unit vectors: exact for one query or many, and by cells."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import dot
from ..lineage import cut, discard

#: Queries of a block at most, results that a task holds for a block of them,
#: bytes of a block's vectors, and scores that are computed at once. A few queries
#: make one block without being counted first. Bits of a block's queries times cells,
#: and rows of a cell from which a task multiplies it by itself.
QUERIES, HELD, QUERY_BYTES, SCORES, FEW = 4096, 1 << 20, 16 << 20, 1 << 21, 256
VISITS, ALONE = 1 << 27, 64
#: Vectors from which cells are worth their while, rows that centres are fitted on
#: in all and for each cell, and the most cells unless their number is given or
#: they would have more rows than CELL_ROWS each.
APPROXIMATE_FROM, FIT_ROWS, FIT_FOR_CELL, MAX_CELLS, CELL_ROWS = 200_000, 100_000, 40, 100, 100_000


def knn(embeddings: DataFrame, query: list[float], k: int) -> DataFrame:
    """(image_id, similarity), the k most similar, ties to the smaller id."""
    v = F.array(*[F.lit(float(x)) for x in query])
    rows = embeddings.where("embedding is not null").select("image_id", dot(F.col("embedding"), v).alias("similarity"))
    return rows.where(~F.isnan("similarity")).orderBy(F.desc("similarity"), "image_id").limit(k)


def _top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, ties to the smaller id."""
    if len(scores) > 4 * k > 0:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        few = np.flatnonzero(scores >= edge)
        return few[np.lexsort((ids[few], -scores[few]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def knn_batch(embeddings: DataFrame, queries: DataFrame, k: Column | int = 10) -> DataFrame:
    """(query_id, image_id, similarity, rank): the k best of each query (query_id, query_vec).

    Every partition multiplies its rows with a block of queries and keeps each
    query's best; only those are shuffled. Blocks are bounded by the number of
    queries, the bytes of their vectors and the results that a task holds. Of more
    queries one block after the other is searched and its best are written, so
    the driver holds one block at a time.
    """
    return _by_blocks(queries, k, lambda block: _ranked(_search_block(embeddings, block)))


def _by_blocks(queries: DataFrame, k: Column | int, search: Callable[[pd.DataFrame], DataFrame], cells: int = 1) -> DataFrame:
    """What ``search`` gives for all queries, block by block (query_id, q, k)."""
    asked = queries.select("query_id", F.transform("query_vec", lambda x: x.cast("double")).alias("q"), (F.lit(k) if isinstance(k, int) else k).cast("int").alias("k"))
    most = lambda size, deepest: max(1, min(QUERIES, HELD // max(deepest, 1), QUERY_BYTES // (8 * max(size, 1)), VISITS // max(cells, 1)))
    few = asked.limit(FEW + 1).toPandas()
    if len(few) <= FEW and len(few) <= most(max(map(len, few["q"]), default=1), few["k"].max() if len(few) else 1):
        return search(few)
    asked = cut(asked)
    n, size, deepest = asked.agg(F.count(F.lit(1)), F.max(F.size("q")), F.max("k")).first()
    blocks, done = -(-n // most(size, deepest)), []
    for b in range(blocks):
        done.append(cut(search(asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).toPandas())))
    discard(asked)
    return queries.sparkSession.read.schema(done[0].schema).parquet(*[d.cut_path for d in done])


def _ranked(found: DataFrame, keep_k: bool = False) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "image_id"))
    out = found.withColumn("rank", rank).where(F.col("rank") <= F.col("k"))
    return out if keep_k else out.drop("k")


class Best:
    """Each query's best so far, of rows that come in blocks; ties to the smaller id.
    Products of matrices say which rows can be among them; these rows' scores are
    then summed in the order of the components, so that equal vectors have equal
    scores wherever they stand in a block."""

    def __init__(self, queries: np.ndarray, depth: np.ndarray, floor: np.ndarray | None = None):
        self.queries, self.depth = queries, depth
        self.length = np.linalg.norm(queries, axis=1)
        self.worst = np.full(len(depth), -np.inf) if floor is None else floor.copy()  # the k-th score, once there are k, or what is known to reach it
        self.scores: list[np.ndarray] = [np.zeros(0)] * len(depth)
        self.ids: list[np.ndarray] = [np.zeros(0, object)] * len(depth)

    def add(self, x: np.ndarray, ids: np.ndarray, which: np.ndarray | None = None, sees: np.ndarray | None = None) -> None:
        """Rows for the queries ``which`` or for all; sees: (queries, rows), false where
        a row is not for a query. Only queries that a row may get among the best of
        are touched."""
        every = which is None or len(which) == len(self.depth)
        which = np.arange(len(self.depth)) if which is None else which
        rough = (self.queries if every else self.queries[which]) @ x.T
        error = 4 * (x.shape[1] + 4) * 2.0**-53 * self.length[which] * np.nanmax(np.linalg.norm(x, axis=1), initial=0)
        hit = rough >= (self.worst[which] - error)[:, None]  # false for nan
        if sees is not None:
            hit &= sees
        for i in np.flatnonzero(hit.any(axis=1)):
            j, new = which[i], np.flatnonzero(hit[i])
            k = int(self.depth[j])
            if len(new) > 4 * k > 0:
                new = new[rough[i, new] >= np.partition(rough[i, new], len(new) - k)[len(new) - k] - 2 * error[i]]
            score = np.cumsum(x[new] * self.queries[j], axis=1)[:, -1]
            s, n = np.concatenate([self.scores[j], score]), np.concatenate([self.ids[j], ids[new]])
            at = _top(s, n, k)
            self.scores[j], self.ids[j] = s[at], n[at]
            if len(at) and len(at) == k:
                self.worst[j] = self.scores[j][-1]


def _search_block(embeddings: DataFrame, asked: pd.DataFrame, visits: np.ndarray | None = None, floor: np.ndarray | None = None) -> DataFrame:
    """(query_id, image_id, similarity, k): the best of each partition for a block of
    queries. visits: bits (cells, queries), set where a query is to see a cell's rows;
    ``embeddings`` has then a column ``cell``, and cells that nobody sees are not read.
    floor: scores of the queries below which no row counts."""
    shape = "query_id long, image_id string, similarity double, k int"
    if not len(asked) or (visits is not None and not visits.any()):
        return embeddings.sparkSession.createDataFrame([], shape)
    matrix, ids, depth = np.stack(asked["q"].to_numpy()), asked["query_id"].to_numpy(), asked["k"].to_numpy()
    step = max(16, SCORES // len(asked))

    def seen_parts(cells: np.ndarray) -> Iterator[np.ndarray]:
        """Rows that are multiplied together: a cell's or, where a cell has few, those of several."""
        order = np.argsort(cells, kind="stable")
        few: list[np.ndarray] = []
        for rows in np.split(order, np.flatnonzero(np.diff(cells[order])) + 1):
            if len(rows) < ALONE:
                few.append(rows)
            else:
                yield from np.split(rows, range(step, len(rows), step))
        if few:
            rows = np.concatenate(few)
            yield from np.split(rows, range(step, len(rows), step))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(matrix, depth, floor)
        for batch in batches:
            names, flat = batch.column("image_id"), batch.column("embedding").flatten().to_numpy(zero_copy_only=False)
            x = flat.reshape(batch.num_rows, -1)
            cells = None if visits is None else batch.column("cell").to_numpy()
            for part in np.split(np.arange(len(x)), range(step, len(x), step)) if cells is None else seen_parts(cells):
                which = sees = None
                if cells is not None:
                    own, of = np.unique(cells[part], return_inverse=True)
                    asks = np.unpackbits(visits[own], axis=1, count=len(ids)).view(bool)
                    which = np.flatnonzero(asks.any(axis=0))
                    if not len(which):
                        continue
                    sees = asks[:, which][of].T if len(own) > 1 else None
                best.add(x[part].astype(np.float64), names.take(pa.array(part)).to_numpy(zero_copy_only=False), which, sees)
        for j, (s, n) in enumerate(zip(best.scores, best.ids, strict=True)):
            if len(s):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), ids[j])), pa.array(n, pa.string()), pa.array(s), pa.array(np.full(len(s), depth[j]), pa.int32())], names=["query_id", "image_id", "similarity", "k"])

    rows = embeddings.where(F.size("embedding") == matrix.shape[1])
    if visits is None:
        return rows.select("image_id", "embedding").mapInArrow(run, shape)
    seen = np.flatnonzero(visits.any(axis=1)).tolist()
    rows = rows if len(seen) == len(visits) else rows.where(F.col("cell").isin(seen))
    return rows.select("image_id", "embedding", F.col("cell").cast("int").alias("cell")).mapInArrow(run, shape)


def cell_count(n: int) -> int:
    return max(1, min(n // 100, max(MAX_CELLS, n // CELL_ROWS)))


def build_cells(embeddings: DataFrame, cells: int | None = None, seed: int = 0) -> tuple[DataFrame, list[np.ndarray]]:
    """(image_id, embedding, cell) and the cells' centres, fitted on a sample of
    FIT_ROWS vectors or so (of FIT_FOR_CELL for each cell, if that is more), drawn by a hash of their ids."""
    rows = embeddings.where("embedding is not null")
    n = rows.count()
    cells = cells or cell_count(n)
    share = max(FIT_ROWS, FIT_FOR_CELL * cells) / max(n, 1)
    sample = rows.where(F.pmod(F.xxhash64("image_id"), F.lit(1 << 40)) < int(share * (1 << 40))) if share < 1 else rows
    model = KMeans(k=cells, seed=seed, featuresCol="features", predictionCol="cell").fit(sample.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features")))
    dealt = model.transform(rows.withColumn("features", array_to_vector(F.col("embedding").cast("array<double>"))))
    return dealt.select("image_id", "embedding", "cell"), model.clusterCenters()


def write_cells(dealt: DataFrame, path: str) -> None:
    """A folder per cell, so a search reads only the cells that it probes. Rows are
    rebalanced by cell: a cell that holds a share of all rows is written by several tasks."""
    dealt.hint("rebalance", F.col("cell")).write.partitionBy("cell").parquet(path, mode="overwrite")


@dataclass(frozen=True)
class Cells:
    """An index: written cells, their centres, how many of them a query probes
    first, and, where they are known, the largest distance of a row from each
    centre. With these a search can be exact."""

    dealt: DataFrame
    centres: list[np.ndarray]
    probes: int
    radii: np.ndarray | None = None

    def nearest(self, queries: DataFrame, k: Column | int = 10, exact: bool = False) -> DataFrame:
        return knn_cells_batch(self.dealt, self.centres, queries, k, self.probes, self.radii if exact else None)


def cell_radii(dealt: DataFrame, centres: list[np.ndarray]) -> np.ndarray:
    """The largest distance of a row from the centre of its cell; -1 for a cell without rows."""
    points = np.asarray(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = np.full(len(points), -1.0)
        for batch in batches:
            cell, x = batch.column("cell").to_numpy(), batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            np.maximum.at(most, cell, np.sqrt(((x - points[cell]) ** 2).sum(axis=1)))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(points), dtype=np.int32)), pa.array(most)], names=["cell", "radius"])

    found = dealt.select("embedding", F.col("cell").cast("int").alias("cell")).mapInArrow(run, "cell int, radius double").groupBy("cell").agg(F.max("radius").alias("radius"))
    radii = np.full(len(points), -1.0)
    for row in found.collect():  # a row for each cell
        radii[row["cell"]] = row["radius"]
    return radii


def build_index(embeddings: DataFrame, path: str, cells: int | None = None, probes: int | None = None, approximate_from: int = APPROXIMATE_FROM) -> Cells | None:
    """Cells in ``path``; None below ``approximate_from`` vectors, where exact search serves. Probes: by
    default a fifth of the cells."""
    n = embeddings.where("embedding is not null").count()
    if n < approximate_from:
        return None
    dealt, centres = build_cells(embeddings, cells or cell_count(n))
    write_cells(dealt, path)
    written = embeddings.sparkSession.read.parquet(path)
    return Cells(written, centres, probes or max(1, len(centres) // 5), cell_radii(written, centres))


def cell_bounds(centres: list[np.ndarray], radii: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """(queries, cells): what no product of a query with a row of the cell exceeds,
    as a row lies within the radius of the centre; -inf for cells without rows."""
    points, length = np.asarray(centres), np.linalg.norm(queries, axis=1)[:, None]
    bound = queries @ points.T + length * np.maximum(radii, 0)
    slack = 1e-9 * length * (np.linalg.norm(points, axis=1) + np.abs(radii)) + 1e-12
    return np.where(radii >= 0, bound + slack, -np.inf)


def _probed(centres: list[np.ndarray], queries: np.ndarray, probes: int) -> np.ndarray:
    """(queries, cells): true for the ``probes`` cells whose centres are nearest."""
    points = np.asarray(centres)
    far = (points**2).sum(axis=1) - 2 * queries @ points.T
    out = np.zeros(far.shape, bool)
    np.put_along_axis(out, np.argsort(far, axis=1, kind="stable")[:, :probes], True, axis=1)
    return out


def _visits(queries: np.ndarray, cells: int, chosen: Callable[[slice], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(bits (cells, queries) of what ``chosen`` says, (queries, cells), for a part of the
    queries; each query's number of cells). The driver holds the bits and one part."""
    bits, count = np.zeros((cells, -(-len(queries) // 8)), np.uint8), np.zeros(len(queries), int)
    step = max(8, SCORES // 8 // max(cells, 1) // 8 * 8)
    for lo in range(0, len(queries), step):
        found = chosen(part := slice(lo, min(lo + step, len(queries))))
        bits[:, lo // 8 : lo // 8 - (-len(found) // 8)] = np.packbits(found, axis=0).T
        count[part] = found.sum(axis=1)
    return bits, count


def knn_cells(dealt: DataFrame, centres: list[np.ndarray], query: list[float], k: int, probes: int, radii: np.ndarray | None = None) -> DataFrame:
    """As ``knn``, within the ``probes`` cells nearest to the query, and with
    ``radii`` in all that can hold one of the k best, so that it is exact."""
    asked = dealt.sparkSession.createDataFrame([(0, [float(x) for x in query])], "query_id long, query_vec array<double>")
    return knn_cells_batch(dealt, centres, asked, k, probes, radii).orderBy("rank").select("image_id", "similarity")


def knn_cells_batch(dealt: DataFrame, centres: list[np.ndarray], queries: DataFrame, k: Column | int, probes: int, radii: np.ndarray | None = None) -> DataFrame:
    """As ``knn_batch``, each query within its ``probes`` nearest cells, and
    ``cells_read``, the cells that it saw. Only cells that a query of the block
    sees are read, and their rows are multiplied where they are read.

    With ``radii`` the search is exact: a cell's centre and radius bound every
    product with its rows. After the nearest cells, those whose bound reaches the
    k-th best so far are searched too; in no other can there be a better row, nor
    one that ties.
    """

    def search(block: pd.DataFrame) -> DataFrame:
        if not len(block):
            return _ranked(_search_block(dealt, block)).withColumn("cells_read", F.lit(0))
        matrix = np.stack(block["q"].to_numpy())
        first, _ = _visits(matrix, len(centres), lambda part: _probed(centres, matrix[part], probes))
        if radii is None:
            return _ranked(_search_block(dealt, block, first)).withColumn("cells_read", F.lit(min(probes, len(centres))))
        begun = cut(_ranked(_search_block(dealt, block, first), keep_k=True))
        place = {q: i for i, q in enumerate(block["query_id"])}
        floor = np.full(len(block), -np.inf)
        for row in begun.where(F.col("rank") == F.col("k")).select("query_id", "similarity").collect():  # one for each query of the block
            floor[place[row["query_id"]]] = row["similarity"]
        seen = lambda part: np.unpackbits(first[:, part.start // 8 : -(-part.stop // 8)], axis=1, count=part.stop - part.start).T.view(bool)
        rest, read = _visits(matrix, len(centres), lambda part: (cell_bounds(centres, radii, matrix[part]) >= floor[part, None]) & (radii >= 0) & ~seen(part))
        counts = block["query_id"].to_frame().assign(cells_read=(min(probes, len(centres)) + read).astype("int32"))
        out = _ranked(begun.drop("rank").union(_search_block(dealt, block, rest, floor)))
        return out.join(F.broadcast(dealt.sparkSession.createDataFrame(counts, "query_id long, cells_read int")), "query_id")

    return _by_blocks(queries, k, search, len(centres))


def candidate_depth(limit: Column, deeper: Column, available: Column | int, max_limit: int = 100) -> Column:
    """How many neighbours to fetch: 10 for each row asked for, 50 where filters
    on quality or source will discard many."""
    asked = F.least(limit, F.lit(max_limit))
    return F.least(asked * F.when(deeper, 50).otherwise(10), F.lit(available) if isinstance(available, int) else available)
