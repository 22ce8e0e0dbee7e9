"""Upkeep of an index of cells: vectors come, change and go, and cells that outgrow
their bound are split.

An index is a folder. Each generation of it adds ``rows/gen=G/part=P`` (vectors
routed to the nearest centre, and those of cells that were split; a part is as
many cells by number as CELL_BYTES have room for, so that small cells share files),
``gone/gen=G`` (ids whose rows of earlier generations are dead) and ``cells/gen=G``
(all cells then in use: number, centre, radius, rows). Nothing that is written
changes, so a search goes on over the generation that it began with, and an
update that fails before its cells are written leaves that in place. ``compact``
writes an index anew without its dead rows. The driver holds the cells' centres
and the names of the files; what is chosen by cell is joined to a table of cells.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import cut, discard
from .vectors import FEW, Cells, build_cells, cell_count, cell_radii, knn_cells_batch

#: Bytes of the rows of a cell at most; rows that the parts of a cell are fitted
#: on, rounds of that fit, and how often a cell is divided by means before what is
#: too alike for that is divided by hash.
CELL_BYTES, FIT_ROWS, ROUNDS, DIVISIONS = 64 << 20, 4096, 8, 3
ROWS = "image_id string, embedding array<float>, cell int, gen int, part int"


@dataclass(frozen=True)
class Index(Cells):
    """Cells with a folder, a generation and the bound of a cell. ``numbers`` names the
    cells in the folder, ``rows`` counts theirs; centres and radii stand in the
    same order, and in ``dealt`` a row's cell is its place in that order."""

    path: str = ""
    generation: int = 0
    cell_bytes: int = CELL_BYTES
    numbers: tuple[int, ...] = ()
    rows: tuple[int, ...] = ()

    def nearest(self, queries: DataFrame, k: Column | int = 10, exact: bool = False) -> DataFrame:
        """Of queries whose probes are as many as the cells, or more, the live rows are
        found and written once, cell by cell, and not anew for every block."""
        if (n := queries.limit(FEW + 1).count()) <= FEW or not exact and n * self.probes < len(self.centres):
            return super().nearest(queries, k, exact)
        dealt = cut(self.dealt.repartition("cell").sortWithinPartitions("cell"))
        return knn_cells_batch(dealt, self.centres, queries, k, self.probes, self.radii if exact else None)


def _part(cell: Column | int, cell_bytes: int) -> Column | int:
    """The part of the folder that a cell's rows are in."""
    width = max(1, CELL_BYTES // cell_bytes)
    return F.floor(cell / width).cast("int") if isinstance(cell, Column) else cell // width


def _by_cell(rows: DataFrame, table: list[tuple], columns: str = "", how: str = "inner") -> DataFrame:
    """``rows`` joined to a table of a row for each cell: its number, and ``columns``."""
    return rows.join(F.broadcast(rows.sparkSession.createDataFrame(table, "cell int" + columns)), "cell", how)


def live_rows(spark: SparkSession, path: str, generation: int, numbers: list[int], cell_bytes: int) -> DataFrame:
    """(image_id, embedding, cell, place): rows of these cells that are not dead; place:
    where the cell stands among ``numbers``."""
    cells = spark.createDataFrame([(n, _part(n, cell_bytes), i) for i, n in enumerate(map(int, numbers))], "cell int, part int, place int")
    rows = spark.read.schema(ROWS).parquet(f"{path}/rows").where(F.col("gen") <= generation).join(F.broadcast(cells), ["part", "cell"])
    if generation:
        gone = spark.read.schema("image_id string, gen int").parquet(f"{path}/gone").where(F.col("gen") <= generation)
        gone = gone.groupBy(F.col("image_id").alias("_id")).agg(F.max("gen").alias("_gen"))
        rows = rows.join(gone, (F.col("image_id") == F.col("_id")) & (F.col("gen") < F.col("_gen")), "left_anti")
    return rows.select("image_id", "embedding", "cell", "place")


def open_index(spark: SparkSession, path: str, generation: int, probes: int | None = None, cell_bytes: int = CELL_BYTES) -> Index:
    """The index as it is in ``generation``."""
    cells = spark.read.parquet(f"{path}/cells/gen={generation}").orderBy("cell").toArrow()  # a row for each cell
    numbers, n = cells["cell"].to_pylist(), cells["n"].to_pylist()
    centres = cells["centre"].combine_chunks().flatten().to_numpy().reshape(len(numbers), -1)
    rows = live_rows(spark, path, generation, numbers, cell_bytes).select("image_id", "embedding", F.col("place").alias("cell"))
    return Index(rows, list(centres), probes or max(1, len(numbers) // 5), cells["radius"].to_numpy(), path, generation, cell_bytes, tuple(numbers), tuple(n))


def create_index(embeddings: DataFrame, path: str, cells: int | None = None, probes: int | None = None, cell_bytes: int = CELL_BYTES) -> Index:
    """Generation 0 in ``path``, a folder that does not exist yet."""
    spark = embeddings.sparkSession
    rows = embeddings.where("embedding is not null").select("image_id", F.col("embedding").cast("array<float>").alias("embedding"))
    if not (n := rows.count()):
        raise ValueError("an index needs a vector")
    dealt, centres = build_cells(rows, cells or cell_count(n))
    _write_rows(dealt, path, 0, cell_bytes)
    numbers = list(range(len(centres)))
    radii = cell_radii(live_rows(spark, path, 0, numbers, cell_bytes), centres)
    return _published(spark, path, 0, _settled(spark, path, 0, cell_bytes, numbers, list(centres), list(radii)), probes, cell_bytes)


def update_index(index: Index, changed: DataFrame, deleted: DataFrame | None = None) -> Index:
    """The next generation. changed: (image_id, embedding), rows that are new or
    replace those of their id; a null vector takes the id away, as ``deleted``
    (image_id) does. Where an id comes twice in ``changed``, one row of it counts."""
    spark, path, generation = changed.sparkSession, index.path, index.generation + 1
    changed = cut(changed.groupBy("image_id").agg(F.max(F.col("embedding").cast("array<float>")).alias("embedding")))
    gone = changed.select("image_id") if deleted is None else changed.select("image_id").union(deleted.select("image_id")).distinct()
    gone.write.parquet(f"{path}/gone/gen={generation}")
    numbers, centres, radii = list(index.numbers), list(index.centres), list(index.radii)
    new = cut(_routed(changed.where("embedding is not null"), {None: (np.asarray(centres), np.asarray(numbers))}))
    _write_rows(new, path, generation, index.cell_bytes)
    place = {n: i for i, n in enumerate(numbers)}
    for row in new.groupBy("cell").agg(F.max("far").alias("far")).collect():  # a row for each cell
        at = place[row["cell"]]
        radii[at] = max(radii[at], row["far"])
    discard(changed, new)
    return _published(spark, path, generation, _settled(spark, path, generation, index.cell_bytes, numbers, centres, radii), index.probes, index.cell_bytes)


def compact(index: Index, path: str, cells: int | None = None) -> Index:
    """The live rows of an index as generation 0 of another folder."""
    return create_index(index.dealt.select("image_id", "embedding"), path, cells or len(index.centres), index.probes, index.cell_bytes)


def _nearest(x: np.ndarray, centres: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """The nearest centre of each row; of equal ones that which ``spread`` picks."""
    far = (centres**2).sum(axis=1) - 2 * x @ centres.T
    tied = far <= far.min(axis=1)[:, None] + 1e-12
    pick = (spread % tied.sum(axis=1).astype(np.uint64)).astype(int)
    return (np.cumsum(tied, axis=1) == (pick + 1)[:, None]).argmax(axis=1)


def _routed(rows: DataFrame, among: dict[int | None, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(image_id, embedding, cell, far): the number of the nearest of the centres, and
    the distance from it. among: (centres, numbers) for the rows of each cell,
    or under None for all rows."""
    by_cell = None not in among

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
            spread = batch.column("spread").to_numpy().view(np.uint64)
            cells = batch.column("cell").to_numpy() if by_cell else np.zeros(len(x), int)
            number, far = np.zeros(len(x), np.int32), np.zeros(len(x))
            for cell in np.unique(cells):
                centres, names = among[int(cell) if by_cell else None]
                own = np.flatnonzero(cells == cell)
                step = max(1, (1 << 21) // len(centres))
                for lo in range(0, len(own), step):
                    part = own[lo : lo + step]
                    at = _nearest(x[part], centres, spread[part])
                    number[part], far[part] = names[at], np.sqrt(((x[part] - centres[at]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([batch.column("image_id"), batch.column("embedding"), pa.array(number), pa.array(far)], names=["image_id", "embedding", "cell", "far"])

    own = rows.select("image_id", "embedding", F.xxhash64("image_id", F.lit("cell")).alias("spread"), *(["cell"] if by_cell else []))
    return own.mapInArrow(run, "image_id string, embedding array<float>, cell int, far double")


def _write_rows(rows: DataFrame, path: str, generation: int, cell_bytes: int) -> None:
    """A part is written by several tasks, each of which writes its rows by cell."""
    rows = rows.select("image_id", "embedding", "cell", _part(F.col("cell"), cell_bytes).alias("part"))
    rows.repartition("part", F.pmod(F.xxhash64("image_id"), F.lit(8))).sortWithinPartitions("part", "cell").write.mode("append").partitionBy("part").parquet(f"{path}/rows/gen={generation}")


Stock = tuple[list[int], list[np.ndarray], list[float], list[int]]


def _published(spark: SparkSession, path: str, generation: int, stock: Stock, probes: int | None, cell_bytes: int) -> Index:
    """Writes the cells of the generation, which is there from then on."""
    numbers, centres, radii, rows = stock
    points = np.asarray(centres, np.float64)
    lists = pa.ListArray.from_arrays(np.arange(0, points.size + 1, points.shape[1], dtype=np.int32), points.ravel())
    table = pa.table({"cell": pa.array(numbers, pa.int32()), "centre": lists, "radius": pa.array(radii, pa.float64()), "n": pa.array(rows, pa.int64())})
    spark.createDataFrame(table).coalesce(1).write.parquet(f"{path}/cells/gen={generation}")
    return open_index(spark, path, generation, probes, cell_bytes)


def _settled(spark: SparkSession, path: str, generation: int, cell_bytes: int, numbers: list[int], centres: list[np.ndarray], radii: list[float]) -> Stock:
    """The cells with their numbers of rows, after those above the bound are split."""
    size = F.max(F.octet_length("image_id") + 4 * F.size("embedding")).alias("size")
    found = live_rows(spark, path, generation, numbers, cell_bytes).groupBy("cell").agg(F.count(F.lit(1)).alias("n"), size).collect()  # a row for each cell
    counts = {r["cell"]: r["n"] for r in found}
    most = max(1, cell_bytes // (max((r["size"] for r in found), default=0) or 1))
    stock = {n: (c, r, counts.get(n, 0)) for n, c, r in zip(numbers, centres, radii, strict=True)}
    full = {n: (c, r, k) for n, (c, r, k) in stock.items() if k > most}
    if full:
        parts, rows = _split(live_rows(spark, path, generation, list(full), cell_bytes).drop("place"), full, most, max(numbers) + 1)
        for table in rows:
            _write_rows(table, path, generation, cell_bytes)
        discard(*rows)
        stock = {n: x for n, x in stock.items() if n not in full} | parts
    ordered = sorted(stock)
    return ordered, [stock[n][0] for n in ordered], [stock[n][1] for n in ordered], [stock[n][2] for n in ordered]


def _split(rows: DataFrame, full: dict[int, tuple], most: int, first: int) -> tuple[dict[int, tuple], list[DataFrame]]:
    """(parts by number: centre, radius, rows; written tables of their rows). Parts are
    means of samples of the cell; what is above the bound is divided again, and
    what means cannot divide is divided by hash under one centre."""
    done: dict[int, tuple] = {}
    tables, pending = [], cut(rows)
    for turn in range(DIVISIONS + 32):
        by_hash = turn >= DIVISIONS
        if by_hash:  # a part more each time until all are within the bound
            among = {n: (np.repeat(np.asarray(c)[None], k := -(-count // most) + 1 + (turn - DIVISIONS) ** 2, axis=0), k) for n, (c, _, count) in full.items()}
        else:
            among = {n: (c, len(c)) for n, c in _part_means(pending, {n: (count, -(-2 * count // most)) for n, (_, _, count) in full.items()}).items()}
        named = {}
        for n, (centres, k) in among.items():
            named[n] = (centres, np.arange(first, first + k))
            first += k
        dealt = cut(_routed(pending, named))
        discard(pending)
        centre_of = {int(m): c for centres, names in named.values() for m, c in zip(names, centres, strict=True)}
        found = {r["cell"]: (centre_of[r["cell"]], r["far"], r["n"]) for r in dealt.groupBy("cell").agg(F.max("far").alias("far"), F.count(F.lit(1)).alias("n")).collect()}
        full = {n: x for n, x in found.items() if x[2] > most}
        done |= {n: x for n, x in found.items() if n not in full}
        if not full:
            return done, [*tables, dealt]
        tables.append(cut(_by_cell(dealt, [(n,) for n in full], how="left_anti")))
        pending = cut(_by_cell(dealt, [(n,) for n in full], how="left_semi").select("image_id", "embedding", "cell"))
        discard(dealt)
    raise RuntimeError(f"a cell of {max(x[2] for x in full.values())} rows could not be split to {most}")


def _part_means(rows: DataFrame, wanted: dict[int, tuple[int, int]]) -> dict[int, np.ndarray]:
    """The centres of each cell's parts; wanted: (rows, parts) by cell."""
    every = [(n, max(1, count // FIT_ROWS)) for n, (count, _) in wanted.items()]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        cell = int(frame["cell"].iloc[0])
        x = np.stack(frame.sort_values("image_id")["embedding"].to_numpy()).astype(np.float64)
        own = np.unique(x, axis=0)
        centres = own[np.random.default_rng(cell).permutation(len(own))[: wanted[cell][1]]]
        for _ in range(ROUNDS):
            near = ((centres**2).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)
            centres = np.stack([x[near == i].mean(axis=0) if (near == i).any() else centres[i] for i in range(len(centres))])
        return pd.DataFrame({"cell": np.full(len(centres), cell, np.int32), "centre": list(centres)})

    sample = _by_cell(rows, every, ", every long").where(F.pmod(F.xxhash64("image_id", F.lit("sample")), F.col("every")) == 0).drop("every")
    found: dict[int, list] = {n: [] for n in wanted}
    for r in sample.groupBy("cell").applyInPandas(run, "cell int, centre array<double>").collect():  # a row for each part
        found[r["cell"]].append(r["centre"])
    return {n: np.asarray(c) for n, c in found.items() if c} | {n: np.zeros((1, len(rows.first()["embedding"]))) for n, c in found.items() if not c}
