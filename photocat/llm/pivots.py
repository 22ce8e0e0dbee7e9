"""Embedding near-dedup by a pivot-permutation index.

A vector is described by its nearest reference points (pivots) in order, its
prefix. It is put into the inverted list of each of the first of them, and a
task that has a list counts shared pivots by lists of a second one within it, so
two vectors meet if they share two pivots at least, one of them among the first
of both. Vectors that meet are verified by cosine. A pair that meets in several
places counts in that of its lowest pivots. Lists longer than a block are
verified in pairs of blocks. No pair is emitted: each block gives sums of links
and one link per vector to the least that it reaches.

Lists carry vectors as bytes with a bound of the error, which decides nearly all
pairs; a block where a pair is closer to the threshold than the bound is
verified again with whole vectors in double precision.

Equal vectors form a class first, so copies are not compared. Pivots are drawn
by hash from the classes, about the square root of a third of their number up to
a fixed size in bytes; of pivots that are near copies of each other one is kept.
The prefix grows with the number of pivots, so recall keeps its level as the
table grows: in simulations of random vectors of a cosine of 0.9 in 64
dimensions it is 0.99 or more for 64 to 4,000 pivots, higher above.

Edge cases. Vectors that are null, zero or hold null or non-finite components
link with nothing; vectors of different lengths are not compared. Null id:
takes part under the least id and is shown as null. Repeated rows and ties:
copies link with each other. Empty table: no rows. Other columns, whatever their
names: ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles as S
from .common import components, cut, discard, join_split
from .vectors import classes_of, dimensions, numbered, shown

COSINE = 0.9
#: Bytes of the pivots, which every task is sent, and components of a block of a list.
PIVOT_BYTES, BLOCK = 64 << 20, 1 << 20
#: Vectors of a list of a second pivot that are multiplied at once; shorter
#: lists are compared by one place of all of them at a time.
TILE, SHORT = 1024, 128


def pivot_count(n: int, dim: int = 64) -> int:
    return min(max(64, int((n / 3) ** 0.5)), max(64, PIVOT_BYTES // (4 * dim)))


def prefix_length(pivots: int) -> int:
    """Grows with the pivots, so that two vectors of cosine 0.9 still share two
    of them in 99 cases of 100 or more."""
    return min(pivots, 6 + max(0, ceil(0.75 * log2(max(pivots, 1) / 64))))


def listed_length(pivots: int) -> int:
    """How many of the prefix have the vector in their list."""
    return ceil(0.72 * prefix_length(pivots))


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def choose_pivots(classes: DataFrame, rows: DataFrame, n: int, dim: int) -> np.ndarray:
    """Unit vectors, at most pivot_count(n, dim), from a sample four times as large."""
    want = pivot_count(n, dim)
    sample = classes.select("h1", "cls").orderBy("h1", "cls").limit(4 * want)
    found = rows.select("row", "v").join(F.broadcast(sample), F.col("row") == F.col("cls")).orderBy("h1", "cls").select("v").toPandas()["v"]
    kept = np.zeros((0, dim))
    for lo in range(0, len(found), 512):
        x = unit(np.stack(found[lo : lo + 512]))
        x = x[(x @ kept.T >= COSINE).sum(axis=1) == 0]
        twins = np.triu(x @ x.T >= COSINE, 1)
        alone = np.ones(len(x), bool)
        for i in np.flatnonzero(twins.any(axis=1)):
            if alone[i]:
                alone &= ~twins[i]
        kept = np.concatenate([kept, x[alone]])
    return kept[:want].astype(np.float32)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def described(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(row, prefix): the nearest pivots of v in order."""
    length, dim = prefix_length(len(pivots)), pivots.shape[1]
    shared = rows.sparkSession.sparkContext.broadcast(pivots)  # PIVOT_BYTES at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, (4 << 20) // len(shared.value))
        for batch in batches:
            x, out = _matrix(batch.column("v"), dim), [np.zeros((0, length), np.int32)]
            for lo in range(0, len(x), step):
                like = unit(x[lo : lo + step]).astype(np.float32) @ shared.value.T
                near = np.argpartition(-like, length - 1, axis=1)[:, :length] if length < len(shared.value) else np.tile(np.arange(length), (len(like), 1))
                order = np.lexsort((near, -np.take_along_axis(like, near, 1)), axis=1)
                out.append(np.take_along_axis(near, order, 1).astype(np.int32))
            flat = pa.array(np.concatenate(out).ravel())
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.FixedSizeListArray.from_arrays(flat, length).cast(pa.list_(pa.int32()))], names=["row", "prefix"])

    return rows.select("row", "v").mapInArrow(run, "row long, prefix array<int>")


def carried(rows: DataFrame, dim: int, exact: bool) -> DataFrame:
    """(row, scale, error, data): a unit vector as doubles, or as ``scale`` times
    bytes, which are ``error`` away from it at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = unit(_matrix(batch.column("v"), dim))
            scale = np.abs(x).max(axis=1) / 127
            data = x if exact else np.rint(x / scale[:, None]).astype(np.int8)
            error = np.zeros(len(x)) if exact else np.linalg.norm(x - data * scale[:, None], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(scale.astype(np.float32)), pa.array((error * 1.001 + 1e-6).astype(np.float32)), S.binary_rows(data)], names=["row", "scale", "error", "data"])

    return rows.select("row", "v").mapInArrow(run, "row long, scale float, error float, data binary")


class _Group:
    """A block pair of a pivot's list, as a task compares it."""

    def __init__(self, pivot: int, listed: int, x: np.ndarray, error: np.ndarray | None, prefix: np.ndarray, copies: np.ndarray, block: np.ndarray | None):
        self.pivot, self.listed, self.x, self.error, self.prefix, self.copies, self.block = pivot, listed, x, error, prefix, copies, block
        self.add = np.zeros(len(x), np.int64)
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []

    def decided(self, like: np.ndarray, error: np.ndarray) -> np.ndarray:
        """Which cosines are links; an error if one cannot be told."""
        if self.error is None:
            return like >= COSINE
        if (np.abs(like - COSINE) <= error).any():
            raise ArithmeticError
        return like >= COSINE

    def count(self, i: np.ndarray, j: np.ndarray, second: np.ndarray | int) -> None:
        """Adds the links (i, j), found by ``second``, that count in this place."""
        for lo in range(0, len(i), 100_000):
            p, q = i[lo : lo + 100_000], j[lo : lo + 100_000]
            own, other = self.prefix[p], self.prefix[q]
            here = own[:, :, None] == other[:, None, :]
            first = np.where(here[:, : self.listed, : self.listed].any(axis=2), own[:, : self.listed], np.iinfo(np.int32).max).min(axis=1)
            low = np.where(here.any(axis=2) & (own != self.pivot), own, np.iinfo(np.int32).max).min(axis=1)
            mine = (first == self.pivot) & (low == (second[lo : lo + 100_000] if isinstance(second, np.ndarray) else second))
            self.add += np.bincount(p[mine], weights=self.copies[q[mine]], minlength=len(self.x)).astype(np.int64)
            self.add += np.bincount(q[mine], weights=self.copies[p[mine]], minlength=len(self.x)).astype(np.int64)

    def compare(self) -> None:
        """All pairs that share the pivot and a second one."""
        n, length = self.prefix.shape
        row, second = np.repeat(np.arange(n), length), self.prefix.ravel()
        row, second = row[second != self.pivot], second[second != self.pivot]
        order = np.lexsort((row, second))
        row, second = row[order], second[order]
        starts = np.flatnonzero(np.concatenate([[True], second[1:] != second[:-1]])) if len(second) else np.zeros(0, int)
        sizes = np.diff(np.append(starts, len(second)))
        short = np.repeat(sizes <= SHORT, sizes)
        left = np.repeat(starts + sizes, sizes) - np.arange(len(second)) - 1  # rows of the list after each
        for step in range(1, min(SHORT, sizes.max(initial=0))):
            there = np.flatnonzero(short & (left >= step))
            for lo in range(0, len(there), 32_768):
                at = there[lo : lo + 32_768]
                i, j = row[at], row[at + step]
                if self.block is not None:
                    apart = self.block[i] != self.block[j]
                    at, i, j = at[apart], i[apart], j[apart]
                linked = self.decided(np.einsum("ij,ij->i", self.x[i], self.x[j]), 0 if self.error is None else self.error[i] + self.error[j])
                self.edges.append((i[linked], j[linked]))
                self.count(i[linked], j[linked], second[at[linked]])
        for a, size in zip(starts[sizes > SHORT], sizes[sizes > SHORT], strict=True):
            own = row[a : a + size]
            for lo in range(0, size, TILE):
                for hi in range(lo, size, TILE):
                    self.tile(own[lo : lo + TILE], own[hi : hi + TILE], lo == hi, int(second[a]))

    def tile(self, one: np.ndarray, two: np.ndarray, same: bool, second: int) -> None:
        like = self.x[one] @ self.x[two].T
        if same:
            np.fill_diagonal(like, -1)
        if self.block is not None:
            like[self.block[one][:, None] == self.block[two][None, :]] = -1
        linked = self.decided(like, 0 if self.error is None else self.error[one][:, None] + self.error[two][None, :])
        i, j = np.nonzero(np.triu(linked) if same else linked)
        self.count(one[i], two[j], second)
        # each row and column with the least that it reaches within the tile
        label_i, label_j, none = one.copy(), two.copy(), len(self.x)
        while len(i):
            new_i = np.minimum(label_i, np.where(linked, label_j[None, :], none).min(axis=1))
            new_j = np.minimum(label_j, np.where(linked, new_i[:, None], none).min(axis=0))
            if (new_i == label_i).all() and (new_j == label_j).all():
                break
            label_i, label_j = new_i, new_j
        self.edges += [(one, label_i), (two, label_j)]


def _verifier(listed: int, length: int, dim: int, exact: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each vector that has links in its block: copies it is linked to, and
        the least that it reaches; for a block that must be verified again, its key alone."""
        for table, bounds in S.whole_groups(batches, ["key"]):
            cls, copies, block, keys = (table.column(c).to_numpy() for c in ("cls", "n", "block", "key"))
            prefix = S.list_values(table.column("prefix"))[0].reshape(-1, length)
            out: list[list] = [[], [], [], []]
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                key = int(keys[a])
                data = S.fixed_bytes(table.column("data").slice(a, b - a), np.float64 if exact else np.int8, dim)
                x = data if exact else data * table.column("scale").slice(a, b - a).to_numpy()[:, None]
                error = None if exact else table.column("error").slice(a, b - a).to_numpy() * np.float32(1.1) + np.float32(1e-5)
                group = _Group(key >> 44, listed, x, error, prefix[a:b], copies[a:b], block[a:b] if (key >> 22 ^ key) & (1 << 22) - 1 else None)
                try:
                    group.compare()
                except ArithmeticError:
                    found = ([key], [None], [None], [None])
                else:
                    root = S.edge_roots(b - a, *(np.concatenate([e[s] for e in group.edges] or [np.zeros(0, np.int64)]) for s in (0, 1)))
                    some = np.flatnonzero((group.add > 0) | (root != np.arange(b - a)))
                    found = ([key] * len(some), cls[a + some], group.add[some], cls[a + root[some]])
                for o, y in zip(out, found, strict=True):
                    o.extend(y)
            yield pa.RecordBatch.from_arrays([pa.array(o, pa.int64()) for o in out], names=["key", "cls", "linked", "least"])

    return run


def linked_classes(classes: DataFrame, rows: DataFrame, dim: int) -> DataFrame:
    """(cls, linked, least), written, of one dimension's classes; a class may have several rows."""
    n = classes.count()
    pivots = choose_pivots(classes, rows, n, dim)
    length, listed = prefix_length(len(pivots)), listed_length(len(pivots))
    if length < 2:  # all are near copies of one: two pivots at right angles serve as lists of all
        pivots = np.concatenate([pivots[:1], np.eye(2, dim, dtype=np.float32)])[:2]
        length = listed = 2
    known = cut(described(rows, pivots).join(classes.select("cls", "n"), F.col("row") == F.col("cls")).select("cls", "n", "prefix"))
    lists = known.select("cls", F.explode(F.slice("prefix", 1, listed)).alias("list"))
    sizes = cut(lists.groupBy("list").agg(F.count(F.lit(1)).alias("n")))  # a row for each pivot at most
    per_block = max(TILE, BLOCK // dim)
    placed = lists.join(F.broadcast(sizes), "list").withColumn("blocks", F.ceil(F.col("n") / per_block).cast("int"))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")).select("cls", "list", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    key = F.shiftleft(F.col("list").cast("long"), 44).bitwiseOR(F.shiftleft(F.least("block", "other").cast("long"), 22)).bitwiseOR(F.greatest("block", "other").cast("long")).alias("key")
    placed = placed.select("cls", key, "block")

    def verified(exact: bool, only: DataFrame | None = None) -> DataFrame:
        wanted = placed if only is None else placed.join(only, "key", "left_semi")
        own = known.join(carried(rows, dim, exact), F.col("row") == F.col("cls")).drop("row")
        sent = wanted.join(own, "cls").select("key", "block", "cls", "n", "prefix", "scale", "error", "data").repartition("key").sortWithinPartitions("key")
        return cut(sent.mapInArrow(_verifier(listed, length, dim, exact), "key long, cls long, linked long, least long"))

    out = verified(False)
    again = out.where("cls is null").select("key")
    if not again.isEmpty():
        out = out.where("cls is not null").union(verified(True, again))
    return out.select("cls", "linked", "least")


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row; links are vectors of
    cosine 0.9 or more, components are named by their smallest id."""
    rows = numbered(df, key, vector)
    classes = classes_of(rows)
    links = None
    for dim in dimensions(classes):
        found = linked_classes(classes.where(F.col("dim") == dim), rows.where(F.col("dim") == dim), dim)
        links = found if links is None else links.union(found)
    if links is None:
        links = df.sparkSession.createDataFrame([], "cls long, linked long, least long")
    sums = links.groupBy("cls").agg(F.sum("linked").alias("linked"))
    groups = components(links.select(F.col("cls").alias("a"), F.col("least").alias("b")))
    named = cut(groups.join(classes.select("cls", "least_id"), F.col("id") == F.col("cls")).select("cls", "root", "least_id"))
    least = cut(named.groupBy("root").agg(F.min("least_id").alias("component"), F.count(F.lit(1)).alias("n")))
    placed = join_split(named.select("cls", "root"), least, ["root"], ["cls"]).select("cls", "component")
    result = cut(classes.join(sums, "cls", "left").join(placed, "cls", "left").select(
        "h1", "h2", (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("component", "least_id").alias("component"), "n"))
    discard(groups, named, least)
    out = join_split(rows.select("id", "row", "h1", "h2"), result, ["h1", "h2"], ["row"], how="left")
    component = F.coalesce("component", "id")
    return out.select(shown(F.col("id")).alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), shown(component).alias("component_id"), (F.col("id") == component).alias("kept"))
