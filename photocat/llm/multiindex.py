"""Hard-negative mining over an inverted multi-index.

Vectors are scaled to integers. Each half of their components has a codebook of
its own, and a pair of codewords is a cell. A half's product with an anchor is at
most that with its codeword plus the half's length times the codeword's radius,
the largest distance of a row from it; the sum of both halves bounds every score
in a cell. For each anchor a heap visits cells in the order of these sums (the
multi-sequence algorithm: both halves sorted, the heap holds the frontier).

A search wants the k best rows of some windows of scores. The first cells of the
sequence give provisional ones; their k-th score is then the floor of a window,
and the sequence goes on until its bound falls below all floors. No cell beyond
can hold a row that belongs into a window, nor one that ties, so the windows are
certified and the result is exact, also where the bounds rule out little. The
positives are the best rows of the anchor's label; their scores give the windows
for rows of other labels.

Cells meet the anchors that visit them in groups of bounded size: a large cell is
dealt over parts, many anchors over blocks, and each group is one product of
matrices that gives the k best of each window and no pairs.

Edge cases. Rows with a null label or vector, or with null or non-finite
components, take no part, and neither do those with no component or one of 2^25
and more after scaling, whose scores might not fit; vectors of different lengths
are not compared. Null id: never an anchor, first among ties and shown as null.
Repeated rows: each asks and is found by itself, and a row never finds itself.
Fewer rows than asked for: all. A negative or contradictory window: no row. Ties:
the smaller id, then the earlier row. Empty table: no rows. Other columns: ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, discard
from .vectors import NULL_ID, shown

#: Rows that the codebooks are fitted on at most (those with the least hashes),
#: rounds of the fit, rows of a cell aimed at, codewords of a half at most.
SAMPLE, ROUNDS, CELL, CODEWORDS = 16_384, 8, 1024, 1024
#: Rows of a part of a cell, anchors of a block, cells that an anchor visits
#: before its floors are known, scores that a task holds at once.
PART, BLOCK, FIRST, HELD = 4096, 16_384, 6, 1 << 21
#: Scaled components are smaller than this.
LARGEST = 1 << 25
LOWEST, HIGHEST = -(2**63), 2**63 - 1


def half_means(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k codewords at most: distinct rows as a start, then rounds of means."""
    rng = np.random.default_rng(seed)
    own = np.unique(x, axis=0)
    centres = own[rng.permutation(len(own))[:k]]
    for _ in range(ROUNDS):
        near = nearest_codeword(x, centres)[0]
        n = np.bincount(near, minlength=len(centres))
        sums = np.stack([np.bincount(near, weights=x[:, j], minlength=len(centres)) for j in range(x.shape[1])], axis=1) if x.shape[1] else np.zeros((len(centres), 0))
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def nearest_codeword(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codeword, distance) of each row."""
    code = np.zeros(len(x), np.int64)
    step = max(1, HELD // max(1, len(centres)))
    length = (centres**2).sum(axis=1) / 2
    for lo in range(0, len(x), step):
        code[lo : lo + step] = (length - x[lo : lo + step] @ centres.T).argmin(axis=1)
    return code, np.sqrt(((x - centres[code]) ** 2).sum(axis=1))


@dataclass(frozen=True)
class Codebooks:
    """Of both halves: codewords, and the largest distance of a row from each."""

    words: tuple[np.ndarray, np.ndarray]
    radii: tuple[np.ndarray, np.ndarray]

    def bounds(self, q: np.ndarray) -> list[np.ndarray]:
        """For each half the bounds (anchors x codewords), rounded up."""
        out, at = [], 0
        for words, radii in zip(self.words, self.radii, strict=True):
            own = q[:, at : at + words.shape[1]]
            at += words.shape[1]
            length, size = np.linalg.norm(own, axis=1)[:, None], np.linalg.norm(words, axis=1)
            out.append(own @ words.T + length * radii + 1e-9 * length * (size + radii) + 0.01)
        return out


def sequence(first: np.ndarray, second: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """(bound, codeword, codeword) of all cells in the order of falling sums."""
    a, b = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    x, y = first[a].tolist(), second[b].tolist()
    heap = [(-(x[0] + y[0]), 0, 0)]
    while heap:
        bound, i, j = heapq.heappop(heap)
        yield -bound, int(a[i]), int(b[j])
        if j + 1 < len(y):
            heapq.heappush(heap, (-(x[i] + y[j + 1]), i, j + 1))
        if j == 0 and i + 1 < len(x):  # each cell has one way to it
            heapq.heappush(heap, (-(x[i + 1] + y[0]), i + 1, 0))


def _matrix(column: pd.Series | list[bytes]) -> np.ndarray:
    return np.stack([np.frombuffer(b, np.int32) for b in column]).astype(np.float64)


def scaled(df: DataFrame, scale: float, key: str, vector: str, label: str) -> DataFrame:
    """(row, id, label, dim, v), written: those that take part; v has the bytes of 32-bit integers."""
    v = F.col(vector)
    fits = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) * scale < LARGEST - 1), F.lit(False)))
    some = F.col(label).isNotNull() & v.isNotNull() & (F.size(v) > 0) & fits
    ints = F.when(some, F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("int")))
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(key).cast("long"), F.lit(NULL_ID)).alias("id"), F.col(label).cast("long").alias("label"), ints.alias("ints")).where("ints is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("ints")
            flat, sizes = own.flatten().to_numpy(), own.value_lengths().to_numpy()
            ends = np.cumsum(np.concatenate([[0], 4 * sizes])).astype(np.int32)
            data = pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(flat))])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("row", "id", "label")], pa.array(sizes.astype(np.int32)), data], names=["row", "id", "label", "dim", "v"])

    return cut(rows.mapInArrow(run, "row long, id long, label long, dim int, v binary"))


def fit(rows: DataFrame, dim: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The codewords of both halves, fitted by one task on SAMPLE rows at most."""
    k = int(min(CODEWORDS, max(1, round((n / CELL) ** 0.5))))

    def run(own: pd.DataFrame) -> pd.DataFrame:
        x = _matrix(own.sort_values(["h", "row"])["v"])
        halves = [half_means(x[:, : dim // 2], k, 1), half_means(x[:, dim // 2 :], k, 2)]
        return pd.DataFrame({"first": [halves[0].tobytes()], "second": [halves[1].tobytes()]})

    sample = rows.select("row", "v", F.xxhash64("v").alias("h")).orderBy("h", "row").limit(SAMPLE)
    found = sample.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(run, "first binary, second binary").first()
    second = np.frombuffer(found["second"]).reshape(-1, dim - dim // 2)
    return (np.frombuffer(found["first"]).reshape(-1, dim // 2) if dim > 1 else np.zeros((1, 0))), second


def build_index(rows: DataFrame, dim: int, n: int) -> tuple[DataFrame, DataFrame, Codebooks]:
    """(rows with cell (a, b) and part, written; cells: a, b, parts, written; codebooks)."""
    words = fit(rows, dim, n)
    shared = rows.sparkSession.sparkContext.broadcast(words)  # 2 CODEWORDS at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column("v").to_pylist()), np.int32).reshape(-1, dim).astype(np.float64)
            (a, da), (b, db) = nearest_codeword(x[:, : dim // 2], shared.value[0]), nearest_codeword(x[:, dim // 2 :], shared.value[1])
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, (a, b, da, db))], names=[*batch.schema.names, "a", "b", "da", "db"])

    own = cut(rows.drop("dim").mapInArrow(run, "row long, id long, label long, v binary, a long, b long, da double, db double"))
    counted = cut(own.groupBy("a", "b").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"), F.max("da").alias("da"), F.max("db").alias("db")))
    radii = []
    for half, size in (("a", len(words[0])), ("b", len(words[1]))):
        r = np.zeros(size)
        for x in counted.groupBy(half).agg(F.max(f"d{half}").alias("r")).collect():  # CODEWORDS rows at most
            r[x[half]] = x["r"]
        radii.append(r)
    return own.drop("da", "db"), counted.select("a", "b", "parts"), Codebooks(words, (radii[0], radii[1]))


def visits(asks: DataFrame, books: Broadcast, dim: int, start: int, stop: int | None) -> DataFrame:
    """``asks`` with (a, b), a row for each cell from place ``start`` of its sequence
    up to ``stop``, and not beyond the least floor of its windows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            q = _matrix(batch["v"])
            first, second = books.value.bounds(q)
            for lo in range(0, len(batch), 64):
                row, a, b = [], [], []
                for i in range(lo, min(lo + 64, len(batch))):
                    floor = batch["floor"].iat[i]
                    for place, (bound, x, y) in enumerate(sequence(first[i], second[i])):
                        if bound < floor or place == stop:
                            break
                        if place >= start:
                            row.append(i)
                            a.append(x)
                            b.append(y)
                out = batch.iloc[row].reset_index(drop=True)
                out["a"], out["b"] = np.array(a, np.int64), np.array(b, np.int64)
                yield out

    return asks.mapInPandas(run, "anchor long, label long, v binary, lo array<long>, hi array<long>, floor long, a long, b long")


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer products of rows with rows."""
    if np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(1, x.shape[1]) < 2.0**53:
        return (q @ x.T).astype(np.int64)
    return q.astype(np.int64) @ x.astype(np.int64).T


def best_places(score: np.ndarray, ok: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of the k largest of each row where ``ok``, ties to the left."""
    score = np.where(ok, score, LOWEST)
    if score.shape[1] > k:
        ok = ok & (score >= np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k, None])
    row, column = np.nonzero(ok)
    order = np.lexsort((column, -score[row, column], row))
    row, column = row[order], column[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], column[place < k]


def compare(index: DataFrame, cells: DataFrame, asked: DataFrame, k: int, same: bool, blocks: int) -> DataFrame:
    """(anchor, w, id, row, score): of each visited part of a cell the k best rows of
    each window, of the anchor's label or of others."""
    parts = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    asked = cut(asked.join(cells, ["a", "b"]).select("*", parts, F.pmod(F.xxhash64("anchor"), F.lit(blocks)).cast("int").alias("block")).drop("parts"))
    own = index.join(cells, ["a", "b"]).withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")).drop("parts")
    keys = ["a", "b", "part", "block"]
    met = asked.select(*[F.col(c).alias(f"_{c}") for c in keys]).distinct()
    own = own.join(met, (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")) & (F.col("part") == F.col("_part"))).select(*index.columns, "part", F.col("_block").alias("block"))
    schema = "anchor long, w int, id long, row long, score long"
    nothing = pd.DataFrame({"anchor": [], "w": [], "id": [], "row": [], "score": []}).astype({"w": "int32", "anchor": "int64", "id": "int64", "row": "int64", "score": "int64"})

    def run(rows: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(asks):
            return nothing
        rows = rows.sort_values(["id", "row"], ignore_index=True)
        x, labels, row, ids = _matrix(rows["v"]), rows["label"].to_numpy(), rows["row"].to_numpy(), rows["id"].to_numpy()
        out = [nothing]
        for lo in range(0, len(asks), step := max(1, HELD // len(rows))):
            part = asks.iloc[lo : lo + step]
            score = products(_matrix(part["v"]), x)
            ok = (labels == part["label"].to_numpy()[:, None]) == same
            anchor = part["anchor"].to_numpy()
            ok &= row != anchor[:, None]
            low, high = np.stack(part["lo"].to_numpy()), np.stack(part["hi"].to_numpy())
            for w in range(low.shape[1]):
                at, place = best_places(score, ok & (score >= low[:, w, None]) & (score <= high[:, w, None]), k)
                out.append(pd.DataFrame({"anchor": anchor[at], "w": np.full(len(at), w, np.int32), "id": ids[place], "row": row[place], "score": score[at, place]}))
        return pd.concat(out, ignore_index=True)

    return own.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(run, schema)


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each window with their ``rank``."""
    order = Window.partitionBy("anchor", "w").orderBy(F.desc("score"), "id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(index: DataFrame, cells: DataFrame, books: Broadcast, asks: DataFrame, dim: int, k: int, same: bool, blocks: int) -> DataFrame:
    """(anchor, w, id, row, score, rank), written: the k best rows of each window of
    ``asks`` (anchor, label, v, lo, hi), exactly; a window is an element of lo and hi."""
    least = F.array_min(F.filter(F.zip_with("lo", "hi", lambda lo, hi: F.when(lo <= hi, lo)), lambda x: x.isNotNull()))
    asks = asks.withColumn("floor", least).where("floor is not null")
    begun = cut(_best(compare(index, cells, visits(asks, books, dim, 0, FIRST), k, same, blocks), k).drop("rank"))
    full = begun.groupBy("anchor", "w").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth")).where(F.col("n") == k)
    floors = full.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("w", "kth"))).alias("floors"))  # one for each window
    raised = F.transform("lo", lambda x, i: F.greatest(x, F.coalesce(F.try_element_at("floors", i), x)))
    later = asks.join(floors, "anchor", "left").withColumn("lo", raised).drop("floors").withColumn("floor", least)
    rest = compare(index, cells, visits(later.select(asks.columns), books, dim, FIRST, None), k, same, blocks)
    out = cut(_best(begun.union(rest), k))
    discard(begun)
    return out


def hard_negatives(
    df: DataFrame, is_anchor: Column, *, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: float = 256.0, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for
    each row where ``is_anchor``, an expression over ``id``, and each of its best
    rows of the same label, the best rows of other labels whose scores lie from
    ``low`` to ``high`` percent of the positive's."""
    rows, out = scaled(df, scale, key, vector, label), None
    for dim, n in sorted((r["dim"], r["count"]) for r in rows.groupBy("dim").count().collect()):  # few lengths
        own = rows.where(F.col("dim") == dim)
        index, cells, books = build_index(own, dim, n)
        shared = df.sparkSession.sparkContext.broadcast(books)
        anchors = own.where(is_anchor & (F.col("id") != NULL_ID)).select(F.col("row").alias("anchor"), "id", "label", "v")
        blocks = max(1, -(-anchors.count() // BLOCK))
        whole = [F.array(F.lit(x).cast("long")).alias(c) for x, c in ((LOWEST, "lo"), (HIGHEST, "hi"))]
        found = search(index, cells, shared, anchors.select("anchor", "label", "v", *whole), dim, positives, True, blocks)
        pairs = found.select("anchor", (F.col("rank") - 1).alias("w"), F.col("id").alias("positive"), F.col("score").alias("positive_score"))
        # window w is that of the positive with the rank w + 1, in whole numbers that stay in range
        q, r = "((positive_score - pmod(positive_score, 100L)) div 100)", "pmod(positive_score, 100L)"
        bounds = F.struct("w", F.expr(f"{low} * {q} + ({low} * {r} + 99) div 100").alias("lo"), F.expr(f"{high} * {q} + ({high} * {r}) div 100").alias("hi"))
        windows = pairs.groupBy("anchor").agg(F.array_sort(F.collect_list(bounds)).alias("x"))  # one for each positive
        padded = [F.concat(F.col(f"x.{c}"), F.array_repeat(F.lit(none).cast("long"), F.lit(positives) - F.size("x"))).alias(c) for c, none in (("lo", 1), ("hi", 0))]
        asks = anchors.join(windows, "anchor").select("anchor", "label", "v", *padded)
        hard = search(index, cells, shared, asks, dim, negatives, False, blocks)
        named = hard.select("anchor", "w", "rank", F.col("id").alias("negative"), F.col("score").alias("negative_score"))
        these = pairs.join(named, ["anchor", "w"]).join(anchors.select("anchor", "id"), "anchor")
        these = these.select(F.col("id").alias("anchor_id"), shown(F.col("positive")).alias("positive_id"), "rank", shown(F.col("negative")).alias("negative_id"), "positive_score", "negative_score")
        out = these if out is None else out.union(these)
    if out is None:
        return df.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return out

