"""Importance resampling of documents towards a target distribution.

Features are runs of words, hashed to buckets. The corpus' and the target's
counts of each bucket give its gain, the logarithm of the smoothed ratio of their
shares; all gains are one array, by which a document's features are looked up
and summed. A Gumbel variate, made of a hash of the id, is added, so the highest
scores are a weighted sample without replacement.

The draw is a distributed quickselect. Each round takes some random rows among
those still in question as pivots, counts exactly how many rows lie below, at and
between them, and keeps the part that holds the last row to be drawn, until a
pivot is that row. The key is composite (score, id, row), so no two rows are
equal, however many scores are. Only the winners are then sorted and ranked: they
are written in ranges of the key, each range is numbered, and starts with the sum
of those before it.

Words are maximal runs of digits, letters and non-ASCII characters; only A-Z are
lower-cased.

Edge cases. Null and empty texts: no features, weight 0, never drawn (the least
number of words is 1 at least). Null id: hashed as an empty one, after all others
among ties. Rows that repeat: each may be drawn, by its row. Very long texts:
hashed in pieces, all features count. Empty tables: no rows; an empty target
gives every bucket the gain of no evidence. Other columns: ignored; clashing
names do no harm.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shingles as S
from .common import cut, discard

#: Pivots of a round, bytes from which a span is hashed by itself.
PIVOTS, LONG = 16, 64
#: The Gumbel variates and gains are integers, in thousandths.
SCALE = 1000
_NO_ID = 2**63 - 1
#: The register's step for each byte: CRC-32 is linear, so the inversions cancel.
_STEP = np.array([zlib.crc32(bytes([i])) ^ zlib.crc32(b"\0") for i in range(256)], np.uint32)


def crc32_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The CRC-32 of each span of bytes, a byte of all spans at a time."""
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    long = int(np.searchsorted(-size[order], -LONG))
    out = np.zeros(len(size), np.uint32)
    whole = data.tobytes() if long else b""
    for i in order[:long]:
        out[i] = zlib.crc32(whole[starts[i] : ends[i]])
    order = order[long:]
    at, left = starts[order], size[order]
    state = np.full(len(order), 0xFFFFFFFF, np.uint32)
    for j in range(int(left[0]) if len(left) else 0):
        n = int(np.searchsorted(-left, -j))  # spans that have a byte there
        state[:n] = _STEP[(state[:n] ^ data[at[:n] + j]) & np.uint32(0xFF)] ^ (state[:n] >> np.uint32(8))
    out[order] = ~state
    return out


def _buckets(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, counts: np.ndarray, runs: tuple[int, int], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each feature, its text) of words that are spans of data."""
    low, high = runs
    if high == 1:
        return crc32_spans(data, starts, ends) % np.uint32(buckets), np.repeat(np.arange(len(counts)), counts)
    # words side by side, one space after each: a run of words is a span of these
    size = ends - starts
    to = np.cumsum(size + 1) - size - 1
    packed = np.full(int((size + 1).sum()), ord(" "), np.uint8)
    shift = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    packed[np.repeat(to, size) + shift] = data[np.repeat(starts, size) + shift]
    owner = np.repeat(np.arange(len(counts)), counts)
    found, owners = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
    for k in range(low, high + 1):
        first = np.flatnonzero(owner[: max(0, len(owner) - k + 1)] == owner[k - 1 :])
        found.append(crc32_spans(packed, to[first], to[first + k - 1] + size[first + k - 1]) % np.uint32(buckets))
        owners.append(owner[first])
    return np.concatenate(found), np.concatenate(owners)


def features(texts: pa.Array, runs: tuple[int, int], buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each chunk of texts: (bucket of each feature, its text in ``texts``, words of each text)."""
    for a, b in S.chunks(texts):
        part = texts.slice(a, b - a)
        text = part[0].as_py() or "" if len(part) == 1 else ""
        if len(text) <= S.CHUNK:
            data, starts, ends, counts = S.word_spans(part, pc.ascii_lower)
            bucket, owner = _buckets(data, starts, ends, counts, runs, buckets)
            yield bucket, owner + a, np.concatenate([np.zeros(a, np.int64), counts, np.zeros(len(texts) - b, np.int64)])
            continue
        carried: list[bytes] = []  # the last words of the piece before, as runs may begin there
        for piece in S.pieces(text):
            data, starts, ends, counts = S.word_spans(pa.array([piece]), pc.ascii_lower)
            new = len(starts)
            lead = b"".join(w + b" " for w in carried)
            if lead:
                at = np.cumsum([0, *[len(w) + 1 for w in carried]])
                starts, ends = np.concatenate([at[:-1], starts + len(lead)]), np.concatenate([at[1:] - 1, ends + len(lead)])
                data = np.concatenate([np.frombuffer(lead, np.uint8), data])
            bucket, owner = _buckets(data, starts, ends, np.array([len(starts)]), runs, buckets)
            if carried:  # what lies in the carried words alone was counted with them
                before = _buckets(data, starts[: len(carried)], ends[: len(carried)], np.array([len(carried)]), runs, buckets)[0]
                bucket = _without(bucket, before)
                owner = owner[: len(bucket)]
            words = np.zeros(len(texts), np.int64)
            words[a] = new
            yield bucket, owner + a, words
            raw = data.tobytes()
            carried = [raw[s:e] for s, e in zip(starts[-(runs[1] - 1) :], ends[-(runs[1] - 1) :], strict=True)] if runs[1] > 1 and len(starts) else []


def _without(values: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """A multiset of buckets without those of another, which it contains."""
    size = int(values.max(initial=0)) + 1
    left = np.bincount(values, minlength=size) - np.bincount(gone, minlength=size)
    return np.repeat(np.arange(size, dtype=np.uint32), left)


def bucket_counts(docs: DataFrame, text: str = "text", *, runs: tuple[int, int] = (1, 1), buckets: int = 10_000) -> DataFrame:
    """(bucket, n): all features of all texts, summed by each task before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for bucket, _, _ in features(batch.column(0), runs, buckets):
                total += np.bincount(bucket, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, *, runs: tuple[int, int] = (1, 1), buckets: int = 10_000) -> np.ndarray:
    """The gain of each bucket: an array of ``buckets`` integers, which the driver holds."""
    counts = []
    for table in (docs, target):
        n = np.zeros(buckets)
        for row in bucket_counts(table, runs=runs, buckets=buckets).collect():  # buckets rows at most
            n[row["bucket"]] = row["n"]
        counts.append(n)
    s, t = counts
    ratio = (t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets))
    return np.array([math.floor(SCALE * math.log(x)) for x in ratio], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, *, key: str = "doc_id", runs: tuple[int, int] = (1, 1)) -> DataFrame:
    """(row, id, n_words, n_features, weight) of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            n = batch.num_rows
            words, found, weight = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
            for bucket, owner, counts in features(batch.column("text"), runs, len(own)):
                words += counts
                if len(bucket):
                    low, high = int(owner.min()), int(owner.max()) + 1
                    weight[low:high] += np.bincount(owner - low, weights=own[bucket], minlength=high - low).astype(np.int64)
                    found[low:high] += np.bincount(owner - low, minlength=high - low)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), pa.array(words), pa.array(found), pa.array(weight)], names=["row", "id", "n_words", "n_features", "weight"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("id"), "text")
    return rows.mapInArrow(run, "row long, id long, n_words long, n_features long, weight long")


def gumbel(key: Column, seed: int) -> Column:
    """A standard Gumbel variate of each key, in thousandths, rounded down."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-F.lit(float(SCALE)) * F.log(-F.log((h.cast("double") + 0.5) / F.lit(2.0**32)))).cast("long")


def _keys() -> list[Column]:
    """(s, i, r): ascending, so that the first to be drawn comes first."""
    return [(-F.col("score")).alias("s"), F.coalesce("id", F.lit(_NO_ID)).alias("i"), F.col("row").alias("r")]


def _above(key: tuple[int, int, int], equal: bool = False) -> Column:
    """Whether (s, i, r) comes after ``key``, or is it."""
    s, i, r = (F.col(c) for c in "sir")
    last = r >= key[2] if equal else r > key[2]
    return (s > key[0]) | ((s == key[0]) & ((i > key[1]) | ((i == key[1]) & last)))


def kth(keys: DataFrame, k: int, seed: int = 0) -> tuple[int, int, int]:
    """The k-th smallest (from 1) of the distinct composite keys (s, i, r) of a
    written table: exact counts around random pivots, until a pivot is it."""
    at, written, turn = k, None, 0
    while True:
        turn += 1
        drawn = sorted((r["s"], r["i"], r["r"]) for r in keys.orderBy(F.xxhash64("r", F.lit(seed), F.lit(turn)), "r").limit(PIVOTS).collect())
        # 2 j: between the pivots j - 1 and j; 2 j + 1: the pivot j itself
        part = sum((_above(p).cast("int") + _above(p, True).cast("int") for p in drawn), F.lit(0))
        counts = {r["part"]: r["count"] for r in keys.groupBy(part.alias("part")).count().collect()}  # 2 PIVOTS + 1 at most
        for here in sorted(counts):
            if at <= counts[here]:
                break
            at -= counts[here]
        if here % 2:
            if written is not None:
                discard(written)
            return drawn[here // 2]
        low = drawn[here // 2 - 1] if here else None
        high = drawn[here // 2] if here // 2 < len(drawn) else None
        rest = keys
        if low is not None:  # the bound of s alone reaches the scan of the table
            rest = rest.where((F.col("s") >= low[0]) & _above(low))
        if high is not None:
            rest = rest.where((F.col("s") <= high[0]) & ~_above(high, True))
        before, keys = written, cut(rest)
        written = keys
        if before is not None:
            discard(before)


def ranked(winners: DataFrame) -> DataFrame:
    """``winners`` with ``rank`` (from 1) by their keys, written: sorted in ranges,
    each numbered by its own task."""
    own = cut(winners.orderBy("s", "i", "r").select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")))
    sizes = own.groupBy("_part").count()
    starts = sizes.select("_part", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))  # a row for each range
    out = cut(own.join(F.broadcast(starts), "_part").withColumn("rank", F.col("_start") + F.col("_at") + 1).drop("_part", "_at", "_start"))
    discard(own)
    return out


def resample(docs: DataFrame, target: DataFrame, *, percent: int = 10, min_words: int = 20, seed: int = 2024, runs: tuple[int, int] = (1, 1), buckets: int = 10_000, key: str = "doc_id") -> DataFrame:
    """(key, n_features, weight, score, rank): a row for each document; rank is null
    where it is not among the ``percent`` of all documents with ``min_words`` words
    that are drawn."""
    gain = gains(docs, target, runs=runs, buckets=buckets)
    scored = cut(weighed(docs, gain, key=key, runs=runs).withColumn("score", F.col("weight") + gumbel(F.col("id"), seed)))
    able = F.col("n_words") >= max(1, min_words)
    n = scored.where(able).count()
    k = min(n, n * percent // 100)
    shown = [F.col("id").alias(key), "n_features", "weight", "score"]
    if k <= 0:
        return scored.select(*shown, F.lit(None).cast("long").alias("rank"))
    keys = cut(scored.where(able).select(*_keys()))
    last = kth(keys, k, seed)
    discard(keys)
    with_keys = scored.select("*", *_keys())
    drawn = able & (F.col("s") <= last[0]) & ~_above(last)
    winners = ranked(with_keys.where(drawn))
    return winners.select(*shown, "rank").union(with_keys.where(~drawn).select(*shown, F.lit(None).cast("long").alias("rank")))
