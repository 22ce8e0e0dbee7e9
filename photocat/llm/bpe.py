"""Byte-level BPE encoding and decoding as a monoid tree reduction.

An encoded span is an element; joining two neighbours gives the element of
their concatenation, whichever way a text was halved, so halves are encoded on
their own and joined up a tree.

* Texts are halved at white space that follows another character. No match of
  the pattern crosses such a place, and matches are encoded separately, so the
  join there is concatenation.
* A match of more than ``LEAF`` bytes is halved too. Its halves' tokens may
  differ near the seam from those of the whole. The join re-encodes a window
  around the seam and widens it until the pairs at its rims are stable. A pair
  is stable if the encoding of its two tokens' bytes is that pair. A sequence
  of tokens is the encoding of its bytes if all its neighbouring pairs are
  stable, which proves the tokens outside the window right.

Decoding concatenates the bytes of the tokens up the same kind of tree.

Vocabulary files map tokens to ranks, which are the ids; they are read on the
executors from a path that every machine has.

Edge cases. Null text: empty. Empty text: no ids. Very long texts and matches:
halved as above, nothing is cut off. Unpaired surrogates cannot occur in
Spark's strings. Ids that are null or outside the vocabulary: an error in
decoding. Repeated rows and null keys: each row by itself. Empty table: no
rows. Clashing columns ("ids", "decoded") are replaced.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a match that are merged directly.
LEAF = 24
#: Characters of a text whose matches are encoded in one go.
TEXT_LEAF = 1 << 16
#: Matches whose encoding a worker remembers, in each of two generations, and pairs.
REMEMBERED, PAIRS = 100_000, 1 << 15
#: Rows whose ids or bytes are held at once.
ROWS = 500
#: The rank of a pair that is no token.
NONE = 1 << 60


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Codec:
    """A vocabulary and what a worker remembers of its use."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        self.space = regex.compile(r"(?<=\S)\s").search
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.stable = lru_cache(PAIRS)(self._stable)
        if unmerged := sum(len(token) > 1 and len(self.pairs(token)) > 1 for token in ranks):
            raise ValueError(f"merges do not reach {unmerged} tokens of the vocabulary")

    def merged(self, data: bytes) -> list[int]:
        """The ids of a span. A token's own is itself, as merges reach every token."""
        whole = self.ranks.get(data)
        return [whole] if whole is not None else self.pairs(data)

    def pairs(self, data: bytes) -> list[int]:
        """The pair with the least rank is merged, the leftmost first, until none is left."""
        ranks, rank = self.ranks, self.ranks.get
        parts = [data[i : i + 1] for i in range(len(data))]
        pair = [rank(data[i : i + 2], NONE) for i in range(len(data) - 1)]
        while pair and (best := min(pair)) != NONE:
            at = pair.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pair[at]
            if at < len(pair):
                pair[at] = rank(parts[at] + parts[at + 1], NONE)
            if at:
                pair[at - 1] = rank(parts[at - 1] + parts[at], NONE)
        return [ranks[p] for p in parts]

    def _stable(self, a: int, b: int) -> bool:
        return self.merged(self.tokens[a] + self.tokens[b]) == [a, b]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The element of two neighbouring spans of one match."""
        if not left or not right or self.stable(left[-1], right[0]):
            return left + right
        width = 1
        while True:
            i, j = max(0, len(left) - width), min(len(right), width)
            middle = self.whole(b"".join(self.tokens[t] for t in left[i:] + right[:j]))
            if (i == 0 or self.stable(left[i - 1], middle[0])) and (j == len(right) or self.stable(middle[-1], right[j])):
                return left[:i] + middle + right[j:]
            width *= 2

    def whole(self, data: bytes) -> list[int]:
        """A window of a seam: direct up to some leaves, else by its own tree."""
        return self.merged(data) if len(data) <= 8 * LEAF else self.span(data)

    def span(self, data: bytes) -> list[int]:
        """Encodes a match: a tree of joins over leaves, from the bottom up."""
        if len(data) <= LEAF:
            return self.merged(data)
        level = [self.merged(data[i : i + LEAF]) for i in range(0, len(data), LEAF)]
        while len(level) > 1:
            level = [self.join(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0]

    def match(self, match: str) -> tuple[int, ...]:
        """The encoding of a match that is not known of late."""
        ids = self.older.get(match) or tuple(self.span(match.encode("utf-8")))
        if len(match) <= 4 * LEAF:
            if len(self.known) >= REMEMBERED:
                self.older, self.known = self.known, {}
            self.known[match] = ids
        return ids

    def leaf(self, text: str) -> list[int]:
        ids: list[int] = []
        for match in self.find(text):
            ids.extend(self.known.get(match) or self.match(match))
        return ids

    def encode(self, text: str) -> list[int]:
        """Halves at white space as near the middle as there is any."""
        if len(text) <= TEXT_LEAF:
            return self.leaf(text)
        seam = self.space(text, len(text) // 2)
        at = seam.start() if seam else next((i for i in range(len(text) // 2, 0, -1) if text[i].isspace() and not text[i - 1].isspace()), 0)
        if not 0 < at < len(text):
            return self.leaf(text)
        return self.encode(text[:at]) + self.encode(text[at:])

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= TEXT_LEAF:
            return b"".join(map(self.tokens.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


@lru_cache(2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(read_ranks(path), pattern)


def _added(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    at = batch.schema.get_field_index(name)
    arrays, names = list(batch.columns), list(batch.schema.names)
    if at >= 0:
        arrays[at] = values
    else:
        arrays, names = [*arrays, values], [*names, name]
    return pa.RecordBatch.from_arrays(arrays, names=names)


def _ids(own: Codec, texts: pa.Array) -> pa.Array:
    lists = [np.array(own.encode(t or ""), dtype=np.int32) for t in texts.to_pylist()]
    ends = np.zeros(len(lists) + 1, dtype=np.int32)
    np.cumsum([len(x) for x in lists], out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(lists)))


def _bytes(own: Codec, ids: pa.Array) -> pa.Array:
    flat, sizes = ids.flatten().to_numpy(), ids.value_lengths().fill_null(0).to_numpy()
    ends = np.concatenate([[0], np.cumsum(sizes)])
    return pa.array([own.decode(flat[a:b].tolist()) for a, b in zip(ends[:-1], ends[1:], strict=True)], type=pa.binary())


def _applied(df: DataFrame, path: str, pattern: str, steps: list[tuple[str, str, T.DataType, Callable[[Codec, pa.Array], pa.Array]]]) -> DataFrame:
    """``df`` with a column for each step (read, written, type, function), by one worker a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                for source, name, _, function in steps:
                    part = _added(part, name, function(own, part.column(source)))
                yield part

    df = df.drop(*[name for _, name, _, _ in steps])
    return df.mapInArrow(run, T.StructType([*df.schema, *[T.StructField(name, kind) for _, name, kind, _ in steps]]))


IDS, BYTES = T.ArrayType(T.IntegerType()), T.BinaryType()


def encode(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``df`` with ``ids``: array<int>."""
    return _applied(df, path, pattern, [(text, "ids", IDS, _ids)])


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """``df`` with ``decoded``: binary, the bytes of the ids."""
    return _applied(df, path, pattern, [(ids, "decoded", BYTES, _bytes)])


def round_trip(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``df`` with ``ids`` and, made of them, ``decoded``; both by one worker a task."""
    return _applied(df, path, pattern, [(text, "ids", IDS, _ids), ("ids", "decoded", BYTES, _bytes)])


def digests(df: DataFrame) -> list:
    """(n_tokens, ids_sha256, decoded_sha256) of ``ids`` and ``decoded``."""
    return [
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256")]
