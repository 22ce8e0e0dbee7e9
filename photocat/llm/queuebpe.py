"""BPE encoding and decoding with a priority queue of merges.

The vocabulary is a JSON file of the public tokenizers library: byte-level BPE,
whose symbols are strings over an alphabet with one printable character for each
byte. A text is split at the file's added tokens, then by the pattern, and each
match is encoded by itself: its bytes are symbols in a doubly linked list, and a
priority queue holds the ranks of the merges of neighbours, the leftmost first
among equals. What is taken from the queue is skipped if it is stale, that is if
the pair at its place has meanwhile become another; else two symbols become one,
and the merges with the new neighbours join the queue. A match of n bytes
takes n log n steps, however long it is. Decoding concatenates the strings that
the ids stand for and reads their bytes as UTF-8, each broken sequence as U+FFFD.

The file is read on the executors from a path that every machine has.

Edge cases. Null text: empty. Empty text: no ids. Very long texts: taken in
segments that end before white space, which no match crosses; nothing is cut
off. An added token in a text is one id, as in the library, and is its own
string when decoded. Unpaired surrogates cannot occur in Spark's strings. Null
ids and ids outside the vocabulary: an error in decoding. Repeated rows and null
keys: each row by itself. Empty table: no rows. Clashing columns ("ids",
"decoded") are replaced. Files with a normaliser, another pre-tokeniser or
options of the model that this does not know are refused.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import _added

#: The library's pattern of byte-level pre-tokenisation (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of a segment, matches whose ids a worker remembers (in each of two
#: generations) and their length at most, rows whose ids are held at once.
SEGMENT, REMEMBERED, LENGTH, ROWS = 1 << 16, 400_000, 96, 500


def alphabet() -> list[str]:
    """The character of each byte: printable ones stand for themselves, the others
    for the characters from 256 on, in their order."""
    own = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)}
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


class Vocabulary:
    """What a file defines, and what a worker remembers of its use."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        if spec.get("normalizer") or spec.get("post_processor") or model["type"] != "BPE" or any(
                model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            raise ValueError(f"{path}: only plain byte-level BPE is known")
        if before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or (spec.get("decoder") or {}).get("type") != "ByteLevel":
            raise ValueError(f"{path}: only byte-level pre-tokenisation by the library's pattern is known")
        ids, chars = model["vocab"], alphabet()
        byte_of = {c: b for b, c in enumerate(chars)}
        self.width = max(ids.values()) + 1
        self.symbols = [ids[c] for c in chars]
        #: The rank of the merge of two symbols, and the symbol that each merge makes.
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[ids[a] * self.width + ids[b]] = rank
            self.made.append(ids[a + b])
        self.strings = {i: bytes(byte_of[c] for c in s) if all(c in byte_of for c in s) else s.encode() for s, i in ids.items()}
        self.added: dict[str, int] = {}
        for token in spec.get("added_tokens") or []:
            if token.get("single_word") or token.get("lstrip") or token.get("rstrip"):
                raise ValueError(f"{path}: added tokens that take in their surroundings are not known")
            self.added[token["content"]] = token["id"]
            self.strings[token["id"]] = bytes(byte_of[c] for c in token["content"]) if all(c in byte_of for c in token["content"]) else token["content"].encode()
        longest_first = sorted(self.added, key=len, reverse=True)
        self.split = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")").split if self.added else lambda text: [text]
        self.find = regex.compile(PATTERN).findall
        self.space = regex.compile(r"(?<=\S)\s").search
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def merged(self, data: bytes) -> list[int]:
        """The symbols of a match after all merges."""
        symbols, rank_of, made, width = list(map(self.symbols.__getitem__, data)), self.rank.get, self.made, self.width
        n = len(symbols)
        following, previous = [*range(1, n), -1], [-1, *range(n - 1)]
        # the rank of the merge of each symbol with the one that follows it, -1 for none
        ranks = [rank_of(a * width + b, -1) for a, b in zip(symbols, symbols[1:])]
        ranks.append(-1)
        queue = [rank << 32 | at for at, rank in enumerate(ranks) if rank >= 0]
        heapify(queue)
        while queue:
            top = heappop(queue)
            at, rank = top & 0xFFFFFFFF, top >> 32
            now = ranks[at]
            if now != rank and (now < 0 or made[now] != made[rank]):
                continue
            new, other = made[rank], following[at]
            symbols[at], symbols[other], ranks[other] = new, -1, -1
            following[at] = after = following[other]
            now = -1
            if after >= 0:
                previous[after] = at
                if (now := rank_of(new * width + symbols[after], -1)) >= 0:
                    heappush(queue, now << 32 | at)
            ranks[at] = now
            if (before := previous[at]) >= 0:
                ranks[before] = now = rank_of(symbols[before] * width + new, -1)
                if now >= 0:
                    heappush(queue, now << 32 | before)
        return [s for s in symbols if s >= 0]

    def match(self, match: str) -> tuple[int, ...]:
        """The ids of a match that is not known of late."""
        ids = self.older.get(match) or tuple(self.merged(match.encode()))
        if len(match) <= LENGTH:
            if len(self.known) >= REMEMBERED:
                self.older, self.known = self.known, {}
            self.known[match] = ids
        return ids

    def segments(self, text: str) -> Iterator[str]:
        start = 0
        while len(text) - start > SEGMENT and (seam := self.space(text, start + SEGMENT)):
            yield text[start : seam.start()]
            start = seam.start()
        yield text[start:] if start else text

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for i, part in enumerate(self.split(text)):
            if i % 2:
                ids.append(self.added[part])
                continue
            for segment in self.segments(part):
                for match in self.find(segment):
                    ids.extend(self.known.get(match) or self.match(match))
        return ids

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _ids(own: Vocabulary, texts: pa.Array) -> pa.Array:
    lists = [np.array(own.encode(t or ""), np.int32) for t in texts.to_pylist()]
    ends = np.cumsum([0, *map(len, lists)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(lists)))


def _texts(own: Vocabulary, ids: pa.Array) -> pa.Array:
    flat, sizes = ids.flatten().to_numpy(zero_copy_only=False), ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    return pa.array([own.decode(flat[a:b].tolist()) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.string())


_STEPS = {"ids": (_ids, T.ArrayType(T.IntegerType())), "decoded": (_texts, T.StringType())}


def _applied(df: DataFrame, path: str, steps: list[tuple[str, str]]) -> DataFrame:
    """``df`` with a column for each step (read, written), by one worker a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                for read, written in steps:
                    part = _added(part, written, _STEPS[written][0](own, part.column(read)))
                yield part

    # the first step may read a column that a later one would replace
    own = df.drop(*[w for r, w in steps if w not in {read for read, _ in steps[:1]}])
    return own.mapInArrow(run, T.StructType([*own.schema, *[T.StructField(w, _STEPS[w][1]) for _, w in steps]]))


def encode(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``df`` with ``ids``: array<int>."""
    return _applied(df, path, [(text, "ids")])


def decode(df: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``df`` with ``decoded``: string."""
    return _applied(df, path, [(ids, "decoded")])


def round_trip(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``df`` with ``ids`` and, made of them, ``decoded``."""
    return _applied(df, path, [(text, "ids"), ("ids", "decoded")])


def digests() -> list[Column]:
    """(n_tokens, ids_sha256, decoded_sha256) of ``ids`` and ``decoded``."""
    return [
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")]
