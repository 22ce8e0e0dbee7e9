"""Word shingles of whole Arrow columns at once, and helpers for grouped Arrow rows.

Words are maximal runs of letters, digits and non-ASCII characters of the
lower-cased text. A shingle is a 64-bit hash of ``k`` words in a row; a text of
fewer words, but one at least, has one shingle of all its words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are hashed at once, which takes some 60 times as much
#: memory for a moment; a longer text is taken alone, and cut between words.
CHUNK = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_WORD = np.array([chr(i).isalnum() or i >= 128 for i in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """Finalises 64-bit hashes (the published splitmix64 step)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_spans(texts: pa.Array, lower: Callable[[pa.Array], pa.Array] = pc.utf8_lower) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, starts and ends of words in them, words of each text)."""
    texts = pc.fill_null(texts, "") if texts.null_count else texts
    texts = lower(texts)
    big = pa.types.is_large_string(texts.type)
    _, at, data = texts.buffers()
    at = np.frombuffer(at, dtype=np.int64 if big else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    if at[-1] == at[0]:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint8), none, none, np.zeros(len(texts), np.int64)
    data = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    inside = _WORD[data]
    before = np.concatenate([[False], inside[:-1]])
    before[at[:-1][at[:-1] < len(data)]] = False
    after = np.concatenate([inside[1:], [False]])
    after[at[1:][at[1:] > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return data, starts, ends, np.diff(np.searchsorted(starts, at))


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, the same wherever it stands."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(data) - 1), dtype=np.uint64)])
    return mix((total[ends] - total[starts]) * _powers(_INVERSE, len(data))[starts])


def pieces(text: str) -> Iterator[str]:
    """A long text in pieces of about CHUNK characters that end at white space."""
    start = 0
    while len(text) - start > CHUNK:
        stop = start + CHUNK
        while stop < len(text) and not text[stop] in " \n\t":
            stop += 1
        yield text[start:stop]
        start = stop
    yield text[start:]


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of words of each text)."""
    if len(texts) == 1 and len(text := texts[0].as_py() or "") > CHUNK:
        found = [hash_spans(*word_spans(pa.array([x]))[:3]) for x in pieces(text)]
        return np.concatenate(found), np.array([sum(map(len, found))])
    data, starts, ends, counts = word_spans(texts)
    return hash_spans(data, starts, ends), counts


def shingles(hashed: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, number of shingles of each text), in order, with repeats."""
    weights = mix(np.arange(1, k + 1, dtype=np.uint64) * _BASE) | np.uint64(1)
    first = np.concatenate([[0], np.cumsum(counts)])[:-1]
    n = np.where(counts >= k, counts - k + 1, (counts > 0).astype(counts.dtype))
    # places of the first words of shingles
    place = np.repeat(first - np.concatenate([[0], np.cumsum(n)])[:-1], n) + np.arange(n.sum())
    length = np.repeat(np.minimum(counts, k), n)
    out = np.zeros(len(place), np.uint64)
    for j in range(k):
        ok = length > j
        if ok.all():
            out += hashed[place + j] * weights[j]
        else:
            out[ok] += hashed[place[ok] + j] * weights[j]
    return mix(out), n


def chunks(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about CHUNK bytes."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > CHUNK:
            yield start, i
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield start, len(sizes)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], size: int = 4 << 20) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """From batches sorted by ``keys`` (longs), tables of whole groups, of about
    ``size`` bytes at most unless one group is larger, and the groups' bounds in them."""

    def bounds(table: pa.Table) -> np.ndarray:
        change = np.zeros(table.num_rows, bool)
        change[:1] = True
        for k in keys:
            v = table.column(k).to_numpy()
            change[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(change)

    held: list[pa.RecordBatch] = []
    weight = 0

    def parts() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, int(size / max(1, batch.nbytes) * batch.num_rows))
            for lo in range(0, batch.num_rows, step):
                yield batch.slice(lo, step)

    for part in parts():
        held.append(part)
        weight += part.nbytes
        if weight < size:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        starts = bounds(table)
        if len(starts) > 1:
            yield table.slice(0, starts[-1]), starts
            held = table.slice(starts[-1]).to_batches()
            weight = sum(b.nbytes for b in held)
        else:
            held, weight = table.to_batches(), 0  # one group so far: look again when as much has come
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, np.concatenate([bounds(table), [table.num_rows]])


def local_roots(linked: np.ndarray) -> np.ndarray:
    """For a symmetric boolean matrix, the least index that each can reach."""
    n = len(linked)
    root = np.arange(n)
    both = linked | np.eye(n, dtype=bool)
    while True:
        new = np.where(both, root[None, :], n).min(axis=1)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def edge_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For n nodes and links (a, b), the least that each can reach."""
    root = np.arange(n)
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        if (low == high).all():
            return root
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]


def binary_rows(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary values."""
    data = np.ascontiguousarray(rows)
    ends = np.arange(len(data) + 1, dtype=np.int32) * (data.shape[1] * data.itemsize)
    return pa.BinaryArray.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(ends), pa.py_buffer(data)])


def list_values(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values of all lists, ends with a leading 0) of a list column without nulls."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())])


def fixed_bytes(column: pa.ChunkedArray | pa.Array, dtype: type, width: int) -> np.ndarray:
    """A binary column of equal lengths as a matrix."""
    parts = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    out, item = [], width * np.dtype(dtype).itemsize
    for p in parts:
        if len(p):  # values of equal lengths lie one after the other
            start = int(np.frombuffer(p.buffers()[1], np.int32)[p.offset])
            out.append(np.frombuffer(p.buffers()[2], np.uint8)[start : start + len(p) * item].view(dtype).reshape(-1, width))
    return np.concatenate(out) if out else np.zeros((0, width), dtype)
