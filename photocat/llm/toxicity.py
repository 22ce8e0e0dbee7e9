"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word is the bag of its hashed byte n-grams, with marks at its ends, and of
itself; its vector is the mean of theirs, so an unseen misspelling shares much of
a known word's vector. The n-grams are short, as a letter that changes spoils
every n-gram that it is in. A window of words is the mean of its words' vectors
and goes through a linear softmax; a text is as toxic as its most toxic window,
so a few words are not diluted by a long text. Vectors and softmax are trained
jointly in numpy on a bounded sample of labelled rows, by one task; every whole
text is then scored where it lies, without a shuffle.

Edge cases. Null, empty and wordless texts: the score of no evidence, that of
the intercept alone. One class only among the labelled rows: its share,
smoothed, scores all; no labelled row: UNKNOWN does. A text with more bytes than
the sample may have: not learned from, unless all are, then a piece of one is. Null label: not learned from; clashing labels of an id:
toxic, if one says so. Null ids: held in, as their hash is null, and not learned
from; a repeated id repeats its row. Ties have no bearing. Very
long texts: all windows count. Empty table: no rows. Other columns: ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shingles as S
from .common import cut, piece, within_bytes

#: Rows that a model is fitted on at most, those with the least hash of the id,
#: and the bytes of their texts.
TRAIN_ROWS, TRAIN_BYTES = 10_000, 64 << 20
#: n-gram lengths in bytes, hash buckets, dimensions and words of a window.
GRAMS, BUCKETS, DIMENSIONS, WINDOW = (2, 3), 1 << 17, 8, 8
EPOCHS, BATCH, RATE, SEED = 5, 64, 0.3, 7
#: The score from which a text is predicted toxic, and that of all where no label is known.
TOXIC, UNKNOWN = 0.3, 0.25


def subwords(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all words, in order; number of them for each word)."""
    size = ends - starts
    first = np.concatenate([[0], np.cumsum(size + 2)])
    marked = np.full(first[-1], ord("<"), np.uint64)
    place = np.repeat(first[:-1] + 1, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    marked[place] = data[np.repeat(starts, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]
    marked[first[1:] - 1] = ord(">")
    owner = np.repeat(np.arange(len(size)), size + 2)
    found, owners = [S.hash_spans(data, starts, ends)], [np.arange(len(size))]
    for n in GRAMS:
        weights = S.mix(np.arange(1, n + 1, dtype=np.uint64) + np.uint64(n << 8)) | np.uint64(1)
        at = np.flatnonzero(owner[: max(0, len(owner) - n + 1)] == owner[n - 1 :])
        h = np.zeros(len(at), np.uint64)
        for j in range(n):
            h += (marked[at + j] + np.uint64(1)) * weights[j]
        found.append(S.mix(h))
        owners.append(owner[at])
    owners = np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return (np.concatenate(found)[order] % np.uint64(BUCKETS)).astype(np.int32), np.bincount(owners, minlength=len(size))


def distinct_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(buckets, buckets per distinct word, distinct word of each word, words of
    each text). Texts are read in chunks; what is held is 12 bytes for each word."""
    known, place = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # hashes in order, and which word each is
    found, grams, sizes, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a, b in S.chunks(texts):
        data, starts, ends, n = S.word_spans(texts.slice(a, b - a))
        hashed = S.hash_spans(data, starts, ends)
        own, first = np.unique(hashed, return_index=True)
        at = np.searchsorted(known, own)
        new = np.append(known, 0)[at] != own if len(known) else np.ones(len(own), bool)
        new |= at == len(known)
        of_new, size = subwords(data, starts[first[new]], ends[first[new]])
        known, place = np.insert(known, at[new], own[new]), np.insert(place, at[new], np.arange(len(known), len(known) + new.sum()))
        for x, y in ((found, hashed), (grams, of_new), (sizes, size), (counts, n)):
            x.append(y)
    words = np.concatenate(found)
    which = place[np.searchsorted(known, words)] if len(words) else np.zeros(0, np.int32)
    return np.concatenate(grams), np.concatenate(sizes), which, np.concatenate(counts)


def windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word of each window, windows of each text): windows of WINDOW
    words, the last of a text may have fewer."""
    n = -(-counts // WINDOW)
    first = np.cumsum(counts) - counts
    return np.repeat(first, n) + WINDOW * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)), n


def means(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Means of consecutive groups, none of which is empty."""
    return np.add.reduceat(values, np.cumsum(sizes) - sizes) / sizes if len(sizes) else np.zeros(0)


def scores(texts: pa.Array, weight: np.ndarray, bias: float) -> np.ndarray:
    """weight: the softmax's margin for each bucket."""
    buckets, sizes, which, counts = distinct_words(texts)
    margin = np.full(len(counts), bias)
    if len(which):
        word = means(weight[buckets].astype(np.float64), sizes)[which]
        first, n = windows(counts)
        window = means(word, np.diff(np.append(first, len(word))))
        some = n > 0
        margin[some] += np.maximum.reduceat(window, (np.cumsum(n) - n)[some])
    return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


def fit(texts: pa.Array, labels: np.ndarray) -> tuple[np.ndarray, float]:
    """(margin of each bucket, bias): vectors E and softmax rows U, V, jointly by
    Adagrad; the margin of a bucket is E (U - V)."""
    rng = np.random.default_rng(SEED)
    prior = (labels.sum() + 0.5) / (len(labels) + 1)
    buckets, sizes, which, counts = distinct_words(texts)
    if labels.min(initial=1) == labels.max(initial=0) or not len(which):
        return np.zeros(BUCKETS, np.float32), float(np.log(prior / (1 - prior)))
    at = np.concatenate([[0], np.cumsum(sizes)])
    start = np.cumsum(counts) - counts
    vectors = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    softmax = np.stack([np.full(DIMENSIONS, -0.3), np.full(DIMENSIONS, 0.3)])
    bias = float(np.log(prior / (1 - prior)))
    sums, sums_s, sum_b = np.full((BUCKETS, DIMENSIONS), 1e-8, np.float32), np.full((2, DIMENSIONS), 1e-4), 1e-2
    docs = np.flatnonzero(counts)
    for _ in range(EPOCHS):
        order = rng.permutation(docs)
        for lo in range(0, len(order), BATCH):
            own = order[lo : lo + BATCH]
            word = which[np.concatenate([np.arange(start[i], start[i] + counts[i]) for i in own])]
            seen, index = np.unique(word, return_inverse=True)
            gram = np.repeat(at[seen] - (np.cumsum(sizes[seen]) - sizes[seen]), sizes[seen]) + np.arange(sizes[seen].sum())
            margin = vectors @ (softmax[1] - softmax[0]).astype(np.float32)
            value = means(margin[buckets[gram]].astype(np.float64), sizes[seen])[index]
            first, n = windows(counts[own])
            length = np.diff(np.append(first, len(value)))
            window = means(value, length)
            pick = np.array([a + np.argmax(window[a : a + k]) for a, k in zip(np.cumsum(n) - n, n, strict=True)])
            error = 1 / (1 + np.exp(-np.clip(window[pick] + bias, -50, 50))) - labels[own]
            size = length[pick]
            chosen = word[np.repeat(first[pick] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
            many = sizes[chosen]
            used = buckets[np.repeat(at[chosen] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
            share = np.repeat(np.repeat(error / size, size) / many, many)
            hit, inverse = np.unique(used, return_inverse=True)
            slope = np.bincount(inverse, weights=share)
            step = slope[:, None] * (softmax[1] - softmax[0])[None, :]
            step_s = np.outer([-1, 1], (slope[:, None] * vectors[hit]).sum(axis=0))
            sums[hit] += (step**2).astype(np.float32)
            vectors[hit] -= (RATE * step / np.sqrt(sums[hit])).astype(np.float32)
            sums_s += step_s**2
            softmax -= 0.1 * step_s / np.sqrt(sums_s)
            sum_b += error.sum() ** 2
            bias -= 0.1 * error.sum() / np.sqrt(sum_b)
    return (vectors @ (softmax[1] - softmax[0])).astype(np.float32), bias


def train(labelled: DataFrame) -> tuple[np.ndarray, float]:
    """A model from (text, label, order, h): one task, TRAIN_ROWS rows at most. What
    returns to the driver is the model, BUCKETS numbers."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["order", "h"], kind="stable")
        weight, bias = fit(pa.array(rows["text"].fillna(""), pa.string()), rows["label"].to_numpy().astype(np.float64))
        return pd.DataFrame({"weight": [weight.tobytes()], "bias": [bias]})

    found = labelled.select(piece(F.col("text"), TRAIN_BYTES).alias("text"), "label", "order", "h", F.lit(0).alias("all")).groupBy("all").applyInPandas(run, "weight binary, bias double").first()
    if found is None:
        return np.zeros(BUCKETS, np.float32), float(np.log(UNKNOWN / (1 - UNKNOWN)))
    return np.frombuffer(found["weight"], np.float32), found["bias"]


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """``docs`` with ``score``."""
    weight, bias = model
    shared = docs.sparkSession.sparkContext.broadcast(weight)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for a, b in S.chunks(texts):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores(part.column("text"), shared.value, bias))], names=[*part.schema.names, "score"])

    own = docs.drop("score")
    return own.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in own.dtypes) + ", score double")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted), a row for each document. Labels of
    held-out rows are not read."""
    known = labels.where("toxic is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("label"))
    known = cut(known.withColumn("order", F.xxhash64("doc_id")).orderBy("order", "doc_id").limit(TRAIN_ROWS))
    own = docs.select("doc_id", "text", F.xxhash64("text").alias("h"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"))
    sample = own.drop("text").join(F.broadcast(known), "doc_id").distinct().orderBy("order", "doc_id", "h").limit(TRAIN_ROWS)
    sample = cut(within_bytes(sample, ["order", "doc_id", "h"], "size", TRAIN_BYTES).drop("size"))
    rows = own.join(F.broadcast(sample), ["doc_id", "h"]).dropDuplicates(["doc_id", "h"])
    scored = score(docs.select("doc_id", "text"), train(rows)).drop("text")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= TOXIC, 1).otherwise(0).cast("int").alias("predicted"))
