"""Quality classifier from a weak-label model.

Heuristic labellers look at a text's tokens and vote good, bad or abstain.
Expectation-maximisation over the counts of vote patterns (at most 3 to the
number of labellers, however many documents there are) estimates how accurate
each labeller is on good and on bad texts, and gives every pattern a posterior.
The posteriors train a logistic model on hashed token shapes: the texts of a sample
are counted where they lie, whole, and one task fits on the rows of BUCKETS
shares that this leaves; that linear scorer judges every text where it lies, also where
the labellers abstain. No hand-made label is read.

A token's shape is the token with runs of lower-case (and non-ASCII) letters as
``a``, of upper-case letters as ``A``, of digits as ``0`` and repeated signs
once; a token that is equal to the one before it has the shape ``=`` besides.

Edge cases. Null, empty and blank texts: score 0, rejected, all labellers
abstain. Null ids: as others. Repeated rows and ties: scored alike. Very long
texts: every token counts. Empty table: no rows. Other columns pass through;
clashing "score" and "keep" are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles as S
from .common import cut

#: Texts that the scorer is fitted on at most (those with the least hashes), hash
#: buckets of shapes (the fit holds 4 bytes of each for a text), the score below
#: which a text is rejected.
FIT_ROWS, BUCKETS, KEEP = 10_000, 1024, 0.5
ROUNDS, STEPS = 200, 400
LABELLERS = ("signs", "loud", "upper", "table", "stutter", "stops", "plain", "repeats", "words")
#: How often a bad and a good text get the votes bad, good, none: the start of
#: the estimation, which also smooths it. Labellers seldom vote against a class.
START = np.array([[0.3, 0.35, 0.35], [0.003, 0.6, 0.397]])

_KIND = np.arange(256, dtype=np.uint8)
for _low, _high, _code in ((ord("a"), ord("z"), ord("a")), (128, 255, ord("a")), (ord("A"), ord("Z"), ord("A")), (ord("0"), ord("9"), ord("0"))):
    _KIND[_low : _high + 1] = _code
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PLAIN_SIGNS = np.isin(np.arange(256), [ord(c) for c in "aA0.,;:!?'\"()-|"])


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, at, data = texts.buffers()
    at = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
    return data, at - at[0]


def _spans(inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends of runs that end where a text ends, runs of each text)."""
    before, after = np.concatenate([[False], inside[:-1]]), np.concatenate([inside[1:], [False]])
    before[at[:-1][at[:-1] < len(inside)]] = False
    after[at[1:][at[1:] > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.diff(np.searchsorted(starts, at))


def _repeated(hashed: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """How many of each text's hashes are seen before in it."""
    pairs = np.lexsort((hashed, owner))
    again = (hashed[pairs][1:] == hashed[pairs][:-1]) & (owner[pairs][1:] == owner[pairs][:-1])
    return np.bincount(owner[pairs][1:][again], minlength=n)


def inspect(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(votes: texts x labellers, buckets of all shapes, text of each of them, tokens of each text)."""
    data, at = _bytes(texts)
    n = len(at) - 1
    if not len(data):
        return np.full((n, len(LABELLERS)), -1, np.int8), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(n, np.int64)
    starts, ends, counts = _spans(~_SPACE[data], at)
    owner = np.repeat(np.arange(n), counts)
    kind = _KIND[data]
    # within a token, a byte of the same kind as the one before it goes
    kept = np.concatenate([[True], kind[1:] != kind[:-1]])
    kept[starts] = True
    place = np.concatenate([[0], np.cumsum(kept)])
    shape = S.hash_spans(kind[kept], place[starts], place[ends])
    token = S.hash_spans(data, starts, ends)
    same = np.concatenate([[False], (token[1:] == token[:-1]) & (owner[1:] == owner[:-1])])[: len(token)]
    def sums(x: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(x)])
        return total[ends] - total[starts]

    letters_low, letters_up, odd, mark = sums(kind == ord("a")), sums(kind == ord("A")), sums(~_PLAIN_SIGNS[kind] & ~_SPACE[data]), sums(data == ord("!"))
    size, last = ends - starts, data[ends - 1]
    stop = (last == ord(".")) | (last == ord(","))
    of = np.maximum(counts, 1)
    share = lambda x: np.bincount(owner, weights=x, minlength=n) / of
    bar = (size == 1) & (last == ord("|"))
    line_starts, line_ends, line_counts = _spans(data != 10, at)
    long = line_ends - line_starts > 20
    line_owner = np.repeat(np.arange(n), line_counts)[long]
    lines = np.bincount(line_owner, minlength=n)
    repeats = _repeated(S.hash_spans(data, line_starts, line_ends)[long], line_owner, n) / np.maximum(lines, 1)
    signs, loud, upper, table, stutter, stops = share(odd > 0), share(mark > 0), share((letters_up > 0) & (letters_low == 0)), share(bar), share(same), share(stop)
    plain, length = share((letters_low + letters_up + stop == size) & ~same), np.diff(at) / of
    some, never = counts > 0, np.zeros(n, bool)
    ballots = {  # the first five know one kind of junk each and are silent otherwise
        "signs": (never, signs > 0.2), "loud": (never, loud > 0.2), "upper": (never, upper > 0.5), "table": (never, table > 0.1), "stutter": (never, stutter > 0.2),
        "stops": ((counts >= 20) & (stops >= 0.02) & (stops <= 0.5), (counts >= 20) & (stops < 0.005)),
        "plain": (plain > 0.9, plain < 0.6), "repeats": ((lines >= 4) & (repeats < 0.1), (lines >= 4) & (repeats > 0.5)), "words": ((length >= 4) & (length <= 13), (length > 21) | (length < 3))}
    votes = np.stack([np.where(some & bad, 0, np.where(some & good, 1, -1)) for good, bad in (ballots[k] for k in LABELLERS)], axis=1).astype(np.int8)
    buckets = np.concatenate([shape % np.uint64(BUCKETS - 1), np.full(same.sum(), BUCKETS - 1, np.uint64)]).astype(np.int64)
    return votes, buckets, np.concatenate([owner, owner[same]]), counts


def fit_votes(patterns: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """EM over vote patterns (1 good, 0 bad, -1 abstains) with counts.

    Returns (posterior of good for each pattern, rates, prior). rates[c, j, v]:
    how often labeller j votes v (0 bad, 1 good, 2 abstains) on texts of class c
    (0 bad, 1 good)."""
    rates = np.repeat(START[:, None, :], patterns.shape[1], axis=1)
    cast = np.stack([patterns == 0, patterns == 1, patterns < 0], axis=2).astype(np.float64)
    prior, post = 0.8, np.full(len(patterns), 0.8)
    for _ in range(ROUNDS):
        log = np.einsum("pjv,cjv->pc", cast, np.log(rates)) + np.log([1 - prior, prior])
        new = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -500, 500)))
        share = np.stack([counts * (1 - new), counts * new])
        votes = np.einsum("cp,pjv->cjv", share, cast) + 5 * START[:, None, :]
        rates = votes / votes.sum(axis=2, keepdims=True)
        prior = float(np.clip((share[1].sum() + 4) / (counts.sum() + 5), 0.01, 0.99))
        moved, post = np.abs(new - post).max(initial=0), new
        if moved < 1e-9:
            break
    return post, rates, prior


def _matrix(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(shares of hashed shapes, one row for each text; votes)."""
    votes, buckets, owner, counts = inspect(texts)
    x = np.bincount(owner * BUCKETS + buckets, minlength=len(counts) * BUCKETS).reshape(len(counts), BUCKETS)
    return (x / np.maximum(counts, 1)[:, None]).astype(np.float32), votes


def fit_scorer(x: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, float]:
    """(weights, bias) of a logistic model of the posteriors from rows of shares, by Adagrad over all rows."""
    w, bias, sums, sum_b = np.zeros(BUCKETS, np.float32), 0.0, np.full(BUCKETS, 1e-8, np.float32), 1e-8
    for _ in range(STEPS):
        error = 1 / (1 + np.exp(-np.clip(x @ w + bias, -30, 30))) - good
        step = x.T @ error.astype(np.float32) / len(x) + 1e-5 * w
        sums += step**2
        sum_b += error.mean() ** 2
        w -= step / np.sqrt(sums)
        bias -= 0.3 * error.mean() / np.sqrt(sum_b)
    return w, float(bias)


def vote_table(docs: DataFrame) -> DataFrame:
    """(order, pattern) of each text that has tokens; order is a hash of the text, pattern the votes as a number to the base of 3."""
    powers = 3 ** np.arange(len(LABELLERS))

    @F.arrow_udf("long")
    def pattern(texts: pa.Array) -> pa.Array:
        out = [np.zeros(0, np.int64)]
        for a, b in S.chunks(texts):
            votes, _, _, counts = inspect(texts.slice(a, b - a))
            out.append(np.where(counts > 0, (votes + 1) @ powers, -1))
        return pa.array(np.concatenate(out), pa.int64())

    return cut(docs.select(F.xxhash64("text").alias("order"), pattern("text").alias("pattern")).where("pattern >= 0"))


def train(docs: DataFrame) -> tuple[np.ndarray, float] | None:
    """The scorer's (weights, bias); None without a text that has tokens."""
    votes = vote_table(docs)
    found = votes.groupBy("pattern").count().collect()  # 3 to the number of labellers at most
    if not found:
        return None
    ids = np.array([r["pattern"] for r in found])
    post, _, _ = fit_votes(ids[:, None] // 3 ** np.arange(len(LABELLERS)) % 3 - 1, np.array([r["count"] for r in found], np.float64))
    table = docs.sparkSession.createDataFrame([(int(p), float(y)) for p, y in zip(ids, post, strict=True)], "pattern long, good double")
    chosen = cut(votes.groupBy("order").agg(F.min("pattern").alias("pattern")).orderBy("order").limit(FIT_ROWS).join(F.broadcast(table), "pattern"))
    texts = docs.select("text", F.xxhash64("text").alias("order")).join(F.broadcast(chosen), "order").groupBy("order").agg(F.min("text").alias("text"), F.min("good").alias("good"))

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in S.chunks(batch.column("text")):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column("order"), part.column("good"), S.binary_rows(_matrix(part.column("text"))[0])], names=["order", "good", "x"])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("order", kind="stable")
        w, bias = fit_scorer(np.frombuffer(b"".join(rows["x"]), np.float32).reshape(len(rows), BUCKETS), rows["good"].to_numpy())
        return pd.DataFrame({"w": [w.tobytes()], "bias": [bias]})

    counted = texts.mapInArrow(shares, "order long, good double, x binary")
    model = counted.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(run, "w binary, bias double").first()
    return np.frombuffer(model["w"], np.float32), model["bias"]


def judge(docs: DataFrame, model: tuple[np.ndarray, float] | None = None) -> DataFrame:
    """``docs`` with score (share of good) and keep."""
    model = model or train(docs)
    own = docs.drop("score", "keep")
    if model is None:
        return own.withColumn("score", F.lit(0.0)).withColumn("keep", F.lit(False))
    w, bias = model

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        out = [np.zeros(0)]
        for a, b in S.chunks(texts):
            _, buckets, owner, counts = inspect(texts.slice(a, b - a))
            margin = np.bincount(owner, weights=w[buckets], minlength=len(counts)) / np.maximum(counts, 1) + bias
            out.append(np.where(counts > 0, 1 / (1 + np.exp(-np.clip(margin, -500, 500))), 0.0))
        return pa.array(np.concatenate(out))

    return own.withColumn("score", scored("text")).withColumn("keep", F.col("score") >= KEEP)
