"""Resampling, hard negatives and the queue of merges against brute force and the public library."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from photocat.llm import common, multiindex, queries, queuebpe, resample
from photocat.llm import shingles as S

FILE = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# Queue of merges -----------------------------------------------------------------


@pytest.fixture(scope="module")
def own():
    return queuebpe.vocabulary(FILE)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.text(max_size=300), st.text(alphabet="abcth e'\n<|endofx>", max_size=600), st.lists(st.sampled_from(["<|endoftext|>", " the", "é", "\n\n ", "12"])).map("".join)))
def test_queue_encodes_as_the_library(own, library, text):
    ids = own.encode(text)
    assert ids == library.encode(text, add_special_tokens=False).ids
    assert own.decode(ids) == library.decode(ids, skip_special_tokens=False) == text


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 50_256), max_size=30))
def test_queue_decodes_any_ids_as_the_library(own, library, ids):
    assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_queue_takes_every_character_and_long_matches(own, library):
    text = " ".join(f"a{chr(c)}b {chr(c)}1" for c in range(1, 0x3000))
    assert own.encode(text) == library.encode(text, add_special_tokens=False).ids
    for text in ("the" * 5000, "ab " * 60_000, " " * 3000 + "x", "é" * 4000, "no space<|endoftext|>" * 90, "!?" * 900):
        assert own.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_queue_remembers_in_generations(library, monkeypatch):
    monkeypatch.setattr(queuebpe, "REMEMBERED", 5)
    fresh = queuebpe.Vocabulary(FILE)
    text = " ".join(f"wort{i % 23} the" for i in range(300))
    assert fresh.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_queue_table(spark, library):
    texts = [(1, "Hello, wörld!\n\n x"), (2, None), (3, ""), (4, "<|endoftext|>a"), (4, "<|endoftext|>a"), (None, "null id")]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("ids", F.lit(1)).withColumn("decoded", F.lit("x"))
    rows = queuebpe.round_trip(df, FILE).select("doc_id", "text", "ids", "decoded", *queuebpe.digests()).collect()
    assert len(rows) == 6
    for r in rows:
        want = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == want and r["decoded"] == (r["text"] or "") and r["n_tokens"] == len(want)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    assert queuebpe.round_trip(df.limit(0), FILE).count() == 0
    again = queuebpe.decode(queuebpe.encode(df.drop("decoded"), FILE), FILE).collect()
    assert [r["decoded"] for r in again] == [r["text"] or "" for r in again]
    with pytest.raises(Exception, match="KeyError"):
        queuebpe.decode(spark.createDataFrame([([99_999_999],)], "ids array<int>"), FILE).collect()


def test_queue_refuses_other_files(tmp_path):
    import json

    with open(FILE, encoding="utf-8") as file:
        spec = json.load(file)
    for part, value in (("normalizer", {"type": "Lowercase"}), ("pre_tokenizer", {"type": "Whitespace"}), ("decoder", None)):
        path = tmp_path / f"{part}.json"
        path.write_text(json.dumps(spec | {part: value}))
        with pytest.raises(ValueError, match="known"):
            queuebpe.Vocabulary(str(path))


# Importance resampling -----------------------------------------------------------


def features_of(text, low, high, buckets):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return [zlib.crc32(" ".join(words[i : i + k]).encode()) % buckets for k in range(low, high + 1) for i in range(len(words) - k + 1)], len(words)


def resampled(docs, target, percent, min_words, runs=(1, 1), buckets=10_000):
    """rows (id, n_features, weight, score, rank) by plain Python, ids distinct."""
    found = {i: features_of(t, *runs, buckets) for i, t in docs}
    s, t = np.zeros(buckets), np.zeros(buckets)
    for f, _ in found.values():
        for b in f:
            s[b] += 1
    for text in target:
        for b in features_of(text, *runs, buckets)[0]:
            t[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.sum() + buckets) / ((s[b] + 1) * (t.sum() + buckets)))) for b in range(buckets)]
    rows = []
    for i, (f, n) in found.items():
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    able = sorted((r for r in rows if r[4] >= min_words), key=lambda r: (-r[3], 2**63 if r[0] is None else r[0]))
    rank = {r[0]: k + 1 for k, r in enumerate(able[: len(able) * percent // 100])}
    return {r[:4] + (rank.get(r[0]),) for r in rows}


def test_crc32_of_spans():
    rng = random.Random(2)
    spans = [bytes(rng.randrange(256) for _ in range(rng.choice([0, 1, 2, 5, 9, 63, 64, 65, 200]))) for _ in range(300)]
    ends = np.cumsum([len(s) for s in spans])
    assert resample.crc32_spans(np.frombuffer(b"".join(spans), np.uint8), ends - [len(s) for s in spans], ends).tolist() == [zlib.crc32(s) for s in spans]


@pytest.mark.parametrize("runs", [(1, 1), (1, 2), (2, 3), (1, 4)])
def test_features_of_texts_and_pieces(runs, monkeypatch):
    monkeypatch.setattr(S, "CHUNK", 200)
    rng = random.Random(3)
    texts = ["".join(rng.choice("abC É1\n-ßx日  ") for _ in range(rng.choice([0, 5, 50, 150, 3000]))) for _ in range(60)] + [None, "", "x" * 2000]
    got, words = [[] for _ in texts], np.zeros(len(texts), int)
    for bucket, owner, counts in resample.features(pa.array(texts), runs, 1000):
        words += counts
        for b, o in zip(bucket, owner, strict=True):
            got[o].append(int(b))
    for i, text in enumerate(texts):
        f, n = features_of(text, *runs, 1000)
        assert sorted(got[i]) == sorted(f) and words[i] == n


def test_resampling_is_that_of_plain_python(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    got = queries.op11_importance_resample(spark, sf_dir)
    assert got.dtypes == [(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")]
    assert set(map(tuple, got.collect())) == resampled(docs, target, 10, 20)


def test_resampling_of_odd_tables(spark):
    rng = random.Random(5)
    words = ["alpha", "BETA", "gamma", "d1", "épée"]
    texts = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 4, 30])))) for i in range(150)] + [(900, None), (None, "alpha beta gamma beta"), (901, "x, " * 70_000)]
    target = ["beta beta", None, "épée d1"]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts], DOCS).withColumn("row", F.lit("x")).withColumn("score", F.lit("y"))
    wanted = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    for percent, least, runs in ((50, 3, (1, 2)), (0, 1, (1, 1))):
        got = resample.resample(df, wanted, percent=percent, min_words=least, runs=runs, buckets=500).collect()
        assert {tuple(r) for r in got} == resampled(texts, target, percent, least, runs, 500) and len(got) == len(texts)
    # no target, no documents, none with enough words
    assert {r["rank"] for r in resample.resample(df, wanted.limit(0), min_words=10**6).collect()} == {None}
    assert resample.resample(df.limit(0), wanted).count() == 0
    # repeated rows: each is drawn by itself
    twice = spark.createDataFrame([(7, "same words here", "en", "s", 1)] * 40, DOCS)
    got = resample.resample(twice, wanted, percent=25, min_words=2).collect()
    assert len(got) == 40 and sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 11)) and len({r["score"] for r in got}) == 1


@pytest.mark.parametrize("distinct", [1, 4000])
def test_quickselect_finds_every_place(spark, monkeypatch, distinct):
    monkeypatch.setattr(resample, "PIVOTS", 5)
    rng = random.Random(distinct)
    keys = [(rng.randrange(-distinct, distinct), rng.randrange(3), r) for r in range(1500)]
    table = common.cut(spark.createDataFrame(keys, "s long, i long, r long").repartition(5))
    for k in (1, 700, 1500):
        assert tuple(resample.kth(table, k)) == sorted(keys)[k - 1]


# Hard negatives ------------------------------------------------------------------


def mined(rows, is_anchor, positives=5, negatives=3, low=50, high=95, scale=256):
    """The contract in plain Python over (id, v, label), ids may repeat."""
    own = []
    for n, (i, v, label) in enumerate(rows):
        if label is None or v is None or not len(v) or any(x is None or not math.isfinite(x) for x in v):
            continue
        own.append((-(2**63) if i is None else i, n, label, [math.floor(scale * x) for x in v]))
    out = []
    for a in own:
        if a[0] == -(2**63) or not is_anchor(a[0]):
            continue
        score = [(-sum(x * y for x, y in zip(a[3], b[3])), b[0], b[1], b[2]) for b in own if b[1] != a[1] and len(b[3]) == len(a[3])]
        shown = lambda i: None if i == -(2**63) else i
        for p in sorted(s for s in score if s[3] == a[2])[:positives]:
            window = sorted(s for s in score if s[3] != a[2] and low * -p[0] <= 100 * -s[0] <= high * -p[0])[:negatives]
            out += [(a[0], shown(p[1]), r + 1, shown(s[1]), -p[0], -s[0]) for r, s in enumerate(window)]
    return sorted(out, key=repr)


VECTORS = "vec_id long, embedding array<double>, label int"
NAMES = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def test_mining_is_that_of_plain_python(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = queries.op12_multi_index(spark, sf_dir).select(*NAMES)
    assert [t for _, t in got.dtypes] == ["bigint", "bigint", "int", "bigint", "bigint", "bigint"]
    assert sorted(map(tuple, got.collect()), key=repr) == mined(rows, lambda i: i % 50 == 0)


@pytest.mark.parametrize("kind", ["random", "copies"])
def test_mining_over_many_cells(spark, monkeypatch, kind):
    for name, value in (("CELL", 20), ("PART", 40), ("BLOCK", 20), ("FIRST", 2), ("HELD", 500), ("SAMPLE", 200)):
        monkeypatch.setattr(multiindex, name, value)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(8, 6))
    x = rng.normal(size=(400, 6)) if kind == "random" else centres[rng.integers(0, 8, 400)] + 0.05 * rng.normal(size=(400, 6))
    if kind == "copies":
        x[:150] = x[0]
    rows = [(int(i), v.tolist(), int(i * 7 % 5)) for i, v in enumerate(x)]
    rows += [(5, x[9].tolist(), 2), (5, x[9].tolist(), 2), (None, x[8].tolist(), 1), (601, None, 1), (602, x[3].tolist(), None), (603, [1.0, float("nan")] * 3, 1), (604, [0.0] * 6, 1), (605, [], 1), (606, [1.0, None] * 3, 1)]
    rows += [(700 + i, [0.25 * i], i % 2) for i in range(12)] + [(720 + i, [float(i % 3), 1.0, -0.5], i % 3) for i in range(30)]
    df = spark.createDataFrame(rows, VECTORS).withColumn("row", F.lit("x")).withColumn("a", F.lit(1)).withColumn("id", F.lit("y"))
    got = multiindex.hard_negatives(df.repartition(3), F.col("id") % 10 == 0, scale=16.0)
    assert sorted(map(tuple, got.select(*NAMES).collect()), key=repr) == mined(rows, lambda i: i % 10 == 0, scale=16)
    assert multiindex.hard_negatives(df.limit(0), F.col("id") % 10 == 0).count() == 0


def test_sequence_is_in_order_and_whole():
    rng = np.random.default_rng(1)
    first, second = rng.normal(size=9), rng.normal(size=13)
    got = list(multiindex.sequence(first, second))
    assert [g[0] for g in got] == sorted((float(x + y) for x in first for y in second), reverse=True)
    assert len({g[1:] for g in got}) == 9 * 13 and all(g[0] == first[g[1]] + second[g[2]] for g in got)


def test_bounds_hold_and_rule_cells_out():
    rng = np.random.default_rng(2)
    centres = 40 * rng.normal(size=(12, 8))
    x = np.round(centres[rng.integers(0, 12, 2000)] + rng.normal(size=(2000, 8)))
    words = (multiindex.half_means(x[:, :4], 12, 1), multiindex.half_means(x[:, 4:], 12, 2))
    codes = [multiindex.nearest_codeword(x[:, s], w) for s, w in ((slice(0, 4), words[0]), (slice(4, 8), words[1]))]
    books = multiindex.Codebooks(words, tuple(np.array([d[c == k].max(initial=0) for k in range(len(w))]) for (c, d), w in zip(codes, words, strict=True)))
    first, second = books.bounds(x[:50])
    bound = first[:, codes[0][0]] + second[:, codes[1][0]]
    score = x[:50] @ x.T
    assert (bound >= score).all()
    assert (bound >= np.sort(score, axis=1)[:, -5, None]).mean() < 0.5


def test_large_products_are_exact():
    q, x = np.array([[float(2**25 - 1)] * 300]), np.array([[float(2**25 - 1)] * 300, [float(1 - 2**25)] * 300])
    assert multiindex.products(q, x).tolist() == [[300 * (2**25 - 1) ** 2, -300 * (2**25 - 1) ** 2]]
