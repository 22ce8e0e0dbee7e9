"""Near-duplicates, joins, search and learned scores against brute force."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from photocat.llm import chosenpath, common, graphann, pivots, toxicity, weaklabel
from photocat.llm import shingles as S

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b + c for a in ("ka", "lo", "mi", "ser", "tu") for b in ("ra", "ne", "bo", "vi") for c in ("n", "l", "st", "d", "m")]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def roots(n, links):
    root = list(range(n))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(400 + i, 401 + i) for i in range(60)]
    got = {r["id"]: r["root"] for r in common.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = roots(500, links)
    assert got == {i: want[i] for e in links if e[0] != e[1] for i in e}


def test_spread_rank(spark):
    df = common.cut(spark.range(3000).select("id", (F.col("id") % 3).alias("k"), F.xxhash64("id").alias("h"), (F.col("id") % 5).alias("w")))
    rows = common.spread_rank(df, ["k"], "h", ["id"], "w").collect()
    for k in range(3):
        own = sorted((r for r in rows if r["k"] == k), key=lambda r: (r["h"], r["id"]))
        assert [r["rank"] for r in own] == list(range(1000))
        assert [r["before"] for r in own] == [sum(x["w"] for x in own[:i]) for i in range(1000)]


def test_shingles_are_words_in_a_row():
    texts = pa.array(["One two THREE four five six", "one, two; three-four! five six", "", None, "ab cd", "x"])
    hashed, counts = S.words(texts)
    values, n = S.shingles(hashed, counts, 5)
    assert counts.tolist() == [6, 6, 0, 0, 2, 1] and n.tolist() == [2, 2, 0, 0, 1, 1]
    assert values[:2].tolist() == values[2:4].tolist() and len(set(values.tolist())) == 4


def jaccard(texts, k=5):
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    return [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]


def test_jaccard_join(spark):
    rng = random.Random(1)
    texts = [prose(rng, rng.choice([3, 40, 120, 300])) for _ in range(150)]
    for i in range(40):  # near copies, at and around the threshold
        w = texts[i].split()
        for _ in range(rng.choice([1, 1, 2, 5])):
            w[rng.randrange(len(w))] = "zzz"
        texts.append(" ".join(w))
    base = prose(rng, 200).split()
    for i in range(120):  # one large group of near copies
        w = list(base)
        w[rng.randrange(200)] = f"edit{i}"
        texts.append(" ".join(w))
    shared = prose(rng, 60)
    texts += [shared + " " + prose(rng, 150) for _ in range(80)] + [texts[0]] * 30 + ["", None, "a", "a"]
    rows = list(enumerate(texts))
    got = {r["doc_id"]: r for r in chosenpath.jaccard_join(docs(spark, rows)).collect()}
    links = jaccard(texts)
    want = roots(len(texts), links)
    n = [0] * len(texts)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    assert [got[i]["n_links"] for i in range(len(texts))] == n
    assert [got[i]["group_id"] for i in range(len(texts))] == want
    assert [got[i]["kept"] for i in range(len(texts))] == [want[i] == i for i in range(len(texts))]
    kept = {r["doc_id"] for r in chosenpath.keep_one(docs(spark, rows)).collect()}
    assert kept == {i for i in range(len(texts)) if want[i] == i}


def test_jaccard_join_on_many_partitions_takes_few_tasks(spark, monkeypatch):
    rng = random.Random(4)
    base, shared = prose(rng, 120).split(), prose(rng, 60)
    texts = [prose(rng, 60) for _ in range(40)] + [shared + " " + prose(rng, 60) for _ in range(20)] + [" ".join(base)] * 30
    for i in range(30):  # near copies
        w = list(base)
        w[rng.randrange(120)] = f"edit{i}"
        texts.append(" ".join(w))
    monkeypatch.setattr(chosenpath, "SMALL", 16)  # so that buckets are split
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "61")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.sparkContext.setJobGroup("few_tasks", "")
        got = {r["doc_id"]: r for r in chosenpath.jaccard_join(docs(spark, list(enumerate(texts)))).collect()}
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    links = jaccard(texts)
    assert [got[i]["n_links"] for i in range(len(texts))] == [sum(i in e for e in links) for i in range(len(texts))]
    assert [got[i]["group_id"] for i in range(len(texts))] == roots(len(texts), links)
    track = spark.sparkContext.statusTracker()
    jobs = [track.getJobInfo(j) for j in track.getJobIdsForGroup("few_tasks")]
    stages = [x for x in (track.getStageInfo(s) for j in jobs if j for s in j.stageIds) if x]
    assert len(stages) > 40 and sum(x.numTasks for x in stages) < 1400


def test_jaccard_join_edges(spark):
    got = chosenpath.jaccard_join(docs(spark, [(None, "one two three four five six"), (4, "One two three four five six!"), (4, "One two three four five six!"), (5, None)])).collect()
    assert sorted((r["doc_id"] is None, r["n_links"]) for r in got) == [(False, 0), (False, 2), (False, 2), (True, 2)]
    assert chosenpath.jaccard_join(docs(spark, []).limit(0)).count() == 0


def vectors(n=900, d=64, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    for i in range(0, 200, 2):  # pairs around the threshold
        u = rng.normal(size=d)
        x[i + 1] = x[i] / np.linalg.norm(x[i]) + u / np.linalg.norm(u) * rng.uniform(0.3, 0.5)
    x[300:420] = x[300] + 0.02 * rng.normal(size=(120, d))
    x[500:540] = x[500]
    return x.astype(np.float32)


def table(spark, x):
    rows = [(i, [float(y) for y in v], 0) for i, v in enumerate(x)]
    odd = [(5000, None, 0), (5001, [0.0] * 64, 0), (5002, [float("nan")] + [1.0] * 63, 0), (5003, [float("inf")] * 64, 0), (5004, [None] + [1.0] * 63, 0), (5005, [1.0, 2.0], 0), (None, rows[min(500, len(rows) - 1)][1], 0)]
    return spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int")


def test_near_duplicate_vectors(spark):
    x = vectors()
    got = pivots.near_duplicates(table(spark, x)).collect()
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    linked = u @ u.T >= 0.9
    np.fill_diagonal(linked, False)
    want = linked.sum(axis=1)
    want[500:540] += 1  # the row without an id is a copy
    own = {r["vec_id"]: r for r in got if r["vec_id"] is not None and r["vec_id"] < 5000}
    have = np.array([own[i]["n_links"] for i in range(len(x))])
    assert (have <= want).all() and have.sum() >= 0.99 * want.sum()
    assert all(r["n_links"] == 0 and r["kept"] and r["component_id"] == r["vec_id"] for r in got if (r["vec_id"] or 0) >= 5000)
    assert {own[i]["component_id"] for i in range(300, 420)} == {300}
    assert pivots.near_duplicates(table(spark, x).limit(0)).count() == 0


@pytest.mark.parametrize("classes", [10_000, 100_000, 1_000_000, 10_000_000, 30_000_000])
def test_pivot_prefix_keeps_recall_as_tables_grow(classes):
    rng = np.random.default_rng(0)
    p, x, u = (pivots.unit(rng.normal(size=(n, 64))) for n in (pivots.pivot_count(classes), 2000, 2000))
    u = pivots.unit(u - (u * x).sum(axis=1, keepdims=True) * x)
    length, listed = pivots.prefix_length(len(p)), pivots.listed_length(len(p))
    a, b = (np.argsort(-(v @ p.T), axis=1)[:, :length] for v in (x, 0.9 * x + 0.19**0.5 * u))
    shared = a[:, :, None] == b[:, None, :]
    assert ((shared.any(axis=2).sum(axis=1) >= 2) & shared[:, :listed, :listed].any(axis=(1, 2))).mean() >= 0.985


def test_pairs_at_the_very_threshold_are_verified_again(spark):
    rng = np.random.default_rng(8)
    base = pivots.unit(rng.normal(size=(60, 64)))
    off = rng.normal(size=(60, 64))
    off = pivots.unit(off - (off * base).sum(axis=1, keepdims=True) * base)
    cosine = 0.9 + np.linspace(-4e-4, 4e-4, 60)  # too near for bytes to tell
    x = np.concatenate([base, cosine[:, None] * base + np.sqrt(1 - cosine**2)[:, None] * off])
    got = {r["vec_id"]: r for r in pivots.near_duplicates(spark.createDataFrame([(i, [float(y) for y in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()}
    u = pivots.unit(x)
    linked = u @ u.T >= 0.9
    np.fill_diagonal(linked, False)
    assert [got[i]["n_links"] for i in range(120)] == linked.sum(axis=1).tolist() and 20 < linked.sum() / 2 < 40
    assert all(got[60 + i]["component_id"] == (i if linked[i, 60 + i] else 60 + i) for i in range(60))


def test_vectors_with_clashing_columns_and_one_direction(spark):
    rows = [(i, [1.0 + i, 0.0], i, i, i) for i in range(5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cls long, row long, score long")
    assert [(r["n_links"], r["component_id"]) for r in pivots.near_duplicates(df).collect()] == [(4, 0)] * 5
    assert {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in graphann.nearest(df, F.col("id") == 3).collect()} == {(3, k + 1): (v, 1.0) for k, v in enumerate([0, 1, 2, 4])}
    long = spark.createDataFrame([(0, [1.0] * 20_000), (1, [1.0] * 19_999 + [2.0]), (2, [-1.0] * 20_000)], "vec_id long, embedding array<float>")
    assert sorted((r["vec_id"], r["n_links"]) for r in pivots.near_duplicates(long).collect()) == [(0, 1), (1, 1), (2, 0)]


def test_blocks_of_lists_add_up(spark, monkeypatch):
    monkeypatch.setattr(pivots, "BLOCK", 1)  # blocks of TILE vectors
    monkeypatch.setattr(pivots, "TILE", 40)
    x = vectors()[300:540]
    got = {r["vec_id"]: r["n_links"] for r in pivots.near_duplicates(table(spark, x)).collect()}
    u = pivots.unit(x)
    linked = u @ u.T >= 0.9
    np.fill_diagonal(linked, False)
    want = linked.sum(axis=1)
    want[200:240] += 1
    assert [got[i] for i in range(len(x))] == want.tolist()


@pytest.mark.parametrize("shard", [graphann.SHARD, 300])
def test_graph_search(spark, monkeypatch, shard):
    monkeypatch.setattr(graphann, "SHARD", shard)  # one shard, and five
    x = vectors(1500, seed=2)
    found = graphann.nearest(table(spark, x), F.col("id") % 50 == 0).collect()
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    hit = total = 0
    for q in range(0, 1500, 50):
        own = sorted((r for r in found if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == [1, 2, 3, 4, 5] and all(r["vec_id"] != q for r in own)
        s = u @ u[q]
        for r in own:
            assert r["vec_id"] is None or r["score"] == pytest.approx(s[r["vec_id"]], abs=1e-12)
        s[q] = -2
        best = np.lexsort((np.arange(len(s)), -s))[:5]
        hit, total = hit + len(set(best) & {r["vec_id"] for r in own}), total + 5
    assert hit >= 0.9 * total
    few = graphann.nearest(table(spark, x[:3]), F.col("id") % 50 == 0).collect()
    assert len([r for r in few if r["query_id"] == 0]) == 3 and graphann.nearest(table(spark, x).limit(0), F.lit(True)).count() == 0


@pytest.mark.parametrize("noise", [1e-3, 1e-4])
def test_graph_search_tells_near_copies_apart(spark, noise):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2500, 64))
    x[500:2000] = x[500] + noise * rng.normal(size=(1500, 64))
    x = x.astype(np.float32)
    rows = [(i, [float(y) for y in v]) for i, v in enumerate(x)]
    found = graphann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("id") % 50 == 0).collect()
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    hit = 0
    for q in range(500, 2000, 50):
        s = u @ u[q]
        s[q] = -2
        hit += len(set(np.lexsort((np.arange(len(s)), -s))[:5]) & {r["vec_id"] for r in found if r["query_id"] == q})
    assert hit >= 0.99 * 150


def test_one_hot_vectors_tie_by_id(spark):
    rows = [(19 - i, [float(i == j) for j in range(20)]) for i in range(20)]
    found = graphann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("id") == 0).collect()
    assert [(r["vec_id"], r["score"]) for r in sorted(found, key=lambda r: r["rank"])] == [(i, 0.0) for i in range(1, 6)]


def test_graph_search_ties_go_to_smaller_ids(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1000, 16))
    x[300:340] = x[300] * 2.0 ** np.arange(40)[:, None]
    rows = [(999 - i, [float(y) for y in v]) for i, v in enumerate(x)]  # ids fall as rows go on
    found = graphann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") == 690).collect()
    assert [r["vec_id"] for r in sorted(found, key=lambda r: r["rank"])] == [660, 661, 662, 663, 664]


def test_toxicity_learns_subwords(spark):
    rng = random.Random(5)
    bad = [a + b for a in ("grumbl", "snarkov", "vexiat") for b in ("e", "er", "ing", "ous", "ik", "ata")]

    def text(toxic, words):
        w = prose(rng, rng.choice([20, 80, 400])).split()
        for _ in range(3 * toxic):
            w[rng.randrange(len(w))] = rng.choice(words)
        return " ".join(w)

    rows = [(i, text(i % 4 == 0, bad[:-3]), i % 4 == 0) for i in range(1600)]
    unseen = [(10_000 + i, text(i % 2, ["grumblish", "snarkovoid", "vexiatum"]), i % 2) for i in range(200)]
    labels = spark.createDataFrame([(i, int(t)) for i, _, t in rows] + [(1, None), (77_777, 1)], "doc_id long, toxic int")
    d = docs(spark, [(i, t) for i, t, _ in rows + unseen] + [(None, None), (20_000, "")])
    got = {r["doc_id"]: r for r in toxicity.toxicity(d, labels).collect()}
    assert len(got) == 1802 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got.values())
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _, _ in rows)
    right = np.mean([got[i]["predicted"] == t for i, _, t in rows if got[i]["held_out"]])
    assert right > 0.95 and np.mean([got[i]["predicted"] == t for i, _, t in unseen]) > 0.85
    assert got[None]["score"] == got[20_000]["score"] < 0.3
    assert toxicity.toxicity(d.limit(0), labels.limit(0)).count() == 0


def test_votes_are_weighed():
    rng = np.random.default_rng(0)
    good = rng.random(4000) < 0.85
    accuracy = np.array([0.95, 0.9, 0.7, 0.6, 0.85])
    votes = np.where(rng.random((4000, 5)) < accuracy, good[:, None], ~good[:, None]).astype(int)
    votes[rng.random((4000, 5)) < 0.3] = -1
    patterns, inverse, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    post, rates, prior = weaklabel.fit_votes(patterns, counts.astype(float))
    assert prior == pytest.approx(0.85, abs=0.04) and ((post[inverse] >= 0.5) == good).mean() > 0.95
    found = rates[1, :, 1] / (rates[1, :, 1] + rates[1, :, 0])
    assert found == pytest.approx(accuracy, abs=0.05)


def test_quality_rejects_junk(spark):
    rng = random.Random(2)
    clean = [prose(rng, 60).capitalize() + ". " + prose(rng, 30) + ", and so on.\nThe end of it, " + prose(rng, 9) + "." for _ in range(300)]
    junk = [" ".join(w + "%&*#" for w in prose(rng, 50).split()) for _ in range(20)] + [prose(rng, 40).upper().replace(" ", "!! ") for _ in range(20)]
    junk += ["\n".join(" | ".join(prose(rng, 1) for _ in range(8)) for _ in range(6)) for _ in range(20)] + [" ".join([w] * 15) for w in WORDS[:20] for w in [w, w[::-1]]][:20]
    rows = list(enumerate(clean + junk)) + [(None, None), (9000, ""), (9001, " \n ")]
    got = {r["doc_id"]: r for r in weaklabel.judge(docs(spark, rows).withColumn("keep", F.lit("clash"))).collect()}
    assert np.mean([got[i]["keep"] for i in range(300)]) > 0.99
    assert np.mean([got[300 + i]["keep"] for i in range(60)]) < 0.1
    assert not got[None]["keep"] and got[9000]["score"] == 0.0 and not got[9001]["keep"]
    assert weaklabel.judge(docs(spark, rows).limit(0)).count() == 0
