"""Limits, frequent keys and odd tables: each has the result that the docstrings define."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from photocat.llm import chosenpath, common, lines, mixing, queries, sharding, toxicity, weaklabel
from photocat.llm import shingles as S

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


def prose(rng, n):
    return " ".join(rng.choice(("kar", "lone", "misti", "sera", "tubo")) + rng.choice(("ran", "nel", "bost")) + str(rng.randrange(90)) for _ in range(n))


# Helpers -----------------------------------------------------------------------


def test_components_of_a_long_chain_and_a_hub(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 100)
    links = [(i + 1, i) for i in range(3000)] + [(10_000 + i, 10_500) for i in range(1000)]
    got = {r["id"]: r["root"] for r in common.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[i] for i in range(3001)} == {0} and {got[10_000 + i] for i in range(1000)} == {10_000}


def test_joins_split_frequent_keys(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 50)
    rows = spark.range(1000).select("id", F.when(F.col("id") < 400, 7).otherwise(F.col("id") % 60).alias("k"))
    by_key = common.cut(rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least")).where("k <> 3"))
    joined = common.join_split(rows, by_key, ["k"], ["id"])
    assert sorted(map(tuple, joined.select("id", "k", "n", "least").collect())) == sorted(map(tuple, rows.join(by_key, "k").select("id", "k", "n", "least").collect()))
    assert common.join_split(rows, by_key, ["k"], ["id"], how="left").count() == 1000


def test_ranks_in_many_ranges(spark):
    df = common.cut(spark.range(4000).select("id", F.xxhash64("id").alias("h"), (F.col("id") % 5).alias("w")))
    rows = sorted(common.spread_rank(df, [], "h", ["id"], "w", parts=2500).collect(), key=lambda r: r["h"])
    assert [r["rank"] for r in rows] == list(range(4000)) and [r["before"] for r in rows] == np.concatenate([[0], np.cumsum([r["w"] for r in rows])[:-1]]).tolist()


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    text = "Éa, hello wörld foo-bar\n" * 500
    whole = S.words(pa.array([text]))
    monkeypatch.setattr(S, "CHUNK", 100)
    parts = S.words(pa.array([text]))
    assert (whole[0] == parts[0]).all() and whole[1].tolist() == parts[1].tolist()


def test_a_recall_that_is_not_met_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(chosenpath, "SEARCHES", 1)
    monkeypatch.setattr(chosenpath, "candidate_links", lambda classes, first_run=0: common.cut(spark.createDataFrame([(1, 0, False), (5, 4, True)], "a long, b long, probe boolean")))
    with pytest.raises(RuntimeError, match="0.0000"):
        chosenpath.candidate_groups(spark.createDataFrame([], "cls long, signature binary, sketch binary"))


def test_large_buckets_are_split(spark, monkeypatch):
    for name, value in (("SMALL", 4), ("HUGE", 20), ("BLOCK", 8), ("BLOCK_WORDS", 2000)):
        monkeypatch.setattr(chosenpath, name, value)
    rng = random.Random(6)
    shared, base = prose(rng, 80), prose(rng, 200).split()
    texts = [shared + " " + prose(rng, 60) for _ in range(60)]
    for i in range(40):
        w = list(base)
        w[rng.randrange(200)] = f"edit{i}"
        texts.append(" ".join(w))
    texts += [texts[3].replace(" ", "  "), "x" * 300_000 + " " + prose(rng, 30_000)]
    got = {r["doc_id"]: r for r in chosenpath.jaccard_join(docs(spark, [(i, t, "s") for i, t in enumerate(texts)]).withColumn("cls", F.lit(1)).withColumn("root", F.lit(2))).collect()}
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    links = [[j for j in range(len(sets)) if j != i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])] for i in range(len(sets))]
    assert [got[i]["n_links"] for i in range(len(texts))] == [len(x) for x in links]
    assert got[100]["class_id"] == 3 and {got[60 + i]["group_id"] for i in range(40)} == {60}


# Learned scores against plain Python ---------------------------------------------


def spans_hash(words: list[bytes]) -> list[int]:
    data = b"".join(words)
    ends = np.cumsum([len(w) for w in words])
    return S.hash_spans(np.frombuffer(data, np.uint8), ends - [len(w) for w in words], ends).tolist()


def shape(token: str) -> str:
    kinds = "".join("a" if "a" <= c <= "z" or ord(c) >= 128 else "A" if "A" <= c <= "Z" else "0" if c.isascii() and c.isdigit() else c for c in token)
    return re.sub(r"(.)\1+", r"\1", kinds)


def test_quality_scores_are_those_of_plain_python(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    w, bias = weaklabel.train(table)
    got = {r["doc_id"]: r for r in queries.op5_weak_quality(spark, sf_dir).collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in table.collect()}
    assert set(got) == set(texts)
    for i in sorted(texts)[:60]:
        tokens = [t for t in re.split("[ \t\n\r\f\v]+", texts[i]) if t]
        buckets = [h % (weaklabel.BUCKETS - 1) for h in spans_hash([shape(t).encode() for t in tokens])] + [weaklabel.BUCKETS - 1 for a, b in zip(tokens, tokens[1:]) if a == b]
        score = 1 / (1 + np.exp(-(sum(float(w[b]) for b in buckets) / len(tokens) + bias))) if tokens else 0.0
        assert got[i]["score"] == pytest.approx(score, abs=1e-5) and got[i]["keep"] == (got[i]["score"] >= 0.5)


def test_patterns_weigh_as_their_documents_do():
    rng = np.random.default_rng(3)
    votes = rng.integers(-1, 2, (300, 3))
    patterns, inverse, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    post, rates, prior = weaklabel.fit_votes(patterns, counts.astype(float))
    every, rates_of_all, prior_of_all = weaklabel.fit_votes(votes, np.ones(300))
    assert post[inverse] == pytest.approx(every, abs=1e-6) and rates == pytest.approx(rates_of_all, abs=1e-6) and prior == pytest.approx(prior_of_all, abs=1e-6)
    # and the posterior is Bayes' rule by hand
    v = votes[0]
    of = [np.prod([rates_of_all[c, j, {0: 0, 1: 1, -1: 2}[int(v[j])]] for j in range(3)]) * (prior if c else 1 - prior) for c in (0, 1)]
    assert every[0] == pytest.approx(of[1] / sum(of), abs=1e-3)  # the rates moved once more since


def test_toxicity_scores_are_those_of_plain_python():
    rng = random.Random(9)
    texts = [prose(rng, n) for n in (1, 7, 8, 9, 40, 500)] + ["", "Ünïcode, twice: Ünïcode!"]
    weight, bias = np.random.default_rng(1).normal(size=toxicity.BUCKETS).astype(np.float32), -1.0

    def margin(word: bytes) -> float:
        marked = b"<" + word + b">"
        hashes = spans_hash([word])
        for n in toxicity.GRAMS:
            factors = (S.mix(np.arange(1, n + 1, dtype=np.uint64) + np.uint64(n << 8)) | np.uint64(1)).tolist()
            raw = [sum((marked[i + j] + 1) * factors[j] for j in range(n)) % 2**64 for i in range(len(marked) - n + 1)]
            hashes += S.mix(np.array(raw, np.uint64)).tolist()
        return float(np.mean([weight[h % toxicity.BUCKETS] for h in hashes]))

    for text, score in zip(texts, toxicity.scores(pa.array(texts), weight, bias), strict=True):
        words = [m.encode() for m in re.findall(r"[^\W_]+", text.lower())]
        windows = [np.mean([margin(x) for x in words[i : i + 8]]) for i in range(0, len(words), 8)]
        assert score == pytest.approx(1 / (1 + np.exp(-(max(windows, default=0.0) + bias))), abs=1e-6)


def test_misspellings_that_were_never_seen_share_their_words_vectors():
    rng = random.Random(11)
    insults = ["grumblous", "snarkovit", "pestilent", "wretchook"]
    texts = [prose(rng, 40) for _ in range(600)]
    labels = np.array([i % 4 == 0 for i in range(600)], float)
    texts = [t + " " + " ".join(rng.sample(insults, 3)) if y else t for t, y in zip(texts, labels, strict=True)]
    weight, bias = toxicity.fit(pa.array(texts[:400]), labels[:400])

    def caught(spoil):
        spoilt = [re.sub("|".join(insults), lambda m: spoil(m[0]), t) for t, y in zip(texts[400:], labels[400:], strict=True) if y]
        return (toxicity.scores(pa.array(spoilt), weight, bias) >= toxicity.TOXIC).mean()

    assert caught(lambda w: w) == 1 and caught(lambda w: w[:3] + w[2:]) > 0.9 and caught(lambda w: w[:4] + w[5:]) > 0.8 and caught(lambda w: w + "z") > 0.9
    clean = [t for t, y in zip(texts[400:], labels[400:], strict=True) if not y]
    assert (toxicity.scores(pa.array(clean), weight, bias) >= toxicity.TOXIC).mean() < 0.02


def test_toxicity_labels(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, 30) + (" grumblous snarkov" if i % 3 == 0 else ""), "s") for i in range(300)]
    table = docs(spark, rows + [(3, "other text of this id", "s"), (4, None, "s"), (None, "grumblous", "s")]).withColumn("score", F.lit(9))
    schema = "doc_id long, toxic int"
    labels = [(i, int(i % 3 == 0)) for i in range(300)] + [(0, 0), (6, 0), (6, None)]  # clashing ones are toxic
    got = toxicity.toxicity(table, spark.createDataFrame(labels, schema)).collect()
    assert len(got) == 303 and np.mean([r["predicted"] == (r["doc_id"] % 3 == 0) for r in got if r["doc_id"] is not None]) > 0.95
    none = {r["score"] for r in toxicity.toxicity(table, spark.createDataFrame([], schema)).collect()}
    ones = {r["score"] for r in toxicity.toxicity(table, spark.createDataFrame([(i, 1) for i in range(50)], schema)).collect()}
    assert len(none) == 1 and len(ones) == 1 and ones.pop() > 0.9


def test_samples_are_bounded_in_bytes(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "TRAIN_BYTES", 3000)
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda rows: seen.append(rows.select("text").collect()) or (np.zeros(toxicity.BUCKETS, np.float32), 0.0))
    toxicity.toxicity(docs(spark, [(i, "x" * 100, "s") for i in range(100)] * 2), spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, toxic int")).collect()
    assert 20 <= len(seen[0]) <= 30
    sample = spark.createDataFrame([(i, 10) for i in range(20)], "o long, size long")
    assert sorted(r["o"] for r in common.within_bytes(sample, ["o"], "size", 55).collect()) == list(range(5))


@pytest.mark.parametrize("large", [0, 4, 9])
def test_a_large_text_costs_only_itself(spark, large):
    sample = spark.createDataFrame([(i, 1000 if i == large else 10) for i in range(10)], "o long, size long")
    assert sorted(r["o"] for r in common.within_bytes(sample, ["o"], "size", 500).collect()) == [i for i in range(10) if i != large]
    assert [r["o"] for r in common.within_bytes(sample, ["o"], "size", 5).collect()] == [0]  # all are too large: the first, of which a piece is read


def test_toxicity_beside_a_text_over_the_limit(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "TRAIN_BYTES", 60_000)
    rng = random.Random(4)
    rows = [(i, prose(rng, 30) + (" grumblous snarkov" if i % 3 == 0 else ""), "s") for i in range(200)] + [(1000 + i, prose(rng, 9000), "s") for i in range(6)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(200)] + [(1000 + i, 0) for i in range(6)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs(spark, rows), labels).where("doc_id < 200").collect()
    assert sum(r["predicted"] == int(r["doc_id"] % 3 == 0) for r in got) > 170
    monkeypatch.setattr(toxicity, "TRAIN_BYTES", 10)
    assert 0 < toxicity.toxicity(docs(spark, rows), labels).agg(F.max("score")).first()[0] < 1
    assert {r["predicted"] for r in toxicity.toxicity(docs(spark, rows[:5]), labels.limit(0)).collect()} == {0}


INSIDE = ("_gone", "_d", "_t", "_kept", "_s", "_id", "row", "cls", "k", "h1", "h2", "site", "n", "order", "size", "pattern", "x", "good", "root", "id", "copies")


def test_names_inside_are_free_outside(spark):
    rng = random.Random(2)
    texts = [(i, "a line of every site, always the same\n" + prose(rng, 20), f"s{i}") for i in range(14)] + [(20, prose(random.Random(7), 40), "s1"), (21, prose(random.Random(7), 40), "s2")]
    plain = docs(spark, texts)
    table = plain.withColumns({c: F.lit("clash") for c in INSIDE})
    for operator in (lines.dedup_lines, weaklabel.judge):
        got = operator(table)
        assert set(INSIDE) < set(got.columns) and set(map(tuple, got.drop(*INSIDE).collect())) == set(map(tuple, operator(plain).collect()))
    one = chosenpath.keep_one(table)
    assert one.columns == table.columns and {r["doc_id"] for r in one.collect()} == {*range(14), 20}
    assert set(INSIDE) < set(mixing.mix(table, budget=None, max_repeats=1.2).columns)


def test_lines_of_documents_without_ids(spark):
    shared = "a line of every site, always the same"
    rows = [(None, f"{shared}\nown line number {i}", f"s{i}") for i in range(30)] + [(None, f"{shared}\nown line number 3", "s3")]
    got = lines.dedup_lines(docs(spark, rows)).collect()
    # the text that comes first by its hash keeps the line, in all its rows
    assert len(got) == 31 and sum(shared in r["text"] for r in got) in (1, 2) and len({r["text"] for r in got if shared in r["text"]}) == 1
    named = lines.dedup_lines(docs(spark, rows + [(5, shared, "t")])).collect()
    assert [r["doc_id"] for r in named if shared in r["text"]] == [5]


def test_quality_of_odd_texts(spark):
    rng = random.Random(8)
    clean = "\n".join(prose(rng, 12).capitalize() + ", " + prose(rng, 9) + "." for _ in range(6))
    rows = [(1, clean, "s"), (1, clean, "s"), (2, " ".join([clean] * 300), "s"), (3, "x" * 1_000_000, "s"), (None, clean, None)]
    got = weaklabel.judge(docs(spark, rows + [(10 + i, "%&# " * 40, "s") for i in range(5)])).collect()
    assert len(got) == 10 and len({round(r["score"], 9) for r in got if r["doc_id"] in (1, None)}) == 1


# Native operators ------------------------------------------------------------------


def test_mixing_of_odd_units(spark):
    rows = [(i, "w " * 10, "big") for i in range(200)] + [(None, "w w", "big"), (None, "w", "big"), (7, "w", None)] + [(1000 + i, " ", "blank") for i in range(500)]
    table = docs(spark, rows).withColumn("copy", F.lit("clash")).withColumn("slot", F.lit("clash"))
    got = mixing.mix(table, budget=None, max_repeats=1.2)
    assert Counter(r["doc_id"] for r in got.collect())[None] == 2 and got.columns.count("copy") == 1
    units = common.cut(mixing.units(table))
    plan = mixing.schedule(units, mixing.rates(units, budget=None, max_repeats=1.2), block_tokens=200).collect()
    blocks = Counter(r["block"] for r in plan if r["source"] == "blank")
    assert sum(blocks.values()) == 500 and len(blocks) == 10 and max(blocks.values()) < 100
    for b in blocks:
        assert sorted(r["slot"] for r in plan if r["block"] == b) == list(range(sum(r["block"] == b for r in plan)))
    for target in ({"budget": 3.0, "max_repeats": 2.0}, {"target_entropy": 1.5}):
        with pytest.raises(ValueError):
            mixing.rates(units, **target)


def test_slots_of_large_blocks(spark, monkeypatch):
    units = common.cut(mixing.units(docs(spark, [(i, "w w", "s") for i in range(900)])))
    rates = mixing.rates(units, max_repeats=1.0)
    want = {(r["doc_id"], r["slot"]) for r in mixing.schedule(units, rates).collect()}
    monkeypatch.setattr(mixing, "RANK_ROWS", 100)
    assert {(r["doc_id"], r["slot"]) for r in mixing.schedule(units, rates).collect()} == want and len(want) == 900


def test_lines_of_odd_documents(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    long = "\n".join(f"a line of its own, number {i}" for i in range(20_000))
    rows = [(i, "shared boilerplate here\nmine, and only mine " + str(i), f"s{i}") for i in range(40)] + [(None, "shared boilerplate here\nnobody's", "s1"), (99, long + "\nshared boilerplate here", "s2"), (99, "shared boilerplate here\nagain", "s3")]
    got = lines.dedup_lines(docs(spark, rows).withColumn("lines_removed", F.lit("clash")).withColumn("n", F.lit(0)).withColumn("h1", F.lit(0))).collect()
    assert len(got) == 43 and Counter(r["lines_removed"] for r in got) == {0: 1, 1: 42}
    assert next(r for r in got if r["doc_id"] == 99 and r["source"] == "s2")["text"] == long


def test_shards_split_hot_texts(spark, monkeypatch, sf_dir):
    monkeypatch.setattr(common, "HOT_ROWS", 20)
    rows = [(i, f"text {i}", "s") for i in range(200)] + [(1000 + i, "hot", "s") for i in range(150)] + [(5, "text 5", "s")]
    got = sharding.shard_documents(docs(spark, rows).withColumn("shard", F.lit(1)).withColumn("row", F.lit(1)).withColumn("size", F.lit(1))).collect()
    counts = Counter(r["shard"] for r in got)
    assert len(got) == 351 and max(counts.values()) - min(counts.values()) <= 1


def test_groups_of_the_table_are_whole(spark, sf_dir):
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got, groups, slots = queries.op10_label_shards(spark, sf_dir).collect(), defaultdict(set), defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        if text[r["doc_id"]] is not None:
            groups[text[r["doc_id"]]].add(r["shard"])
    assert len(got) == len(text) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    repeated = [t for t, n in Counter(text.values()).items() if n > 1 and t is not None and n <= len(text) / 64]
    assert sum(len(groups[t]) > 1 for t in repeated) <= 0.1 * len(repeated)


# The pipeline ------------------------------------------------------------------------


def test_stages_take_odd_tables(spark):
    rng = random.Random(1)
    words = [a + b + c for a in ("ka", "lo", "mi", "ser", "tu") for b in ("ra", "ne", "bo", "vi") for c in ("n", "l", "st", "d", "m")]
    plain = lambda n: " ".join(rng.choice(words) for _ in range(n))
    good = lambda: "\n".join(plain(12).capitalize() + ", " + plain(9) + "." for _ in range(6))
    own = [good() for _ in range(40)]
    rows = [(i, t, f"s{i % 3}") for i, t in enumerate(own)] + [(0, own[0], "s0"), (None, own[1], "s1"), (None, good(), None), (50, None, "s1"), (51, "", "s1"), (52, own[2], "s2")]
    rows += [(60 + i, "a line that very many sites have\n" + good(), f"site{i}") for i in range(12)]
    for table, none in ((docs(spark, rows), False), (docs(spark, rows).limit(0), True)):
        for name, stage in corpus_pipeline.STAGES:
            columns = table.columns
            table = common.cut(stage(spark, table, ""))
            assert name == "tokens" or table.columns == columns
            if name == "line_dedup":
                assert all(r["n_chars"] == len(r["text"]) for r in table.where("doc_id >= 60").collect())
        got = {r["doc_id"]: r for r in table.collect()}
        # text 1 stays in the row without an id, which is the first of its group
        assert (not got) if none else ({None, 0, *range(2, 40), *range(60, 72)} <= set(got) and not {1, 50, 51, 52} & set(got))
