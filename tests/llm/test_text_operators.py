"""Mixing, chat formatting, lines, tokens and sharding on small tables with edge cases."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from photocat.llm import bpe, chat, common, lines, mixing, sharding

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


# Tokens ----------------------------------------------------------------------


@pytest.fixture(scope="module")
def own():
    return bpe.codec(PATH, PATTERN)


@pytest.fixture(scope="module")
def library(own):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=own.ranks, special_tokens={})


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.text(max_size=300), st.text(alphabet="abcth e'\n", max_size=600), st.text(alphabet="aé", max_size=400)))
def test_encoding_is_the_librarys(own, library, text):
    ids = own.encode(text)
    assert ids == library.encode_ordinary(text)
    assert own.decode(ids) == text.encode()


def test_long_matches_and_texts(own, library):
    for text in ("the" * 5000, "a" * 3000, "ab " * 60_000, " " * 2000 + "x", "no space" + "é" * 4000, "!?" * 900):
        assert own.encode(text) == library.encode_ordinary(text)


def test_token_table(spark, own, library):
    rows = [(1, "Some text, twice.", "a"), (1, "Some text, twice.", "a"), (None, None, None), (3, "", "a"), (4, "long " * 30_000, "b")]
    df = docs(spark, rows).withColumn("ids", F.lit("clash"))
    got = bpe.decode(bpe.encode(df, PATH, PATTERN), PATH, PATTERN).select("doc_id", "text", "ids", "decoded", *bpe.digests(df)).collect()
    assert len(got) == 5
    for r in got:
        ids = library.encode_ordinary(r["text"] or "")
        assert r["ids"] == ids and bytes(r["decoded"]) == (r["text"] or "").encode() and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert bpe.encode(df.limit(0), PATH, PATTERN).count() == 0


# Chat ------------------------------------------------------------------------


def test_chat_round_trip(spark):
    said = [
        (1, 0, "system", "be <part> kind"), (1, 1, "user", "hi"), (1, 2, "user", "### User: no </turn>"), (1, 3, "assistant", "\\h \\### Assistant: </turn> ok"), (1, 4, "assistant", ""),
        (2, 0, None, None), (2, 0, "a:b ### c", "x##"), (2, None, "assistant", "é" * 3), (None, 5, "assistant", "####"), (3, 1, "user", "same"), (3, 1, "user", "same")]
    rows = spark.createDataFrame(said, "conv_id long, turn long, role string, text string")
    df = chat.format_chat(rows.withColumn("turns", F.lit(1)))
    got = {r["conv_id"]: r for r in df.select("*", chat.parse(F.col("formatted")).alias("read"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    assert set(got) == {1, 2, 3, None}
    for key, r in got.items():
        turns = sorted(((t is not None, t, ro or "", tx or "") for c, t, ro, tx in said if c == key), key=lambda x: (x[0], x[1] or 0, x[2], x[3]))
        assert [(t["role"], t["text"]) for t in r["read"]] == [x[2:] for x in turns]
        assert r["loss"] == "".join(x[3] for x in turns if x[2] == "assistant")
        spans = [r["formatted"][s["start"] : s["start"] + s["length"]] for s in r["loss_spans"]]
        for old, new in reversed(chat.ESCAPES):
            spans = [s.replace(new, old) for s in spans]
        assert spans == [x[3] for x in turns if x[2] == "assistant"]
    assert got[1]["formatted"].count("### User: ") == 1  # adjacent turns of a role are one block
    assert chat.format_chat(rows.limit(0)).count() == 0


def test_chat_uses_no_python(spark):
    df = chat.format_chat(spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


# Lines -----------------------------------------------------------------------


def test_shared_lines_stay_once(spark):
    rows = [(i, f"own line number {i}\nshared boilerplate here\n\nok", f"s{i % 12}") for i in range(24)]
    rows += [(100, "shared boilerplate here", "s1"), (101, None, "s1"), (102, "", None), (103, "only\nonly", "s3"), (None, "shared boilerplate here\nmine is mine", "s2"), (50, "within one site only\nx", "s1")]
    rows += [(200 + i, "within one site only", "s1") for i in range(15)]
    got = {r["doc_id"]: r for r in lines.dedup_lines(docs(spark, rows), min_sites=10).collect()}
    assert got[0]["text"] == "own line number 0\nshared boilerplate here\n\nok"
    assert got[5]["text"] == "own line number 5\n\nok" and got[5]["lines_removed"] == 1
    assert 100 not in got and got[101]["text"] is None and got[102]["text"] == "" and got[103]["text"] == "only\nonly"
    assert got[None]["text"] == "mine is mine" and got[205]["text"] == "within one site only"


def test_near_threshold_counts_are_exact(spark):
    rows = [(s * 1000 + i, f"line with {s} sites", f"site{i}") for s in (9, 10, 11) for i in range(s)]
    got = lines.boilerplate(docs(spark, rows), min_sites=10)[0].collect()
    assert sorted(r["n_sites"] for r in got) == [10, 11]
    assert lines.dedup_lines(docs(spark, rows).limit(0)).count() == 0


# Mixing ----------------------------------------------------------------------


def mixture(spark):
    rows = [(i, "w " * (5 + i % 7), "big") for i in range(600)] + [(1000 + i, "w " * 9, "mid") for i in range(60)] + [(2000 + i, "w " * 10, None) for i in range(20)]
    return docs(spark, rows + [(3000, "", "none"), (3001, None, "none"), (5, "w w", "big")])


def test_no_source_exceeds_its_repeats(spark):
    table = common.cut(mixing.units(mixture(spark)))
    rates = {r["source"]: r for r in mixing.rates(table, budget=1.0, max_repeats=3.0).collect()}
    assert rates[None]["rate"] == pytest.approx(3.0) and rates["big"]["rate"] < 1
    assert sum(r["weight"] for r in rates.values()) == pytest.approx(1)
    total = sum(r["total"] for r in rates.values())
    plan = mixing.schedule(table, mixing.rates(table, budget=1.0, max_repeats=3.0), block_tokens=500).collect()
    assert sum(r["n_tokens"] for r in plan) == pytest.approx(total, rel=0.02)
    assert max(Counter((r["doc_id"], r["source"]) for r in plan).values()) == 3
    assert Counter(r["copy"] for r in plan if r["source"] is None) == {0: 20, 1: 20, 2: 20}
    tokens = Counter()
    for r in plan:
        tokens[r["block"]] += r["n_tokens"]
    assert max(tokens.values()) < 1.3 * min(tokens.values())
    for b in tokens:
        assert sorted(r["slot"] for r in plan if r["block"] == b) == list(range(sum(r["block"] == b for r in plan)))


def test_target_entropy(spark):
    import math

    table = common.cut(mixing.units(mixture(spark)))
    for target in (0.6, 0.9):
        w = [r["weight"] for r in mixing.rates(table, target_entropy=target).collect() if r["weight"] > 0]
        assert -sum(x * math.log(x) for x in w) / math.log(3) == pytest.approx(target, abs=1e-6)


def test_covering_budget_keeps_all(spark):
    df = mixture(spark)
    got = mixing.mix(df, budget=None, max_repeats=1.5)
    assert got.columns == df.columns + ["copy", "block", "slot"]
    counts = Counter(r["doc_id"] for r in got.select("doc_id").collect())
    assert set(counts) == {r["doc_id"] for r in df.collect()}
    assert mixing.mix(df.limit(0), budget=None, max_repeats=1.5).count() == 0


def test_mixing_uses_no_python(spark):
    df = mixing.mix(mixture(spark), budget=None, max_repeats=1.5)
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


# Sharding --------------------------------------------------------------------


def test_shards_are_even_and_groups_together(spark):
    rows = [(i, f"text {i}", "a") for i in range(300)] + [(1000 + 10 * g + k, f"group {g}", "a") for g in range(20) for k in range(4)] + [(5000 + i, "hot", "a") for i in range(150)]
    rows += [(None, None, "a"), (None, None, "a"), (9007, "", "a"), (9008, "é", "a")]
    got = sharding.shard_documents(docs(spark, rows)).collect()
    counts = Counter(r["shard"] for r in got)
    assert len(got) == len(rows) and set(counts) <= set(range(16)) and max(counts.values()) - min(counts.values()) <= 1
    for s in counts:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(counts[s]))
    text = dict((i, t) for i, t, _ in rows if i is not None)
    for r in got:
        t = (text[r["doc_id"]] if r["doc_id"] is not None else None) or ""
        assert r["size"] == len(t.encode()) + 1 and r["text_crc32"] == zlib.crc32(t.encode()) and r["law"] == "rows" and r["grown_shard"] is None
    together = sum(len({r["shard"] for r in got if r["doc_id"] is not None and 1000 + 10 * g <= r["doc_id"] < 1010 + 10 * g}) == 1 for g in range(20))
    assert together >= 15
    assert len({r["shard"] for r in got if r["doc_id"] and r["doc_id"] >= 5000}) < 14
    assert sharding.shard_documents(docs(spark, rows).limit(0)).count() == 0
    assert len(sharding.shard_documents(docs(spark, rows[:3])).collect()) == 3


@pytest.mark.parametrize("size", [2, 3, 8])
def test_small_groups_share_a_shard(spark, size):
    rows = [(i, f"text {i}", "a") for i in range(3000)] + [(10_000 + 10 * g + k, f"group {g}", "a") for g in range(100) for k in range(size)]
    got = sharding.shard_documents(docs(spark, rows)).collect()
    counts = Counter(r["shard"] for r in got)
    assert len(got) == len(rows) and len(counts) == 16 and max(counts.values()) - min(counts.values()) <= 1
    shards = {}
    for r in got:
        if r["doc_id"] >= 10_000:
            shards.setdefault(r["doc_id"] // 10, set()).add(r["shard"])
    assert sum(len(s) == 1 for s in shards.values()) >= 98


def test_pairs_meet_without_unlinked_rows(spark):
    rows = [(2 * g + k, f"pair {g}", "a") for g in range(1500) for k in range(2)]
    got = sharding.shard_documents(docs(spark, rows)).collect()
    counts, shards = Counter(r["shard"] for r in got), {}
    for r in got:
        shards.setdefault(r["doc_id"] // 2, set()).add(r["shard"])
    assert max(counts.values()) - min(counts.values()) <= 1 and sum(len(s) == 1 for s in shards.values()) >= 1350


def spark_hash(*parts):
    """xxhash64 of numbers (bytes of an int or a long), as Spark chains it."""
    out = 42
    for number, size in parts:
        out = xxhash.xxh64_intdigest(number.to_bytes(size, "little", signed=True), seed=out)
    return out - (1 << 64) if out >= 1 << 63 else out


def plain_propagation(rows, links, shards):
    """Shards by going through rows one by one: what the joins and ranks do for all at once."""
    order = sorted(rows, key=lambda r: (spark_hash((0, 4), (r, 8)), r))
    now = {r: i % shards for i, r in enumerate(order)}
    around, top, side = defaultdict(list), {}, {}
    for a, b, t, s in links:
        around[a].append(b)
        around[b].append(a)
        top[a] = top[b] = t
        side[a], side[b] = s, 1 - s
    turn = idle = moves = 0
    while idle < sharding.IDLE:
        wants = {}
        for r, others in around.items():
            there = Counter(now[o] for o in others)
            best = min(there, key=lambda s: (-there[s], s))
            if there[best] > there[now[r]]:
                wants[r] = best
        if not wants:
            break
        rank = lambda rs: sorted(rs, key=lambda r: (spark_hash((0, 4), (turn, 4), (r, 8)), r))
        drawn = lambda r: (spark_hash((0, 4), (turn // 2, 4), (top[r], 8)) + turn) % 2 if turn else 1
        asking, free = defaultdict(list), defaultdict(list)
        for r in rank(r for r in wants if side[r] == drawn(r)):
            asking[now[r], wants[r]].append(r)
        for r in rank(set(rows) - set(around)):
            free[now[r]].append(r)
        moved = {}
        for (a, b), own in sorted(asking.items()):
            back = len(asking.get((b, a), ()))
            pairs = min(len(own), back)
            filled = min(len(own) - pairs, len(free[b]))
            moved |= dict.fromkeys(own[: pairs + filled], b) | dict.fromkeys(free[b][:filled], a)
            free[b] = free[b][filled:]
        turn, idle, moves = turn + 1, 0 if moved else idle + 1, moves + len(moved)
        now |= moved
    return now, moves


def test_propagation_is_that_of_plain_python(spark):
    rng = random.Random(5)
    rows = [(i, f"text {i}", "a") for i in range(120)] + [(1000 + i, f"group {rng.randrange(60)}", "a") for i in range(180)] + [(3000 + i, "hot", "a") for i in range(60)] + [(None, None, "a"), (7, "", "a"), (8, "", "a")]
    sized = sharding.sized(docs(spark, rows))
    links = sharding.equal_text_links(sized, 8)
    where, pairs = {r["row"]: r for r in sized.collect()}, sorted(map(tuple, links.collect()))
    groups, linked = defaultdict(set), defaultdict(set)
    for r in where.values():
        if r["doc_id"] is not None:
            groups[r["g1"]].add(r["row"])
    for a, b, top, _ in pairs:
        assert where[a]["g1"] == where[b]["g1"] and top == min(groups[where[a]["g1"]])
        linked[top] |= {a, b}
    assert sorted(map(sorted, linked.values())) == sorted(sorted(g) for g in groups.values() if len(g) > 1)
    assert len(pairs) == sum(len(g) - 1 for g in groups.values())
    want, moves = plain_propagation(list(where), pairs, 8)
    got = {r["row"]: r["shard"] for r in sharding.propagate(sized, links, 8).collect()}
    assert got == want and moves > 50
