"""The pipeline and the queries on the smallest tables."""

import hashlib
import math
import re
from collections import Counter

import duckdb
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from photocat.llm import bpe, queries, weaklabel


def test_stages_feed_each_other(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).cache()
        assert docs.columns == columns, name
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] >= sizes[2] > sizes[3] <= sizes[4] <= 1.26 * sizes[3]


def test_run_tokenizes_what_is_left(spark, sf_dir):
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path(queries.BPE_FILE)), special_tokens={})
    got = corpus_pipeline.run(spark, sf_dir).collect()
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    same = [r for r in got if r["decoded_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest()]
    assert len(same) > len(got) / 2
    for r in same[:50]:
        assert r["n_tokens"] == len(encoding.encode_ordinary(text[r["doc_id"]]))


@pytest.mark.parametrize("name", ["op1_mix_sources", "op3_chat_format", "op4_line_dedup"])
def test_queries_match_their_sql(spark, sf_dir, name):
    from tools.compare import rows_of

    mine, theirs = rows_of(spark, queries.QUERIES[name], queries.ORACLE_SQL[name], sf_dir)
    assert mine == theirs


def plain_mixture(docs, most):
    """How often each document comes: the least budget that leaves all in, no source passed over more than ``most`` times."""
    tokens = Counter()
    for r in docs:
        tokens[r["source"], r["doc_id"]] += len(re.findall(r"[^ \t\n\x0b\f\r]+", r["text"] or ""))
    total = Counter()
    for (source, _), n in tokens.items():
        total[source] += n
    share = {s: n / sum(total.values()) for s, n in total.items() if n}
    low, high = 0.0, 1.0
    for _ in range(50):
        x = (low + high) / 2
        gain = [s**x / s for s in share.values()]
        low, high = (low, x) if max(gain) / min(gain) <= most else (x, high)
    gain = {s: v**high / v for s, v in share.items()}
    rate = {s: round(g / min(gain.values()), 9) for s, g in gain.items()}
    out = Counter()
    for source in total:
        own = [d for s, d in tokens if s == source]
        for copy in range(max(1, math.ceil(rate.get(source, 1.0)))):
            before = 0
            for d in sorted(own, key=lambda d: (hashlib.md5(f"0:{source}:{copy}:{d}".encode()).hexdigest()[:15], d)):
                if copy < math.floor(rate.get(source, 1.0)) or before < rate[source] % 1 * total[source]:
                    out[d] += 1
                before += tokens[source, d]
    return out


def test_stages_give_what_sql_and_plain_python_give(spark, sf_dir, tmp_path):
    """Each stage on what its predecessor kept, all rows and texts compared."""
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path(queries.BPE_FILE)), special_tokens={})
    docs, con = spark.read.parquet(f"{sf_dir}/documents.parquet"), duckdb.connect()
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        folder = str(tmp_path / name)
        docs.write.parquet(f"{folder}-in")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
        after = docs.collect()
        con.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{folder}-in/*.parquet'")
        if name == "quality":
            score = {r["doc_id"]: r["score"] for r in weaklabel.judge(spark.read.parquet(f"{folder}-in")).collect()}
            assert sorted(after) == sorted(r for r in before if score[r["doc_id"]] >= weaklabel.KEEP)
        elif name == "line_dedup":
            want = con.execute(f"SELECT doc_id, source, text FROM ({queries.ORACLE_SQL['op4_line_dedup']})").fetchall()
            assert sorted((r["doc_id"], r["source"], r["text"]) for r in after) == sorted(want)
        elif name == "near_duplicates":
            want = {i for i, in con.execute(f"SELECT doc_id FROM ({queries.ORACLE_SQL['op6_chosen_path_join']}) WHERE kept").fetchall()}
            assert sorted(after) == sorted(r for r in before if r["doc_id"] in want) and len(want) < len(before)
        elif name == "mixture":
            of, want = {r["doc_id"]: r for r in before}, plain_mixture(before, corpus_pipeline.MOST_REPEATS)
            assert Counter(after) == Counter({of[d]: n for d, n in want.items()}) and set(want) == set(of)
        else:
            ids = {r["doc_id"]: encoding.encode_ordinary(r["text"] or "") for r in before}
            text = {r["doc_id"]: r["text"] or "" for r in before}
            digest = lambda b: hashlib.sha256(b).hexdigest()
            want = Counter((r["doc_id"], len(ids[r["doc_id"]]), digest(" ".join(map(str, ids[r["doc_id"]])).encode()), digest(text[r["doc_id"]].encode())) for r in before)
            assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in after) == want
