"""The operators with production parameters, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, chosenpath, graphann, lines, mixing, multiindex, pivots, queuebpe, resample, sharding, toxicity, weaklabel

BPE_FILE, QUEUE_FILE = "byte_bpe_50k.tiktoken", "byte_bpe_50k.json"
#: The sources are mixed so that none is passed over more often than this.
MOST_REPEATS = 2.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = mixing.cut(mixing.units(table(spark, sf_dir, "documents")))
    return mixing.schedule(units, mixing.rates(units, budget=1.0, max_repeats=MOST_REPEATS))


def op2_pivot_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(planted)
    df = chat.format_chat(rows).withColumn("read", chat.parse(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans")))
    said = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return df.select(
        "conv_id", F.size("read").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "source", "text", "lines_removed")


def op5_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weaklabel.judge(table(spark, sf_dir, "documents")).select("doc_id", "score", "keep")


def op6_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosenpath.jaccard_join(table(spark, sf_dir, "documents"))


def op7_graph_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphann.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    decoded = bpe.round_trip(docs, public_tokenizers.path(BPE_FILE), public_tokenizers.PATTERN)
    return decoded.select("doc_id", *bpe.digests(decoded))


def op10_label_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op11_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return multiindex.hard_negatives(rows.withColumn("label", noisy), F.col("id") % 50 == 0)


def op13_queue_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = queuebpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path(QUEUE_FILE))
    return decoded.select("doc_id", *queuebpe.digests())


QUERIES = {f.__name__: f for f in (
    op1_mix_sources, op2_pivot_neardup, op3_chat_format, op4_line_dedup, op5_weak_quality, op6_chosen_path_join, op7_graph_ann, op8_toxicity, op9_byte_bpe, op10_label_shards, op11_importance_resample,
    op12_multi_index, op13_queue_bpe)}

ORACLE_SQL = {
    "op2_pivot_neardup": """
WITH RECURSIVE e AS (
  SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS size FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_inner_product(a.v, b.v) / (a.size * b.size) >= 0.9),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM link WHERE a = vec_id) AS n_links, coalesce(least(least.b, vec_id), vec_id) AS component_id, vec_id <= coalesce(least.b, vec_id) AS kept
FROM embeddings LEFT JOIN least ON a = vec_id
""",
    "op6_chosen_path_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9\x{80}-\x{10FFFF}]+') AS ws FROM documents),
class AS (SELECT ws, min(doc_id) AS c, count(*) AS n FROM w WHERE len(ws) > 0 GROUP BY ws),
shingle AS (SELECT c, n, unnest(CASE WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END) AS s FROM class),
size AS (SELECT c, any_value(n) AS n, count(*) AS k FROM shingle GROUP BY c),
met AS (SELECT a.c AS a, b.c AS b, count(*) AS shared FROM shingle a JOIN shingle b USING (s) WHERE a.c <> b.c GROUP BY ALL),
link AS (SELECT a, b, y.n FROM met JOIN size x ON x.c = a JOIN size y ON y.c = b WHERE 10 * shared >= 8 * (x.k + y.k - shared)),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
other AS (SELECT a, sum(n) AS n FROM link GROUP BY a)
SELECT doc_id, coalesce(c, doc_id) AS class_id, coalesce(class.n - 1, 0)::BIGINT + coalesce(other.n, 0)::BIGINT AS n_links, coalesce(least(least.b, c), c, doc_id) AS group_id, doc_id = coalesce(least(least.b, c), c, doc_id) AS kept
FROM w LEFT JOIN class USING (ws) LEFT JOIN least ON least.a = c LEFT JOIN other ON other.a = c
""",
    "op1_mix_sources": f"""
WITH RECURSIVE unit AS (
  SELECT doc_id, source, sum(coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\x0b\\f\\r]+')), 0))::BIGINT AS n_tokens FROM documents GROUP BY ALL),
tot AS (SELECT source, sum(n_tokens)::BIGINT AS total FROM unit GROUP BY source),
share AS (SELECT source, total, total::DOUBLE / (SELECT sum(total) FROM tot)::DOUBLE AS share FROM tot),
bis(i, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT i + 1, CASE WHEN good THEN lo ELSE mid END, CASE WHEN good THEN mid ELSE hi END
  FROM (SELECT i, lo, hi, (lo + hi) / 2 AS mid, max(pow(share, (lo + hi) / 2) / share) / sum(pow(share, (lo + hi) / 2)) <= {MOST_REPEATS} AS good
        FROM bis, share WHERE i < 50 AND total > 0 GROUP BY i, lo, hi)),
x AS (SELECT hi AS x FROM bis ORDER BY i DESC LIMIT 1),
rate AS (SELECT source, total, CASE WHEN total > 0 THEN round(pow(share, x) / (SELECT sum(pow(share, x)) FROM share, x WHERE total > 0) / share, 9) ELSE 1 END AS rate FROM share, x),
pass AS (
  SELECT doc_id, u.source, n_tokens, total, rate, c::INT AS copy,
         ('0x' || substr(md5('0:' || coalesce(u.source, '') || ':' || c || ':' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS o
  FROM unit u JOIN rate r ON u.source IS NOT DISTINCT FROM r.source, unnest(range(0, greatest(ceil(rate)::INT, 1))) t(c)),
ranked AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY source, copy ORDER BY o, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM pass),
taken AS (SELECT * FROM ranked WHERE copy < floor(rate) OR before < (rate - floor(rate)) * total),
blocks AS (SELECT greatest(1, floor(sum(rate * total) / {mixing.BLOCK_TOKENS})) AS n FROM rate),
placed AS (
  SELECT *, least(floor(CASE WHEN total > 0 THEN (copy * total + before)::DOUBLE / (rate * total) ELSE o::DOUBLE / 1152921504606846976 END * n), n - 1)::INT AS block FROM taken, blocks)
SELECT doc_id, source, n_tokens, copy, block,
       (row_number() OVER (PARTITION BY block ORDER BY ('0x' || substr(md5('0:' || block || ':' || copy || ':' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(source, '')), 1, 15))::BIGINT, doc_id, copy, source) - 1)::INT AS slot
FROM placed
""",
    "op3_chat_format": r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, unnest([0, 1]), unnest(['user', 'assistant']), '\### Assistant: </turn> ok'),
t AS (
  SELECT *, lag(role) OVER w IS DISTINCT FROM role AS starts,
         replace(replace(replace(replace(text, '\', '\s'), '###', '\h'), '</turn>', '\t'), '<part>', '\p') AS shown
  FROM said WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(shown) + CASE WHEN starts THEN length('### ' || role || ': ') + length('</turn>') + 1 ELSE length('<part>') END)::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
""",
    "op4_line_dedup": """
WITH l AS (
  SELECT doc_id, source, i, line, trim(line) AS key FROM (
    SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
spread AS (SELECT key, min(doc_id) AS first_doc FROM l WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT source) >= 10),
kept AS (
  SELECT l.doc_id, string_agg(line, chr(10) ORDER BY i) FILTER (NOT coalesce(l.doc_id <> first_doc, false)) AS text,
         count(*) FILTER (coalesce(l.doc_id <> first_doc, false)) AS lines_removed
  FROM l LEFT JOIN spread USING (key) GROUP BY l.doc_id)
SELECT d.doc_id, d.source, coalesce(k.text, d.text) AS text, coalesce(lines_removed, 0)::INT AS lines_removed
FROM documents d LEFT JOIN kept k USING (doc_id)
WHERE coalesce(lines_removed, 0) = 0 OR trim(coalesce(k.text, ''), chr(32) || chr(9) || chr(13) || chr(10)) <> ''
""",
    "op11_importance_resample": r"""
WITH step AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) r(i)),
word AS (
  SELECT true AS doc, doc_id AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM documents
  UNION ALL
  SELECT false, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark),
per AS (SELECT doc, id, w, count(*) AS n FROM word GROUP BY ALL),
bucket AS (
  SELECT w, xor(list_reduce([4294967295] || list_transform(range(1, strlen(w) + 1), lambda j: ('0x' || substr(hex(encode(w)), 2 * j - 1, 2))::BIGINT),
                            lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 10000 AS b
  FROM (SELECT DISTINCT w FROM per), step),
n AS (SELECT b, coalesce(sum(n) FILTER (doc), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (NOT doc), 0)::DOUBLE AS t FROM per JOIN bucket USING (w) GROUP BY b),
total AS (SELECT coalesce(sum(s), 0) AS s, coalesce(sum(t), 0) AS t FROM n),
gain AS (SELECT b, floor(1000 * ln(((n.t + 1) * (total.s + 10000)) / ((n.s + 1) * (total.t + 10000))))::BIGINT AS g FROM n, total),
weighed AS (SELECT id AS doc_id, sum(n)::BIGINT AS n_features, sum(n * g)::BIGINT AS weight FROM per JOIN bucket USING (w) JOIN gain USING (b) WHERE doc GROUP BY id),
scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM documents LEFT JOIN weighed USING (doc_id)),
place AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= n * 10 // 100 THEN rank END AS rank FROM scored LEFT JOIN place USING (doc_id)
""",
    "op12_multi_index": """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER w)::INT AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 3
""",
}
