"""Line dedup: lines that many sites share are kept once.

Lines are counted by a 128-bit hash of their trimmed text. Only lines that
occur as often as the limit of sites can reach it (a count decides, so nothing
is lost), and only these get a HyperLogLog sketch of their sites; sketches of
the partitions merge in the aggregation. A line whose estimate is far above the
limit is boilerplate, one far below is not, and lines near it get an exact
distinct count. Joins by line split the lines that a share of all documents hold. Boilerplate stays in the document with the smallest doc_id and
goes from all others. A document from which everything goes is dropped, since
each of its lines is still in another; a document without text stays as it is.

Edge cases. Null text: kept. Null site: counts as no site. Null doc_id: never
the first, unless all are null; rows without an id are documents by their texts,
so one that repeats is one document. Rows with one doc_id are one document. Blank
lines and lines shorter than ``min_chars`` are never removed by themselves.
A line that repeats only within a site stays. Ties of doc_id cannot occur, as
equal ids are one document. Empty table: no rows. Other columns pass through,
whatever their names; a clashing "lines_removed" is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, join_split, unused

#: Bits of a sketch's index: a standard error of 1.6 %.
LG_K = 12
#: Estimates within this share of the limit are counted exactly: 15 standard errors.
NEAR = 0.25


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def line_key(line: Column) -> Column:
    trimmed = F.btrim(line)
    return F.struct(F.xxhash64(trimmed).alias("h1"), F.xxhash64(trimmed, F.lit("second")).alias("h2"))


def nameless() -> Column:
    """A hash of the text of a document without an id, by which such documents differ."""
    return F.when(F.col("doc_id").isNull(), F.xxhash64("text")).alias("nameless")


def occurrences(docs: DataFrame, site: str, min_chars: int) -> DataFrame:
    """(h1, h2, doc_id, nameless, site) for each line that counts."""
    lines = docs.select("doc_id", nameless(), F.col(site).cast("string").alias("site"), F.explode(_lines(F.col("text"))).alias("line"))
    kept = lines.where(F.char_length(F.btrim("line")) >= min_chars)
    return kept.select(line_key(F.col("line")).alias("k"), "doc_id", "nameless", "site").select("k.h1", "k.h2", "doc_id", "nameless", "site")


def boilerplate(docs: DataFrame, *, site: str = "source", min_sites: int = 10, min_chars: int = 10) -> tuple[DataFrame, DataFrame]:
    """(lines: h1, h2, first_doc, first_nameless, n, n_sites; occurrences of lines that are frequent).
    n_sites is exact near the limit, else the sketch's estimate."""
    rows = occurrences(docs, site, min_chars)
    frequent = cut(rows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_sites))
    rows = cut(join_split(rows, frequent, ["h1", "h2"], ["doc_id", "nameless", "site"]))
    sketched = cut(rows.groupBy("h1", "h2").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("n_sites"), F.min("doc_id").alias("first_doc"), F.min("nameless").alias("first_nameless"), F.first("n").alias("n")))
    near = sketched.where(F.col("n_sites").between(min_sites * (1 - NEAR), min_sites * (1 + NEAR)))
    exact = join_split(rows.drop("n"), near.select("h1", "h2", "n"), ["h1", "h2"], ["doc_id", "nameless", "site"]).groupBy("h1", "h2").agg(F.count_distinct("site").alias("exact"))
    lines = sketched.join(exact, ["h1", "h2"], "left").withColumn("n_sites", F.coalesce("exact", "n_sites")).drop("exact")
    return cut(lines.where(F.col("n_sites") >= min_sites)), rows


def dedup_lines(docs: DataFrame, *, site: str = "source", min_sites: int = 10, min_chars: int = 10) -> DataFrame:
    """``docs`` with ``text`` rewritten and ``lines_removed`` added."""
    lines, rows = boilerplate(docs, site=site, min_sites=min_sites, min_chars=min_chars)
    first = F.when(F.col("first_doc").isNotNull(), F.col("doc_id").eqNullSafe(F.col("first_doc"))).otherwise(F.col("nameless") == F.col("first_nameless"))
    gone = join_split(rows.drop("n"), lines, ["h1", "h2"], ["doc_id", "nameless", "site"]).where(~first)
    own = docs.drop("lines_removed")
    d, t, g, k = unused(own, "_d", "_t", "_gone", "_kept")
    gone = gone.groupBy(F.col("doc_id").alias(d), F.col("nameless").alias(t)).agg(F.collect_set("h1").alias(g))
    out = own.join(gone, own["doc_id"].eqNullSafe(gone[d]) & nameless().eqNullSafe(gone[t]), "left")
    # the hash alone marks a line among those of its own document
    keep = F.filter(_lines(F.col("text")), lambda x: (F.char_length(F.btrim(x)) < min_chars) | ~F.array_contains(g, F.xxhash64(F.btrim(x))))
    out = out.withColumn(k, F.when(F.col(g).isNotNull() & F.col("text").isNotNull(), keep))
    removed = F.coalesce(F.size(_lines(F.col("text"))) - F.size(k), F.lit(0)).alias("lines_removed")
    text = F.coalesce(F.array_join(k, "\n"), F.col("text")).alias("text")
    left = F.col(k).isNull() | (F.btrim(F.array_join(k, "\n"), F.lit(" \t\r\n")) != "")
    return out.where(left).select(*[text if c == "text" else F.col(f"`{c}`") for c in own.columns], removed)
