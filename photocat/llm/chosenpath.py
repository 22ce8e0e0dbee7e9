"""N-gram Jaccard join of documents by chosen paths.

Documents with the same words in the same order form a class; classes are
compared. A class is a set of tokens (position, value) of a MinHash signature
over its word shingles: two sets share a position with the probability of their
Jaccard similarity.

Search. In each run every set starts in one bucket, which is split on sampled
tokens: a bucket's path draws one position, or two in a quarter of the cases
(1/0.8 on average), and sets with the same value there go on together. Buckets
with one set end. Small ones are compared by brute force, in one task. In a
large one, all sets are compared with its first: those that are similar to it
leave with a candidate link to it, which loses no group, since Jaccard distance
is a metric (what is within 0.2 of one that leaves is within 0.6 of the first,
and linked to it too, in this run or another); the rest is split again. Buckets
that are still large at the last depth are compared in pairs of blocks. Below
the first split, and in all comparisons, a token is its lowest byte, so a row of
a bucket is 64 bytes. Some runs are probes: the share of their links that the
other runs' groups know is the recall, and searches repeat with new runs until
it meets the target; if it does not after many, the join fails and says so.

Check. Candidate links join classes to groups; within a group, all pairs are
compared by exact Jaccard similarity of their shingle sets, in pairs of blocks
of bounded rows and words where the group is large. No pair is emitted: each
block gives sums of links and one link per class to the least class it reaches
there. Tables of a search are deleted when they are read.

Edge cases. Null or wordless text: a class of its own without links. Fewer
words than a shingle has: one shingle of all. Null doc_id: takes part under the
least id and is shown as null. Repeated rows: copies of one class. Ties: the
smallest doc_id represents. Very long texts: hashed in pieces; a block holds few
of them. Empty table: no rows. Other columns, whatever their names: ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles as S
from .common import components, cut, discard, few, join_split, unused

WORDS, SIMILARITY = 5, 0.8
#: Tokens of a signature, and the share of equal ones from which a pair is a
#: candidate: 5 standard errors below the similarity.
POSITIONS, CANDIDATE = 64, 0.55
#: The share from which a set leaves with the first of a large bucket, and the
#: one from which it is linked to it: 2 standard errors below the similarity of
#: 0.4 that a neighbour of a set that leaves has to the first.
SAME, NEAR = 0.7, 0.28
#: Sets of a bucket that is compared by brute force, of one that is split twice
#: in a step, and the most steps of splitting.
SMALL, HUGE, DEPTH = 2048, 32_768, 12
#: Runs of a search, runs that probe its recall, the target and the searches
#: after which it must be met.
RUNS, PROBES, RECALL, SEARCHES = 8, 2, 0.995, 8
#: Classes and words of a block of exact comparison; a longer text is a block.
BLOCK, BLOCK_WORDS = 512, 500_000
#: Pairs of sets, and words of texts, that count as a row where tasks are dealt.
ROW_PAIRS, ROW_WORDS = 400, 20
NULL_ID = -(2**63)

_MULTIPLY = S.mix(np.arange(1, POSITIONS + 1, dtype=np.uint64)) | np.uint64(1)
_ADD = S.mix(np.arange(1001, POSITIONS + 1001, dtype=np.uint64))


def _signatures(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """POSITIONS minimums for each text; texts without shingles have none."""
    out = np.full((len(counts), POSITIONS), np.iinfo(np.uint32).max, np.uint32)
    full = np.flatnonzero(counts)
    if len(full):
        starts = np.concatenate([[0], np.cumsum(counts[full])])[:-1]
        for i in range(POSITIONS):
            out[full, i] = np.minimum.reduceat((values * _MULTIPLY[i] + _ADD[i]) >> np.uint64(32), starts)
    return out


def _sequence_keys(hashed: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for the sequence of words of each text."""
    first = np.concatenate([[0], np.cumsum(counts)])[:-1]
    place = (np.arange(len(hashed)) - np.repeat(first, counts)).astype(np.uint64)
    keys = []
    for salt in (1, 2):
        spread = S.mix(hashed * S.mix(place * np.uint64(2) + np.uint64(salt << 40)) + place)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(spread, dtype=np.uint64)])
        keys.append(S.mix(total[first + counts] - total[first]).view(np.int64))
    return keys[0], keys[1]


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text")
        for a, b in S.chunks(texts):
            hashed, counts = S.words(texts.slice(a, b - a))
            k1, k2 = _sequence_keys(hashed, counts)
            values, n = S.shingles(hashed, counts, WORDS)
            signature = _signatures(values, n)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row").slice(a, b - a), batch.column("doc_id").slice(a, b - a), pa.array(k1), pa.array(k2), pa.array(counts), S.binary_rows(signature), S.binary_rows(signature.astype(np.uint8))],
                names=["row", "doc_id", "k1", "k2", "n_words", "signature", "sketch"])


def signed(docs: DataFrame) -> DataFrame:
    """(row, doc_id, k1, k2, n_words, signature, sketch), written; sketch: the lowest bytes of the signature."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), "text")
    return cut(rows.mapInArrow(_signed, "row long, doc_id long, k1 long, k2 long, n_words long, signature binary, sketch binary"))


def _split(rows: DataFrame, column: str, width: int) -> DataFrame:
    """(path, probe, cls, sketch) of the next depth, by values of ``width`` bytes in ``column``."""
    place = lambda i: F.pmod(F.xxhash64("path", F.lit(i)), F.lit(POSITIONS)).cast("int")
    value = lambda p: F.xxhash64("path", p, F.substring(F.col(column), p * width + 1, F.lit(width)))
    one, two = place(1), place(2)
    paths = F.when((F.pmod(F.xxhash64("path", F.lit(3)), F.lit(4)) == 0) & (one != two), F.array(value(one), value(two))).otherwise(F.array(value(one)))
    return rows.select(F.explode(paths).alias("path"), "probe", "cls", *(["sketch"] if "sketch" in rows.columns else []))


def _alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=-1)


def _with_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            like = _alike(*(S.fixed_bytes(batch.column(c), np.uint8, POSITIONS) for c in ("sketch", "first_sketch")))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("path", "probe", "cls", "sketch", "n", "first")), pa.array(like)], names=["path", "probe", "cls", "sketch", "n", "first", "alike"])


def _candidates(sketch: np.ndarray) -> np.ndarray:
    """The matrix of candidate pairs of a bucket."""
    return np.stack([_alike(sketch, x) >= CANDIDATE for x in sketch])


def _brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate links of buckets: each set to the least that it reaches."""
    for table, bounds in S.whole_groups(batches, ["path"]):
        cls, sketch = table.column("cls").to_numpy(), S.fixed_bytes(table.column("sketch"), np.uint8, POSITIONS)
        probe = table.column("probe").to_numpy(zero_copy_only=False)
        sizes = np.diff(bounds)
        two = bounds[:-1][sizes == 2]
        hit = two[_alike(sketch[two], sketch[two + 1]) >= CANDIDATE]
        a, b = [hit], [hit + 1]
        for lo, hi in zip(bounds[:-1][sizes > 2], bounds[1:][sizes > 2], strict=True):
            root = S.local_roots(_candidates(sketch[lo:hi]))
            away = np.flatnonzero(root != np.arange(len(root)))
            a.append(lo + away)
            b.append(lo + root[away])
        a, b = np.concatenate(a), np.concatenate(b)
        yield pa.RecordBatch.from_arrays([pa.array(cls[a]), pa.array(cls[b]), pa.array(probe[a])], names=["a", "b", "probe"])


def _compared(buckets: DataFrame, rows: int) -> DataFrame:
    """Links (a, b, probe) of the sets in each bucket; ``rows``: what the work counts as."""
    dealt = few(buckets.select("path", "probe", "cls", "sketch").repartition("path"), rows)
    return dealt.sortWithinPartitions("path").mapInArrow(_brute, "a long, b long, probe boolean")


def candidate_links(classes: DataFrame, first_run: int = 0) -> DataFrame:
    """(a, b, probe) of classes, written; from RUNS runs, and PROBES with probe set."""
    runs = F.explode(F.array(*[F.lit(first_run + i) for i in range(RUNS + PROBES)])).alias("run")
    rows = classes.select(runs, "cls", "signature").select(F.xxhash64("run", F.lit("root")).alias("path"), (F.col("run") >= first_run + RUNS).alias("probe"), "cls", "signature")
    found, used, rows = [], [], _split(rows, "signature", 4)
    small, work, links, n_classes = [], 0, 0, classes.count()
    held = n_classes * (RUNS + PROBES)
    sketches = classes.select("cls", "sketch")
    for depth in range(DEPTH + 1):
        sizes = cut(few(rows.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min("cls").alias("first")).where("n > 1"), held))
        n, low = F.col("n"), F.col("n") <= SMALL
        total, most, pairs = (x or 0 for x in sizes.agg(F.sum(n), F.max(n), F.sum(F.when(low, n * n))).first())
        sized = few(join_split(rows, sizes, ["path"], ["cls"], counted=(total, most)), held)
        sized = cut(few(sized.join(sketches, "cls"), max(total, n_classes)) if depth == 0 else sized)
        used += [sizes, sized]
        small.append(sized.where(low))
        work, links = work + total + pairs // ROW_PAIRS, links + total
        if most <= SMALL:
            break
        large = sized.where(~low)
        firsts = cut(few(large.where("cls = first").select("path", F.col("sketch").alias("first_sketch"), "n").dropDuplicates(["path"]), total // SMALL))
        large = few(join_split(large.drop("n"), firsts, ["path"], ["cls"]), total).mapInArrow(_with_first, "path long, probe boolean, cls long, sketch binary, n long, first long, alike double")
        large = cut(large.where("cls <> first"))
        used += [firsts, large]
        found.append(large.where(F.col("alike") >= NEAR).select(F.col("cls").alias("a"), F.col("first").alias("b"), "probe"))
        rest = large.where(F.col("alike") < SAME)
        if depth == DEPTH:
            left = cut(few(rest.groupBy("path").agg(F.count(F.lit(1)).alias("n")), total // SMALL))
            used.append(left)
            pairs = left.agg(F.sum(n * n)).first()[0] or 0
            blocks = _block_pairs(join_split(rest.drop("n"), left, ["path"], ["cls"]).withColumn("blocks", F.ceil(F.col("n") / (SMALL // 2)).cast("int")), "cls")
            found.append(_compared(blocks.select(F.xxhash64("path", "lo", "hi").alias("path"), "probe", "cls", "sketch"), total + 4 * pairs // ROW_PAIRS))
        split = lambda x: _split(x, "sketch", 1)
        rows, held = split(rest.where(n <= HUGE)).union(split(split(rest.where(n > HUGE)))), total
    # the small buckets of all depths are compared together
    out = _compared(reduce(DataFrame.union, [x.select("path", "probe", "cls", "sketch") for x in small]), work)
    out = cut(few(reduce(DataFrame.union, [out, *found]).distinct(), links))
    discard(*used)
    return out


def _block_pairs(rows: DataFrame, key: str) -> DataFrame:
    """Each row once for every pair of blocks (lo <= hi) that its block is in; ``blocks`` is the group's number of them."""
    own = rows.withColumn("block", F.pmod(F.xxhash64(key, F.lit("block")), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    return own.select("*", other).withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))


def candidate_groups(classes: DataFrame) -> DataFrame:
    """(id, root), written: classes with a candidate link, by groups of them."""
    links = candidate_links(classes)
    n = links.count()
    groups = components(links.where("not probe").select("a", "b"), n)
    for search in range(1, SEARCHES + 1):
        one, two = groups.select(F.col("id").alias("a"), F.col("root").alias("ra")), groups.select(F.col("id").alias("b"), F.col("root").alias("rb"))
        met = few(few(links.where("probe").join(one, "a", "left"), n).join(two, "b", "left"), n)
        state = cut(met.select("a", "b", F.coalesce(F.col("ra") == F.col("rb"), F.lit(False)).alias("known")))
        discard(links)
        known, total = state.agg(F.count_if("known"), F.count(F.lit(1))).first()
        if known == total:
            discard(state)
            return groups
        good = known >= RECALL * total
        if not good and search == SEARCHES:
            raise RuntimeError(f"after {SEARCHES} searches the recall is {known / total:.4f}, and {RECALL} is asked for")
        grown = groups.select(F.col("id").alias("a"), F.col("root").alias("b")).union(state.where("not known").select("a", "b"))
        if not good:
            links = candidate_links(classes, search * (RUNS + PROBES))
            n += links.count()
            grown = grown.union(links.where("not probe").select("a", "b"))
        before, groups = groups, components(grown, 2 * n)
        discard(before, state)
        if good:
            return groups
    return groups


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text")
        for a, b in S.chunks(texts):
            hashed, counts = S.words(texts.slice(a, b - a))
            k1, k2 = _sequence_keys(hashed, counts)
            values, n = S.shingles(hashed, counts, WORDS)
            sets = [np.unique(x) for x in np.split(values, np.cumsum(n)[:-1])] if len(n) else []
            ends = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
            flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(k1), pa.array(k2), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["k1", "k2", "shingles"])


def overlaps(flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets, as a matrix."""
    n = len(ends) - 1
    owner = np.repeat(np.arange(n), np.diff(ends))
    order = np.argsort(flat, kind="stable")
    value, owner = flat[order], owner[order]
    new = np.concatenate([[True], value[1:] != value[:-1]]) if len(value) else np.zeros(0, bool)
    column = np.cumsum(new) - 1
    often = np.bincount(column) > 1 if len(column) else np.zeros(0, bool)
    renumbered = np.cumsum(often) - 1
    keep = often[column]
    owner, column = owner[keep], renumbered[column[keep]]
    out = np.zeros((n, n), np.float32)  # whole numbers below 2**24 are exact, and larger ones near enough to any share
    for lo in range(0, int(often.sum()), 4096):  # a shared shingle is one column
        a, b = np.searchsorted(column, [lo, lo + 4096])
        has = np.zeros((n, 4096), np.float32)
        has[owner[a:b], column[a:b] - lo] = 1
        out += has @ has.T
    return out


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each class of a pair of blocks that has links there: the copies it is
    linked to, and the least class that it reaches."""
    for table, bounds in S.whole_groups(batches, ["root", "lo", "hi"]):
        cls, copies, block, lo, hi = (table.column(c).to_numpy() for c in ("cls", "copies", "block", "lo", "hi"))
        flat, ends = S.list_values(table.column("shingles"))
        size = np.diff(ends)
        out: list[list] = [[], [], []]
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            _, at = np.unique(cls[a:b], return_index=True)
            at = at + a
            both = np.concatenate([flat[ends[i] : ends[i + 1]] for i in at])
            shared = overlaps(both, np.concatenate([[0], np.cumsum(size[at])]))
            union = size[at][:, None] + size[at][None, :] - shared
            linked = shared >= SIMILARITY * union - 1e-9
            np.fill_diagonal(linked, False)
            if lo[a] != hi[a]:  # pairs within a block have a task of their own
                linked &= block[at][:, None] != block[at][None, :]
            add = linked @ copies[at]
            root = S.local_roots(linked)
            own = np.flatnonzero(add)
            for x, y in zip(out, (cls[at][own], add[own], cls[at][root[own]]), strict=True):
                x.append(y)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in out], names=["cls", "linked", "least"])


def jaccard_join(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, n_links, group_id, kept): a row for each document.

    class_id: smallest doc_id with the same words. n_links: other documents of
    similarity 0.8 or more. group_id: smallest doc_id that links reach. kept:
    the document is that one.
    """
    rows = signed(docs)
    n = rows.count()
    named = rows.where("n_words > 0").groupBy("k1", "k2").agg(F.min("row").alias("cls"), F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("copies"), F.first("n_words").alias("words"))
    all_classes = cut(few(named, n))
    classes = cut(few(rows.select(F.col("row").alias("cls"), "signature", "sketch").join(all_classes.select("cls"), "cls"), n))
    groups = candidate_groups(classes)
    discard(classes)
    grouped = few(groups.join(all_classes, F.col("id") == F.col("cls")).select("root", "cls", "class_id", "copies", "words", "k1", "k2"), n)
    sizes = cut(few(grouped.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum("words").alias("words_of_all")), n))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("words_of_all") / BLOCK_WORDS)).cast("int").alias("blocks")
    total, most, words = (x or 0 for x in sizes.agg(F.sum("n"), F.max("n"), F.sum(F.col("words_of_all") * blocks)).first())
    members = cut(few(join_split(grouped, sizes, ["root"], ["cls"], counted=(total, most)).select("root", blocks, "cls", "class_id", "copies", "k1", "k2"), total))
    wanted = members.select(F.col("class_id").alias("_id")).distinct()
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("_id"), "text").join(wanted, "_id", "left_semi")
    sets = own.select("text").mapInArrow(_sets, "k1 long, k2 long, shingles array<long>")
    work = total + words // ROW_WORDS
    pairs = _block_pairs(sets.join(members, ["k1", "k2"]).select("root", "blocks", "cls", "copies", "shingles"), "cls")
    pairs = few(pairs.select("root", "lo", "hi", "block", "cls", "copies", "shingles").repartition("root", "lo", "hi"), work).sortWithinPartitions("root", "lo", "hi")
    links = cut(pairs.mapInArrow(_exact, "cls long, linked long, least long"))
    linked = links.count()
    discard(groups, sizes, members)
    sums = few(links.groupBy("cls").agg(F.sum("linked").alias("linked")), linked)
    exact = components(links.select(F.col("cls").alias("a"), F.col("least").alias("b")), linked)
    reached = cut(few(exact.join(all_classes.select("cls", "class_id"), F.col("id") == F.col("cls")).select("cls", "root", "class_id"), n))
    least = cut(few(reached.groupBy("root").agg(F.min("class_id").alias("group_id"), F.count(F.lit(1)).alias("n")), n))
    placed = few(join_split(reached.select("cls", "root"), least, ["root"], ["cls"]).select("cls", "group_id"), n)
    result = few(all_classes.join(sums, "cls", "left"), n).join(placed, "cls", "left")
    result = cut(few(result, n).select("k1", "k2", "class_id", F.coalesce("group_id", "class_id").alias("group_id"), (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.col("copies").alias("n")))
    discard(all_classes, links, exact, reached, least)
    out = few(join_split(rows.select("row", "doc_id", "k1", "k2", "n_words"), result, ["k1", "k2"], ["row"], how="left"), n)
    some = F.col("n_words") > 0
    class_id, group_id = F.when(some, F.col("class_id")).otherwise(F.col("doc_id")), F.when(some, F.col("group_id")).otherwise(F.col("doc_id"))
    shown = lambda c: F.nullif(c, F.lit(NULL_ID))
    return out.select(
        shown(F.col("doc_id")).alias("doc_id"), shown(class_id).alias("class_id"), F.when(some, F.col("n_links")).otherwise(0).cast("long").alias("n_links"),
        shown(group_id).alias("group_id"), (F.col("doc_id") == group_id).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` without the documents that are not the first of their group. An
    id whose rows differ stays if one of them is to stay; rows without an id stay."""
    own, = unused(docs, "_gone")
    gone = jaccard_join(docs).groupBy("doc_id").agg(F.bool_or("kept").alias("stays")).where("not stays").select(F.col("doc_id").alias(own))
    return docs.join(gone, docs["doc_id"] == gone[own], "left_anti")
