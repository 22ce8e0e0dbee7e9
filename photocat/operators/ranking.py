"""Search: filters, blended rank, collapse of duplicates, cap per class, limit."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema
from ..functions.scalars import archive_mode, dot
from ..lineage import cut
from .vectors import FEW, Cells, candidate_depth, knn_batch

# Fixed values of ranking.
QUALITY_CENTRE, QUALITY_SCALE, TASTE_SCALE = 5.0, 0.02, 0.005
SOURCE_PRIOR = {"pro": 0.0, "unknown": -0.01, "archive": -0.01, "amateur": -0.03}
DUPLICATE_COSINE, ARCHIVE_CAP, MAX_LIMIT = 0.97, 2, 100

#: Matches of a query that are collapsed at once, rows of a block of that, and
#: queries whose parameters go to the tasks at once where all images are filtered first.
BLOCK, GREEDY, QUERIES = MAX_LIMIT * 50, 256, 100

QUERY_SCHEMA = (
    "query_id long, query_text string, query_vec array<float>, limit int, date_from string, date_to string, folder_pattern string, tags array<string>, min_quality double,"
    " min_long_edge int, quality_weight double, dedupe boolean, sources array<string>, archive string, taste_weight double")
QUERY_COLUMNS = [tuple(x.strip().rsplit(" ", 1)) for x in QUERY_SCHEMA.split(",")]
RESULT = (
    "image_id", "filepath", "similarity", "filename", "folder", "date_taken", "camera_model", "width", "height", "long_edge_px", "aesthetic_score", "source_class",
    "rotation_fix", "taste_score", "rank_score", "duplicate_ids")


@dataclass(frozen=True)
class SearchParams:
    """One search. ``mode``: "candidates" filters the nearest ones only, so it
    may return fewer rows than match; "prefilter" ranks all rows that match."""

    query_vec: tuple[float, ...]
    query_text: str | None = None
    limit: int = 10
    date_from: str | None = None
    date_to: str | None = None
    folder_pattern: str | None = None
    tags: tuple[str, ...] | None = None
    min_quality: float | None = None
    min_long_edge: int | None = None
    quality_weight: float | None = 0.0
    dedupe: bool = True
    sources: tuple[str, ...] | None = None
    archive: str | None = "auto"
    taste_weight: float | None = 1.0


@dataclass(frozen=True)
class SearchOptions:
    """How searches run, the same for all of a batch."""

    mode: str = "candidates"
    similarity_threshold: float = 0.0
    date_to_whole_day: bool = False
    max_limit: int = MAX_LIMIT
    columns: tuple[str, ...] = field(default=RESULT)


def queries_frame(spark: SparkSession, searches: list[SearchParams]) -> DataFrame:
    for s in searches:
        if s.limit < 0:
            raise ValueError("limit is negative")
        if s.sources and set(s.sources) == {"archive"} and s.archive == "exclude":
            raise ValueError("sources asks for the archive only and archive excludes it")
    rows = [(i, s.query_text, [float(x) for x in s.query_vec], s.limit, s.date_from, s.date_to, s.folder_pattern, list(s.tags) if s.tags else None, s.min_quality, s.min_long_edge,
             s.quality_weight, s.dedupe, list(s.sources) if s.sources else None, s.archive, s.taste_weight) for i, s in enumerate(searches)]
    return schema.few_rows(spark, rows, QUERY_COLUMNS)


def normalized(queries: DataFrame) -> DataFrame:
    """Nulls of a service's arguments as their defaults; mode_archive added."""
    some = lambda c: F.when(F.size(c) > 0, F.col(c))
    out = queries.withColumns({
        "limit": F.coalesce("limit", F.lit(10)), "quality_weight": F.coalesce("quality_weight", F.lit(0.0)), "taste_weight": F.coalesce("taste_weight", F.lit(1.0)),
        "archive": F.coalesce("archive", F.lit("auto")), "dedupe": F.coalesce("dedupe", F.lit(True)), "sources": some("sources"), "tags": some("tags")})
    return out.withColumn("archive_mode", archive_mode(F.col("archive"), F.col("query_text")))


def passes(options: SearchOptions, asked_for: Callable[[str], Column] = F.col) -> Column:
    """The predicates of a search over columns of an image and of its query, which
    ``asked_for`` names; a predicate that is not asked for passes, a null value
    fails one that is."""
    of = asked_for
    taken = F.date_format("date_taken", "yyyy-MM-dd'T'HH:mm:ss")
    last = F.when(F.length(of("date_to")) == 10, F.concat(of("date_to"), F.lit("T23:59:59"))).otherwise(of("date_to")) if options.date_to_whole_day else of("date_to")
    pattern = F.concat(F.lit("%"), F.replace(of("folder_pattern"), F.lit("\\"), F.lit("\\\\")), F.lit("%"))
    wanted = F.when(of("archive_mode") == "only", F.array(F.lit("archive"))).when(
        of("archive_mode") == "exclude", F.filter(F.coalesce(of("sources"), F.array(*[F.lit(c) for c in ("pro", "archive", "amateur", "unknown")])), lambda c: c != "archive")).otherwise(of("sources"))

    def asked(given: str, test: Column) -> Column:
        blank = of(given).isNull() if given not in ("date_from", "date_to", "folder_pattern") else F.coalesce(of(given), F.lit("")) == ""
        return blank | F.coalesce(test, F.lit(False))

    return (
        asked("date_from", taken >= of("date_from")) & asked("date_to", taken <= last) & asked("folder_pattern", F.call_function("ilike", F.col("folder"), pattern))
        & (wanted.isNull() | F.coalesce(F.array_contains(wanted, F.col("source_class")), F.lit(False)))
        & asked("min_quality", F.col("aesthetic_score") >= of("min_quality")) & asked("min_long_edge", F.col("long_edge_px") >= of("min_long_edge")))


def quality_blend() -> Column:
    score, weight = F.col("aesthetic_score"), F.col("quality_weight")
    return F.when((weight <= 0) | score.isNull(), F.col("similarity")).otherwise(F.col("similarity") + weight * QUALITY_SCALE * (score - QUALITY_CENTRE))


def source_prior() -> Column:
    prior = F.lit(0.0)
    for name, value in SOURCE_PRIOR.items():
        prior = F.when(F.col("source_class") == name, value).otherwise(prior)
    free = (F.col("source_class") == "archive") & F.col("archive_mode").isin("include", "only")
    return F.when(F.col("sources").isNotNull() | F.coalesce(free, F.lit(False)), 0.0).otherwise(prior)


def taste_term() -> Column:
    return F.coalesce(F.lit(TASTE_SCALE) * F.col("taste_weight") * F.col("taste_score"), F.lit(0.0))


def rank_score() -> Column:
    return quality_blend() + source_prior() + taste_term()


def with_tags(rows: DataFrame, image_tags: DataFrame | None, tags: DataFrame | None) -> DataFrame:
    """Rows of queries without tags, and those whose image has one of its query's."""
    plain = rows.where("tags is null")
    if image_tags is None or tags is None:
        return plain
    named = image_tags.join(tags, "tag_id").select("image_id", "tag_name")
    asked = rows.where("tags is not null").withColumn("_tag", F.explode(F.array_distinct("tags")))
    hit = asked.join(named, (asked["image_id"] == named["image_id"]) & (asked["_tag"] == named["tag_name"])).select("query_id", asked["image_id"]).distinct()
    return plain.unionByName(rows.where("tags is not null").join(hit, ["query_id", "image_id"], "left_semi").select(*rows.columns))


def greedy_owners(x: np.ndarray, settled: int, threshold: float) -> np.ndarray:
    """For rows in order of rank: the kept row that each belongs to, itself if it is
    kept. The first ``settled`` are kept already. A row is kept unless a kept one
    before it is as similar as ``threshold``; it belongs to the most similar of
    those, the first among equals.

    Blocks are compared with all that is kept as one product. In a block, rows like
    none of its others are kept at once, and only those that are like one go in order.
    """
    owner = np.arange(len(x))
    kept = list(range(settled))
    for lo in range(settled, len(x), GREEDY):
        own = np.arange(lo, min(lo + GREEDY, len(x)))
        like = x[own] @ x[kept].T if kept else np.zeros((len(own), 0))
        free = ~(like >= threshold).any(axis=1)
        among = x[own] @ x[own].T >= threshold
        np.fill_diagonal(among, False)
        among &= free[:, None] & free[None, :]  # a row that is not kept drops none
        stays = free.copy()
        for i in np.flatnonzero(among.any(axis=1)):
            stays[i] = not (among[i, :i] & stays[:i]).any()
        new = own[stays]
        before = len(kept)
        kept.extend(new.tolist())
        gone = np.flatnonzero(~stays)
        if len(gone):
            like = np.concatenate([like[gone], x[own[gone]] @ x[new].T], axis=1)
            like[:, before:][new[None, :] >= own[gone][:, None]] = -np.inf  # only what stands before it
            owner[own[gone]] = np.asarray(kept)[like.argmax(axis=1)]
    return owner


def collapse_duplicates(ranked: DataFrame, kept: DataFrame | None = None, threshold: float = DUPLICATE_COSINE) -> DataFrame:
    """(query_id, image_id, place, owner). Within each query, in order of rank
    (query_id, image_id, place, embedding, dedupe): a row as similar as
    ``threshold`` to a kept one belongs to the most similar of those, any other
    is kept and its own owner. ``kept``: rows of the same columns that stand
    before all of ``ranked``; they are not in the result. A group is one query's
    block, BLOCK at most, and what was kept before it."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["new", "place"], ignore_index=True)
        ids, owner = frame["image_id"].to_numpy(), frame["image_id"].to_numpy().copy()
        some = np.flatnonzero(frame["embedding"].notna().to_numpy())
        if bool(frame["dedupe"].iloc[0]) and len(some):
            new = frame["new"].to_numpy(bool)[some]
            x = np.stack(frame["embedding"].to_numpy()[some]).astype(np.float64)
            owner[some] = ids[some[greedy_owners(x, int((~new).sum()), threshold)]]
        out = frame[["query_id", "image_id", "place"]].copy()
        out["owner"] = owner
        return out[frame["new"]]

    own = ("query_id", "image_id", "place", "embedding", "dedupe")
    rows = ranked.select(*own, F.lit(True).alias("new"))
    if kept is not None:
        rows = rows.union(kept.select(*own, F.lit(False).alias("new")))
    return rows.groupBy("query_id").applyInPandas(run, "query_id long, image_id string, place long, owner string")


def collapsed(rows: DataFrame, threshold: float = DUPLICATE_COSINE) -> DataFrame:
    """``rows`` of queries (query_id, image_id, place, embedding, dedupe and others) that
    are kept, without their vectors and with ``duplicate_ids``: the rows that
    ``collapse_duplicates`` gives to each, in order of rank. A group is the
    candidates of one query, BLOCK at most."""
    columns = [f for f in rows.schema.fields if f.name not in ("embedding", "duplicate_ids")]
    shape = T.StructType([*columns, T.StructField("duplicate_ids", T.ArrayType(T.StringType()))])

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.argsort(table.column("place").to_numpy(), kind="stable")))
        ids, owner = table.column("image_id").to_pylist(), np.arange(table.num_rows)
        if table.num_rows and table.column("dedupe")[0].as_py():
            vectors = table.column("embedding").combine_chunks()
            some = np.flatnonzero(vectors.is_valid().to_numpy(zero_copy_only=False))
            if len(some):
                x = np.asarray([vectors[i].values.to_numpy(zero_copy_only=False) for i in some.tolist()], np.float64)
                owner[some] = some[greedy_owners(x, 0, threshold)]
        kept = np.flatnonzero(owner == np.arange(len(owner)))
        twins = {int(i): [] for i in kept}
        for i in np.flatnonzero(owner != np.arange(len(owner))):
            twins[int(owner[i])].append(ids[i])
        out = table.take(pa.array(kept)).select([f.name for f in columns])
        return out.append_column("duplicate_ids", pa.array([twins[int(i)] for i in kept], pa.list_(pa.string())))

    return rows.groupBy("query_id").applyInArrow(run, shape)


def _capped() -> Column:
    """Whether only ARCHIVE_CAP pictures of the archive may stay."""
    return F.coalesce((F.col("archive_mode") == "capped") & F.col("sources").isNull() & (F.col("source_class") == "archive"), F.lit(False))


def _under_cap(kept: DataFrame) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id", "source_class").orderBy("place"))
    return kept.withColumn("_n", rank).where(~_capped() | (F.col("_n") <= ARCHIVE_CAP)).drop("_n")


def _best_blocks(rows: DataFrame, vectors: DataFrame) -> DataFrame:
    """(query_id, image_id, place, owner) of the best matches of each query: blocks
    of BLOCK matches, best first, are collapsed against what was kept before
    them, until a query has as many results as it asks for or no match is left."""
    rows = cut(rows)
    order = Window.partitionBy("query_id").orderBy(F.desc("rank_score"), "image_id")
    left, kept, found, at = rows, None, None, 0
    while True:
        block = cut(left.withColumn("place", F.row_number().over(order)).where(F.col("place") <= BLOCK).withColumn("place", (F.col("place") + at).cast("long")).join(vectors, "image_id"))
        placed = cut(collapse_duplicates(block, kept))
        found = placed if found is None else found.union(placed)
        stay = block.join(placed.where("owner = image_id").select("query_id", "image_id"), ["query_id", "image_id"])
        kept = cut(stay if kept is None else kept.unionByName(stay))
        at += BLOCK
        results = _under_cap(kept).groupBy("query_id").agg(F.count(F.lit(1)).alias("results"))
        ends = block.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max_by(F.struct("rank_score", "image_id"), "place").alias("last"), F.first("limit").alias("asks"))
        going = cut(ends.join(results, "query_id", "left").where((F.col("n") == BLOCK) & (F.coalesce("results", F.lit(0)) < F.col("asks"))).select("query_id", "last"))
        if going.isEmpty():
            return found
        after = (F.col("rank_score") < F.col("last.rank_score")) | ((F.col("rank_score") == F.col("last.rank_score")) & (F.col("image_id") > F.col("last.image_id")))
        left = rows.join(going, "query_id").where(after).drop("last")


def search_batch(images: DataFrame, embeddings: DataFrame, queries: DataFrame, image_tags: DataFrame | None = None, tags: DataFrame | None = None,
                 options: SearchOptions = SearchOptions(), thumbnails: DataFrame | None = None, cells: Cells | None = None) -> DataFrame:
    """Results of all ``queries`` (QUERY_SCHEMA): query_id, place and RESULT.
    ``cells``: an approximate index that candidates are taken from."""
    images = schema.evolve_schema(images)
    asked = normalized(queries).withColumn("limit", F.least("limit", F.lit(options.max_limit)))
    vectors = embeddings.where("embedding is not null").select("image_id", "embedding")
    wide = images.select(*[c for c in images.columns if c in RESULT])
    asked = _at_hand(asked) if options.mode == "candidates" else asked
    params = asked.drop("query_vec")
    if options.mode == "candidates":
        deeper = (F.col("min_quality").isNotNull() | F.col("min_long_edge").isNotNull() | (F.col("quality_weight") > 0) | F.col("sources").isNotNull() | F.col("archive").isin("only", "exclude"))
        depth = candidate_depth(F.col("limit"), deeper, F.lit(1 << 30), options.max_limit)
        asks = asked.withColumn("k", depth)
        nearest = (knn_batch(vectors, asks, F.col("k")) if cells is None else cells.nearest(asks, F.col("k"))).drop("rank")
        rows = nearest.where(F.col("similarity") >= options.similarity_threshold).join(wide, "image_id").join(params, "query_id").where(passes(options))
        rows = with_tags(cut(rows), image_tags, tags) if _any_tags(asked) else rows
        order = Window.partitionBy("query_id").orderBy(F.desc("rank_score"), "image_id")
        rows = rows.withColumn("rank_score", rank_score()).withColumn("place", F.row_number().over(order))  # at most BLOCK for each query
        rows = _under_cap(collapsed(rows.join(vectors, "image_id")))
    else:
        rows = _matching(wide, vectors, asked, image_tags, tags, options).where(F.col("similarity") >= options.similarity_threshold)
        rows = cut(rows.withColumn("rank_score", rank_score()))
        placed = _best_blocks(rows, vectors)
        twins = F.collect_list(F.when(F.col("owner") != F.col("image_id"), F.struct("place", "image_id")))
        kept = placed.groupBy("query_id", F.col("owner").alias("image_id")).agg(F.min("place").alias("place"), F.transform(F.array_sort(twins), lambda x: x["image_id"]).alias("duplicate_ids"))
        rows = _under_cap(rows.join(kept, ["query_id", "image_id"]))
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("place"))).where(F.col("place") <= F.col("limit"))
    rows = rows.withColumns({"aesthetic_score": F.round("aesthetic_score", 2), "taste_score": F.round("taste_score", 2)})
    columns = ["query_id", "place", *options.columns]
    if thumbnails is not None:
        rows = rows.join(thumbnails.select("image_id", F.col("path").alias("thumbnail_path")), "image_id", "left")
        columns.append("thumbnail_path")
    return rows.select(*columns)


def _at_hand(asked: DataFrame) -> DataFrame:
    """The queries as a local table if they are few, so that what follows does not
    derive them again; else as they are."""
    few = asked.limit(FEW + 1).toArrow()
    return asked.sparkSession.createDataFrame(few, asked.schema) if 0 < few.num_rows <= FEW else asked


def _any_tags(asked: DataFrame) -> bool:
    """Whether a query asks for tags; where none does, no tag is read and nothing is written."""
    return not asked.where("tags is not null").isEmpty()


def _matching(wide: DataFrame, vectors: DataFrame, asked: DataFrame, image_tags: DataFrame | None, tags: DataFrame | None, options: SearchOptions) -> DataFrame:
    """All images that match each query, with their similarity. The queries go
    over the images in blocks of QUERIES, so what is sent with a block is bounded.
    Images are filtered by their other columns, and only what is left meets its
    vector; the queries' own vectors, one block of them, are sent to the tasks."""
    asked = cut(asked)
    blocks = max(1, -(-asked.count() // QUERIES))
    out = None
    for b in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b) if blocks > 1 else asked
        plain = own.drop("query_vec")
        params = [F.struct(*[F.lit(x).cast(t).alias(c) for (c, t), x in zip(plain.dtypes, row, strict=True)]) for row in plain.collect()]  # QUERIES or so
        fits = F.filter(F.array(*params), lambda p: passes(options, lambda c: p[c]))
        rows = wide.withColumn("_q", F.explode(fits)).select(*wide.columns, "_q.*")
        rows = with_tags(rows, image_tags, tags).join(vectors, "image_id").join(F.broadcast(own.select("query_id", "query_vec")), "query_id")
        rows = rows.withColumn("similarity", dot(F.col("embedding"), F.col("query_vec"))).where(~F.isnan("similarity")).drop("embedding", "query_vec")
        out = rows if out is None else out.union(rows)
    return out


def search(images: DataFrame, embeddings: DataFrame, params: SearchParams, image_tags: DataFrame | None = None, tags: DataFrame | None = None, options: SearchOptions = SearchOptions()) -> DataFrame:
    """One search, best first."""
    queries = queries_frame(images.sparkSession, [params])
    return search_batch(images, embeddings, queries, image_tags, tags, options).drop("query_id").orderBy("place")
