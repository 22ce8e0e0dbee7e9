"""Catalogue maintenance: change detection, upsert, pruning, folder sizes, run counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of a listed folder above which it is flagged.
FOLDER_BUDGET = 50 * 1024**3


def detect_changes(files: DataFrame, images: DataFrame, force: bool = False) -> DataFrame:
    """Files that are new or differ in size or time; all with ``force``."""
    if force:
        return files
    known = images.select(F.col("filepath").alias("_path"), F.col("file_size").alias("_size"), F.col("file_modified").alias("_time"))
    same = (files["path"] == known["_path"]) & files["file_size"].eqNullSafe(known["_size"]) & files["file_modified"].eqNullSafe(known["_time"])
    return files.join(known, same, "left_anti")


def upsert(table: DataFrame, new: DataFrame, key: str, newest: str | None = None) -> DataFrame:
    """Rows of ``new`` replace those of ``table`` with the same key as a whole:
    columns that ``new`` lacks become null. newest: the column by which one
    version of a key is chosen where ``new`` has several."""
    if newest:
        columns = new.columns
        new = new.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(newest, *[F.col(c).cast("string") for c in columns if c != newest])).alias("_r")).select("_r.*")
    return table.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True).select(*table.columns)


def patch(table: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Only ``columns`` change, only where ``changes`` has the key; a null is a value."""
    new = changes.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_new_{c}") for c in columns])
    rows = table.join(new, table[key] == new["_key"], "left")
    matched = F.col("_key").isNotNull()
    values = {c: F.when(matched, F.col(f"_new_{c}")).otherwise(table[c]) if c in table.columns else F.col(f"_new_{c}") for c in columns}
    kept = [values[c].alias(c) if c in values else table[c] for c in table.columns]
    return rows.select(*kept, *[v.alias(c) for c, v in values.items() if c not in table.columns])


def orphans(images: DataFrame, files: DataFrame) -> DataFrame:
    """Images whose path is null, empty or not listed."""
    listed = files.select(F.col("path").alias("filepath")).where("filepath <> ''")
    return images.join(listed, "filepath", "left_anti")


def prune_orphans(images: DataFrame, image_tags: DataFrame, files: DataFrame, allow_empty: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(images that stay, their tags, counts of what goes and stays). An empty
    listing would prune everything and is refused."""
    if not allow_empty and files.isEmpty():
        raise ValueError("the listing is empty; pass allow_empty=True to prune everything")
    gone = orphans(images, files).select("image_id")
    stay = images.join(files.select(F.col("path").alias("filepath")).where("filepath <> ''"), "filepath", "left_semi").select(*images.columns)
    tags = image_tags.join(gone, "image_id", "left_anti")
    counts = gone.agg(F.count(F.lit(1)).alias("pruned")).crossJoin(stay.agg(F.count(F.lit(1)).alias("remaining")))  # one row each
    return stay, tags, counts


def orphan_thumbnails(images: DataFrame, files: DataFrame, thumbnails: DataFrame) -> DataFrame:
    """Thumbnails (path) of orphans, by the file's stem."""
    stem = F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1)
    return thumbnails.withColumn("image_id", stem).join(orphans(images, files).select("image_id"), "image_id", "left_semi")


def ancestors(path: Column) -> Column:
    """All folders above a path, and the path itself."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def folder_sizes(files: DataFrame, allowlist: DataFrame, max_bytes: int = FOLDER_BUDGET) -> DataFrame:
    """(line_no, folder, bytes, files, missing, over_budget) in list order.
    A file counts for every listed folder above it."""
    own = files.select(F.explode(ancestors(F.col("path"))).alias("folder"), "file_size")
    listed = allowlist.select("folder").distinct()
    sums = own.join(listed, "folder").groupBy("folder").agg(F.sum(F.coalesce("file_size", F.lit(0))).alias("bytes"), F.count(F.lit(1)).alias("files"))
    out = allowlist.join(sums, "folder", "left").select("line_no", "folder", F.coalesce("bytes", F.lit(0)).alias("bytes"), F.coalesce("files", F.lit(0)).alias("files"), F.col("files").isNull().alias("missing"))
    return out.withColumn("over_budget", F.col("bytes") > max_bytes).orderBy("line_no")


def top_level_folders(files: DataFrame) -> DataFrame:
    """The default list: sorted first parts of the (relative) paths below a folder."""
    first = files.where(F.col("path").contains("/")).select(F.substring_index("path", "/", 1).alias("folder")).distinct()
    ordered = first.agg(F.array_sort(F.collect_set("folder")).alias("all"))  # folders of one directory
    return ordered.select(F.posexplode("all").alias("line_no", "folder"))


def stale_embedding(dimension: int) -> Column:
    return F.col("embedding").isNull() | (F.size("embedding") != dimension)


def select_stale_embeddings(embeddings: DataFrame, dimension: int) -> DataFrame:
    return embeddings.where(stale_embedding(dimension))


def pilot_sample(df: DataFrame, n: int, seed: int, key: str = "image_id") -> DataFrame:
    """n rows by a seeded hash of the key, the same for any partitioning."""
    return df.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256), key).limit(n)


def clear_stale_embeddings(embeddings: DataFrame, dimension: int) -> tuple[DataFrame, DataFrame]:
    """(embeddings with null for other dimensions, count of those)."""
    stale = F.size("embedding") != dimension
    count = embeddings.agg(F.count_if(F.coalesce(stale, F.lit(False))).alias("cleared"))
    return embeddings.withColumn("embedding", F.when(~stale, F.col("embedding"))), count


def embedding_source(images: DataFrame, thumbnails: DataFrame, thumbnails_only: bool = False) -> DataFrame:
    """(image_id, source, source_path, rotate): thumbnail where there is one,
    else the original, or ``skip`` with thumbnails_only."""
    have = thumbnails.select(F.col("image_id").alias("_id"), F.col("path").alias("_thumb"))
    rows = images.join(have, images["image_id"] == have["_id"], "left")
    found = F.col("_id").isNotNull()
    source = F.when(found, "thumbnail").otherwise("skip" if thumbnails_only else "original")
    rotate = ~F.coalesce("orientation", F.lit(1)).isin(0, 1)
    return rows.select("image_id", source.alias("source"), F.when(found, F.col("_thumb")).when(source == "original", F.col("filepath")).alias("source_path"), (rotate & (source != "skip")).alias("rotate"))


def source_counts(sources: DataFrame) -> DataFrame:
    one = lambda kind: F.count_if(F.col("source") == kind)
    return sources.agg(one("thumbnail").alias("from_thumbnail"), one("original").alias("from_original"), one("skip").alias("skipped"), F.count_if("rotate").alias("rotated"))


def run_counters(embeddings: DataFrame, dimension: int) -> DataFrame:
    """(total, current, todo, stale): stale ones have a vector of another dimension."""
    todo = stale_embedding(dimension)
    return embeddings.agg(F.count(F.lit(1)).alias("total"), F.count_if(~todo).alias("current"), F.count_if(todo).alias("todo"), F.count_if(todo & F.col("embedding").isNotNull()).alias("stale"))


def index_run_stats(found: DataFrame, changed: DataFrame, indexed: DataFrame) -> DataFrame:
    """(found, changed, skipped, indexed, errors, first_errors): ``indexed`` has
    ``error``, null for rows that went well."""
    total = found.agg(F.count(F.lit(1)).alias("found"))
    todo = changed.agg(F.count(F.lit(1)).alias("changed"))
    done = indexed.agg(
        F.count_if(F.col("error").isNull()).alias("indexed"), F.count("error").alias("errors"))
    texts = indexed.where("error is not null").select("error").distinct().orderBy("error").limit(10).agg(F.array_sort(F.collect_list("error")).alias("first_errors"))
    rows = total.crossJoin(todo).crossJoin(done).crossJoin(texts)  # one row each
    return rows.select("found", "changed", (F.col("found") - F.col("changed")).alias("skipped"), "indexed", "errors", "first_errors")


def id_collisions(images: DataFrame) -> DataFrame:
    """(image_id, paths): ids that stand for more than one path. Sixteen hex digits
    are likely to meet from some four billion pictures on, and an upsert by the id
    would then keep one of them."""
    return images.groupBy("image_id").agg(F.count_distinct("filepath").alias("paths")).where(F.col("paths") > 1)


def existing_ids(images: DataFrame) -> DataFrame:
    return images.select("image_id").distinct()
