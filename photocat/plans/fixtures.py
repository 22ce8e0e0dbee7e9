"""The catalogue's logical tables derived from the given tables, in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.scalars import SourceRules
from ..lineage import cut, qualified
from ..schema import few_rows

RULES = SourceRules(archive_prefixes=("src0",), photographers=("SRC1",))
CAMERAS = ("Canon EOS 5D Mark IV", "NIKON D850", "iPhone 8", "iPhone 14 Pro", "DSC-W800", "COOLPIX S33", "", None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _twin(v: F.Column) -> F.Column:
    moved = F.transform(v, lambda x, i: x.cast("double") * (1 + 0.01 * ((i % 3) - 1)))
    return scalars.let(moved, lambda m: scalars.let(F.sqrt(scalars.dot(m, m)), lambda length: F.transform(m, lambda x: (x / length).cast("float"))))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, lang, n_chars, embedding): documents and, for every fifth
    that has a vector, a near-duplicate with an id of 1,000,000 more."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    own = d.join(e, "doc_id", "left")
    twins = own.where("doc_id % 5 = 0 and embedding is not null").select((F.col("doc_id") + 1_000_000).alias("doc_id"), "source", "lang", "n_chars", _twin(F.col("embedding")).alias("embedding"))
    return own.union(twins)


def catalogue(spark: SparkSession, sf_dir: str, written: bool = False) -> tuple[DataFrame, DataFrame]:
    """(images, embeddings); ``written``: as tables, as a catalogue is that jobs read several times."""
    d = documents(spark, sf_dir)
    n = F.col("doc_id")
    path = F.concat(F.lit("/lib/"), F.col("source"), F.lit("/"), F.col("lang"), F.lit("/img_"), n.cast("string"), F.lit(".jpg"))
    camera = F.lit(None).cast("string")
    for i, name in enumerate(CAMERAS):
        camera = F.when(n % 8 == i, F.lit(name).cast("string")).otherwise(camera)
    rows = d.select("doc_id", "n_chars", path.alias("filepath"), "embedding", camera.alias("camera_model"))
    rows = rows.select(
        scalars.image_id(F.col("filepath")).alias("image_id"), "filepath", scalars.filename(F.col("filepath")).alias("filename"),
        F.when(n % 29 != 0, scalars.relative_folder(F.col("filepath"), "/lib")).alias("folder"), F.col("n_chars").alias("file_size"),
        F.when(n % 31 == 0, 0).otherwise(600 + (n * 37) % 3000).cast("int").alias("width"), F.when(n % 31 == 0, 0).otherwise(400 + (n * 53) % 2400).cast("int").alias("height"),
        F.when(n % 11 != 0, F.expr("timestampadd(HOUR, int(doc_id), timestamp_ntz'2001-01-01 00:00:00')")).alias("date_taken"), "camera_model",
        F.when(~((n % 9 == 0) & (n % 2 == 0)), n % 9).cast("int").alias("orientation"),
        F.expr("timestampadd(SECOND, int(doc_id), timestamp'2020-01-01 00:00:00')").alias("file_modified"),
        F.when(n % 5 != 0, F.round(1 + (n * 97 % 900) / F.lit(100.0), 4)).alias("aesthetic_score"),
        F.when(n % 7 != 0, F.round((n * 71 % 401 - 200) / F.lit(100.0), 4)).alias("taste_score"),
        F.when(n % 13 == 0, 90).cast("int").alias("rotation_fix"), "doc_id", "embedding")
    rows = rows.withColumn("long_edge_px", scalars.long_edge(F.col("width"), F.col("height"))).withColumn("source_class", scalars.classify_source(F.col("folder"), F.col("camera_model"), RULES))
    if written:
        rows = cut(rows)
    return rows.drop("embedding"), rows.select("image_id", "embedding", "doc_id")


def labels(spark: SparkSession, sf_dir: str, images: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tags, image_tags, tier_labels with image_id)."""
    images = images or catalogue(spark, sf_dir)[0]
    known = table(spark, sf_dir, "labels").join(images.select("doc_id", "image_id"), "doc_id")
    tags = few_rows(spark, [(1, "quality"), (2, "toxic")], [("tag_id", "long"), ("tag_name", "string")])
    image_tags = known.select("image_id", F.explode(F.array_compact(F.array(F.when(F.col("quality") == 1, F.lit(1).cast("long")), F.when(F.col("toxic") == 1, F.lit(2).cast("long"))))).alias("tag_id"))
    tier = F.when(F.col("quality") == 1, "hero").when(F.col("toxic") == 1, "reject").otherwise("secondary")
    return tags, image_tags, known.select("image_id", tier.alias("tier"))


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    images, embeddings = catalogue(spark, sf_dir)
    ids = embeddings.where("embedding is not null and doc_id < 1000000").select("doc_id", "image_id")
    n = table(spark, sf_dir, "embeddings").count()
    pairs = ids.select(F.col("doc_id").alias("vote_id"), F.col("image_id").alias("a"), ((F.col("doc_id") * 7 + 3) % n).alias("other"))
    pairs = pairs.join(ids.select(F.col("doc_id").alias("other"), F.col("image_id").alias("b")), "other").where("vote_id <> other")
    r = (F.col("vote_id") * 13) % 10
    choice = F.when(r < 4, "a").when(r < 8, "b").when(r == 8, "tie").otherwise("both_bad")
    return pairs.select("vote_id", choice.alias("choice"), "a", "b")


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A later listing: some files of another size, some gone, some new."""
    images, _ = catalogue(spark, sf_dir)
    rows = images.where("doc_id % 17 <> 0").select(F.col("filepath").alias("path"), F.when(F.col("doc_id") % 10 == 0, F.col("file_size") + 1).otherwise(F.col("file_size")).alias("file_size"), "file_modified")
    new = images.where("doc_id % 20 = 3").select(F.concat(F.lit("/lib/new/"), F.col("filename")).alias("path"), "file_size", "file_modified")
    return rows.union(new)


def rotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, rotation, embedding): the vectors of the next three documents stand in."""
    images, _ = catalogue(spark, sf_dir)
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    n = e.count()
    own = images.where("doc_id < 1000000").join(e.select(F.col("vec_id").alias("doc_id")), "doc_id").select("image_id", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("k"), "doc_id")
    own = own.select("image_id", (F.col("k") * 90).alias("rotation"), ((F.col("doc_id") + F.col("k")) % n).alias("vec_id"))
    return own.join(e, "vec_id").select("image_id", "rotation", "embedding")


def write_files(rows: DataFrame, folder: str) -> None:
    """A file for each row (path, content), below ``folder``, which all executors share."""
    target = qualified(rows.sparkSession, folder)
    target = target.replace("file:/", "file:///", 1) if not target.startswith("file://") else target

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fs, base = pafs.FileSystem.from_uri(target)
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                fs.create_dir(f"{base}/{path}".rsplit("/", 1)[0])
                with fs.open_output_stream(f"{base}/{path}") as out:
                    out.write(content)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    rows.select("path", "content").mapInArrow(run, "n long").agg({"n": "sum"}).collect()


CAMERA_SQL = "CASE doc_id % 8 " + " ".join(f"WHEN {i} THEN " + ("NULL" if c is None else f"'{c}'") for i, c in enumerate(CAMERAS)) + " END"
PRO_SQL = scalars.PRO_BODY.replace("'", "''")

#: The same tables for DuckDB: WITH clauses.
SQL = f"""
own AS (SELECT d.doc_id, d.source, d.lang, d.n_chars, e.embedding FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id),
moved AS (SELECT doc_id + 1000000 AS doc_id, source, lang, n_chars, list_transform(embedding::DOUBLE[], lambda x, i: x * (1 + 0.01 * ((i - 1) % 3 - 1)::DOUBLE)) AS w
          FROM own WHERE doc_id % 5 = 0 AND embedding IS NOT NULL),
doc AS (SELECT * FROM own UNION ALL
        SELECT doc_id, source, lang, n_chars, list_transform(w, lambda x: (x / sqrt(list_inner_product(w, w)))::FLOAT) FROM moved),
base AS (
  SELECT doc_id, '/lib/' || source || '/' || lang || '/img_' || doc_id || '.jpg' AS filepath, 'img_' || doc_id || '.jpg' AS filename,
         CASE WHEN doc_id % 29 <> 0 THEN source || '/' || lang END AS folder, n_chars AS file_size,
         CASE WHEN doc_id % 31 = 0 THEN 0 ELSE 600 + (doc_id * 37) % 3000 END::INT AS width, CASE WHEN doc_id % 31 = 0 THEN 0 ELSE 400 + (doc_id * 53) % 2400 END::INT AS height,
         CASE WHEN doc_id % 11 <> 0 THEN timestamp '2001-01-01 00:00:00' + to_hours(doc_id) END AS date_taken, {CAMERA_SQL} AS camera_model,
         CASE WHEN NOT (doc_id % 9 = 0 AND doc_id % 2 = 0) THEN doc_id % 9 END::INT AS orientation,
         timestamp '2020-01-01 00:00:00' + to_seconds(doc_id) AS file_modified,
         CASE WHEN doc_id % 5 <> 0 THEN round(1 + (doc_id * 97 % 900) / 100::DOUBLE, 4) END AS aesthetic_score,
         CASE WHEN doc_id % 7 <> 0 THEN round((doc_id * 71 % 401 - 200) / 100::DOUBLE, 4) END AS taste_score,
         CASE WHEN doc_id % 13 = 0 THEN 90 END AS rotation_fix, embedding
  FROM doc),
img AS (
  SELECT substr(sha256(filepath), 1, 16) AS image_id, *, nullif(greatest(width, height), 0) AS long_edge_px,
         CASE WHEN starts_with(coalesce(folder, ''), 'src0') THEN 'archive' WHEN contains(upper(coalesce(folder, '')), 'SRC1') THEN 'pro'
              WHEN regexp_matches(coalesce(camera_model, ''), '{PRO_SQL}') OR regexp_matches(coalesce(camera_model, ''), '{scalars.RECENT_PHONE}') THEN 'pro'
              WHEN coalesce(camera_model, '') <> '' THEN 'amateur' ELSE 'unknown' END AS source_class
  FROM base)"""
LABELS_SQL = """
known AS (SELECT image_id, quality, toxic FROM labels JOIN img USING (doc_id)),
image_tag AS (SELECT image_id, 'quality' AS tag_name FROM known WHERE quality = 1 UNION ALL SELECT image_id, 'toxic' FROM known WHERE toxic = 1),
tier AS (SELECT image_id, CASE WHEN quality = 1 THEN 'hero' WHEN toxic = 1 THEN 'reject' ELSE 'secondary' END AS tier FROM known)"""
VOTES_SQL = """
vec AS (SELECT doc_id, image_id, embedding::DOUBLE[] AS v FROM img WHERE embedding IS NOT NULL AND doc_id < 1000000),
vote AS (
  SELECT x.doc_id AS vote_id, CASE WHEN x.doc_id * 13 % 10 < 4 THEN 'a' WHEN x.doc_id * 13 % 10 < 8 THEN 'b' WHEN x.doc_id * 13 % 10 = 8 THEN 'tie' ELSE 'both_bad' END AS choice, x.image_id AS a, y.image_id AS b
  FROM vec x JOIN vec y ON y.doc_id = (x.doc_id * 7 + 3) % (SELECT count(*) FROM embeddings) WHERE x.doc_id <> y.doc_id)"""
LISTING_SQL = """
later AS (
  SELECT filepath AS path, CASE WHEN doc_id % 10 = 0 THEN file_size + 1 ELSE file_size END AS file_size, file_modified FROM img WHERE doc_id % 17 <> 0
  UNION ALL SELECT '/lib/new/' || filename, file_size, file_modified FROM img WHERE doc_id % 20 = 3)"""
ROTATED_SQL = """
turned AS (
  SELECT i.image_id, k * 90 AS rotation, e.embedding FROM img i JOIN embeddings own ON own.vec_id = i.doc_id, unnest([1, 2, 3]) t(k)
  JOIN embeddings e ON e.vec_id = (i.doc_id + k) % (SELECT count(*) FROM embeddings) WHERE i.doc_id < 1000000)"""


def with_sql(body: str, *parts: str) -> str:
    return "WITH " + ",".join((SQL, *parts)) + "\n" + body
