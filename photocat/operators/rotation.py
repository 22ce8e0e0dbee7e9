"""Pictures stored the wrong way up: scores, verdicts, triage, and applying them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import dot, let
from .catalog import patch

APPLY_MARGIN, REVIEW_MARGIN = 0.03, 0.01
ROTATIONS = (0, 90, 180, 270)


def upright_direction(prompts: DataFrame) -> DataFrame:
    """One row (direction): unit mean of upright prompt vectors minus that of the
    rotated ones. prompts: (upright boolean, v array)."""
    parts = prompts.select("upright", F.posexplode("v").alias("i", "x")).groupBy("upright", "i").agg(F.avg("x").alias("x"))
    means = parts.groupBy("upright").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("m"))  # a vector's components
    one = means.withColumn("u", let(F.sqrt(dot(F.col("m"), F.col("m"))), lambda length: F.transform("m", lambda x: x / length)))
    return one.agg(F.max(F.when(F.col("upright"), F.col("u"))).alias("a"), F.max(F.when(~F.col("upright"), F.col("u"))).alias("b")).select(F.zip_with("a", "b", lambda x, y: x - y).alias("direction"))


def rotation_work(images: DataFrame, embeddings: DataFrame, scanned: DataFrame, thumbnails: DataFrame) -> DataFrame:
    """image_id of pictures to scan: with a vector and a thumbnail, not scanned, not fixed."""
    fixed = F.coalesce("rotation_fix", F.lit(0)) != 0 if "rotation_fix" in images.columns else F.lit(False)
    rows = images.where(~fixed).select("image_id").join(embeddings.where("embedding is not null").select("image_id"), "image_id", "left_semi")
    return rows.join(scanned.select("image_id"), "image_id", "left_anti").join(thumbnails.select("image_id"), "image_id", "left_semi")


def rotation_scores(embeddings: DataFrame, rotated: DataFrame, direction: list[float]) -> DataFrame:
    """(image_id, s0, s90, s180, s270). rotated: (image_id, rotation, embedding)."""
    d = F.array(*[F.lit(float(x)) for x in direction])
    rows = rotated.select("image_id", "rotation", "embedding").union(embeddings.where("embedding is not null").select("image_id", F.lit(0).alias("rotation"), "embedding"))
    scored = rows.select("image_id", "rotation", dot(F.col("embedding"), d).alias("s")).groupBy("image_id").pivot("rotation", list(ROTATIONS)).agg(F.first("s"))
    return scored.select("image_id", *[F.col(str(r)).alias(f"s{r}") for r in ROTATIONS]).where("s0 is not null and s90 is not null and s180 is not null and s270 is not null")


def _best() -> tuple[Column, Column]:
    scores = F.array(*[F.col(f"s{r}") for r in ROTATIONS])
    at = F.array_position(scores, F.array_max(scores)).cast("int") - 1
    return at * 90, F.array_max(scores) - F.col("s0")


def rotation_verdict(margin: float) -> Column:
    """The rotation that scores best, the first of equal ones, if it gains ``margin`` over none; else 0."""
    rotation, gain = _best()
    return F.when((rotation != 0) & (gain >= margin), rotation).otherwise(0)


def triage_rotation(scores: DataFrame, apply_margin: float = APPLY_MARGIN, review_margin: float = REVIEW_MARGIN) -> DataFrame:
    """``scores`` with rotation, gain and action: apply, review or none."""
    rotation, gain = _best()
    rows = scores.withColumn("rotation", rotation).withColumn("gain", gain)
    turned = F.col("rotation") != 0
    return rows.withColumn("action", F.when(turned & (F.col("gain") >= apply_margin), "apply").when(turned & (F.col("gain") >= review_margin), "review").otherwise("none"))


def apply_rotation(images: DataFrame, embeddings: DataFrame, scanned: DataFrame, fixes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(images, embeddings, scanned) after ``fixes`` (image_id, embedding,
    aesthetic_score, taste_score, rotation_fix) are applied. The fixed ones leave
    the scan; they are not scanned again, as rotation_fix is set."""
    images = patch(images, fixes, "image_id", ["aesthetic_score", "taste_score", "rotation_fix"])
    vectors = patch(embeddings, fixes, "image_id", ["embedding"])
    return images, vectors, scanned.join(fixes.select("image_id"), "image_id", "left_anti")
