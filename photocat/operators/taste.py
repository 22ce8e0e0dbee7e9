"""A preference score learned from pairwise votes."""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import dot
from ..lineage import cut
from .ranks import positions
from .stats import quantile, spearman, zscore
from .taste_fits import Model, fit_models, left_out_accuracy

# Fixed values of the preference score.
GRID, FOLDS = (1e-3, 3e-3, 1e-2, 3e-2, 1e-1), 5
CHOICES = ("a", "b", "tie", "both_bad")
TIERS = {"reject": 0, "secondary": 1, "hero": 2}


def vote_counts(votes: DataFrame) -> DataFrame:
    """One row with the number of votes of each choice."""
    return votes.agg(*[F.count_if(F.col("choice") == c).alias(c) for c in CHOICES])


def vote_pairs(votes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(winners: vote_id, winner, loser; below floor: vote_id, image_id). Ties teach nothing."""
    won = votes.where("choice in ('a', 'b')")
    pairs = won.select("vote_id", F.when(F.col("choice") == "a", F.col("a")).otherwise(F.col("b")).alias("winner"), F.when(F.col("choice") == "a", F.col("b")).otherwise(F.col("a")).alias("loser"))
    bads = votes.where("choice = 'both_bad'").select("vote_id", F.explode(F.array("a", "b")).alias("image_id"))
    return pairs, bads


def needed_ids(votes: DataFrame, held_out: DataFrame) -> DataFrame:
    voted = votes.select(F.explode(F.array("a", "b")).alias("image_id"))
    return voted.union(held_out.select("image_id")).distinct()


def difference_vectors(pairs: DataFrame, embeddings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((vote_id, winner, loser, d), count of votes dropped for want of a vector)."""
    ids = pairs.select(F.explode(F.array("winner", "loser")).alias("image_id")).distinct()
    own = embeddings.where("embedding is not null").join(ids, "image_id", "left_semi")
    a = own.select(F.col("image_id").alias("winner"), F.col("embedding").alias("va"))
    b = own.select(F.col("image_id").alias("loser"), F.col("embedding").alias("vb"))
    out = pairs.join(a, "winner").join(b, "loser").select("vote_id", "winner", "loser", F.zip_with("va", "vb", lambda x, y: x.cast("double") - y.cast("double")).alias("d"))
    dropped = pairs.agg(F.count(F.lit(1)).alias("_n")).crossJoin(out.agg(F.count(F.lit(1)).alias("_m"))).select((F.col("_n") - F.col("_m")).alias("dropped"))  # one row each
    return out, dropped


def fit_taste(differences: DataFrame, l2: float, n_bad: int = 0) -> np.ndarray | None:
    """The weights that minimise the mean softplus loss of the differences plus
    l2 |w|^2, the mean being over pairs and below-floor rows. The floor has no
    finite optimum, and at its limit the below-floor rows only count in the
    mean. None without a pair (the weights are then zero)."""
    rows = differences.select(array_to_vector("d").alias("features"))
    both = rows.withColumn("label", F.lit(1.0))
    n = rows.count()
    if not n:
        return None
    model = LogisticRegression(fitIntercept=False, standardization=False, regParam=2 * l2 * (n + n_bad) / n, maxIter=400, tol=1e-8).fit(both)
    return model.coefficients.toArray()


def folds(pairs: DataFrame, seed: int = 0, n: int = FOLDS) -> DataFrame:
    """``pairs`` with fold, by a seeded hash of the vote."""
    return pairs.withColumn("fold", F.pmod(F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vote_id").cast("string")), 256), 1, 8), 16, 10).cast("long"), F.lit(n)).cast("int"))


def balanced_folds(pairs: DataFrame, seed: int = 0, n: int = FOLDS) -> DataFrame:
    """``pairs``, written, with fold: dealt in turn in the order of a seeded hash of
    the vote, so that folds differ by one row at most however few there are."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vote_id").cast("string")), 256)
    return positions(pairs, [order, F.col("vote_id")], "_place").withColumn("fold", (F.col("_place") % n).cast("int")).drop("_place")


def pairwise_accuracy(scored: DataFrame) -> DataFrame:
    """(fold, accuracy) of (fold, s_winner, s_loser); a fold without rows is absent."""
    return scored.groupBy("fold").agg(F.avg(F.when(F.col("s_winner") > F.col("s_loser"), 1.0).otherwise(0.0)).alias("accuracy"))


def choose_l2(differences: DataFrame, n_bad: int = 0, grid: tuple[float, ...] = GRID, seed: int = 0, balanced: bool = False) -> tuple[float, float]:
    """(best value, its mean accuracy over the folds); the first wins ties. All
    models of the grid and the folds are fitted in the same passes over the votes."""
    rows = cut((balanced_folds if balanced else folds)(differences, seed).select("fold", "d"))
    present = sorted(r[0] for r in rows.select("fold").distinct().collect())
    if not present:
        return grid[0], 0.0
    models = [Model(l2, f) for l2 in grid for f in present]
    weights = fit_models(rows, models, n_bad)
    accuracy = left_out_accuracy(rows, models, weights).reshape(len(grid), len(present)).mean(axis=1)
    best = int(accuracy.argmax())  # the first of equal ones
    return grid[best], float(accuracy[best])


def raw_taste(embeddings: DataFrame, w: np.ndarray) -> DataFrame:
    weights = F.array(*[F.lit(float(x)) for x in w])
    return embeddings.where("embedding is not null").select("image_id", dot(F.col("embedding"), weights).alias("raw"))


def score_taste(embeddings: DataFrame, w: np.ndarray) -> DataFrame:
    """(image_id, taste_score): z-scores over the library."""
    return zscore(raw_taste(embeddings, w), "raw", "taste_score").select("image_id", "taste_score")


def taste_for_new(embeddings: DataFrame, w: np.ndarray, mean: float, sd: float) -> DataFrame:
    """As score_taste, with a stored mean and deviation."""
    score = (F.col("raw") - mean) / F.lit(sd) if sd > 0 else F.lit(None).cast("double")
    return raw_taste(embeddings, w).select("image_id", score.alias("taste_score"))


def tier_means(scores: DataFrame, labels: DataFrame, value: str = "taste_score") -> DataFrame:
    """(tier, mean_score, n) in the order of the tiers."""
    known = F.create_map(*[F.lit(x) for pair in TIERS.items() for x in pair])
    rows = labels.join(scores, "image_id").groupBy("tier").agg(F.avg(value).alias("mean_score"), F.count(value).alias("n"))
    return rows.orderBy(known[F.col("tier")])


def floor_z(scores: DataFrame, bads: DataFrame) -> DataFrame:
    """Our floor: the 95th percentile of the z-scores of pictures that votes called bad."""
    return quantile(cut(bads.join(scores, "image_id").select("taste_score")), "taste_score", 0.95, "floor_z")


def taste_report(votes: DataFrame, scores: DataFrame, labels: DataFrame, bads: DataFrame, l2: float, accuracy: float) -> DataFrame:
    """(key, value): JSON of votes, l2, cv_acc, heldout_rho, floor_z."""
    known = F.create_map(*[F.lit(x) for pair in TIERS.items() for x in pair])
    held = labels.join(scores, "image_id").withColumn("level", known[F.col("tier")])
    row = votes.agg(F.count(F.lit(1)).alias("votes")).crossJoin(spearman(held, "taste_score", "level").withColumnRenamed("rho", "heldout_rho")).crossJoin(floor_z(scores, bads))  # one row each
    value = F.to_json(F.struct("votes", F.lit(l2).alias("l2"), F.lit(accuracy).alias("cv_acc"), "heldout_rho", "floor_z"))
    return row.select(F.lit("taste_model").alias("key"), value.alias("value"))
