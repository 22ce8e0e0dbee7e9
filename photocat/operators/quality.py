"""Scores by a stack of linear layers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import dot


def fold_layers(layers: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, float]:
    """One affine map for layers (weight: out x in, bias) without activations,
    the last of which has one output."""
    w, b = np.eye(layers[0][0].shape[1]), np.zeros(layers[0][0].shape[1])
    for weight, bias in layers:
        w, b = np.asarray(weight, np.float64) @ w, np.asarray(weight, np.float64) @ b + np.asarray(bias, np.float64)
    if w.shape[0] != 1:
        raise ValueError("the last layer must have one output")
    return w[0], float(b[0])


def aesthetic_score(embeddings: DataFrame, layers: list[tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """``embeddings`` with aesthetic_score; a vector of another length is an error."""
    w, b = fold_layers(layers)
    v = F.col("embedding")
    wrong = F.raise_error(F.concat(F.lit(f"expected {len(w)} dimensions, got "), F.size(v).cast("string"))).cast("double")
    score = dot(v, F.array(*[F.lit(float(x)) for x in w])) + b
    return embeddings.withColumn("aesthetic_score", F.when(v.isNull(), None).when(F.size(v) == len(w), score).otherwise(wrong))
