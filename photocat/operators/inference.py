"""Batch inference with an encoder of the caller's, also in slices that are committed
one by one, so that a run which was stopped goes on where it was."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Takes the values of a column, gives a matrix with a row for each.
Encoder = Callable[[list], np.ndarray]


def embed_batches(df: DataFrame, make_encoder: Callable[[], Encoder], dimension: int, key: str = "image_id", value: str = "content", batch: int = 32) -> DataFrame:
    """(key, embedding, error). The encoder is made once for each partition. A
    batch that fails is tried again row by row; rows that fail, and vectors of
    another length or without length, get a null embedding and a text."""

    def unit(v: np.ndarray) -> tuple[np.ndarray | None, str | None]:
        v = np.asarray(v, np.float64).ravel()
        length = np.linalg.norm(v)
        if len(v) != dimension:
            return None, f"expected {dimension} dimensions, got {len(v)}"
        if not np.isfinite(length) or length == 0:
            return None, "the vector has no length"
        return (v / length).astype(np.float32), None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = make_encoder()
        for frame in frames:
            for lo in range(0, len(frame), batch):
                part = frame.iloc[lo : lo + batch]
                values = part[value].tolist()
                try:
                    found = [unit(v) for v in encode(values)]
                    if len(found) != len(values):
                        raise ValueError("the encoder returned another number of rows")
                except Exception:
                    found = []
                    for x in values:
                        try:
                            found.append(unit(encode([x])[0]))
                        except Exception as e:
                            found.append((None, f"{type(e).__name__}: {e}"))
                yield pd.DataFrame({key: part[key].to_numpy(), "embedding": [f[0] for f in found], "error": [f[1] for f in found]})

    kind = dict(df.dtypes)[key]
    return df.select(key, value).mapInPandas(run, f"{key} {kind}, embedding array<float>, error string")


def _files(spark: SparkSession, path: str) -> tuple:
    """(file system, path) of Hadoop."""
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), own


def _commit(spark: SparkSession, written: str, target: str) -> bool:
    """Moves a slice to its place in one step. Whoever comes second leaves the first
    one's there and gives its own up."""
    fs, at = _files(spark, target)
    own = spark._jvm.org.apache.hadoop.fs.Path(written)
    if not fs.exists(own):
        fs.mkdirs(own)  # a slice without rows
    if fs.exists(at) or not fs.rename(own, at):
        fs.delete(own, True)
        return False
    nested = spark._jvm.org.apache.hadoop.fs.Path(at, own.getName())
    if fs.exists(nested):  # the place was taken between the two, and the file system put it inside
        fs.delete(nested, True)
        return False
    return True


def committed_slices(spark: SparkSession, folder: str, version: str, slices: int) -> list[int]:
    """The log: slices of this encoder's version that are in their place."""
    fs, _ = _files(spark, folder)
    path = spark._jvm.org.apache.hadoop.fs.Path
    return [i for i in range(slices) if fs.exists(path(f"{folder}/version={version}/slice={i}"))]


def embed_slices(
    df: DataFrame, make_encoder: Callable[[], Encoder], dimension: int, folder: str, version: str, slices: int = 64, at_once: int = 8, key: str = "image_id", value: str = "content", batch: int = 32,
    after: Callable[[], None] | None = None) -> DataFrame:
    """As ``embed_batches``, through ``folder``. The work is dealt to numbered slices by
    a hash of the key; ``at_once`` slices are encoded by a job, written, and then
    each moved to its place, which commits it. A run that finds committed slices
    of the same ``version`` (it names the encoder and the work list) does not
    encode them again. ``after`` is called when some are committed. The result is
    read from the committed slices alone."""
    spark = df.sparkSession
    done = set(committed_slices(spark, folder, version, slices))
    todo = [i for i in range(slices) if i not in done]
    dealt = df.select(key, value, F.pmod(F.xxhash64(F.col(key), F.lit("slice")), F.lit(slices)).cast("int").alias("_slice"))
    fs, path = _files(spark, f"{folder}/version={version}")
    fs.mkdirs(path)
    for lo in range(0, len(todo), at_once):
        own = todo[lo : lo + at_once]
        draft = f"{folder}/draft-{uuid.uuid4().hex}"
        rows = dealt.where(F.col("_slice").isin(own)).repartition("_slice", F.pmod(F.xxhash64(key), F.lit(8)))
        named = embed_batches(rows, make_encoder, dimension, key, value, batch)
        number = F.pmod(F.xxhash64(F.col(key), F.lit("slice")), F.lit(slices)).cast("int")
        named.withColumn("slice", number).write.partitionBy("slice").parquet(draft)
        for i in own:
            _commit(spark, f"{draft}/slice={i}", f"{folder}/version={version}/slice={i}")
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(draft), True)
        if after is not None:
            after()
    kind = dict(df.dtypes)[key]
    return spark.read.schema(f"{key} {kind}, embedding array<float>, error string").parquet(*[f"{folder}/version={version}/slice={i}" for i in range(slices)])
