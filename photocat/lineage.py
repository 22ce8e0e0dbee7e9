"""Cutting lineage: a job's intermediate result as a table in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows for a task of ``few``, and the tasks that each core has at least.
TASK_ROWS, CORE_TASKS = 50_000, 2


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where it is unset, local mode gets
    a temporary one; on a cluster that is an error, as machines share no such folder."""
    key = "spark.checkpoint.dir"
    if not (found := spark.sparkContext.getConf().get(key) or spark.conf.get(key, None)):
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError(f"{key} must name a folder that all executors share")
        spark.conf.set(key, found := tempfile.mkdtemp(prefix="spark-"))
    return found


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme of the file system that Spark resolves it to, so
    that executors which use it by other means go to the same place."""
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return str(own.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(own).toString())


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later jobs start
    from the table, so a lost executor costs no recomputation of what led to it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def few(df: DataFrame, rows: int) -> DataFrame:
    """``df`` in as many tasks as ``rows`` ask for, where its last shuffle makes
    more; they read that shuffle's partitions whole, so keys stay together. A
    step on few rows then costs a few tasks and files, however many partitions
    the session's shuffles have."""
    least = CORE_TASKS * df.sparkSession.sparkContext.defaultParallelism
    return df.coalesce(max(least, -(-int(rows) // TASK_ROWS)))


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` has written, once nothing reads them any more."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.cut_path)
        path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
