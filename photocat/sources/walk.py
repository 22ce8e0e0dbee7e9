"""A listing of a file tree by tasks: folders are expanded level by level.

The driver holds a number for each level and no file. A level's folders are dealt
over tasks, each of which lists its own and writes what it finds to a table in
the shared folder; the folders among it are the next level. So a lost executor
costs the folders of its tasks, and a tree of any width is listed in as many
rounds as it is deep.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from datetime import datetime, timezone
from urllib.parse import urlparse

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..lineage import CORE_TASKS, cut, qualified
from ..schema import few_rows
from .files import image_suffix

#: Folders that a task lists, tasks of a level at most, rows of a batch.
FOLDERS, TASKS, ROWS = 64, 20_000, 8192
FOUND = T.StructType([T.StructField("path", T.StringType()), T.StructField("folder", T.BooleanType()), T.StructField("file_size", T.LongType()), T.StructField("file_modified", T.TimestampType())])


def entries(folder: str) -> Iterator[tuple[str, bool, int | None, float | None]]:
    """(path, is a folder, size, time in seconds) of what ``folder`` holds. Links to
    folders are not followed, so there is no way round in circles; links to files
    are files. A folder that has gone meanwhile holds nothing."""
    try:
        if folder.startswith("/"):
            with os.scandir(folder) as found:
                for e in found:
                    if e.is_dir(follow_symlinks=False):
                        yield e.path, True, None, None
                    elif e.is_file():
                        try:
                            state = e.stat()
                        except FileNotFoundError:
                            continue
                        yield e.path, False, state.st_size, state.st_mtime_ns // 1_000_000 / 1000
            return
        parts = urlparse(folder)
        fs, base = pafs.FileSystem.from_uri(folder)
        for e in fs.get_file_info(pafs.FileSelector(base)):
            path = f"{parts.scheme}://{parts.netloc}/{e.path.lstrip('/')}" if parts.netloc and not e.path.startswith(parts.netloc) else f"{parts.scheme}://{e.path}"
            if e.type == pafs.FileType.Directory:
                yield path, True, None, None
            elif e.type == pafs.FileType.File:
                yield path, False, e.size, e.mtime_ns // 1_000_000 / 1000 if e.mtime_ns is not None else None
    except (FileNotFoundError, NotADirectoryError):
        return


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def table(rows: list[tuple]) -> pa.RecordBatch:
        path, folder, size, time = zip(*rows, strict=True)
        times = [None if t is None else datetime.fromtimestamp(t, timezone.utc) for t in time]
        return pa.RecordBatch.from_arrays([pa.array(path, pa.string()), pa.array(folder, pa.bool_()), pa.array(size, pa.int64()), pa.array(times, pa.timestamp("us", tz="UTC"))], names=FOUND.names)

    held: list[tuple] = []
    for batch in batches:
        for folder in batch.column(0).to_pylist():
            for entry in entries(folder):
                held.append(entry)
                if len(held) == ROWS:
                    yield table(held)
                    held = []
    if held:
        yield table(held)


def _start(spark: SparkSession, root: str) -> str:
    """A local path, or a URI of another file system."""
    uri = qualified(spark, root)
    return "/" + uri[len("file:") :].lstrip("/") if uri.startswith("file:") else uri


def walkable(spark: SparkSession, root: str) -> bool:
    """True for a folder of a file system that tasks can list."""
    start = _start(spark, root)
    if start.startswith("/"):
        return os.path.isdir(start)
    try:
        fs, base = pafs.FileSystem.from_uri(start)
        return fs.get_file_info(base).type == pafs.FileType.Directory
    except (OSError, pa.ArrowException):
        return False


def walk_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, file_size, file_modified) of the pictures below ``root``, also of empty
    ones and those whose names begin with a dot or an underscore. A root without a
    scheme is in Spark's default file system. On a cluster a root of the scheme
    ``file`` must be a folder that all machines share; other schemes are those of
    Arrow's file systems."""
    frontier, levels, n = few_rows(spark, [(_start(spark, root),)], [("path", "string")]), [], 1
    cores = CORE_TASKS * spark.sparkContext.defaultParallelism
    while n:
        tasks = max(-(-n // FOLDERS), min(n, cores))  # a few large folders go to a task each
        found = frontier.repartition(min(TASKS, tasks)).mapInArrow(_expand, FOUND)
        level = cut(found.where(F.col("folder") | image_suffix(F.col("path"))))
        levels.append(level.cut_path)
        frontier = level.where("folder").select("path")
        n = frontier.count()
    return spark.read.schema(FOUND).parquet(*levels).where("not folder").drop("folder")
