"""Tables that several writers change: a log of versions, and tables in buckets of
which a change rewrites only those that it touches.

A version is an entry of the log, a small file with the next number that nobody
can write twice. Data is written before its entry, so a writer that dies leaves
the version before in place, and a reader that has opened a version keeps it. A
writer whose number is taken meanwhile starts again from the newer version.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..lineage import qualified
from ..operators.catalog import upsert

#: How often a writer starts again before it gives up.
RETRIES = 20


class Conflict(RuntimeError):
    """Another writer was first, again and again."""


def _file_system(spark: SparkSession, path: str) -> tuple:
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), own


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a small file as a whole unless there is one of its name. Needs a store
    whose renames are atomic and do not replace, as HDFS's; on a local disk a hard
    link does it."""
    draft = f"{path}.{uuid.uuid4().hex}.draft"
    fs, own = _file_system(spark, draft)
    out = fs.create(own, False)
    out.write(bytearray(text.encode()))
    out.close()
    _, target = _file_system(spark, path)
    try:
        if fs.getScheme() == "file":
            nio = spark._jvm.java.nio.file
            local = lambda p: spark._jvm.java.io.File(fs.makeQualified(p).toUri().getPath()).toPath()
            try:
                nio.Files.createLink(local(target), local(own))
                return True
            except Exception as e:
                if "FileAlreadyExistsException" in str(e):
                    return False
                raise
        return not fs.exists(target) and fs.rename(own, target)
    finally:
        fs.delete(own, False)


def _entries(spark: SparkSession, base: str) -> list[int]:
    fs, log = _file_system(spark, f"{base}/_log")
    if not fs.exists(log):
        return []
    return sorted(int(n[: -len(".json")]) for n in (s.getPath().getName() for s in fs.listStatus(log)) if n.endswith(".json"))


def _entry(spark: SparkSession, base: str, number: int) -> dict:
    rows = spark.read.text(f"{base}/_log/{number:020d}.json", wholetext=True).collect()
    return json.loads(rows[0][0])


def current(spark: SparkSession, base: str) -> int:
    """The number of the newest version, -1 without any."""
    return max(_entries(spark, base), default=-1)


def commit(spark: SparkSession, base: str, number: int, entry: dict) -> bool:
    """Whether ``entry`` became version ``number``."""
    fs, log = _file_system(spark, f"{base}/_log")
    fs.mkdirs(log)
    return put_if_absent(spark, f"{base}/_log/{number:020d}.json", json.dumps(entry | {"written": time.time()}))


def _delete(spark: SparkSession, path: str) -> None:
    fs, own = _file_system(spark, path)
    fs.delete(own, True)


def read_version(spark: SparkSession, base: str, number: int | None = None) -> DataFrame | None:
    """The table in a version, the newest by default; None without any. What it
    reads is fixed from here on, whatever others commit."""
    number = current(spark, base) if number is None else number
    if number < 0:
        return None
    entry = _entry(spark, base, number)
    schema, paths = T.StructType.fromJson(entry["schema"]), entry["paths"] if "paths" in entry else sorted(set(entry["buckets"].values()))
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def change(spark: SparkSession, base: str, build: Callable[[DataFrame | None], DataFrame]) -> int:
    """Commits what ``build`` makes of the newest version and returns its number. If
    another writer commits first, what was written goes and ``build`` is asked again."""
    base = qualified(spark, base)
    for _ in range(RETRIES):
        seen = current(spark, base)
        rows = build(read_version(spark, base, seen))
        path = f"{base}/data-{uuid.uuid4().hex}"
        rows.write.parquet(path)
        if commit(spark, base, seen + 1, {"paths": [path], "schema": json.loads(rows.schema.json())}):
            return seen + 1
        _delete(spark, path)
    raise Conflict(base)


def clean_up(spark: SparkSession, base: str, older_than: float, keep: int = 1) -> list[int]:
    """Deletes versions written more than ``older_than`` seconds ago, but not the
    newest ``keep``, and data that only they name; returns their numbers. Data of
    that age which no version names was left by writers that died and goes too."""
    base = qualified(spark, base)
    numbers = _entries(spark, base)
    entries = {n: _entry(spark, base, n) for n in numbers}
    gone = [n for n in numbers[: len(numbers) - keep] if entries[n]["written"] < time.time() - older_than]
    used = {p for n in numbers if n not in gone for p in (entries[n].get("paths") or entries[n].get("buckets", {}).values())}
    fs, own = _file_system(spark, base)
    for n in gone:
        _delete(spark, f"{base}/_log/{n:020d}.json")
    for status in fs.listStatus(own):
        name, path = status.getPath().getName(), status.getPath().toString()
        old = status.getModificationTime() / 1000 < time.time() - older_than
        if name.startswith("data-") and old and not any(p == path or p.startswith(path + "/") for p in used):
            fs.delete(status.getPath(), True)
    return gone


# Buckets -----------------------------------------------------------------------


def _bucket(key: str, buckets: int, by: Column | None) -> Column:
    return F.pmod(F.xxhash64(F.col(key) if by is None else by), F.lit(buckets)).cast("int")


def _write_buckets(rows: DataFrame, base: str) -> dict[str, str]:
    """bucket -> folder of the rows with a column ``_bucket``."""
    path = f"{base}/data-{uuid.uuid4().hex}"
    rows.repartition("_bucket").write.partitionBy("_bucket").parquet(path)
    fs, own = _file_system(rows.sparkSession, path)
    names = [s.getPath().getName() for s in fs.listStatus(own)]
    return {n.split("=")[1]: f"{path}/{n}" for n in names if n.startswith("_bucket=")}


def create_buckets(df: DataFrame, base: str, key: str, buckets: int = 256, by: Column | None = None) -> int:
    """Version 0 of a table in ``buckets`` of the key, or of ``by``, an expression of
    the key alone that keeps together what changes together."""
    spark, base = df.sparkSession, qualified(df.sparkSession, base)
    folders = _write_buckets(df.withColumn("_bucket", _bucket(key, buckets, by)), base)
    if not commit(spark, base, 0, {"buckets": folders, "n": buckets, "schema": json.loads(df.schema.json())}):
        raise Conflict(f"{base} has a version already")
    return 0


def upsert_buckets(spark: SparkSession, base: str, new: DataFrame, key: str, by: Column | None = None, merge: Callable[[DataFrame, DataFrame, str], DataFrame] = upsert) -> tuple[int, list[int]]:
    """(version, buckets rewritten): the table after ``merge`` (upsert, or a patch of
    columns) of its touched buckets with ``new``. The other buckets stay the files
    that they are. If another writer commits first, only a writer whose buckets it
    changed does its work again; else the two changes are joined."""
    base, done = qualified(spark, base), None
    for _ in range(RETRIES):
        seen = current(spark, base)
        entry = _entry(spark, base, seen)
        if done is None or any(entry["buckets"].get(b) != p for b, p in done[0].items()):
            if done is not None:
                _delete(spark, done[2])
            number = _bucket(key, entry["n"], by)
            touched = sorted(str(r[0]) for r in new.select(number).distinct().collect())  # a row for each bucket
            before = {b: entry["buckets"].get(b) for b in touched}
            schema = T.StructType.fromJson(entry["schema"])
            paths = [p for p in before.values() if p]
            old = spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
            merged = merge(old, new, key).select(*schema.names)
            after = _write_buckets(merged.withColumn("_bucket", number), base)
            folder = next(iter(after.values())).rsplit("/", 1)[0] if after else ""
            done = (before, {b: after.get(b) for b in touched}, folder)
        buckets = {b: p for b, p in (entry["buckets"] | done[1]).items() if p}
        if commit(spark, base, seen + 1, {"buckets": buckets, "n": entry["n"], "schema": entry["schema"]}):
            return seen + 1, [int(b) for b in done[0]]
    raise Conflict(base)
