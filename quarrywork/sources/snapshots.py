"""Tables that change in one commit: row files that are never changed, and manifests that say which of them are the table.

A folder holds ``rows/<snapshot>/context=…/kind=…`` and ``manifests/<version>.json``. A change writes the partitions that it
touches as a new snapshot and then publishes the next manifest by one rename. A writer that dies before that leaves the
table as it was; of two that started from one version the second is refused. Readers keep the version that they opened.
The file system's rename must refuse a name that exists, as HDFS does.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.sets import changes, upserted
from ..session import cut, drop_table

PARTS = ("context", "kind")


class Conflict(RuntimeError):
    """Another writer has published this version."""


def _files(spark: SparkSession, path: str):
    """A path as the file system's own, the file system, and the session's handle to both."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    own = jvm.org.apache.hadoop.fs.Path(path)
    return own, own.getFileSystem(conf), jvm, conf


def versions(spark: SparkSession, folder: str) -> list[int]:
    """The published versions, oldest first; none where there is no table."""
    own, fs, *_ = _files(spark, f"{folder}/manifests")
    names = [s.getPath().getName() for s in fs.listStatus(own)] if fs.exists(own) else []
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith("."))


def _manifest(spark: SparkSession, folder: str, version: int) -> dict:
    return json.loads(spark.read.text(f"{folder}/manifests/{version:010d}.json", wholetext=True).first()[0])


def _publish(spark: SparkSession, folder: str, version: int, manifest: dict) -> None:
    staged, fs, jvm, conf = _files(spark, f"{folder}/manifests/.{uuid.uuid4().hex}")
    out = fs.create(staged, False)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    final = jvm.org.apache.hadoop.fs.Path(f"{folder}/manifests/{version:010d}.json")
    options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(staged, final, options)
    except Py4JJavaError as error:
        fs.delete(staged, False)
        if "FileAlreadyExists" in str(error.java_exception):
            raise Conflict(f"version {version} of {folder} is published") from None
        raise


def _among(names: list[tuple]) -> Column:
    """Whether a row is in one of these partitions; only their files are read."""
    each = [reduce(Column.__and__, [F.col(c).eqNullSafe(v) for c, v in zip(PARTS, name)]) for name in names]
    return reduce(Column.__or__, each, F.lit(False))


def read(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """The table as of a version, the latest by default. Each snapshot's files are read for the partitions it still holds."""
    manifest = _manifest(spark, folder, versions(spark, folder)[-1] if version is None else version)
    schema = StructType.fromJson(manifest["schema"])
    held: dict[str, list[tuple]] = {}
    for *name, snapshot in manifest["parts"]:
        held.setdefault(snapshot, []).append(tuple(name))
    parts = [spark.read.schema(schema).parquet(f"{folder}/rows/{s}").select(schema.names).filter(_among(n)) for s, n in sorted(held.items())]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def _names(rows: DataFrame) -> list[tuple]:
    """The partitions that rows lie in: contexts and kinds, few whatever the rows."""
    return [tuple(r) for r in rows.select(*PARTS).distinct().collect()]


def commit(spark: SparkSession, folder: str, rows: DataFrame, touched: list[tuple], base: int) -> int:
    """Make ``rows`` all that the partitions ``touched`` hold, after version ``base`` (0: no table yet); the new version.
    Partitions that aren't touched stay where they are, and one without rows is none any more. Text in ``context`` and ``kind`` is null or not empty."""
    snapshot = uuid.uuid4().hex
    rows.write.partitionBy(*PARTS).parquet(f"{folder}/rows/{snapshot}")
    filled = _names(spark.read.schema(rows.schema).parquet(f"{folder}/rows/{snapshot}"))
    before = _manifest(spark, folder, base)["parts"] if base else []
    parts = [p for p in before if tuple(p[:-1]) not in set(touched)] + [[*name, snapshot] for name in filled]
    _publish(spark, folder, base + 1, {"schema": json.loads(rows.schema.json()), "parts": parts})
    return base + 1


def create(spark: SparkSession, folder: str, rows: DataFrame) -> int:
    """A new table. Rows are read twice, once for their partitions."""
    return commit(spark, folder, rows, _names(rows), 0)


def upsert(spark: SparkSession, folder: str, incoming: DataFrame) -> int:
    """Merge rows into the table by ``id``, within their partitions: the latest ``indexed_at`` stays, of equal ones the
    incoming row. A repeated call with the same rows changes nothing but the version."""
    base = versions(spark, folder)[-1]
    stored, touched = read(spark, folder, base), _names(incoming)
    rows = upserted(stored.filter(_among(touched)), incoming.select(stored.columns), ["id"], "indexed_at")
    return commit(spark, folder, rows.select(stored.columns), touched, base)


def reindex(spark: SparkSession, folder: str, listing: DataFrame, elements_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Bring the table up to a listing (file_path, modified) of all files, each once, in one commit; (file_path, change) of all.

    ``elements_of`` makes the rows (with file_path, modified, context, kind) of the files that are new or modified, and sees only
    these. Elements of files that are gone or modified go. A file without elements isn't known to the table and is read
    again each time. Only partitions that lose or gain rows are written; without a change none is, and there is no new version.
    """
    published = versions(spark, folder)
    base = published[-1] if published else 0
    if base:
        stored = read(spark, folder, base)
        known = stored.groupBy("file_path").agg(F.max("modified").alias("_indexed"))
        found = cut(changes(listing, known, "file_path", F.col("modified") > F.col("_indexed")))
    else:
        found = cut(listing.select("file_path", F.lit("new").alias("change")))
    wanted = found.filter("change IN ('new', 'modified')").select("file_path")
    fresh = cut(elements_of(listing.join(wanted, "file_path", "semi")))
    touched = set(_names(fresh))
    rows = fresh
    if base:
        gone = found.filter("change IN ('deleted', 'modified')").select("file_path")
        touched |= set(_names(stored.join(gone, "file_path", "semi")))
        kept = stored.filter(_among(list(touched))).join(gone, "file_path", "anti")
        rows = kept.select(stored.columns).unionByName(fresh.select(stored.columns))
    if touched or not base:
        commit(spark, folder, rows, sorted(touched, key=str), base)
    drop_table(fresh)
    return found


def vacuum(spark: SparkSession, folder: str, keep: int = 1) -> int:
    """Remove all but the last ``keep`` versions, and row files that none of those names; how many snapshots went.
    Not while a writer is at work: what it has written isn't named yet."""
    every = versions(spark, folder)
    held = {p[-1] for v in every[-keep:] for p in _manifest(spark, folder, v)["parts"]}
    for v in every[:-keep]:
        own, fs, *_ = _files(spark, f"{folder}/manifests/{v:010d}.json")
        fs.delete(own, False)
    own, fs, *_ = _files(spark, f"{folder}/rows")
    stale = [s.getPath() for s in fs.listStatus(own) if s.getPath().getName() not in held]
    for path in stale:
        fs.delete(path, True)
    return len(stale)
