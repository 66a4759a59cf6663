"""Streams give the same rows for a file, a folder, many files, any trigger size, rows out of order, and after a restart."""

import datetime as dt
import os
import shutil

import pytest
from pyspark.sql import functions as F

from quarrywork.registry import QUERIES
from quarrywork.streaming import changes, keyed

SF = "/root/testdata/sf0.001"
STREAMS = ["R01", "R02", "R03", "R04", "R05", "R06"]


def rows_of(df):
    return sorted(repr(tuple(r)) for r in df.collect())


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """The events as a folder of files, each a stretch of time."""
    folder = tmp_path_factory.mktemp("sf")
    events = spark.read.parquet(f"{SF}/events.parquet").orderBy("ts").collect()
    schema = spark.read.parquet(f"{SF}/events.parquet").schema
    for i in range(5):
        part = spark.createDataFrame(events[200 * i : 200 * (i + 1)], schema).coalesce(1)
        part.write.mode("append").parquet(f"{folder}/events.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def whole(spark):
    return {name: rows_of(QUERIES[name](spark, SF)) for name in STREAMS}


@pytest.mark.parametrize("name", STREAMS)
@pytest.mark.parametrize("files", [None, 1])
def test_folder_and_triggers(spark, parts, whole, monkeypatch, name, files):
    table_stream = changes.table_stream
    monkeypatch.setattr(changes, "table_stream", lambda spark, path, _: table_stream(spark, path, files))
    assert rows_of(QUERIES[name](spark, parts)) == whole[name]


def source(spark, path):
    return changes.table_stream(spark, path, 1).select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("string").alias("path"), F.col("event_type").alias("kind"))


@pytest.mark.parametrize("make", [lambda e: keyed.debounced(e, 3_600_000_000), lambda e: keyed.queued(e, F.col("kind") == "purchase")])
def test_restart(spark, parts, tmp_path, make):
    """A run over two of the files, then another over all of them, which goes on where the first ended."""
    with keyed.keyed_state(spark):
        want = rows_of(changes.drained(make(source(spark, f"{parts}/events.parquet")), str(tmp_path / "once")))
        some = tmp_path / "events.parquet"
        os.makedirs(some)
        files = sorted((f for f in os.listdir(f"{parts}/events.parquet") if f.endswith(".parquet")), key=lambda f: os.stat(f"{parts}/events.parquet/{f}").st_mtime_ns)
        for among in (files[:2], files[2:]):
            for f in among:
                shutil.copy2(f"{parts}/events.parquet/{f}", some)
            found = changes.drained(make(source(spark, str(some))), str(tmp_path / "twice"))
        assert rows_of(found) == want


def test_changes_out_of_order(spark, tmp_path):
    """Bursts, a gap of exactly the quiet time, a rename, an ignored path, a late row and rows in the wrong order."""
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    first = [(2, at(2), "a", None, "x", "changed"), (1, at(0), "a", None, "x", "created"), (3, at(9), "b", "a", "x", "rename"), (4, at(1), ".git/q", None, "x", "changed")]
    second = [(6, at(8), "c", None, "x", "changed"), (5, at(5), "c", None, "x", "created"), (7, at(7), "d", None, "x", "created"), (8, at(300), "end", None, "x", "created")]
    third = [(9, at(20), "late", None, "x", "created"), (10, at(600), "end", None, "x", "changed")]
    for i, rows in enumerate((first, second, third)):
        spark.createDataFrame(rows, changes.SCHEMA).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    events = expanded = changes.expanded(spark.readStream.schema(changes.SCHEMA).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in")))
    with keyed.keyed_state(spark):
        found = changes.drained(keyed.debounced(expanded, 3_000_000), str(tmp_path / "bursts"))
        assert sorted((r.path, r.kind, r.events) for r in found.collect()) == [
            ("a", "changed", 2), ("a", "delete", 1), ("b", "create", 1), ("c", "changed", 1), ("c", "created", 1), ("d", "created", 1), ("end", "created", 1),
        ]
        waits = changes.drained(keyed.queued(events, F.col("kind") == "changed"), str(tmp_path / "queue"))
        assert sorted(r.path for r in waits.collect()) == ["a", "a", "b", "c", "d", "end"]
