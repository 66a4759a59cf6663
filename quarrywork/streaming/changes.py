"""Change events as streams: sources, expiry, budgets, hand-over by context; what needs a key's state is in ``keyed``.

All of it is event time with a watermark, so a stream that is restarted gives the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: How late an event may be.
LATE = "10 seconds"
SCHEMA = "event_id long, ts timestamp, path string, old_path string, context string, kind string"
IGNORED = r"(^|/)\.|\.(tmp|swp)$|/(bin|obj|node_modules)/"


def expanded(events: DataFrame) -> DataFrame:
    """Events without what is ignored; a rename, which has an ``old_path``, is the deletion of one path and the creation of
    another."""
    change = lambda path, kind: F.struct(path.alias("path"), F.lit(kind).alias("kind"))
    both = F.array(change(F.col("old_path"), "delete"), change(F.col("path"), "create"))
    own = F.array(F.struct(F.col("path").alias("path"), F.col("kind").alias("kind")))
    changes = F.when(F.col("kind") == "rename", both).otherwise(own)
    others = [c for c in events.columns if c not in ("path", "old_path", "kind")]
    rows = events.select(*others, F.inline(changes))
    return rows.filter(F.col("path").isNotNull() & ~F.col("path").rlike(IGNORED))


def source(spark: SparkSession, folder: str, schema: str = SCHEMA) -> DataFrame:
    """JSON files of events, as they come into a folder."""
    return expanded(spark.readStream.schema(schema).json(folder))


def table_stream(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """A Parquet table as a stream, a single file or a folder of them; at most ``files`` files a trigger."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    listed = f"{path[:-1]}[{path[-1]}]"  # a pattern for this one name: a plain path has to be a folder
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(listed)


def drained(stream: DataFrame, folder: str) -> DataFrame:
    """Everything that a stream gives now, appended to a table in the shared folder. A run that is repeated goes on where
    its checkpoint ends, and no row is written twice."""
    spark = stream.sparkSession
    writer = stream.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
    writer.option("checkpointLocation", f"{folder}/checkpoint").start(f"{folder}/rows").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def sessions(events: DataFrame, key: str = "context", idle: str = "30 minutes") -> DataFrame:
    """A session of each key ends after ``idle`` without an event."""
    found = events.withWatermark("ts", LATE).groupBy(F.session_window("ts", idle), key).agg(F.count("*").alias("events"))
    return found.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events")


def sliding_sum(events: DataFrame, amount: str, length: str = "60 seconds", slide: str = "1 second") -> DataFrame:
    sums = events.withWatermark("ts", LATE).groupBy(F.window("ts", length, slide)).agg(F.sum(amount).alias("used"))
    return sums.select(F.col("window.end").alias("at"), "used")


def by_context(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, **trigger):
    """Hand each micro-batch's distinct (context, path) to ``handle``, which must be idempotent in the batch's number."""

    def run(batch: DataFrame, number: int) -> None:
        handle(batch.select("context", "path").distinct(), number)

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
