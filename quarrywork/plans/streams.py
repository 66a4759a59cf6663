"""Streams of change events, run to their end: events.parquet is a stream's source, and what is emitted is read back.

Windows are emitted once the watermark has passed them, so what is still open at the last event isn't there.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import shared_dir
from ..streaming import changes, keyed
from . import query

_GAPS = """WITH e AS (SELECT user_id, event_type, ts, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY {k} ORDER BY ts) AS gap FROM events),
  s AS (SELECT *, sum((gap IS NULL OR gap >= {us})::INT) OVER (PARTITION BY {k} ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM e)"""


_SEEN = "(SELECT epoch_us(max(ts)) - 10000000 FROM events)"


def _events(spark, sf_dir, files=None):
    """The events table as a stream of changes; a click is a rename."""
    raw = changes.table_stream(spark, f"{sf_dir}/events.parquet", files)
    kinds = F.when(F.col("event_type") == "click", "rename").otherwise(F.col("event_type"))
    user = F.col("user_id").cast("string")
    return raw.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("src/"), user).alias("path"),
        F.concat(F.lit("old/"), user).alias("old_path"),
        F.concat(F.lit("c"), (F.col("user_id") % 5).cast("string")).alias("context"),
        kinds.alias("kind"),
        "value",
    )


def _drained(spark, stream):
    return changes.drained(stream, f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}")


@query("R01", """SELECT event_id, 'src/' || user_id AS path, CASE event_type WHEN 'click' THEN 'create' ELSE event_type END AS kind FROM events
  UNION ALL SELECT event_id, 'old/' || user_id, 'delete' FROM events WHERE event_type = 'click'""")
def changed(spark, sf_dir):
    return _drained(spark, changes.expanded(_events(spark, sf_dir)).select("event_id", "path", "kind"))


@query("R02", _GAPS.format(k="user_id", us=3600000000) + f""" SELECT 'src/' || user_id AS path, CASE arg_max(event_type, ts) WHEN 'click' THEN 'rename' ELSE arg_max(event_type, ts) END AS kind, count(*) AS events FROM s
  GROUP BY user_id, n HAVING epoch_us(max(ts)) + 3600000000 <= {_SEEN}""")
def debounced(spark, sf_dir):
    """Bursts of a path's changes that an hour parts, each with its last kind."""
    with keyed.keyed_state(spark):
        return _drained(spark, keyed.debounced(_events(spark, sf_dir), 3_600_000_000).select("path", "kind", "events"))


@query("R03", """SELECT 'c' || (user_id % 5) AS context, list_sort(list(DISTINCT 'src/' || user_id)) AS paths FROM events GROUP BY 1""")
def micro_batch(spark, sf_dir):
    """Each micro-batch is handed on by context, under its own number, so that one that is repeated replaces itself."""
    folder = f"{shared_dir(spark)}/batches-{uuid.uuid4().hex}"

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    changes.by_context(_events(spark, sf_dir), keep, f"{folder}/checkpoint", availableNow=True).awaitTermination()
    rows = spark.read.schema("context string, path string, batch long").parquet(f"{folder}/rows")
    return rows.groupBy("context").agg(F.array_sort(F.collect_set("path")).alias("paths"))


@query("R04", _GAPS.format(k="user_id", us=1800000000) + f""" SELECT 'src/' || user_id AS path, epoch_us(min(ts)) AS start, count(*) AS events FROM s
  GROUP BY user_id, n HAVING epoch_us(max(ts)) + 1800000000 <= {_SEEN}""")
def expiry(spark, sf_dir):
    found = changes.sessions(_events(spark, sf_dir), "path", "30 minutes")
    return _drained(spark, found.select("path", F.unix_micros("start").alias("start"), "events"))


@query("R05", f"""WITH w AS (SELECT (epoch_us(ts) // 20000000 + unnest([1, 2, 3])) * 20000000 AS until, value FROM events)
  SELECT until, round(sum(value), 2) AS used FROM w GROUP BY until HAVING until <= {_SEEN}""")
def budget(spark, sf_dir):
    """Sixty seconds that slide by twenty: each event counts in three windows."""
    found = changes.sliding_sum(_events(spark, sf_dir), "value", "60 seconds", "20 seconds")
    return _drained(spark, found.select(F.unix_micros("at").alias("until"), F.round("used", 2).alias("used")))


@query("R06", f"""WITH s AS (SELECT user_id, ts, event_type, sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n
    FROM events WHERE epoch_us(ts) <= {_SEEN})
  SELECT 'src/' || user_id AS path, epoch_us(min(ts)) AS since FROM s WHERE event_type <> 'purchase' GROUP BY user_id, n""")
def queue(spark, sf_dir):
    """Whenever an item enters the queue; while it waits, further changes don't bring it in again, and a purchase takes it out."""
    with keyed.keyed_state(spark):
        return _drained(spark, keyed.queued(_events(spark, sf_dir), F.col("kind") == "purchase"))
