"""What changed between two listings, and upserts and deletes by key on plain tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import latest


def changes(now: DataFrame, before: DataFrame, key: str, modified: Column | None = None) -> DataFrame:
    """(key, change): new, deleted, modified or unchanged, by one full outer join. Both sides have one row for a key."""
    joined = now.withColumn("_now", F.lit(True)).join(before.withColumn("_before", F.lit(True)), key, "full_outer")
    kind = F.when(F.col("_before").isNull(), "new").when(F.col("_now").isNull(), "deleted")
    if modified is not None:
        kind = kind.when(F.coalesce(modified, F.lit(True)), "modified")
    return joined.select(key, kind.otherwise("unchanged").alias("change"))


def upserted(stored: DataFrame, incoming: DataFrame, key: list[str], stamp: str) -> DataFrame:
    """The latest row of each key; of equal stamps the incoming one."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    return latest(both, key, F.desc_nulls_last(stamp), F.desc("_new")).drop("_new")


def without(stored: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return stored.join(gone.select(key).distinct(), key, "anti")
