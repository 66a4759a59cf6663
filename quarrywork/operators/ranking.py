"""Top rows, pages, fusion of hit lists, and re-ranking by use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(n)


def top_in_groups(df: DataFrame, n: int, group: str | list[str], *order: Column) -> DataFrame:
    """The first ``n`` rows of each group. Spark keeps ``n`` of a group within each task before the shuffle."""
    rank = F.row_number().over(W.partitionBy(group).orderBy(*order))
    return df.withColumn("rank", rank).filter(F.col("rank") <= n)


def page(df: DataFrame, offset: int, limit: int, *order: Column) -> DataFrame:
    """A page of rows, with the number of all and whether more follow; the total comes from an aggregate."""
    total = df.agg(F.count("*").alias("total"))
    rows = df.orderBy(*order).offset(offset).limit(limit)
    joined = rows.join(F.broadcast(total), F.lit(True))  # one row: a bounded broadcast
    return joined.withColumn("has_more", F.col("total") > offset + limit)


def fused(first: DataFrame, second: DataFrame, key: list[str]) -> DataFrame:
    """Full outer merge of two hit lists (key, score): the mean where both have a hit."""
    a = first.select(*key, F.col("score").alias("semantic"))
    b = second.select(*key, F.col("score").alias("graph"))
    both = a.join(b, key, "full_outer")
    mean = (F.col("semantic") + F.col("graph")) / 2
    return both.withColumn("score", F.coalesce(mean, "semantic", "graph"))


def latest(df: DataFrame, key: str | list[str], *order: Column) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(key).orderBy(*order))
    return df.withColumn("_r", rank).filter("_r = 1").drop("_r")
