"""Verdicts of several models on one item, put together. Votes are rows (item, model, score, message, severity)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: The mean from which an item passes, and how many models must name an issue for it to count.
PASS, AGREE = 8, 2
#: Scores between which a first model is unsure, and the difference of two that calls for a third.
UNSURE, APART = (4, 8), 2


def voted(votes: DataFrame, item: str, agree: int = AGREE) -> DataFrame:
    """(item, score, confidence, votes, passed, issues): the mean, rounded half to even, how far the models agree, and the
    issues that ``agree`` of them name. Issues are counted before they are gathered."""
    means = votes.groupBy(item).agg(
        F.bround(F.avg("score"), 0).alias("score"),
        F.greatest(F.lit(0.0), 1 - F.stddev_pop("score") / 5).alias("confidence"),
        F.count("*").alias("votes"),
    )
    shared = votes.groupBy(item, "message", "severity").agg(F.count("*").alias("n")).filter(F.col("n") >= agree)
    issues = shared.groupBy(item).agg(F.array_sort(F.collect_list(F.concat_ws("/", "message", "severity"))).alias("issues"))
    joined = means.join(issues, item, "left")
    none = F.array().cast("array<string>")
    return joined.withColumns({"passed": F.col("score") >= PASS, "issues": F.coalesce("issues", none)})


def extremes(votes: DataFrame, item: str) -> DataFrame:
    """(item, pessimist, optimist, issues): the lowest and the highest score, and the distinct messages."""
    return votes.groupBy(item).agg(
        F.min("score").alias("pessimist"), F.max("score").alias("optimist"), F.array_sort(F.collect_set("message")).alias("issues")
    )


def consulted(votes: DataFrame, item: str, iteration: Column, last: int, *order: str) -> DataFrame:
    """The votes that are asked for: one in early iterations; in the two before the last one a second where the first is
    unsure and a third where two are far apart; three in the last."""
    own = W.partitionBy(item)
    ranked = votes.withColumn("_k", F.row_number().over(own.orderBy(*order)))
    of = lambda k: F.max(F.when(F.col("_k") == k, F.col("score"))).over(own)
    placed = ranked.withColumns({"_a": of(1), "_b": of(2)})
    sure = (F.col("_a") >= UNSURE[1]) | (F.col("_a") < UNSURE[0])
    most = (
        F.when(iteration < last - 2, 1)
        .when(iteration >= last, 3)
        .when(sure, 1)
        .when(F.abs(F.col("_a") - F.col("_b")) > APART, 3)
        .otherwise(2)
    )
    return placed.filter(F.col("_k") <= most).drop("_k", "_a", "_b")
