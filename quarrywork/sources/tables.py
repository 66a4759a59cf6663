"""Sinks of elements and graphs, and deletes by path. Tables that change by commits are in ``snapshots``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import usable
from ..operators.sets import without


def point_id(*parts: str | Column) -> Column:
    """The id that makes writing the same element again an update."""
    return F.md5(F.concat_ws(":", *parts))


def points(elements: DataFrame, vector: str) -> DataFrame:
    """Without those whose vector is null or zero."""
    return elements.filter(usable(F.col(vector)))


def write_graph(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """Tables ``nodes`` (node, kind) and ``edges`` (src, dst, kind), an edge of a kind once; the ends that are no nodes are
    written as such of kind ``Reference``."""
    once = edges.select("src", "dst", "kind").distinct()
    once.write.mode("overwrite").parquet(f"{folder}/edges")
    stored = nodes.sparkSession.read.parquet(f"{folder}/edges")
    ends = stored.select(F.col("src").alias("node")).union(stored.select("dst")).distinct()
    missing = ends.join(nodes.select("node"), "node", "anti").withColumn("kind", F.lit("Reference"))
    nodes.select("node", "kind").distinct().unionByName(missing).write.mode("overwrite").parquet(f"{folder}/nodes")


def delete_paths(elements: DataFrame, gone: DataFrame) -> DataFrame:
    return without(elements, gone, "file_path")
