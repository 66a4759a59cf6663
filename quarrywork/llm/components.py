"""Connected components of an undirected graph that no machine could hold."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_table


def forest(pairs: Iterator[tuple[int, int]]) -> dict[int, int]:
    """Union-find over one batch of edges: every node with the smallest node that these edges reach."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def _contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = forest(zip(batch.a.tolist(), batch.b.tolist()))
        yield pd.DataFrame({"a": list(found), "b": list(found.values())}).query("a != b")


#: Edges that one task of a round reads: a round has as many tasks as its edges ask for.
EDGES_PER_TASK = 200_000


def _spread(edges: DataFrame, rows: int) -> DataFrame:
    return edges.coalesce(max(1, -(-rows // EDGES_PER_TASK)))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that ``edges`` (a, b) mention; component is its smallest node.

    Union-find shortens the edges within a batch; then, round by round, every node's larger neighbours
    are linked with the smallest of it and its neighbours (large star), and its smaller neighbours with
    their smallest one (small star), until nothing changes. Each round is written to the shared folder.
    Nodes are longs. No edges give no rows; loops and repeated edges are harmless, nodes with loops alone left out.
    """
    edges = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a != b")
    now = cut(edges.mapInPandas(_contract, "a long, b long"), "edges")
    mark = _mark(now)
    while True:
        links = _spread(now, mark[0])
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = large.filter("a != b").distinct()  # every edge has its smaller node second by now
        least = small.groupBy("a").agg(F.min("b").alias("m"))
        linked = small.join(least, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = cut(linked.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        drop_table(now)
        now, was, mark = after, mark, _mark(after)
        if was == mark:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def _mark(edges: DataFrame) -> tuple:
    """(number of edges, a sum over them) by which a round that changed nothing is told."""
    total = F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).cast("string")
    return tuple(edges.agg(F.count("*"), total).first())
