"""Joins and set operations over the star tables. Aggregates come before joins wherever that avoids a fan-out."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators import graph, sets
from ..session import shared_dir, table
from ..sources import snapshots, tables
from . import query


@query("J01", """SELECT c_custkey, list_sort(coalesce(list(o_orderkey) FILTER (o_orderkey IS NOT NULL), [])) AS orders
  FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P' GROUP BY c_custkey""")
def collected(spark, sf_dir):
    own = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey"))
    lists = own.agg(F.array_sort(F.collect_list("o_orderkey")).alias("orders"))
    joined = table(spark, sf_dir, "customer").select("c_custkey").join(lists, "c_custkey", "left")
    return joined.select("c_custkey", F.coalesce("orders", F.array().cast("array<bigint>")).alias("orders"))


@query("J02", """SELECT o_orderkey, list(l_linenumber || ':' || l_partkey ORDER BY l_linenumber, l_partkey) AS tasks
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey""")
def plan_tasks(spark, sf_dir):
    task = F.struct("l_linenumber", "l_partkey")
    lists = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(task)).alias("t"))
    named = F.transform("t", lambda x: F.concat_ws(":", x["l_linenumber"].cast("string"), x["l_partkey"].cast("string")))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey"))
    return orders.join(lists, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", named.alias("tasks"))


@query("J03", """SELECT n_nationkey, coalesce(c.x, []) AS segments, coalesce(s.x, []) AS suppliers, coalesce(o.x, []) AS neighbours FROM nation n
  LEFT JOIN (SELECT c_nationkey AS k, list_sort(list(DISTINCT c_mktsegment)) AS x FROM customer GROUP BY 1) c ON c.k = n_nationkey
  LEFT JOIN (SELECT s_nationkey AS k, list_sort(list(DISTINCT s_suppkey)) AS x FROM supplier GROUP BY 1) s ON s.k = n_nationkey
  LEFT JOIN (SELECT a.n_nationkey AS k, list_sort(list(b.n_nationkey)) AS x FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey GROUP BY 1) o ON o.k = n_nationkey""")
def edge_kinds(spark, sf_dir):
    """Three kinds of edges, each collected to distinct ones before it is joined, so that they don't multiply."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    other = nation.select(F.col("n_nationkey").alias("_o"), "n_regionkey")
    pairs = nation.join(other, "n_regionkey").filter("_o <> n_nationkey")
    kinds = {
        "segments": table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n_nationkey"), F.col("c_mktsegment").alias("x")),
        "suppliers": table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n_nationkey"), F.col("s_suppkey").alias("x")),
        "neighbours": pairs.select("n_nationkey", F.col("_o").alias("x")),
    }
    out = nation.select("n_nationkey")
    for name, edges in kinds.items():
        sets = edges.groupBy("n_nationkey").agg(F.array_sort(F.collect_set("x")).alias(name))
        out = out.join(sets, "n_nationkey", "left").withColumn(name, F.coalesce(name, F.array().cast(sets.schema[name].dataType)))
    return out


@query("J04", """SELECT r_name, n_name, o_orderpriority, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def star(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    # nation and region are small by definition; Spark broadcasts them by their size, no hint forces it
    joined = (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_nationkey", "o_orderpriority")
        .agg(F.count("*").alias("n"))
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return joined.groupBy("r_name", "n_name", "o_orderpriority").agg(F.sum("n").alias("n"))


@query("J05", """SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'Reference' ELSE 'Node' END AS target FROM documents d
  LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)""")
def placeholders(spark, sf_dir):
    known = table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("_k", F.lit(True))
    joined = table(spark, sf_dir, "documents").select("doc_id").join(known, "doc_id", "left")
    return joined.select("doc_id", F.when(F.col("_k"), "Node").otherwise("Reference").alias("target"))


@query("J06", """WITH t AS (SELECT conv_id, turn, least(6, 1 + length(text) // 200) AS level FROM conversations)
  SELECT a.conv_id, a.turn, min(b.turn) AS end_turn FROM t a LEFT JOIN t b
  ON a.conv_id = b.conv_id AND b.turn > a.turn AND b.level <= a.level GROUP BY a.conv_id, a.turn""")
def containment(spark, sf_dir):
    """The first later turn of a level as high, of six levels: one pass over each conversation from its end, not a join
    of its turns with each other."""
    level = F.least(F.lit(6), 1 + F.floor(F.length("text") / 200))
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", level.alias("level"))
    later = W.partitionBy("conv_id").orderBy(F.desc("turn")).rangeBetween(W.unboundedPreceding, -1)
    ends = [F.when(F.col("level") == k, F.min(F.when(F.col("level") <= k, F.col("turn"))).over(later)) for k in range(1, 7)]
    return t.select("conv_id", "turn", F.coalesce(*ends).alias("end_turn")).groupBy("conv_id", "turn").agg(F.min("end_turn").alias("end_turn"))


@query("J08", """WITH x AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)
  SELECT a.l_partkey AS a, b.l_partkey AS b, count(*) AS times FROM x a JOIN x b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY 1, 2""")
def co_occurrence(spark, sf_dir):
    return graph.pairs_within(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey")


@query("J09", """WITH x AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem), p AS (
  SELECT a.l_suppkey AS a, b.l_suppkey AS b, count(*) AS times FROM x a JOIN x b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey GROUP BY 1, 2)
  SELECT b AS neighbour, times FROM p WHERE a = 3 UNION ALL SELECT a, times FROM p WHERE b = 3""")
def neighbours(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").distinct()
    own = items.filter("l_suppkey = 3").select("l_orderkey")  # only groups that hold the item take part
    met = items.join(own, "l_orderkey", "semi").filter("l_suppkey <> 3")
    return met.groupBy(F.col("l_suppkey").alias("neighbour")).agg(F.count("*").alias("times"))


@query("J10", """SELECT d.doc_id, round(n_chars / 1000.0 * (1 + 0.5 * coalesce(l.quality::DOUBLE, 0.5)), 6)::DOUBLE AS score
  FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) l USING (doc_id)""")
def hit_importance(spark, sf_dir):
    known = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").cast("double").alias("quality"))
    hits = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(known, "doc_id", "left")
    score = F.col("n_chars") / 1000.0 * (1 + 0.5 * F.coalesce("quality", F.lit(0.5)))
    return hits.select("doc_id", F.round(score, 6).alias("score"))


@query("J14", """WITH a AS (SELECT l_partkey AS k, avg(l_discount) AS s FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1),
  b AS (SELECT l_partkey AS k, avg(l_tax) AS g FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1)
  SELECT k, round(coalesce((s + g) / 2, s, g) + 1e-9, 4) AS score FROM a FULL JOIN b USING (k)""")
def hybrid_merge(spark, sf_dir):
    from ..operators.ranking import fused

    items = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k"), "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    a = items.filter("l_returnflag = 'A'").groupBy("k").agg(F.avg("l_discount").alias("score"))
    b = items.filter("l_linestatus = 'F'").groupBy("k").agg(F.avg("l_tax").alias("score"))
    return fused(a, b, ["k"]).select("k", F.round(F.col("score") + 1e-9, 4).alias("score"))


@query("J18", """SELECT n_name, count(DISTINCT c_custkey) AS customers, list_sort(list(DISTINCT c_mktsegment)) AS segments
  FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY n_name""")
def contained(spark, sf_dir):
    own = table(spark, sf_dir, "customer").groupBy("c_nationkey")
    rolled = own.agg(F.count_distinct("c_custkey").alias("customers"), F.array_sort(F.collect_set("c_mktsegment")).alias("segments"))
    nation = table(spark, sf_dir, "nation")
    return rolled.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "customers", "segments")


@query("J19", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')")
def missing(spark, sf_dir):
    used = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey").join(used, "p_partkey", "anti")


@query("U01", """SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'new' WHEN d.doc_id IS NULL THEN 'deleted' ELSE 'unchanged' END AS change
  FROM (SELECT doc_id FROM documents) d FULL JOIN (SELECT DISTINCT doc_id + 5 AS doc_id FROM labels) l ON d.doc_id = l.doc_id""")
def changes(spark, sf_dir):
    """Documents against an index that was made of the labelled ones under older numbers: some are new, some gone."""
    indexed = table(spark, sf_dir, "labels").select((F.col("doc_id") + 5).alias("doc_id")).distinct()
    return sets.changes(table(spark, sf_dir, "documents").select("doc_id"), indexed, "doc_id")


@query("U02", """SELECT a.k AS k, CASE WHEN b.m IS NULL OR a.m > b.m THEN 'modified' ELSE 'unchanged' END AS change FROM
  (SELECT o_custkey AS k, max(o_orderdate) AS m FROM orders GROUP BY 1) a JOIN
  (SELECT o_custkey AS k, max(o_orderdate) AS m FROM orders WHERE o_orderdate < '2000-01-01' GROUP BY 1) b USING (k)
  UNION ALL SELECT DISTINCT o_custkey, 'new' FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate < '2000-01-01')""")
def modified(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_orderdate")
    now = orders.groupBy("k").agg(F.max("o_orderdate").alias("m"))
    before = orders.filter("o_orderdate < '2000-01-01'").groupBy("k").agg(F.max("o_orderdate").alias("indexed"))
    return sets.changes(now, before, "k", F.col("m") > F.col("indexed"))


@query("U04", "SELECT n_nationkey AS k FROM nation UNION SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier")
def distinct_union(spark, sf_dir):
    parts = (("nation", "n_nationkey"), ("customer", "c_nationkey"), ("supplier", "s_nationkey"))
    a, b, c = (table(spark, sf_dir, t).select(F.col(k).alias("k")) for t, k in parts)
    return a.union(b).union(c).distinct()


@query("S17", """SELECT vec_id, label % 3 AS kind, round(list_sum(embedding::DOUBLE[]), 4)::DOUBLE AS total, vec_id % 4 = 0 AS replaced FROM embeddings WHERE len(list_filter(embedding, lambda x: x <> 0)) > 0""")
def upsert(spark, sf_dir):
    """Points written to a table by kind, then a fourth of them again: null and zero vectors are skipped, and a point that
    is written twice is one row, its latest."""
    key = F.col("vec_id").cast("string")
    points = table(spark, sf_dir, "embeddings").select(
        tables.point_id(F.lit("all"), key).alias("id"), F.lit("all").alias("context"), (F.col("label") % 3).cast("string").alias("kind"),
        "vec_id", "embedding", F.lit(1).alias("indexed_at"))
    none = points.limit(1).withColumns({"embedding": F.lit(None).cast(points.schema["embedding"].dataType), "id": F.lit("none")})
    folder = f"{shared_dir(spark)}/points-{uuid.uuid4().hex}"
    snapshots.create(spark, folder, tables.points(points.unionByName(none), "embedding"))
    again = points.filter("vec_id % 4 = 0").withColumn("indexed_at", F.lit(2))
    snapshots.upsert(spark, folder, tables.points(again, "embedding"))
    snapshots.vacuum(spark, folder)
    stored = snapshots.read(spark, folder)
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return stored.select("vec_id", F.col("kind").cast("int").alias("kind"), F.round(total, 4).alias("total"), (F.col("indexed_at") == 2).alias("replaced"))


@query("REINDEX", """WITH l AS (SELECT doc_id, max(quality) AS q, max(toxic) AS t FROM labels GROUP BY 1), w AS (SELECT CAST(doc_id AS VARCHAR) AS file_path, q IS NULL AS added, coalesce(q = 0, false) AS gone,
      coalesce(t = 1, false) AS touched, lang, source FROM documents LEFT JOIN l USING (doc_id))
  SELECT file_path, CASE WHEN gone THEN 'deleted' WHEN added THEN 'new' WHEN touched THEN 'modified' ELSE 'unchanged' END AS change,
    CASE WHEN NOT gone THEN CASE WHEN touched AND NOT added THEN 2 ELSE 1 END END AS modified, CASE WHEN NOT gone THEN lang END AS context, CASE WHEN NOT gone THEN source END AS kind FROM w""")
def reindexed(spark, sf_dir):
    """The labelled documents are indexed; then all are listed but those of no quality, the toxic ones with a later time.
    Each document's change, and what the index then holds of it."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.col("doc_id").cast("string").alias("file_path"), F.col("lang").alias("context"), F.col("source").alias("kind"))
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("q"), F.max("toxic").alias("t"))
    files = docs.join(labels, "doc_id", "left")
    listed = files.select("file_path", F.when(F.col("t") == 1, 2).otherwise(1).alias("modified"))
    elements = lambda files: files.join(docs.drop("doc_id"), "file_path")
    folder = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    before = files.filter("q IS NOT NULL").select("file_path", F.lit(1).alias("modified"))
    snapshots.reindex(spark, folder, before, elements)
    now = listed.join(files.filter("q = 0").select("file_path"), "file_path", "anti")
    found = snapshots.reindex(spark, folder, now, elements)
    snapshots.vacuum(spark, folder)
    return found.join(snapshots.read(spark, folder), "file_path", "left").select("file_path", "change", "modified", "context", "kind")


@query("S18", """WITH n AS (SELECT doc_id FROM documents), e AS (SELECT DISTINCT doc_id AS src, doc_id * 3 // 2 AS dst FROM documents)
  SELECT 'node' AS part, doc_id AS a, NULL::BIGINT AS b, 'Document' AS kind FROM n UNION ALL SELECT 'edge', src, dst, 'USES' FROM e
  UNION ALL SELECT DISTINCT 'node', dst, NULL::BIGINT, 'Reference' FROM e WHERE dst NOT IN (SELECT doc_id FROM n)""")
def graph_sink(spark, sf_dir):
    """Nodes and edges written as tables, each edge once; an end that is no node yet becomes a placeholder."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    nodes = docs.select(F.col("doc_id").alias("node"), F.lit("Document").alias("kind"))
    edges = docs.select(F.col("doc_id").alias("src"), F.floor(F.col("doc_id") * 3 / 2).alias("dst"), F.lit("USES").alias("kind"))
    folder = f"{shared_dir(spark)}/graph-{uuid.uuid4().hex}"
    tables.write_graph(nodes, edges.unionByName(edges), folder)
    stored, links = spark.read.parquet(f"{folder}/nodes"), spark.read.parquet(f"{folder}/edges")
    rows = stored.select(F.lit("node").alias("part"), F.col("node").alias("a"), F.lit(None).cast("long").alias("b"), "kind")
    return rows.unionByName(links.select(F.lit("edge").alias("part"), F.col("src").alias("a"), F.col("dst").alias("b"), "kind"))


@query("S19", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def delete(spark, sf_dir):
    gone = table(spark, sf_dir, "labels").filter("quality = 0")
    return sets.without(table(spark, sf_dir, "documents").select("doc_id"), gone, "doc_id")
