"""Traversals over edges that the star tables imply."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators import graph, ranking
from ..session import table
from . import query

_EDGES = """SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b
  ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1"""
#: The element that single questions are about; questions of many take every part whose number is divisible by 50.
ELEMENT, EVERY = 5, 50


def dependencies(spark, sf_dir):
    """Parts as nodes, with cycles: a part needs the one that is on the next line of an order."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("src"))
    after = lines.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("src").alias("dst"))
    return lines.join(after, ["l_orderkey", "l_linenumber"]).select("src", "dst").distinct()


def element(spark):
    return spark.createDataFrame([(ELEMENT,)], "seed long")


def asked(edges):
    """The nodes that are asked about, of those with an edge."""
    return edges.filter(F.col("src") % EVERY == 0).select(F.col("src").alias("seed")).distinct()


def _reach(forward: bool, most: int | None = None) -> str:
    a, b = ("src", "dst") if forward else ("dst", "src")
    bound = f"r.depth < {most} AND " if most else ""
    return f"""WITH RECURSIVE e AS ({_EDGES}), r(node, depth) USING KEY (node) AS (SELECT {b}, 1 FROM e WHERE {a} = {ELEMENT}
      UNION SELECT e.{b}, min(r.depth) + 1 FROM r JOIN e ON e.{a} = r.node
        WHERE {bound}NOT EXISTS (SELECT 1 FROM recurring.r k WHERE k.node = e.{b}) GROUP BY e.{b})"""


@query("G01", _reach(False) + " SELECT node, depth FROM r")
def impact(spark, sf_dir):
    return graph.reachable(graph.reversed_edges(dependencies(spark, sf_dir)), element(spark)).drop("seed")


@query("G02", _reach(True, 5) + " SELECT node, depth FROM r ORDER BY depth, node LIMIT 100")
def chain(spark, sf_dir):
    found = graph.reachable(dependencies(spark, sf_dir), element(spark), 5)
    return ranking.top(found.drop("seed"), 100, F.col("depth"), F.col("node"))


@query("G03", f"""WITH e AS ({_EDGES}) SELECT [src] AS path, 1 AS length FROM e WHERE src = dst
  UNION ALL SELECT [a.src, a.dst], 2 FROM e a JOIN e b ON a.dst = b.src AND b.dst = a.src WHERE a.src < a.dst
  UNION ALL SELECT [a.src, a.dst, b.dst], 3 FROM e a JOIN e b ON a.dst = b.src JOIN e c ON b.dst = c.src AND c.dst = a.src
    WHERE a.src < a.dst AND a.src < b.dst AND a.dst <> b.dst""")
def circular(spark, sf_dir):
    return graph.cycles(dependencies(spark, sf_dir), 3)


@query("SCC")
def mutual(spark, sf_dir):
    """Which elements depend on each other in circles of any length: strong components, tested against brute force."""
    return graph.strong_components(dependencies(spark, sf_dir))


@query("LEVELS", """SELECT doc_id AS node, CASE WHEN doc_id = 0 THEN 0 ELSE floor(log2(doc_id))::INT + 1 END AS level FROM documents""")
def planned(spark, sf_dir):
    """Documents as work items, each of which needs the one of half its number: what can be done first, second, ..."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("src"), F.floor(F.col("doc_id") / 2).alias("dst"))
    return graph.levels(docs)


@query("G04", "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
def follows(spark, sf_dir):
    asia = table(spark, sf_dir, "region").filter("r_name = 'ASIA'").select(F.col("r_regionkey").alias("n_regionkey"))
    nation = table(spark, sf_dir, "nation").join(asia, "n_regionkey").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return table(spark, sf_dir, "customer").join(nation, "c_nationkey").select("c_custkey", "n_name")


@query("G07", """WITH x AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem)
  SELECT b.l_suppkey AS neighbour, count(*) AS times FROM x a JOIN x b ON a.l_orderkey = b.l_orderkey AND b.l_suppkey <> a.l_suppkey
  WHERE a.l_suppkey = 7 GROUP BY 1 ORDER BY times DESC, neighbour LIMIT 10""")
def co_edit(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").distinct()
    own = items.filter("l_suppkey = 7").select("l_orderkey")
    met = items.join(own, "l_orderkey", "semi").filter("l_suppkey <> 7").groupBy(F.col("l_suppkey").alias("neighbour"))
    return met.agg(F.count("*").alias("times")).orderBy(F.desc("times"), "neighbour").limit(10)


@query("G08", """WITH x AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), p AS (
    SELECT a.l_partkey AS a, b.l_partkey AS b FROM x a JOIN x b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY 1, 2 HAVING count(*) >= 3)
  SELECT a AS center, list_sort(list_append(list(b), a)) AS members, (count(*) + 1)::INT AS size FROM p GROUP BY a ORDER BY size DESC, center LIMIT 20""")
def clusters(spark, sf_dir):
    stars = graph.stars(graph.pairs_within(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey"))
    return ranking.top(stars, 20, F.desc("size"), F.col("center"))


@query("G09", f"""WITH e AS ({_EDGES}), n AS (SELECT src AS node, 1 AS o FROM e UNION ALL SELECT dst, 0 FROM e)
  SELECT node, sum(o)::BIGINT AS n_out, (count(*) - sum(o))::BIGINT AS n_in, count(*) AS degree FROM n GROUP BY node HAVING count(*) >= 5""")
def critical(spark, sf_dir):
    return graph.degrees(dependencies(spark, sf_dir)).filter("degree >= 5")


@query("G10", """WITH x AS (SELECT a.c_nationkey AS g, (b.c_nationkey = a.c_nationkey)::INT AS own FROM
    (SELECT o_custkey, lead(o_custkey) OVER (PARTITION BY o_orderdate ORDER BY o_orderkey) AS next FROM orders) o JOIN customer a ON a.c_custkey = o_custkey JOIN customer b ON b.c_custkey = next),
  f AS (SELECT c_nationkey AS g, count(*) AS files FROM customer GROUP BY 1 HAVING count(*) >= 3)
  SELECT g, files, coalesce(sum(own), 0)::BIGINT AS inside, count(own) AS dependencies, round(coalesce(avg(own), 0), 6)::DOUBLE AS cohesion FROM f LEFT JOIN x USING (g) GROUP BY g, files""")
def cohesion(spark, sf_dir):
    """Customers in the nations as files in directories; who orders next on a day is what one depends on."""
    own = W.partitionBy("o_orderdate").orderBy("o_orderkey")
    edges = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("src"), F.lead("o_custkey").over(own).alias("dst"))
    place = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"), F.col("c_nationkey").alias("g"))
    return graph.cohesion(edges.filter("dst IS NOT NULL"), place)


@query("G11", "SELECT o_custkey, CASE WHEN count(*) >= 10 THEN 'High' WHEN count(*) >= 5 THEN 'Medium' ELSE 'Low' END AS risk FROM orders GROUP BY 1")
def risk(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(graph.risk(F.count("*")).alias("risk"))


@query("G13", "SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_orderkey) AS parents FROM lineitem GROUP BY ALL")
def histogram(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), F.count_distinct("l_orderkey").alias("parents")
    )
