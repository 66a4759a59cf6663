"""Pipelines put together from the operators: contexts, examples, project graphs, import checks, lineage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import graph, ranking
from ..session import table
from . import ORACLE_SQL, QUERIES, aggregates, query  # noqa: F401  (the queries of aggregates are used by name)
from .graphs import _EDGES, ELEMENT, EVERY, _reach, asked, dependencies, element
from .search import _BEST, _COS, _Z01, best, close, semantic_first, similar


@query("Z02", _reach(False) + " SELECT node, round(0.9 / depth, 4)::DOUBLE AS score FROM r")
def graph_first(spark, sf_dir):
    """What depends on an element, nearer ones first."""
    found = graph.reachable(graph.reversed_edges(dependencies(spark, sf_dir)), element(spark))
    return found.select("node", F.round(0.9 / F.col("depth"), 4).alias("score"))


@query("Z04", f"SELECT query, vec_id, round(score, 5) AS similarity, CASE WHEN score >= 0.3 THEN 'high' ELSE 'low' END AS confidence FROM ({_COS}) WHERE label = 2 " + _BEST.format("score DESC, vec_id", 10))
def pattern_search(spark, sf_dir):
    """Filtered before the top rows are taken, so a rare kind still fills its list."""
    hits = best(close(spark, sf_dir, 10, "label = 2"), 10, F.desc("score"), F.col("vec_id"))
    confidence = F.when(F.col("score") >= 0.3, "high").otherwise("low")
    return hits.select("query", "vec_id", F.round("score", 5).alias("similarity"), confidence.alias("confidence"))


@query("Z06", f"SELECT query, vec_id FROM ({_COS}) WHERE label <> 1 AND score >= 0.2 " + _BEST.format("score DESC, vec_id", 5))
def similar_questions(spark, sf_dir):
    hits = close(spark, sf_dir, 5, "label <> 1", least=0.2)
    return best(hits, 5, F.desc("score"), F.col("vec_id")).select("query", "vec_id")


@query("Z08", _reach(False) + f""", o AS (SELECT dst AS node, 1 AS depth FROM e WHERE src = {ELEMENT} UNION ALL SELECT b.dst, 2 FROM e a JOIN e b ON a.dst = b.src WHERE a.src = {ELEMENT})
  SELECT s.*, p_type AS kind FROM (SELECT 'needs' AS side, node, min(depth) AS depth FROM o GROUP BY node UNION ALL SELECT 'needed by', node, depth FROM r) s JOIN part ON p_partkey = node""")
def explain(spark, sf_dir):
    """What an element needs within two hops, all that needs it, and the kind of each."""
    edges = dependencies(spark, sf_dir)
    needs = graph.reachable(edges, element(spark), 2).select(F.lit("needs").alias("side"), "node", "depth")
    needed = graph.reachable(graph.reversed_edges(edges), element(spark)).select(F.lit("needed by").alias("side"), "node", "depth")
    kinds = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.col("p_type").alias("kind"))
    return needs.unionByName(needed).join(kinds, "node").select("side", "node", "depth", "kind")


@query("Z10", f"""WITH t AS (SELECT event_type, count(*) AS calls, count(DISTINCT user_id) AS users, round(100.0 * count(*) FILTER (value < 100) / count(*), 4)::DOUBLE AS success FROM events GROUP BY 1),
  f AS ({ORACLE_SQL["A10"]}), s AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) = 1)
  (SELECT 'tool' AS section, event_type AS name, calls, users, success AS score FROM t ORDER BY calls DESC, event_type LIMIT 3)
  UNION ALL (SELECT 'important', CAST(user_id AS VARCHAR), access, NULL, importance FROM f ORDER BY importance DESC, access DESC, user_id LIMIT 20)
  UNION ALL SELECT 'session', event_type, event_id, user_id, NULL FROM s
  UNION ALL SELECT 'total', 'events', count(*), count(DISTINCT user_id), round(avg((value < 100)::INT), 6)::DOUBLE FROM events""")
def status(spark, sf_dir):
    """A workspace at a glance: the tools used most, the elements that matter most by their events, the latest session of
    each context, and totals."""
    events = table(spark, sf_dir, "events")
    good = F.col("value") < 100
    rolled = events.groupBy(F.col("event_type").alias("name")).agg(
        F.count("*").alias("calls"), F.count_distinct("user_id").alias("users"), F.round(100.0 * F.count_if(good) / F.count("*"), 4).alias("score"))
    tools = ranking.top(rolled, 3, F.desc("calls"), F.col("name"))
    scored = ranking.top(QUERIES["A10"](spark, sf_dir), 20, F.desc("importance"), F.desc("access"), F.col("user_id"))
    important = scored.select(F.col("user_id").cast("string").alias("name"), F.col("access").alias("calls"), F.lit(None).cast("long").alias("users"), F.col("importance").alias("score"))
    last = ranking.latest(events, "event_type", F.desc("ts"), F.col("event_id"))
    sessions = last.select(F.col("event_type").alias("name"), F.col("event_id").alias("calls"), F.col("user_id").alias("users"), F.lit(None).cast("double").alias("score"))
    total = events.agg(F.count("*").alias("calls"), F.count_distinct("user_id").alias("users"), F.round(F.avg(good.cast("int")), 6).alias("score")).withColumn("name", F.lit("events"))
    parts = (("tool", tools), ("important", important), ("session", sessions), ("total", total))
    return reduce(lambda x, y: x.unionByName(y), [p.select(F.lit(n).alias("section"), "name", "calls", "users", "score") for n, p in parts])


@query("Z13", f"""WITH e AS ({_EDGES}), n AS (SELECT src AS node FROM e UNION ALL SELECT dst FROM e), d AS (SELECT node, count(*) AS degree FROM n GROUP BY node),
  c AS (SELECT p_type AS g, count(*) AS files FROM part GROUP BY 1 HAVING count(*) >= 3),
  h AS (SELECT a.p_type AS g, round(avg((a.p_type = b.p_type)::INT), 6)::DOUBLE AS cohesion FROM e JOIN part a ON a.p_partkey = src JOIN part b ON b.p_partkey = dst GROUP BY 1)
  SELECT node, degree, CASE WHEN degree >= 10 THEN 'High' WHEN degree >= 5 THEN 'Medium' ELSE 'Low' END AS risk, p_type AS g, files, coalesce(cohesion, 0) AS cohesion
  FROM d JOIN part ON p_partkey = node JOIN c ON c.g = p_type LEFT JOIN h ON h.g = p_type""")
def project_graph(spark, sf_dir):
    """Every node with its degree, its risk, and its cluster's size and cohesion."""
    edges = dependencies(spark, sf_dir)
    place = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.col("p_type").alias("g"))
    found = graph.degrees(edges).select("node", "degree", graph.risk(F.col("degree")).alias("risk"))
    return found.join(place, "node").join(graph.cohesion(edges, place).select("g", "files", "cohesion"), "g")


@query("Z11", """WITH w AS (SELECT DISTINCT p_partkey, unnest(string_split(p_name, ' ')) AS name FROM part), k AS (SELECT unnest(['red', 'ring', 'smell', 'widgets']) AS known)
  SELECT p_partkey, name, CASE WHEN name IN (SELECT known FROM k) THEN 'valid' WHEN near IS NOT NULL THEN 'warning' ELSE 'invalid' END AS verdict, near AS suggestion
  FROM (SELECT w.*, (SELECT min(known) FROM k WHERE known <> w.name AND levenshtein(known, w.name) <= 2) AS near FROM w)""")
def import_check(spark, sf_dir):
    """Names that import lines give, against a list of known ones; each distinct name is compared once."""
    known = ("red", "ring", "smell", "widgets")
    lines = F.concat(F.lit("import "), F.replace("p_name", F.lit(" "), F.lit("\nimport ")), F.lit("\n"))
    used = table(spark, sf_dir, "part").select("p_partkey", F.explode(S.imports(lines)).alias("name")).distinct()
    listed = F.array(*map(F.lit, known))
    close = F.array_min(F.filter(listed, lambda k: (k != F.col("name")) & (F.levenshtein(k, "name") <= 2)))
    verdict = F.when(F.array_contains(listed, F.col("name")), "valid").when(close.isNotNull(), "warning").otherwise("invalid")
    judged = used.select("name").distinct().select("name", verdict.alias("verdict"), close.alias("suggestion"))
    return used.join(judged, "name").select("p_partkey", "name", "verdict", "suggestion")


@query("J11", """WITH r AS (SELECT o_custkey, o_orderpriority, round(sum(o_totalprice), 2) AS r FROM orders GROUP BY ALL)
  SELECT c_custkey, round(coalesce(sum(r) FILTER (contains('asks for 1-URGENT or 2-HIGH', o_orderpriority)), 0.0), 2)::DOUBLE AS reward FROM customer LEFT JOIN r ON o_custkey = c_custkey GROUP BY 1""")
def rewards_joined(spark, sf_dir):
    """Rewards of a path by term, summed before the join; those whose term the query's text holds count."""
    asked = F.lit("asks for 1-URGENT or 2-HIGH")
    sums = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey"), "o_orderpriority").agg(F.round(F.sum("o_totalprice"), 2).alias("r"))
    held = sums.filter(F.contains(asked, F.col("o_orderpriority"))).groupBy("c_custkey").agg(F.sum("r").alias("r"))
    joined = table(spark, sf_dir, "customer").select("c_custkey").join(held, "c_custkey", "left")
    return joined.select("c_custkey", F.round(F.coalesce("r", F.lit(0.0)), 2).alias("reward"))


@query("J12", f"""WITH e AS ({_EDGES}), o AS (SELECT src AS k, list_sort(list(dst))[1:10] AS needs FROM e WHERE src % {EVERY} = 0 GROUP BY 1), i AS (SELECT dst AS k, list_sort(list(src))[1:10] AS needed FROM e WHERE dst % {EVERY} = 0 GROUP BY 1)
  SELECT p_partkey, coalesce(needs, []) AS needs, coalesce(needed, []) AS needed FROM part LEFT JOIN o ON o.k = p_partkey LEFT JOIN i ON i.k = p_partkey WHERE p_partkey % {EVERY} = 0""")
def relations(spark, sf_dir):
    """What the elements that are asked about need and are needed by, at most ten of each: ranked first, so no list grows
    beyond what is kept."""
    edges = dependencies(spark, sf_dir)
    out = table(spark, sf_dir, "part").select("p_partkey").filter(F.col("p_partkey") % EVERY == 0)
    for name, own, other in (("needs", "src", "dst"), ("needed", "dst", "src")):
        first = ranking.top_in_groups(edges.filter(F.col(own) % EVERY == 0), 10, own, F.col(other))
        lists = first.groupBy(F.col(own).alias("p_partkey")).agg(F.array_sort(F.collect_list(other)).alias(name))
        out = out.join(lists, "p_partkey", "left").withColumn(name, F.coalesce(name, F.array().cast("array<bigint>")))
    return out


@query("J13", f"SELECT query, vec_id, doc_id, lang FROM ({_COS}) JOIN documents ON doc_id = vec_id WHERE score >= 0.3")
def hits_with_documents(spark, sf_dir):
    hits = similar(spark, sf_dir, 0.3).select("query", "vec_id")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return hits.join(docs, F.col("doc_id") == F.col("vec_id"))


@query("J17", """SELECT p_partkey, practice FROM part, (VALUES ('rings', 'ring'), ('reds', 'red'), ('economy rings', 'ring')) AS v(practice, word)
  WHERE contains(p_name, word) AND (practice <> 'economy rings' OR p_type = 'ECONOMY')""")
def practices(spark, sf_dir):
    found = [
        F.when(F.col("p_name").contains("ring"), "rings"),
        F.when(F.col("p_name").contains("red"), "reds"),
        F.when(F.col("p_name").contains("ring") & (F.col("p_type") == "ECONOMY"), "economy rings"),
    ]
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(F.array_compact(F.array(*found))).alias("practice"))


@query("G06", f"""WITH e AS ({_EDGES}) SELECT src AS node, dst AS other, 'conflicts with' AS link FROM e WHERE src % {EVERY} = 0
  UNION ALL SELECT dst, src, 'superseded by' FROM e WHERE dst % {EVERY} = 0""")
def conflicts(spark, sf_dir):
    """One hop both ways: what an element conflicts with, and what supersedes it."""
    edges = dependencies(spark, sf_dir)
    forward = edges.select(F.col("src").alias("node"), F.col("dst").alias("other"), F.lit("conflicts with").alias("link"))
    reverse = edges.select(F.col("dst").alias("node"), F.col("src").alias("other"), F.lit("superseded by").alias("link"))
    return forward.unionByName(reverse).filter(F.col("node") % EVERY == 0)


@query("G05", f"""WITH RECURSIVE e AS ({_EDGES}), r(seed, node) AS (SELECT src, dst FROM e WHERE src % {EVERY} = 0
  UNION SELECT seed, dst FROM r JOIN e ON src = node) SELECT seed, node FROM r""")
def requirements(spark, sf_dir):
    edges = dependencies(spark, sf_dir)
    return graph.requirements(edges, asked(edges))


@query("G12", """SELECT p_partkey, CASE WHEN contains(p_name, 'widget') THEN 0 WHEN contains(p_name, 'ring') THEN 1 ELSE 2 END AS rank FROM part""")
def file_order(spark, sf_dir):
    name = F.col("p_name")
    rank = F.when(name.contains("widget"), 0).when(name.contains("ring"), 1).otherwise(2)
    return table(spark, sf_dir, "part").select("p_partkey", rank.alias("rank"))


@query("T06", """SELECT o_orderkey FROM orders WHERE o_orderstatus = 'X' UNION ALL (SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderstatus = 'X')
  ORDER BY o_totalprice DESC, o_orderkey LIMIT 5)""")
def fallback(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    wanted = orders.filter("o_orderstatus = 'X'")
    rows = wanted if not wanted.isEmpty() else ranking.top(orders, 5, F.desc("o_totalprice"), F.col("o_orderkey"))
    return rows.select("o_orderkey")


@query("T07", "SELECT c_custkey FROM customer ORDER BY c_acctbal, c_custkey LIMIT 100")
def fixed_cap(spark, sf_dir):
    return ranking.top(table(spark, sf_dir, "customer"), 100, F.col("c_acctbal"), F.col("c_custkey")).select("c_custkey")


@query("U06", "SELECT p_type, list_sort(list(DISTINCT w)) AS words FROM (SELECT p_type, unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY 1")
def keyword_union(spark, sf_dir):
    words = table(spark, sf_dir, "part").select("p_type", F.explode(F.split("p_name", " ")).alias("w"))
    return words.groupBy("p_type").agg(F.array_sort(F.collect_set("w")).alias("words"))


@query("A22", """SELECT source, count(*) AS files, sum(n_chars)::BIGINT AS chars, coalesce(list(doc_id ORDER BY doc_id) FILTER (n_chars < 200), [])[1:10] AS errors FROM documents GROUP BY 1""")
def totals(spark, sf_dir):
    """Sums over files, and the first ten that failed; documents too short for anything count as failed."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    sums = docs.groupBy("source").agg(F.count("*").alias("files"), F.sum("n_chars").alias("chars"))
    failed = ranking.top_in_groups(docs.filter("n_chars < 200"), 10, "source", F.col("doc_id"))
    errors = failed.groupBy("source").agg(F.array_sort(F.collect_list("doc_id")).alias("errors"))
    return sums.join(errors, "source", "left").withColumn("errors", F.coalesce("errors", F.array().cast("array<bigint>")))


@query("A23", "SELECT DISTINCT lower(source) AS context FROM documents")
def contexts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.lower("source").alias("context")).distinct()


@query("F02", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_totalprice >= 1000 AND o_orderdate >= '1998-01-01'")
def conditions(spark, sf_dir):
    wanted = {"status": "O", "least": 1000, "since": "1998-01-01", "customer": None}
    tests = {
        "status": lambda v: F.col("o_orderstatus") == v,
        "least": lambda v: F.col("o_totalprice") >= v,
        "since": lambda v: F.col("o_orderdate") >= F.lit(v).cast("timestamp"),
        "customer": lambda v: F.col("o_custkey") == v,
    }
    all_of = reduce(lambda a, b: a & b, (tests[k](v) for k, v in wanted.items() if v is not None), F.lit(True))
    return table(spark, sf_dir, "orders").filter(all_of).select("o_orderkey")


@query("F12", "SELECT vec_id, label FROM embeddings")
def payload(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "label")


@query("W04", """SELECT user_id, round(avg(value) FILTER (r <= 5), 4) AS recent, round(avg(value) FILTER (r > 5), 4) AS before FROM
  (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 10 GROUP BY 1""")
def last_five(spark, sf_dir):
    last = ranking.top_in_groups(table(spark, sf_dir, "events"), 10, "user_id", F.desc("ts"), F.desc("event_id"))
    mean = lambda test: F.round(F.avg(F.when(test, F.col("value"))), 4)
    return last.groupBy("user_id").agg(mean(F.col("rank") <= 5).alias("recent"), mean(F.col("rank") > 5).alias("before"))


@query("Z07", f"""SELECT 'semantic' AS part, query, vec_id AS id FROM ({_Z01}) {_BEST.format("score DESC, vec_id", 5)}
  UNION ALL SELECT 'questions', query, vec_id FROM (SELECT * FROM ({_COS}) WHERE label <> 1 AND score >= 0.2 {_BEST.format("score DESC, vec_id", 5)})
  UNION ALL SELECT 'patterns', query, vec_id FROM (SELECT * FROM ({_COS}) WHERE label = 2 {_BEST.format("score DESC, vec_id", 5)})
  UNION ALL SELECT 'graph', NULL, node FROM ({_reach(False)} SELECT node, depth FROM r ORDER BY depth, node LIMIT 5)
  UNION ALL SELECT 'important', NULL, c_custkey FROM (SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 5)""")
def context_pack(spark, sf_dir):
    """What each task starts from: the best of semantic search, similar questions and patterns; and for all, the graph around an
    element and important rows."""
    order = F.desc("score"), F.col("vec_id")
    own = {
        "semantic": best(semantic_first(spark, sf_dir), 5, *order),
        "questions": best(close(spark, sf_dir, 5, "label <> 1", least=0.2), 5, *order),
        "patterns": best(close(spark, sf_dir, 5, "label = 2"), 5, *order),
    }
    common = {
        "graph": ranking.top(graph_first(spark, sf_dir), 5, F.desc("score"), F.col("node")).select("node"),
        "important": ranking.top(table(spark, sf_dir, "customer"), 5, F.desc("c_acctbal"), F.col("c_custkey")).select("c_custkey"),
    }
    named = [rows.select(F.lit(part).alias("part"), "query", F.col("vec_id").alias("id")) for part, rows in own.items()]
    named += [rows.select(F.lit(part).alias("part"), F.lit(None).cast("long").alias("query"), F.col(rows.columns[0]).alias("id")) for part, rows in common.items()]
    return reduce(lambda a, b: a.unionByName(b), named)
