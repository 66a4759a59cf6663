"""Catalog, change and intent queries: filters, seeds, cascades, keyword ladders and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import code as C
from ..functions import scalars as S
from ..session import table
from . import query

IGNORED = r"(^|/)\.[^/]|\.(tmp|swp)$|/(bin|obj|node_modules)/"
TYPES = (("error", "failure"), ("purchase", "sale"), ("view", "visit"), ("click", "visit"))
SEGMENTS = ("BUILDING", "HOUSEHOLDS", "MACHINE", "FURNITURES")
PRACTICES = (("en", "stemming"), ("en", "casing"), ("de", "compounds"), ("fr", "elision"), ("fr", "casing"))
SEEDS = ((0, "NATION_0"), (1000, "NATION_1000"), (1001, "NATION_1001"))
TOPICS = (("greeting", ("hello", "hi ")), ("question", ("?", "how ", "what ")), ("thanks", ("thank", "merci", "danke")))


@query("F09", "SELECT doc_id FROM labels WHERE quality = 1 AND coalesce(toxic, 0) <> 1")
def active(spark, sf_dir):
    return table(spark, sf_dir, "labels").filter("quality = 1 AND coalesce(toxic, 0) <> 1").select("doc_id")


@query("F13", """SELECT doc_id, list_sort(list_filter(['lang=' || lang, 'n_chars=' || n_chars, 'source=' || source],
  lambda x: x IS NOT NULL)) AS metadata FROM documents""")
def metadata(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").drop("text")
    return docs.select("doc_id", S.metadata([c for c in docs.columns if c != "doc_id"]).alias("metadata"))


@query("F14", f"SELECT page_id FROM pages WHERE url IS NOT NULL AND NOT regexp_matches(url, '{IGNORED}')")
def watched(spark, sf_dir):
    return table(spark, sf_dir, "pages").filter(~F.col("url").rlike(IGNORED)).select("page_id")


@query("S03", "SELECT page_id, url FROM pages WHERE NOT ends_with(url, '.html') AND NOT ends_with(url, '#top')")
def without_endings(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").filter(~url.endswith(".html") & ~url.endswith("#top")).select("page_id", "url")


@query("S20", """SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN
  (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY l_orderkey""")
def cascade(spark, sf_dir):
    gone = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    counts = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return counts.join(gone, "l_orderkey", "anti")


@query("S21", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def exported(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    listed = nation.select(F.to_json(F.struct("*")).alias("entry"))
    return listed.select(F.from_json("entry", nation.schema).alias("e")).select("e.*")


@query("S22", """SELECT n_nationkey, n_name FROM nation UNION ALL SELECT * FROM
  (VALUES (0, 'NATION_0'), (1000, 'NATION_1000'), (1001, 'NATION_1001')) AS s(k, v) WHERE k NOT IN (SELECT n_nationkey FROM nation)""")
def seeded(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    seeds = spark.createDataFrame(SEEDS, "n_nationkey int, n_name string")
    return nation.unionByName(seeds.join(nation, "n_nationkey", "anti"))


@query("J15", """WITH t AS (SELECT c_mktsegment, c_nationkey % 2 = 0 AS control, count(*) AS n FROM customer GROUP BY 1, 2)
  SELECT a.c_mktsegment, a.n AS control_runs, b.n AS test_runs FROM t a JOIN t b USING (c_mktsegment)
  WHERE a.control AND NOT b.control""")
def variants(spark, sf_dir):
    runs = table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(
        F.count_if(F.col("c_nationkey") % 2 == 0).alias("control_runs"), F.count_if(F.col("c_nationkey") % 2 != 0).alias("test_runs")
    )
    return runs.filter("control_runs > 0 AND test_runs > 0")


@query("J20", f"""SELECT c_mktsegment, list_sort(list_filter(list_transform({list(SEGMENTS)},
  lambda k: struct_pack(d := levenshtein(c_mktsegment, k), k := k)), lambda x: x.d <= 2))[1].k AS nearest
  FROM (SELECT DISTINCT c_mktsegment FROM customer)""")
def nearest_names(spark, sf_dir):
    names = table(spark, sf_dir, "customer").select("c_mktsegment").distinct()
    return names.select("c_mktsegment", S.nearest_name(F.col("c_mktsegment"), SEGMENTS, 2).alias("nearest"))


@query("T02", """WITH hits AS (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 40)
  SELECT o_orderkey, round(0.7 * o_totalprice / 100000 + 0.3 * coalesce(c_acctbal, 0) / 1000, 4) AS score
  FROM hits LEFT JOIN customer ON o_custkey = c_custkey ORDER BY score DESC, o_orderkey LIMIT 20""")
def over_fetched(spark, sf_dir):
    hits = table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(40)
    balance = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal")
    enriched = hits.join(balance, "o_custkey", "left")
    score = 0.7 * F.col("o_totalprice") / 100000 + 0.3 * F.coalesce("c_acctbal", F.lit(0.0)) / 1000
    return enriched.select("o_orderkey", F.round(score, 4).alias("score")).orderBy(F.desc("score"), "o_orderkey").limit(20)


@query("U03", """SELECT doc_id, 'match' AS branch FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)
  UNION ALL SELECT doc_id, 'create' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)""")
def branches(spark, sf_dir):
    docs, known = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    matched = docs.join(known, "doc_id", "semi").withColumn("branch", F.lit("match"))
    return matched.unionByName(docs.join(known, "doc_id", "anti").withColumn("branch", F.lit("create")))


@query("W08", """SELECT user_id, event_id, event_type FROM events
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def latest(spark, sf_dir):
    # the latest row as an aggregate: combined within tasks, so that a frequent user isn't gathered or sorted
    last = F.max_by(F.struct("event_id", "event_type"), F.struct("ts", "event_id")).alias("e")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(last).select("user_id", "e.*")


@query("A25", """WITH t AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1)
  SELECT sum(n)::BIGINT AS total, round(100.0 * sum(CASE WHEN event_type <> 'error' THEN n ELSE 0 END) / sum(n), 2)::DOUBLE AS success_percent,
    list(event_type ORDER BY n DESC, event_type)[1:3] AS most_used FROM t""")
def insights(spark, sf_dir):
    counts = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    by_count = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "event_type")))
    return counts.agg(
        F.sum("n").alias("total"),
        F.round(100.0 * F.sum(F.when(F.col("event_type") != "error", F.col("n")).otherwise(0)) / F.sum("n"), 2).alias("success_percent"),
        F.slice(F.transform(by_count, lambda x: x["event_type"]), 1, 3).alias("most_used"),
    )


@query("A32", """SELECT source, list_sort(list(DISTINCT practice)) AS practices FROM documents JOIN
  (VALUES ('en', 'stemming'), ('en', 'casing'), ('de', 'compounds'), ('fr', 'elision'), ('fr', 'casing')) AS p(lang, practice)
  USING (lang) GROUP BY source""")
def practices(spark, sf_dir):
    known = spark.createDataFrame(PRACTICES, "lang string, practice string")
    pairs = table(spark, sf_dir, "documents").select("source", "lang").distinct().join(known, "lang")
    return pairs.groupBy("source").agg(F.array_sort(F.collect_set("practice")).alias("practices"))


@query("R07", """WITH t AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTE, true) AS new FROM events),
  s AS (SELECT user_id, ts, sum(new::INT) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM t)
  SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, count(*) AS n FROM s GROUP BY user_id, k""")
def auto_sessions(spark, sf_dir):
    found = table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w"))
    return found.agg(F.count("*").alias("n")).select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("started"), "n")


@query("X34", """SELECT event_id, CASE WHEN event_type LIKE '%error%' THEN 'failure' WHEN event_type LIKE '%purchase%' THEN 'sale'
  WHEN event_type LIKE '%view%' THEN 'visit' WHEN event_type LIKE '%click%' THEN 'visit' ELSE 'other' END AS kind FROM events""")
def kinds(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", S.ladder(F.col("event_type"), TYPES, "other").alias("kind"))


@query("X37", """SELECT p_partkey, CASE WHEN starts_with(p_name, 'small') THEN 'size' WHEN starts_with(p_name, 'red') THEN 'colour' ELSE 'plain' END AS category FROM part""")
def prefixes(spark, sf_dir):
    name = F.col("p_name")
    kind = F.when(name.startswith("small"), "size").when(name.startswith("red"), "colour").otherwise("plain")
    return table(spark, sf_dir, "part").select("p_partkey", kind.alias("category"))


@query("X38", """WITH t AS (SELECT event_type, count(*) AS n, avg(value) AS mean,
    avg(value) FILTER (ts >= TIMESTAMP '2024-01-15') AS late, avg(value) FILTER (ts < TIMESTAMP '2024-01-15') AS early FROM events GROUP BY 1)
  SELECT event_type, round((CASE WHEN n >= 10 THEN 0.7 * mean + 0.3 * 50 ELSE 0.5 * mean + 0.5 * 50 END)
    * CASE WHEN late > 1.1 * early THEN 1.1 WHEN late < 0.9 * early THEN 0.9 ELSE 1 END, 4) AS estimate,
    least(60 + least(2 * n, 30), 98) AS confidence FROM t""")
def execution_modes(spark, sf_dir):
    late = F.col("ts") >= F.lit("2024-01-15").cast("timestamp")
    stats = table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count("*").alias("n"), F.avg("value").alias("mean"), F.avg(F.when(late, F.col("value"))).alias("late"),
        F.avg(F.when(~late, F.col("value"))).alias("early"),
    )
    estimate, confidence = S.execution_estimate(F.col("mean"), F.col("n"), F.lit(50.0), F.lit(60), F.col("late"), F.col("early"))
    return stats.select("event_type", F.round(estimate, 4).alias("estimate"), confidence.cast("long").alias("confidence"))


@query("X46", """SELECT page_id, list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(html, '([0-9]+)px', 1), lambda x: x::INT),
  lambda x: x NOT IN (12, 14, 16, 20, 24)))) AS off_scale FROM pages WHERE html IS NOT NULL""")
def off_scale(spark, sf_dir):
    sizes = S.off_scale(F.col("html"), r"(\d+)px", (12, 14, 16, 20, 24))
    return table(spark, sf_dir, "pages").filter("html IS NOT NULL").select("page_id", sizes.alias("off_scale"))


@query("X52", """SELECT source, CASE WHEN bool_or(lang = 'de') THEN 'de' WHEN bool_or(lang = 'fr') THEN 'fr' ELSE 'en' END AS language,
    CASE WHEN sum(n_chars) < 10000 AND count(*) <= 2 THEN 'simple' WHEN sum(n_chars) < 500000 AND count(*) <= 500 THEN 'medium' ELSE 'complex' END AS complexity
  FROM documents GROUP BY source""")
def file_sets(spark, sf_dir):
    n, size = F.count("*"), F.sum("n_chars")
    language = F.when(F.bool_or(F.col("lang") == "de"), "de").when(F.bool_or(F.col("lang") == "fr"), "fr").otherwise("en")
    complexity = F.when((size < 10_000) & (n <= 2), "simple").when((size < 500_000) & (n <= 500), "medium").otherwise("complex")
    return table(spark, sf_dir, "documents").groupBy("source").agg(language.alias("language"), complexity.alias("complexity"))


@query("X53", """SELECT conv_id, turn, list_filter([CASE WHEN contains(lower(text), 'hello') OR contains(lower(text), 'hi ') THEN 'greeting' END,
  CASE WHEN contains(lower(text), '?') OR contains(lower(text), 'how ') OR contains(lower(text), 'what ') THEN 'question' END,
  CASE WHEN contains(lower(text), 'thank') OR contains(lower(text), 'merci') OR contains(lower(text), 'danke') THEN 'thanks' END],
  lambda x: x IS NOT NULL) AS topics, list_transform([list_filter([""" + ", ".join(
      "CASE WHEN (" + " OR ".join(f"contains(lower(text), '{w}')" for w in words) + ")" + "".join(f" AND NOT contains(lower(text), '{w}')" for w in settled) + f" THEN '{term}: {impact}' END"
      for words, settled, term, _, impact in C.AMBIGUITIES) + """], lambda x: x IS NOT NULL)], lambda l: CASE WHEN len(l) > 0 THEN list_append(l, 'error handling: Medium') ELSE l END)[1] AS open FROM conversations""")
def topics(spark, sf_dir):
    opened = F.transform(C.ambiguities(F.col("text")), lambda a: F.concat_ws(": ", a["term"], a["impact"]))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", S.topics(F.col("text"), TOPICS).alias("topics"), opened.alias("open"))
