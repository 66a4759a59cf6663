"""Aggregations over the star tables, events and labels."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import code as C
from ..functions import scalars as S
from ..operators import ensembles, usage
from ..session import table
from . import query

AS_OF = "2001-12-01"


@query("A01", """SELECT count(DISTINCT p_name) AS names, count(*) FILTER (p_size > 25) AS large, count(*) AS n, round(avg(p_retailprice), 4) AS mean,
  sum(p_size) AS total FROM part""")
def catalog(spark, sf_dir):
    return table(spark, sf_dir, "part").agg(
        F.count_distinct("p_name").alias("names"), F.count_if(F.col("p_size") > 25).alias("large"), F.count("*").alias("n"),
        F.round(F.avg("p_retailprice"), 4).alias("mean"), F.sum("p_size").alias("total"),
    )


@query("A02", "SELECT p_type, count(*) AS n FROM part WHERE p_size > 10 GROUP BY p_type")
def by_type(spark, sf_dir):
    return table(spark, sf_dir, "part").filter("p_size > 10").groupBy("p_type").agg(F.count("*").alias("n"))


@query("A03", """SELECT o_custkey, arg_max(o_orderkey, struct_pack(d := o_orderdate, k := o_orderkey)) FILTER (o_orderstatus = 'F') AS active, count(*) AS versions
  FROM orders GROUP BY o_custkey""")
def versions(spark, sf_dir):
    active = F.max_by("o_orderkey", F.when(F.col("o_orderstatus") == "F", F.struct("o_orderdate", "o_orderkey")))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(active.alias("active"), F.count("*").alias("versions"))


@query("A04", """SELECT c_custkey, coalesce(round(count(*) FILTER (o_orderstatus = 'F') / nullif(count(o_orderkey), 0), 6), 0.5)::DOUBLE AS rate
  FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey""")
def success_rate(spark, sf_dir):
    own = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey"))
    counts = own.agg(F.count_if(F.col("o_orderstatus") == "F").alias("good"), F.count("*").alias("n"))
    joined = table(spark, sf_dir, "customer").select("c_custkey").join(counts, "c_custkey", "left").na.fill(0)
    return joined.select("c_custkey", F.round(S.guarded_rate(F.col("good"), F.col("n")), 6).alias("rate"))


@query("A05", f"""WITH x AS (SELECT l_suppkey AS model, l_quantity AS score, (l_returnflag = 'N')::INT AS ok,
    CASE WHEN date_diff('hour', l_shipdate, TIMESTAMP '{AS_OF}') <= 24 THEN 3 WHEN date_diff('hour', l_shipdate, TIMESTAMP '{AS_OF}') <= 168 THEN 2 ELSE 1 END AS w FROM lineitem)
  SELECT model, sum(w)::BIGINT AS attempts, round(100.0 * sum(w * ok) / sum(w), 4)::DOUBLE AS rate, round(sum(w * score) / sum(w), 4) AS mean_score
  FROM x GROUP BY model ORDER BY rate DESC, mean_score DESC, attempts DESC, model LIMIT 5""")
def model_ranking(spark, sf_dir):
    hours = (F.unix_timestamp(F.lit(AS_OF).cast("timestamp")) - F.unix_timestamp("l_shipdate")) / 3600
    x = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("model"), F.col("l_quantity").alias("score"), (F.col("l_returnflag") == "N").cast("int").alias("ok"),
        S.age_weight(hours).alias("w"),
    )
    rolled = x.groupBy("model").agg(
        F.sum("w").alias("attempts"),
        F.round(100.0 * F.sum(F.col("w") * F.col("ok")) / F.sum("w"), 4).alias("rate"),
        F.round(F.sum(F.col("w") * F.col("score")) / F.sum("w"), 4).alias("mean_score"),
    )
    return rolled.orderBy(F.desc("rate"), F.desc("mean_score"), F.desc("attempts"), "model").limit(5)


@query("A06", """SELECT l_suppkey, l_returnflag, count(*) AS n, count(*) FILTER (l_linestatus = 'F') AS good, round(avg(l_quantity), 4) AS mean
  FROM lineitem GROUP BY ALL""")
def model_stats(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(
        F.count("*").alias("n"), F.count_if(F.col("l_linestatus") == "F").alias("good"), F.round(F.avg("l_quantity"), 4).alias("mean")
    )


@query("A07", """SELECT event_type AS tool, count(*) AS calls, count(*) FILTER (value < 100) AS ok, count(*) FILTER (value >= 100) AS failed,
  round(sum(value), 2) AS total_ms, round(avg(value), 4) AS mean_ms, arg_max(props, ts) AS last_query, count(DISTINCT props) AS n_queries FROM events GROUP BY 1""")
def tool_usage(spark, sf_dir):
    found = usage.tool_usage(table(spark, sf_dir, "events"), "event_type", F.col("value") < 100, "value", "ts", "props")
    rounded = {"total_ms": F.round("total_ms", 2), "mean_ms": F.round("mean_ms", 4)}
    return found.withColumns(rounded).drop("first_at", "last_at")


@query("A08", """SELECT a.event_type AS tool, b.event_type AS then, count(*) AS times, count(DISTINCT a.user_id) AS sessions FROM events a
  JOIN events b ON a.user_id = b.user_id AND a.event_type <> b.event_type AND a.ts < b.ts GROUP BY 1, 2 HAVING count(*) >= 3""")
def followed_by(spark, sf_dir):
    return usage.followed_by(table(spark, sf_dir, "events"), "user_id", "event_type", "ts")


@query("J07", """SELECT a.event_type AS tool, b.event_type AS then, count(*) AS times, count(DISTINCT a.user_id) AS sessions FROM events a
  JOIN events b ON a.user_id = b.user_id AND a.event_type <> b.event_type AND a.ts < b.ts WHERE a.value > 50 AND b.value > 50 GROUP BY 1, 2 HAVING count(*) >= 1""")
def session_pairs(spark, sf_dir):
    return usage.followed_by(table(spark, sf_dir, "events").filter("value > 50"), "user_id", "event_type", "ts", 1)


@query("A09", "SELECT o_custkey, o_orderpriority, round(coalesce(sum(o_totalprice), 0), 2) AS reward FROM orders GROUP BY ALL")
def rewards(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderpriority").agg(
        F.round(F.coalesce(F.sum("o_totalprice"), F.lit(0.0)), 2).alias("reward")
    )


@query("A10", """WITH k AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'view' THEN 'access' WHEN 'purchase' THEN 'edit' WHEN 'click' THEN 'search' WHEN 'signup' THEN 'selected' END AS kind FROM events),
  f AS (SELECT user_id, arg_min(kind, ts) AS first_kind, count(*) FILTER (kind = 'access') AS a, count(*) FILTER (kind = 'edit') AS e,
    count(*) FILTER (kind = 'search') AS s, count(*) FILTER (kind = 'selected') AS x, list(kind ORDER BY ts, event_id) AS ks FROM k WHERE kind IS NOT NULL GROUP BY user_id),
  n AS (SELECT *, list_transform(ks[2:], lambda k: CASE k WHEN 'edit' THEN 100::DOUBLE WHEN 'selected' THEN 200::DOUBLE WHEN 'access' THEN 300::DOUBLE ELSE 400::DOUBLE END) AS later FROM f)
  SELECT user_id, first_kind, a + x AS access, e AS edit, s + (first_kind = 'selected')::INT AS search, x AS selected,
    round(list_reduce(list_prepend(CASE WHEN ks[1] IN ('edit', 'selected') THEN 0.6::DOUBLE ELSE 0.5::DOUBLE END, later),
      lambda a, x: CASE x WHEN 100 THEN CASE WHEN a < 0.9::DOUBLE THEN a + 0.05::DOUBLE ELSE 0.95::DOUBLE END WHEN 200 THEN CASE WHEN a < 0.95::DOUBLE THEN a + 0.02::DOUBLE ELSE 0.95::DOUBLE END ELSE a END), 6) AS importance,
    CASE WHEN a + e + x > 0 THEN 1.0 ELSE 0.5 END::DOUBLE AS recency,
    round(list_reduce(list_prepend(CASE WHEN ks[1] IN ('edit', 'selected') THEN 0.2::DOUBLE ELSE 0.1::DOUBLE END, later),
      lambda a, x: CASE x WHEN 300 THEN CASE WHEN a < 0.9::DOUBLE THEN a + 0.05::DOUBLE ELSE 0.95::DOUBLE END WHEN 100 THEN CASE WHEN a < 0.9::DOUBLE THEN a + 0.1::DOUBLE ELSE 0.95::DOUBLE END ELSE a END), 6) AS frequency FROM n""")
def importance_counts(spark, sf_dir):
    kinds = {"view": "access", "purchase": "edit", "click": "search", "signup": "selected"}
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", S.mapped(F.col("event_type"), kinds).alias("kind"))
    counts = usage.importance_counts(events.filter("kind IS NOT NULL"), "user_id", "kind", "ts")
    scores = usage.importance_scores(events, "user_id", "kind", "ts", "event_id")
    return counts.join(scores.withColumns({c: F.round(c, 6) for c in ("importance", "frequency")}), "user_id")


@query("A11", """WITH d AS (SELECT *, CASE WHEN n_chars < 200 THEN 95 WHEN n_chars < 400 THEN 85 WHEN n_chars < 800 THEN 75 WHEN n_chars < 1600 THEN 65 ELSE 50 END AS points FROM documents)
  SELECT source, floor(avg(n_chars))::BIGINT AS mean, max(n_chars) AS most, count(*) FILTER (n_chars > 1000) AS long,
    CASE WHEN avg(points) >= 90 THEN 'A' WHEN avg(points) >= 80 THEN 'B' WHEN avg(points) >= 70 THEN 'C' WHEN avg(points) >= 60 THEN 'D' ELSE 'F' END AS grade FROM d GROUP BY source""")
def complexity(spark, sf_dir):
    chars = F.col("n_chars")
    own = F.when(chars < 200, "A").when(chars < 400, "B").when(chars < 800, "C").when(chars < 1600, "D").otherwise("F")
    return table(spark, sf_dir, "documents").withColumn("_own", own).groupBy("source").agg(
        F.floor(F.avg("n_chars")).alias("mean"), F.max("n_chars").alias("most"), F.count_if(chars > 1000).alias("long"),
        C.overall_grade(F.col("_own")).alias("grade"))


@query("A12", """WITH r AS (SELECT event_type AS tool, value AS ms, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS pos, count(*) OVER (PARTITION BY event_type) AS n FROM events)
  SELECT tool, max(n) AS n, min(ms) AS least, max(ms) AS most, floor(avg(ms))::BIGINT AS mean, max(ms) FILTER (pos = floor(n * 0.5)) AS median,
  max(ms) FILTER (pos = floor(n * 0.9)) AS p90, max(ms) FILTER (pos = floor(n * 0.95)) AS p95 FROM r GROUP BY tool""")
def latency(spark, sf_dir):
    return usage.latency(table(spark, sf_dir, "events"), "event_type", "value")


@query("A13", """WITH r AS (SELECT user_id AS tool, value AS ms, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events),
  m AS (SELECT tool, count(*) AS n, avg(ms) FILTER (r <= 5) AS recent, avg(ms) FILTER (r > 5) AS before FROM r WHERE r <= 10 GROUP BY tool)
  SELECT tool, round(recent, 4) AS recent, round(before, 4) AS before, CASE WHEN n < 10 THEN 'insufficient_data' WHEN recent > 1.2 * before THEN 'increasing'
    WHEN recent < 0.8 * before THEN 'decreasing' ELSE 'stable' END AS trend FROM m""")
def trend(spark, sf_dir):
    found = usage.trend(table(spark, sf_dir, "events"), "user_id", "value", F.desc("ts"), F.desc("event_id"))
    return found.withColumns({c: F.round(c, 4) for c in ("recent", "before")})


@query("A16", """WITH s AS (SELECT c_custkey, c_acctbal / 100 AS s FROM customer), g AS (SELECT *, CASE WHEN s >= 90 THEN 'A' WHEN s >= 80 THEN 'B' WHEN s >= 70 THEN 'C' WHEN s >= 60 THEN 'D' ELSE 'F' END AS grade FROM s),
  w AS (SELECT grade, list(c_custkey ORDER BY s, c_custkey) AS worst FROM (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY grade ORDER BY s, c_custkey) <= 5) GROUP BY 1)
  SELECT grade, count(*) AS n, floor(avg(s))::BIGINT AS mean, any_value(CASE WHEN grade = 'F' THEN worst ELSE [] END) AS critical FROM g JOIN w USING (grade) GROUP BY grade""")
def quality_report(spark, sf_dir):
    """A histogram of grades with the mean scores, and the five worst of the lowest grade."""
    from ..operators.ranking import top_in_groups

    s = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") / 100).alias("s"))
    graded = s.withColumn("grade", S.letter_grade(F.col("s")))
    rolled = graded.groupBy("grade").agg(F.count("*").alias("n"), F.floor(F.avg("s")).alias("mean"))
    last = top_in_groups(graded.filter("grade = 'F'"), 5, "grade", F.col("s"), F.col("c_custkey"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "c_custkey"))), lambda x: x["c_custkey"])
    worst = last.groupBy("grade").agg(ordered.alias("critical"))
    return rolled.join(worst, "grade", "left").withColumn("critical", F.coalesce("critical", F.array().cast("array<bigint>")))


@query("A17", """WITH c AS (SELECT source, count(*) FILTER (toxic = 1) AS critical, count(*) FILTER (quality = 0) AS high, count(*) FILTER (lang <> 'en') AS medium,
    count(*) FILTER (n_chars < 300) AS low, count(*) FILTER (n_chars < 100) AS info FROM labels JOIN documents USING (doc_id) GROUP BY source)
  SELECT source, greatest(0.0, 10.0 - 3 * critical - high)::DOUBLE AS pattern, greatest(0.0, 10.0 - 4 * critical - 2 * high)::DOUBLE AS security,
    greatest(0.0, 10.0 - 3 * critical - 2 * high - medium)::DOUBLE AS review, round(greatest(0.0, 10.0 - 3 * critical - 1.5 * high - 0.5 * medium - 0.2 * low - 0.1 * info), 0)::DOUBLE AS design FROM c""")
def penalties(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    found = table(spark, sf_dir, "labels").join(docs, "doc_id")
    tests = {
        "critical": F.col("toxic") == 1, "high": F.col("quality") == 0, "medium": F.col("lang") != "en",
        "low": F.col("n_chars") < 300, "info": F.col("n_chars") < 100,
    }
    counts = found.groupBy("source").agg(*[F.count_if(t).alias(k) for k, t in tests.items()])
    score = lambda *weights: S.penalty_score({k: F.col(k) for k in tests}, dict(zip(tests, weights)))
    return counts.select(
        "source",
        score(3.0, 1.0, 0.0, 0.0, 0.0).alias("pattern"),
        score(4.0, 2.0, 0.0, 0.0, 0.0).alias("security"),
        score(3.0, 2.0, 1.0, 0.0, 0.0).alias("review"),
        F.round(score(3.0, 1.5, 0.5, 0.2, 0.1), 0).alias("design"),
    )


_VOTES = """SELECT l_orderkey AS item, l_linenumber AS model, floor(l_quantity / 5)::DOUBLE AS score, l_returnflag AS message, l_linestatus AS severity FROM lineitem"""


def _votes(spark, sf_dir):
    """Lines of an order as the verdicts of several models on one item: a score from 0 to 10 and an issue."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("item"), F.col("l_linenumber").alias("model"), F.floor(F.col("l_quantity") / 5).cast("double").alias("score"),
        F.col("l_returnflag").alias("message"), F.col("l_linestatus").alias("severity"),
    )


_AGREED = """SELECT item, list_sort(list(message || '/' || severity)) AS issues FROM (SELECT item, message, severity FROM v GROUP BY ALL HAVING count(*) >= 2) GROUP BY item"""


@query("A18", f"""WITH v AS ({_VOTES}), i AS ({_AGREED}) SELECT item, round_even(avg(score), 0)::DOUBLE AS score, round(greatest(0, 1 - stddev_pop(score) / 5), 6) AS confidence,
  count(*) AS votes, round_even(avg(score), 0) >= 8 AS passed, coalesce(any_value(issues), []) AS issues FROM v LEFT JOIN i USING (item) GROUP BY item""")
def voting(spark, sf_dir):
    return ensembles.voted(_votes(spark, sf_dir), "item").withColumn("confidence", F.round("confidence", 6))


@query("A19", f"""WITH v AS ({_VOTES}) SELECT item, min(score) AS pessimist, max(score) AS optimist, list_sort(list(DISTINCT message)) AS issues FROM v GROUP BY item""")
def extremes(spark, sf_dir):
    return ensembles.extremes(_votes(spark, sf_dir), "item")


@query("A34", f"""WITH v AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY model, score, message, severity) AS k FROM ({_VOTES})),
  p AS (SELECT item, max(score) FILTER (k = 1) AS a, max(score) FILTER (k = 2) AS b, item % 10 + 1 AS iteration FROM v GROUP BY item),
  n AS (SELECT item, CASE WHEN iteration < 8 THEN 1 WHEN iteration >= 10 THEN 3 WHEN a >= 8 OR a < 4 THEN 1 WHEN abs(a - b) > 2 THEN 3 ELSE 2 END AS most FROM p)
  SELECT item, count(*) AS votes, round_even(avg(score), 0)::DOUBLE AS score, round_even(avg(score), 0) >= 8 AS passed FROM v JOIN n USING (item) WHERE k <= most GROUP BY item""")
def adaptive(spark, sf_dir):
    """Early on one model; later a second where the first is unsure, and a third where they disagree; at last all three."""
    iteration = F.col("item") % 10 + 1
    votes = ensembles.consulted(_votes(spark, sf_dir), "item", iteration, 10, "model", "score", "message", "severity")
    return ensembles.voted(votes, "item").select("item", "votes", "score", "passed")


@query("A20", """WITH w AS (SELECT p_partkey, p_type, p_name, unnest(string_split(p_name, ' ')) AS word FROM part),
  c AS (SELECT p_type, word, count(*) AS n FROM w GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY p_type ORDER BY n DESC, word) <= 5),
  f AS (SELECT p_type, count(*) AS failures, arg_min(p_name, p_partkey) AS example FROM part GROUP BY 1 ORDER BY failures DESC, p_type LIMIT 5)
  SELECT p_type, failures, example, word, n FROM f JOIN c USING (p_type)""")
def lessons(spark, sf_dir):
    """The most frequent kinds with their first row, and the most frequent words of each."""
    from ..operators.ranking import top, top_in_groups

    part = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_name")
    kinds = part.groupBy("p_type").agg(F.count("*").alias("failures"), F.min_by("p_name", "p_partkey").alias("example"))
    first = top(kinds, 5, F.desc("failures"), F.col("p_type"))
    words = part.select("p_type", F.explode(F.split("p_name", " ")).alias("word")).groupBy("p_type", "word").agg(F.count("*").alias("n"))
    return top_in_groups(words, 5, "p_type", F.desc("n"), F.col("word")).drop("rank").join(first, "p_type")


@query("A21", """SELECT p_partkey, round((len(list_intersect(string_split(p_name, ' '), ['red', 'ring', 'small'])) / 3.0 + 0.5) *
  CASE WHEN p_size < 10 THEN 2.0 WHEN p_size < 30 THEN 1.5 ELSE 1.0 END, 6)::DOUBLE AS relevance FROM part""")
def relevance(spark, sf_dir):
    shared = F.size(F.array_intersect(F.split("p_name", " "), F.array(*map(F.lit, ("red", "ring", "small")))))
    boost = S.laddered(F.col("p_size"), [(10, 2.0), (30, 1.5)], 1.0)
    return table(spark, sf_dir, "part").select("p_partkey", F.round((shared / 3.0 + 0.5) * boost, 6).alias("relevance"))


@query("A24", "SELECT count(*) FILTER (role = 'user') AS users, count(*) FILTER (role = 'assistant') AS assistants, count(*) FILTER (role = 'system') AS systems FROM conversations")
def kinds(spark, sf_dir):
    n = [F.count_if(F.col("role") == r).alias(r + "s") for r in ("user", "assistant", "system")]
    return table(spark, sf_dir, "conversations").agg(*n)


@query("A26", """WITH v AS (SELECT p_brand, (p_size > 25) AS test, count(*) AS n, avg((p_retailprice > 1000)::INT) AS r FROM part GROUP BY 1, 2)
  SELECT a.p_brand, CASE WHEN a.n < 30 OR b.n < 30 THEN 'continue' WHEN b.r - a.r > 0.05 THEN 'promote' WHEN b.r - a.r < -0.05 THEN 'reject' ELSE 'continue' END AS decision
  FROM v a JOIN v b ON a.p_brand = b.p_brand AND NOT a.test AND b.test""")
def ab_decision(spark, sf_dir):
    side = lambda flag: F.when((F.col("p_size") > 25) == F.lit(flag), 1)
    good = (F.col("p_retailprice") > 1000).cast("int")
    v = table(spark, sf_dir, "part").groupBy("p_brand").agg(
        F.count(side(False)).alias("n0"), F.count(side(True)).alias("n1"),
        F.avg(side(False) * good).alias("r0"), F.avg(side(True) * good).alias("r1"),
    )
    gap = F.col("r1") - F.col("r0")
    few = (F.col("n0") < 30) | (F.col("n1") < 30)
    decision = F.when(few, "continue").when(gap > 0.05, "promote").when(gap < -0.05, "reject").otherwise("continue")
    return v.filter("n0 > 0 AND n1 > 0").select("p_brand", decision.alias("decision"))


@query("A29", """WITH p AS (SELECT o_custkey, bool_and(o_orderstatus = 'F') AS done, o_custkey % 4 = 0 AS closed FROM orders GROUP BY 1)
  SELECT o_orderkey, CASE WHEN done OR closed THEN 'Completed' ELSE 'Open' END AS plan, CASE WHEN closed AND o_orderstatus <> 'F' THEN 'Cancelled' ELSE o_orderstatus END AS task
  FROM orders JOIN p USING (o_custkey)""")
def propagation(spark, sf_dir):
    """A plan whose tasks are all done is completed; completing a plan cancels its unfinished tasks."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    plans = orders.groupBy("o_custkey").agg(F.bool_and(F.col("o_orderstatus") == "F").alias("done"))
    joined = orders.join(plans.withColumn("closed", F.col("o_custkey") % 4 == 0), "o_custkey")
    plan = F.when(F.col("done") | F.col("closed"), "Completed").otherwise("Open")
    task = F.when(F.col("closed") & (F.col("o_orderstatus") != "F"), "Cancelled").otherwise(F.col("o_orderstatus"))
    return joined.select("o_orderkey", plan.alias("plan"), task.alias("task"))


@query("A30", """SELECT DISTINCT a.l_orderkey, a.l_linenumber FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_quantity = b.l_quantity
  AND a.l_returnflag = b.l_returnflag AND b.l_linenumber > a.l_linenumber""")
def repeated_blocks(spark, sf_dir):
    last = F.max("l_linenumber").over(W.partitionBy("l_orderkey", "l_quantity", "l_returnflag"))
    items = table(spark, sf_dir, "lineitem").withColumn("_last", last)
    return items.filter("l_linenumber < _last").select("l_orderkey", "l_linenumber").distinct()
