"""Scalar functions over the input tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..session import table
from . import query



@query("X02", """SELECT doc_id, CASE WHEN length(text) > 1400
  THEN substring(text, 1, 838) || '...' || right(text, 559) ELSE text END AS shortened FROM documents""")
def head_and_tail(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.head_and_tail(F.col("text"), 1400).alias("shortened"))


@query("X03", """SELECT doc_id, concat_ws(chr(10), '[DOCUMENT] ' || doc_id, 'Language: ' || lang, 'Source: ' || source,
  'Code:', substring(text, 1, 200)) AS described FROM documents""")
def described(spark, sf_dir):
    parts = [
        F.concat(F.lit("[DOCUMENT] "), F.col("doc_id").cast("string")),
        F.concat(F.lit("Language: "), "lang"),
        F.concat(F.lit("Source: "), "source"),
        F.lit("Code:"),
        F.substring("text", 1, 200),
    ]
    return table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("\n", *parts).alias("described"))


@query("X04", "SELECT doc_id, md5(source || ':' || lang || ':' || doc_id || ':1') AS id FROM documents")
def ids(spark, sf_dir):
    from ..sources.tables import point_id

    docs = table(spark, sf_dir, "documents").withColumns({"k": F.col("doc_id").cast("string"), "one": F.lit("1")})
    return docs.select("doc_id", point_id("source", "lang", "k", "one").alias("id"))


@query("X09", """SELECT a, b, n, round(least(0.95, 0.3 * ln(n + 1)), 6) AS strength FROM (
  SELECT p_size AS a, p_brand AS b, count(*) AS n FROM part GROUP BY 1, 2)""")
def strength(spark, sf_dir):
    counts = table(spark, sf_dir, "part").groupBy(F.col("p_size").alias("a"), F.col("p_brand").alias("b"))
    return counts.agg(F.count("*").alias("n")).withColumn("strength", F.round(S.co_edit_strength(F.col("n")), 6))


@query("X10", """SELECT o_orderkey, CASE WHEN d < 1 THEN 1.0 WHEN d < 7 THEN 0.8 WHEN d < 30 THEN 0.5 WHEN d < 90 THEN 0.3
  ELSE 0.1 END::DOUBLE AS recency FROM (SELECT o_orderkey, date_diff('day', o_orderdate::DATE, DATE '2001-08-02') AS d FROM orders)""")
def recency(spark, sf_dir):
    age = F.datediff(F.lit("2001-08-02").cast("date"), F.col("o_orderdate").cast("date"))
    return table(spark, sf_dir, "orders").select("o_orderkey", S.recency(age).cast("double").alias("recency"))


@query("X11", """SELECT user_id, round((0.1 * a + 0.3 * e + 0.2 * s + 0.2 * d + 0.2 * 0.5) / (a + e + s + d + 1), 6) AS importance
  FROM (SELECT user_id, count(*) FILTER (event_type = 'view') AS a, count(*) FILTER (event_type = 'purchase') AS e,
    count(*) FILTER (event_type = 'click') AS s, count(*) FILTER (event_type = 'signup') AS d FROM events GROUP BY user_id)""")
def importance(spark, sf_dir):
    n = [F.count_if(F.col("event_type") == k).alias(k) for k in ("view", "purchase", "click", "signup")]
    counts = table(spark, sf_dir, "events").groupBy("user_id").agg(*n)
    score = S.importance(F.col("view"), F.col("purchase"), F.col("click"), F.col("signup"), F.lit(0.5))
    return counts.select("user_id", F.round(score, 6).alias("importance"))


@query("X15", r"""SELECT doc_id, len(list_filter(string_split(text, chr(10)),
  lambda x: trim(x) <> '' AND NOT starts_with(trim(x), '//') AND NOT starts_with(trim(x), '#')))::INT AS loc FROM documents""")
def lines_of_code(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.lines_of_code(F.col("text")).alias("loc"))


_LUM = """CASE WHEN {c} / 255.0 <= 0.03928 THEN {c} / 255.0 / 12.92 ELSE pow(({c} / 255.0 + 0.055) / 1.055, 2.4) END"""
_SQL_LUM = " + ".join(f"{w} * ({_LUM.format(c=c)})" for w, c in ((0.2126, "r"), (0.7152, "g"), (0.0722, "b")))


@query("X20", f"""SELECT p_partkey, round(1.05 / ({_SQL_LUM} + 0.05), 4) AS contrast FROM (
  SELECT p_partkey, p_partkey % 256 AS r, (p_partkey // 3) % 256 AS g, (p_size * 5) % 256 AS b FROM part)""")
def contrast(spark, sf_dir):
    hex2 = lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")
    k = F.col("p_partkey")
    color = F.concat(F.lit("#"), hex2(k % 256), hex2(F.floor(k / 3) % 256), hex2((F.col("p_size") * 5) % 256))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(S.contrast(F.lit("#fff"), color), 4).alias("contrast"))


@query("X24", r"""SELECT conv_id, round(len(list_intersect(x, y))::DOUBLE / greatest(len(x), len(y)), 6) AS overlap FROM (
  SELECT a.conv_id, list_filter(regexp_split_to_array(a.text, '\s+'), lambda w: w <> '') AS x,
    list_filter(regexp_split_to_array(b.text, '\s+'), lambda w: w <> '') AS y
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = 0 AND b.turn = 1)""")
def overlap(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    a = turns.filter("turn = 0").select("conv_id", F.col("text").alias("a"))
    b = turns.filter("turn = 1").select("conv_id", F.col("text").alias("b"))
    return a.join(b, "conv_id").select("conv_id", F.round(S.word_overlap(F.col("a"), F.col("b")), 6).alias("overlap"))


@query("X26", r"""SELECT page_id, len(regexp_extract_all(html, '<p[ >]'))::INT AS paragraphs, len(regexp_extract_all(html, '<a '))::INT AS links,
  contains(html, '<nav') AS has_nav, contains(html, '<table') AS has_table FROM pages""")
def tags(spark, sf_dir):
    html = F.col("html")
    return table(spark, sf_dir, "pages").select(
        "page_id",
        F.regexp_count(html, F.lit("<p[ >]")).alias("paragraphs"),
        F.regexp_count(html, F.lit("<a ")).alias("links"),
        html.contains("<nav").alias("has_nav"),
        html.contains("<table").alias("has_table"),
    )


@query("X36", """SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS INT), -1) AS k,
  coalesce(TRY_CAST(event_type AS INT), 0) AS bad FROM events""")
def coerced(spark, sf_dir):
    k = F.get_json_object("props", "$.k").try_cast("int")
    return table(spark, sf_dir, "events").select(
        "event_id", F.coalesce(k, F.lit(-1)).alias("k"), F.coalesce(F.col("event_type").try_cast("int"), F.lit(0)).alias("bad")
    )


@query("X42", "SELECT item_id, CASE WHEN length(text) > 200 THEN substring(text, 1, 200) || '...' ELSE text END AS short FROM benchmark")
def caps(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", S.capped(F.col("text"), 200).alias("short"))


@query("X23", """SELECT a.p_name AS a, b.p_name AS b, levenshtein(a.p_name, b.p_name)::INT AS edits FROM (SELECT DISTINCT p_name FROM part) a JOIN (SELECT DISTINCT p_name FROM part) b
  ON a.p_name < b.p_name WHERE levenshtein(a.p_name, b.p_name) <= 2""")
def edits(spark, sf_dir):
    from ..operators.text import near_names

    return near_names(table(spark, sf_dir, "part"), "p_name")
