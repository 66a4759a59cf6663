"""Filters, chunk sources and full-text ranking over documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import text as T
from ..sources import chunks, nesting
from ..session import table
from . import query

TERMS = ("the", "and", "with", "shall")


_TREE = """'{"down":{"more":{"deep":{"er":"not reached"}}},"leaf":"value ' || event_id || '","none":1}'"""


@query("S05", f"""WITH e AS (SELECT event_id, event_type, props FROM events), o AS (SELECT * FROM e WHERE event_id % 3 = 0), l AS (SELECT * FROM e WHERE event_id % 3 = 1)
  SELECT event_id, 'tree' AS path, 'object' AS type, 0 AS depth, {_TREE} AS content FROM o
  UNION ALL SELECT event_id, 'tree.leaf', 'value', 1, 'leaf: value ' || event_id FROM o
  UNION ALL SELECT event_id, 'tree.down', 'object', 1, '{{"more":{{"deep":{{"er":"not reached"}}}}}}' FROM o
  UNION ALL SELECT event_id, 'tree.down.more', 'object', 2, '{{"deep":{{"er":"not reached"}}}}' FROM o
  UNION ALL SELECT event_id, 'tree.down.more.deep', 'object', 3, '{{"er":"not reached"}}' FROM o
  UNION ALL SELECT event_id, 'list', 'array', 0, '[{{"type":"' || event_type || '"}},7,"text"]' FROM o
  UNION ALL SELECT event_id, 'long', 'array', 0, '["' || repeat('x', 1998) || '...' FROM o
  UNION ALL SELECT event_id, '[0]', 'object', 0, '{{"type":"' || event_type || '"}}' FROM l
  UNION ALL SELECT event_id, '[2]', 'array', 0, '["a long text"]' FROM l
  UNION ALL SELECT event_id, '', 'parse_error', 0, props[:-2] FROM e WHERE event_id % 3 = 2""")
def json_chunks(spark, sf_dir):
    """Events as objects of five levels, as arrays, and cut off."""
    key, kind = F.col("event_id").cast("string"), F.col("event_type")
    tree = F.concat(F.lit('{"tree": {"leaf": "value '), key, F.lit('", "none": 1, "down": {"more": {"deep": {"er": "not reached"}}}}, "list": [{"type": "'), kind,
                    F.lit('"}, 7, "text"], "k": 12, "long": ["'), F.repeat(F.lit("x"), F.lit(3000)), F.lit('"]}'))
    items = F.concat(F.lit('[{"type": "'), kind, F.lit('"}, 7, ["a long text"]]'))
    events = table(spark, sf_dir, "events")
    text = F.when(F.col("event_id") % 3 == 0, tree).when(F.col("event_id") % 3 == 1, items).otherwise(F.left("props", F.length("props") - 1))
    return chunks.json_entries(events.select("event_id", text.alias("t")), "event_id", "t")


_CODE = "@code {\n  void A() { if (x) { y(); } }\n}"
_SQL_CODE = "'" + _CODE.replace("\n", "' || chr(10) || '") + "'"
_KEPT = "CASE WHEN length(v) > 1000 THEN v[:1000] || '...' ELSE v END"


@query("S08", rf"""WITH p AS (SELECT page_id, html || chr(10) || {_SQL_CODE} || chr(10) || '<section id="s' || page_id || '"><section class="in ner">  a  </section></section><Grid Rows="1"><Cell/></Grid><Grid>' AS t FROM pages),
  m AS (SELECT page_id, regexp_extract_all(t, '<h[1-3]|<div[^>]*id\s*=\s*"[^"]+"') AS marks, string_split_regex(t, '<h[1-3]|<div[^>]*id\s*=\s*"[^"]+"') AS gaps FROM p),
  h AS (SELECT page_id, k - 1 AS i, marks[k] || gaps[k + 1] AS v, regexp_extract(marks[k], 'id\s*=\s*"([^"]+)"', 1) AS own FROM (SELECT *, unnest(range(1, len(marks) + 1)) AS k FROM m)),
  e AS (SELECT page_id, tag, k, regexp_replace(f[k], '^\s+|\s+$', '', 'g') AS v FROM (SELECT *, unnest(range(1, len(f) + 1)) AS k FROM
    (SELECT page_id, tag, regexp_extract_all(t, '(?is)<' || tag || '\b[^>]*>(.*?)</' || tag || '\s*>', 1) AS f FROM p, (VALUES ('form'), ('table'), ('nav'), ('header'), ('footer'), ('aside'), ('main'), ('article')) g(tag)))),
  s AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY k) AS i, v FROM (SELECT page_id, k, regexp_replace(f[k], '^\s+|\s+$', '', 'g') AS v FROM
    (SELECT *, unnest(range(1, len(f) + 1)) AS k FROM (SELECT page_id, regexp_extract_all(t, '(?is)<style[^>]*>(.*?)</style>', 1) AS f FROM p))) WHERE v <> ''),
  c AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(t, '<([A-Z][a-zA-Z0-9]*)[^>]*>', 1)) AS name FROM p),
  a AS (SELECT page_id, 'html_section' AS chunk, CASE WHEN own <> '' THEN own ELSE 'Section_' || i END AS name, v[:1500] AS v FROM h WHERE length(v) >= 100
    UNION ALL SELECT page_id, 'element', tag || '_' || tag || k, {_KEPT} FROM e UNION ALL SELECT page_id, 'style_tag', 'InlineStyles_' || i, v FROM s UNION ALL SELECT page_id, 'component', name, '' FROM c
    UNION ALL SELECT page_id, 'code', 'code', {_SQL_CODE} FROM p UNION ALL SELECT page_id, 'element', 'section_in', 'a' FROM p
    UNION ALL SELECT page_id, 'element', 'section_s' || page_id, '<section class="in ner">  a  </section>' FROM p)
  SELECT page_id, chunk, name, md5(v) AS digest FROM a""")
def html_blocks(spark, sf_dir):
    """Pages with a block of code, nested sections and components after them."""
    pages = table(spark, sf_dir, "pages")
    more = F.concat(F.lit(f'\n{_CODE}\n<section id="s'), F.col("page_id").cast("string"), F.lit('"><section class="in ner">  a  </section></section><Grid Rows="1"><Cell/></Grid><Grid>'))
    found = nesting.markup(pages.select("page_id", F.concat("html", more).alias("t")), "page_id", "t")
    return found.select("page_id", "chunk", "name", F.md5("value").alias("digest"))


@query("S14", "SELECT DISTINCT source, lang FROM documents")
def scroll(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("source", "lang").distinct()


@query("S15", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def label_scan(spark, sf_dir):
    wanted = {"o_orderstatus": "F", "o_orderpriority": "1-URGENT", "o_custkey": None}
    orders = table(spark, sf_dir, "orders")
    for column, value in wanted.items():
        if value is not None:
            orders = orders.filter(F.col(column) == value)
    return orders.select("o_orderkey")


@query("S16", "SELECT doc_id, lang, n_chars FROM documents WHERE doc_id = 7")
def lookup(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter("doc_id = 7").select("doc_id", "lang", "n_chars")


@query("F01", "SELECT doc_id FROM documents WHERE lower(source) = 'src3'")
def context(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter(F.lower("source") == "src3").select("doc_id")


@query("F03", """SELECT doc_id FROM documents WHERE lower(text) LIKE '%thing%' OR lower(source) LIKE '%src1%'""")
def substring(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.filter(S.contains_any(F.col("text"), ["Thing"]) | S.contains_any(F.col("source"), ["SRC1"])).select("doc_id")


@query("F04", "SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)(idiot|scum\\.)')")
def regex(spark, sf_dir):
    import re

    pattern = "(?i)(" + "|".join(re.escape(w) for w in ("idiot", "scum.")) + ")"
    return table(spark, sf_dir, "documents").filter(F.col("text").rlike(pattern)).select("doc_id")


@query("F05", "SELECT count(*) AS n FROM events WHERE event_type NOT IN ('error', 'view')")
def membership(spark, sf_dir):
    return table(spark, sf_dir, "events").filter(~F.col("event_type").isin("error", "view")).agg(F.count("*").alias("n"))


@query("F06", "SELECT doc_id FROM documents WHERE list_has_any(string_split(text, ' '), ['idiot', 'clown'])")
def array_any(spark, sf_dir):
    wanted = F.array(F.lit("idiot"), F.lit("clown"))
    return table(spark, sf_dir, "documents").filter(F.arrays_overlap(F.split("text", " "), wanted)).select("doc_id")


@query("F07", "SELECT doc_id, lang FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1)")
def exists(spark, sf_dir):
    toxic = table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(toxic, "doc_id", "semi")


@query("F10", "SELECT o_orderkey FROM orders WHERE o_orderdate > TIMESTAMP '2001-08-01' - INTERVAL 30 DAY")
def time_window(spark, sf_dir):
    as_of = F.lit("2001-08-01").cast("timestamp")
    return table(spark, sf_dir, "orders").filter(F.col("o_orderdate") > as_of - F.expr("INTERVAL 30 DAYS")).select("o_orderkey")


@query("F15", r"SELECT event_id FROM events WHERE regexp_matches(props, '[/\\.]')")
def path_like(spark, sf_dir):
    return table(spark, sf_dir, "events").filter(F.col("props").rlike(r"[/\\.]")).select("event_id")


@query("W07", """WITH l AS (SELECT doc_id, generate_subscripts(x, 1) AS pos, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents))
  SELECT doc_id, pos::INT AS pos, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM l""")
def offsets(spark, sf_dir):
    return chunks.lines(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "pos", "start")


@query("W03", """WITH h AS (SELECT page_id, generate_subscripts(x, 1) AS pos, unnest(x)::INT AS level FROM (SELECT page_id, regexp_extract_all(html, '(?i)<h([1-6])\\b', 1) AS x FROM pages))
  SELECT page_id, pos::INT - 1 AS pos, level, coalesce(level > lag(level) OVER (PARTITION BY page_id ORDER BY pos) + 1, false) AS skips FROM h""")
def heading_skips(spark, sf_dir):
    from pyspark.sql.window import Window as W

    heads = chunks.headings(table(spark, sf_dir, "pages"), "page_id", "html")
    before = F.lag("level").over(W.partitionBy("page_id").orderBy("pos"))
    return heads.withColumn("skips", F.coalesce(F.col("level") > before + 1, F.lit(False)))


_BM = " + ".join(
    f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * len / mean))" for i in range(4)
)
_TF = ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) AS tf{i}" for i, t in enumerate(sorted(TERMS)))
_DF = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(4))


@query("BM25", f"""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM documents),
  c AS (SELECT doc_id, len(w) AS len, {_TF} FROM t), a AS (SELECT count(*) AS n, avg(len) AS mean, {_DF} FROM c)
  SELECT doc_id, round({_BM}, 4) AS score FROM c, a WHERE tf0 + tf1 + tf2 + tf3 > 0""")
def bm25(spark, sf_dir):
    found = T.bm25(table(spark, sf_dir, "documents"), "doc_id", "text", TERMS)
    return found.select("doc_id", F.round("score", 4).alias("score"))
