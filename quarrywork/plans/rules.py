"""Rule tables, classifiers and the remaining scalar functions over the input tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import code as C
from ..functions import scalars as S
from ..operators import blocks
from ..operators import detect as D
from ..operators.ranking import top, top_in_groups
from ..session import table
from . import query

RULES = (
    D.Rule("shout", r"[A-Z]{6,}", "style", "high", confidence=0.8),
    D.Rule("license", r"[Ll]icense", "legal", "low"),
    D.Rule("insult", r"\b(idiot|scum|moron)\b", "toxicity", "critical", confidence=0.9),
    D.Rule("german-und", r"(^| )und( |$)", "language", "low", language="de", confidence=0.5),
)
#: The types that a healthy project has.
CRITICAL = ("style", "legal", "toxicity", "language", "secrets")
WEIGHTS = {"critical": 3.0, "high": 1.0, "low": 0.1}

_LINES = """l AS (SELECT doc_id, lang, generate_subscripts(x, 1)::INT AS line, unnest(x) AS t FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS x FROM documents))"""
_FOUND = f"""WITH {_LINES}, f AS (SELECT doc_id, line, 'shout' AS rule, 'style' AS type, 'high' AS severity FROM l WHERE regexp_matches(t, '[A-Z]{{6,}}')
  UNION ALL SELECT doc_id, line, 'license', 'legal', 'low' FROM l WHERE regexp_matches(t, '[Ll]icense')
  UNION ALL SELECT doc_id, line, 'insult', 'toxicity', 'critical' FROM l WHERE regexp_matches(t, '\\b(idiot|scum|moron)\\b')
  UNION ALL SELECT doc_id, line, 'german-und', 'language', 'low' FROM l WHERE lang = 'de' AND regexp_matches(t, '(^| )und( |$)'))"""


def _findings(spark, sf_dir):
    return D.detect(table(spark, sf_dir, "documents"), "doc_id", "text", RULES, "lang")


@query("D01", f"{_FOUND} SELECT doc_id, line, rule, type FROM f")
def findings(spark, sf_dir):
    return _findings(spark, sf_dir).select("doc_id", "line", "rule", "type")


@query("RULES", """WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[a-z]{8,}')) AS word FROM benchmark),
  l AS (SELECT doc_id, generate_subscripts(x, 1)::INT AS line, unnest(x) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
  c AS (SELECT DISTINCT doc_id, line, t, unnest(regexp_extract_all(lower(t), '[a-z0-9_]+')) AS word FROM l)
  SELECT doc_id, line, 'ends-' || word AS rule FROM c JOIN w USING (word) WHERE regexp_matches(t, '(?i)' || word || '[.,]')""")
def many_rules(spark, sf_dir):
    """A rule for each long word of the benchmark texts: it ends a part of a sentence."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[a-z]{8,}"), F.lit(0))).alias("word")).distinct()
    rules = words.select(
        F.concat(F.lit("ends-"), "word").alias("rule"), F.concat(F.lit("(?i)"), "word", F.lit("[.,]")).alias("regex"), F.array("word").alias("words"),
        F.lit("end").alias("type"), F.lit("low").alias("severity"), F.lit(1.0).alias("confidence"), F.lit(True).alias("positive"))
    return D.detect_by_words(table(spark, sf_dir, "documents"), "doc_id", "text", rules).select("doc_id", "line", "rule")


@query("A33", f"""{_FOUND}, u AS (SELECT doc_id, severity FROM f UNION ALL SELECT doc_id, 'high' FROM documents WHERE length(text) > 5000 UNION ALL SELECT doc_id, 'critical' FROM documents WHERE trim(coalesce(text, '')) = ''
    UNION ALL SELECT doc_id, 'info' FROM documents WHERE NOT contains(lower(coalesce(text, '')), 'the'))
  SELECT doc_id, count(*) AS issues, round(greatest(0, 10 - sum(CASE severity WHEN 'critical' THEN 3 WHEN 'high' THEN 1 WHEN 'info' THEN 0 ELSE 0.1 END)), 4)::DOUBLE AS score FROM u GROUP BY doc_id""")
def review(spark, sf_dir):
    """Line rules, rules of whole files (too long, empty), and one of the task: its keyword should occur."""
    text = F.coalesce("text", F.lit(""))
    whole = F.array_compact(F.array(
        F.when(F.length(text) > 5000, "high"), F.when(F.trim(text) == "", "critical"), F.when(~F.lower(text).contains("the"), "info")
    ))
    universal = table(spark, sf_dir, "documents").select("doc_id", F.explode(whole).alias("severity"))
    found = _findings(spark, sf_dir).select("doc_id", "severity").unionByName(universal)
    return D.score(found, "doc_id", {**WEIGHTS, "info": 0.0}).withColumn("score", F.round("score", 4))


@query("A14", f"""{_FOUND}, n AS (SELECT count(*) AS n FROM documents), d AS (SELECT DISTINCT type, doc_id FROM f)
  SELECT type, count(*) AS documents, round(count(*) / any_value(n.n), 6)::DOUBLE AS coverage, list_sort(list(doc_id))[1:3] AS examples, any_value(c.confidence) AS confidence
  FROM d JOIN (SELECT type, round(avg(confidence), 6)::DOUBLE AS confidence FROM f JOIN (VALUES ('shout', 0.8), ('license', 1.0), ('insult', 0.9), ('german-und', 0.5)) v(rule, confidence) USING (rule) GROUP BY type) c USING (type) CROSS JOIN n GROUP BY type""")
def coverage(spark, sf_dir):
    """Of each practice: in how many documents, how sure, and the first three of them. Lists never hold more than these."""
    docs = table(spark, sf_dir, "documents")
    found = _findings(spark, sf_dir)
    own = found.groupBy("type", "doc_id").agg(F.sum("confidence").alias("c"), F.count("*").alias("k"))
    rolled = own.groupBy("type").agg(F.count("*").alias("documents"), (F.sum("c") / F.sum("k")).alias("confidence"))
    first = top_in_groups(own, 3, "type", F.col("doc_id")).groupBy("type").agg(F.array_sort(F.collect_list("doc_id")).alias("examples"))
    total = docs.agg(F.count("*").alias("n"))  # one row
    return rolled.join(first, "type").join(F.broadcast(total), F.lit(True)).select(
        "type", "documents", F.round(F.col("documents") / F.col("n"), 6).alias("coverage"), F.round("confidence", 6).alias("confidence"), "examples"
    )


@query("A15", f"""{_FOUND} SELECT count(DISTINCT type) AS present, round(count(DISTINCT type) / 5.0, 2)::DOUBLE AS health FROM f WHERE type IN {CRITICAL!r}""")
def health(spark, sf_dir):
    n = F.count_distinct("type")
    critical = _findings(spark, sf_dir).filter(F.col("type").isin(*CRITICAL))
    return critical.agg(n.alias("present"), F.round(n / len(CRITICAL), 2).alias("health"))


@query("U05", f"""{_FOUND}, w AS (SELECT doc_id, unnest(['style', 'legal']) AS type FROM documents)
  SELECT w.doc_id, w.type FROM w LEFT JOIN (SELECT DISTINCT doc_id, type FROM f) g USING (doc_id, type) WHERE g.doc_id IS NULL""")
def missing_types(spark, sf_dir):
    return D.missing(table(spark, sf_dir, "documents"), "doc_id", _findings(spark, sf_dir), ("style", "legal"))


@query("A31", f"""{_FOUND}, r AS (SELECT doc_id, line, rule, severity FROM f QUALIFY row_number() OVER (PARTITION BY doc_id
  ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 ELSE 2 END, line, rule) <= 5),
  m AS (SELECT doc_id, CASE WHEN count(*) FILTER (severity = 'critical') > 0 THEN 'fix ' || count(*) FILTER (severity = 'critical') || ' critical' WHEN count(*) >= 3 THEN 'plan ' || count(*) ELSE 'fine' END AS message FROM f GROUP BY doc_id)
  SELECT doc_id, line, rule, message FROM r JOIN m USING (doc_id)""")
def worst(spark, sf_dir):
    """The five worst findings of each document, and what their numbers ask for."""
    found = _findings(spark, sf_dir)
    rank = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "high", 1).otherwise(2)
    first = top_in_groups(found, 5, "doc_id", rank, F.col("line"), F.col("rule")).select("doc_id", "line", "rule")
    counts = found.groupBy("doc_id").agg(F.count_if(F.col("severity") == "critical").alias("c"), F.count("*").alias("n"))
    message = F.when(F.col("c") > 0, F.format_string("fix %d critical", "c")).when(F.col("n") >= 3, F.format_string("plan %d", "n")).otherwise("fine")
    return first.join(counts.select("doc_id", message.alias("message")), "doc_id")


#: What graph questions name: the target of "implements X" (fixed value).
IMPLEMENTED = r"(?i)implement(?:s)?\s+([A-Z][a-zA-Z0-9<>]+)"


@query("X06", f"""SELECT conv_id, turn, regexp_extract(text || CASE WHEN turn % 2 = 0 THEN ' classes that implement IRepo<' || role || '>' ELSE ' who Implements ' || role END, '{IMPLEMENTED}', 1) AS target FROM conversations""")
def target(spark, sf_dir):
    """Turns as graph questions, each with what it asks to be implemented."""
    asks = F.when(F.col("turn") % 2 == 0, F.concat(F.lit(" classes that implement IRepo<"), "role", F.lit(">"))).otherwise(F.concat(F.lit(" who Implements "), "role"))
    asked = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat("text", asks).alias("text"))
    return asked.select("conv_id", "turn", F.regexp_extract("text", IMPLEMENTED, 1).alias("target"))


@query("X12", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(0.7 * l_discount + 0.3 * l_tax + 1e-9, 4) AS score FROM lineitem")
def fusion(spark, sf_dir):
    score = S.fused_score(F.col("l_discount"), F.col("l_tax"), 0.7)
    items = table(spark, sf_dir, "lineitem")
    return items.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(score + 1e-9, 4).alias("score"))


@query("X16", "SELECT page_id, list_max(list_transform(string_split(html, chr(10)), lambda x: length(regexp_extract(x, '^( *)', 1)) // 4))::BIGINT AS depth FROM pages")
def nesting(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", S.deepest_indent(F.col("html")).cast("long").alias("depth"))


@query("X22", r"""SELECT page_id, len(regexp_extract_all(html, '(?i)<img\b'))::INT - len(regexp_extract_all(html, '(?i)<img\b[^>]*alt='))::INT AS no_alt,
  len(regexp_extract_all(html, '(?i)<(button|a|input)[^>]*aria-hidden="true"'))::INT AS hidden, len(regexp_extract_all(html, '(?i)tabindex="([2-9]|\d{2,})"'))::INT AS tabs,
  len(regexp_extract_all(html, '(?i)<div[^>]*onclick'))::INT AS clickable, NOT contains(lower(html), '<main') AND length(html) > 500 AS no_main, NOT regexp_matches(html, '<html[^>]*\blang=') AS no_lang,
  len(list_filter(regexp_extract_all(html, '(?i)<button[^>]*>\s*<(svg|i)\b'), lambda x: NOT contains(x, 'aria-label')))::INT AS icons
  FROM (SELECT page_id, html || CASE WHEN page_id % 3 = 0 THEN '<img src="x"><IMG alt="y"><div onClick="z">' ELSE '<a aria-hidden="true">' END || CASE WHEN page_id % 4 = 0 THEN '<p tabIndex="12"><button ><i></i></button><button aria-label="q"><svg>' ELSE '' END AS html FROM pages)""")
def accessibility(spark, sf_dir):
    key = F.col("page_id")
    first = F.when(key % 3 == 0, '<img src="x"><IMG alt="y"><div onClick="z">').otherwise('<a aria-hidden="true">')
    second = F.when(key % 4 == 0, '<p tabIndex="12"><button ><i></i></button><button aria-label="q"><svg>').otherwise("")
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat("html", first, second).alias("html"))
    return pages.select("page_id", C.accessibility(F.col("html")).alias("a")).select("page_id", "a.*")


_PAIRED = """(SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_quantity % 7)::INT AS e, (l_quantity % 11)::INT AS f, l_quantity % 2 = 0 AS i, l_quantity % 3 = 0 AS j,
  l_tax > 0.03 AS t FROM lineitem)"""


@query("X25", f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(((abs(e - f) <= 2)::INT + (i = j)::INT + 1 + (i = t)::INT + (j = t)::INT + t::INT) / 6.0, 4)::DOUBLE AS alike FROM {_PAIRED}""")
def block_similarity(spark, sf_dir):
    q = F.col("l_quantity")
    i, j, t = q % 2 == 0, q % 3 == 0, F.col("l_tax") > 0.03
    block = lambda e, *flags, text: F.struct(e.cast("int").alias("elements"), *[f.alias(n) for f, n in zip(flags, blocks.FLAGS)], text.alias("content"))
    a = block(q % 7, i, F.lit(True), i, j, text=F.lit("p q r s"))
    b = block(q % 11, j, F.lit(True), t, t, text=F.when(t, F.lit("s r q x")).otherwise("s r z x"))
    items = table(spark, sf_dir, "lineitem")
    return items.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(blocks.similarity(a, b), 4).alias("alike"))


def _pages(spark, sf_dir):
    """Pages with a few small blocks that differ by their number, far enough from the rest to be blocks of their own."""
    key = F.col("page_id")
    word = F.concat(F.lit("w"), (key % 17).cast("string"))
    one = F.concat(F.lit('\n<div class="card"><b>'), word, F.lit("</b> one two three four"), F.when(key % 3 == 0, "<img>").otherwise(""), F.repeat(F.lit("<i>"), (key % 12).cast("int")))
    gap = "\n" * 12
    return table(spark, sf_dir, "pages").select("page_id", F.concat(F.coalesce("html", F.lit("")), F.lit(gap), one, F.lit(gap), F.lit('<div class="price">')).alias("html"))


@query("J16")
def block_groups(spark, sf_dir):
    found = blocks.found(_pages(spark, sf_dir), "page_id", "html")
    return blocks.groups(found, "page_id").select("page_id", "pos", "elements", *blocks.FLAGS, "group")


@query("Z14")
def reusable(spark, sf_dir):
    """Groups of alike blocks that come twice or more, the most frequent first."""
    found = blocks.groups(blocks.found(_pages(spark, sf_dir), "page_id", "html"), "page_id")
    rolled = found.groupBy("group").agg(
        F.count("*").alias("times"), F.count_distinct("page_id").alias("pages"), F.round(F.avg("elements"), 4).alias("elements")
    )
    return top(rolled.filter("times >= 2"), 20, F.desc("times"), F.col("group"))


_CLASSES = {"UserController": "API", "OrderService": "Domain", "MyDbContext": "Data", "CardViewModel": "UI", "LoginTests": "Test", "LogMiddleware": "Infra", "Thing": None}
_SPACES = {"Shop.Users.Controllers": ("API", "Users"), "Shop.Services": ("Domain", "Shop"), "Shop.Data.Sql": ("Data", "Shop"), "Shop.Billing.Views": ("UI", "Billing"), "Solo": ("Domain", "Solo")}


@query("X28", f"""SELECT page_id, CASE WHEN contains(url, '//blog.') THEN 'blog' WHEN contains(url, '//m.') THEN 'mobile' WHEN contains(url, '//www.') THEN 'web' ELSE 'core' END AS layer,
  coalesce({[v or "" for v in _CLASSES.values()]!r}[page_id % {len(_CLASSES)} + 1].nullif(''), {[v for v, _ in _SPACES.values()]!r}[page_id % {len(_SPACES)} + 1]) AS class_layer,
  {[v for _, v in _SPACES.values()]!r}[page_id % {len(_SPACES)} + 1] AS context FROM pages""")
def layers(spark, sf_dir):
    url = F.col("url")
    layer = F.when(url.contains("//blog."), "blog").when(url.contains("//m."), "mobile").when(url.contains("//www."), "web")
    pick = lambda names: F.element_at(F.array(*map(F.lit, names)), (F.col("page_id") % len(names) + 1).cast("int"))
    named = table(spark, sf_dir, "pages").select("page_id", layer.otherwise("core").alias("layer"), pick(_CLASSES).alias("name"), pick(_SPACES).alias("space"))
    return named.select("page_id", "layer", C.layer(F.col("name"), F.col("space")).alias("class_layer"), C.bounded_context(F.col("space")).alias("context"))


@query("X29", "SELECT p_partkey, CASE WHEN p_size <= 3 THEN 'low' WHEN p_size <= 6 THEN 'medium' ELSE 'high' END AS complexity FROM part")
def buckets(spark, sf_dir):
    level = S.laddered(F.col("p_size"), [(4, "low"), (7, "medium")], "high")
    return table(spark, sf_dir, "part").select("p_partkey", level.alias("complexity"))


@query("X30", "SELECT n_nationkey, 'Dear ' || n_name || ' of region ' || n_regionkey || '.' AS rendered FROM nation")
def templates(spark, sf_dir):
    values = {"name": F.col("n_name"), "region": F.col("n_regionkey").cast("string")}
    text = S.rendered(F.lit("Dear {{name}} of region {{region}}."), values)
    return table(spark, sf_dir, "nation").select("n_nationkey", text.alias("rendered"))


@query("X31", r"""SELECT page_id, regexp_replace(url, '([\\+\-&|!(){}\[\]^"~*?:/])', '\\\1', 'g') AS escaped FROM pages""")
def escaped(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", S.escaped_for_search(F.col("url")).alias("escaped"))


@query("X32", r"SELECT page_id, regexp_replace(url, '^https?://', '/workspace/') AS path FROM pages")
def translated(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^https?://", "/workspace/").alias("path"))


@query("X35", r"SELECT page_id, TRY_CAST(regexp_extract(url, '/(\d+)', 1) AS BIGINT) AS n FROM pages")
def scraped(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"/(\d+)", 1).try_cast("long").alias("n"))


@query("X45", f"SELECT doc_id, list_filter({list(C.TASK_TECHNOLOGIES)!r}, lambda w: contains(lower(coalesce(text, '')), w)) AS keywords FROM documents")
def keywords(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", C.task_keywords(F.col("text")).alias("keywords"))


@query("X49", r"SELECT item_id, array_to_string(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '')[1:3], '-') AS name FROM benchmark")
def slugs(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", S.slug(F.col("text")).alias("name"))


@query("X51", """SELECT vec_id, CASE WHEN label < 3 THEN 'files' WHEN label < 6 THEN 'classes' WHEN label < 9 THEN 'methods' ELSE 'patterns' END AS collection FROM embeddings""")
def collections(spark, sf_dir):
    kind = S.laddered(F.col("label"), [(3, "files"), (6, "classes"), (9, "methods")], "patterns")
    return table(spark, sf_dir, "embeddings").select("vec_id", kind.alias("collection"))


@query("A35", """SELECT o_orderkey, round(least(99.0, 100.0 * e / s) + 1e-9, 4)::DOUBLE AS percent, round(greatest(0.0, s - e), 2)::DOUBLE AS left_ FROM (
  SELECT o_orderkey, o_orderkey % 700 AS e, 500 AS s FROM orders)""")
def job_progress(spark, sf_dir):
    percent, left = S.progress(F.col("o_orderkey") % 700, F.lit(500))
    orders = table(spark, sf_dir, "orders")
    return orders.select("o_orderkey", F.round(percent + 1e-9, 4).alias("percent"), F.round(left, 2).cast("double").alias("left_"))


@query("A28", """WITH c AS (SELECT source, count(*) FILTER (doc_id % 3 = 0) AS tests, count(*) AS methods, max(n_chars) AS complexity, count(*) FILTER (lang = 'fr') AS undocumented,
    count(*) FILTER (n_chars > 3000) AS smells, bool_or(doc_id % 7 = 0) AS has_file FROM documents GROUP BY source),
  r AS (SELECT source, list_filter([CASE WHEN tests = 0 THEN 'requires_test' END, CASE WHEN NOT has_file THEN 'requires_file' END, CASE WHEN 100.0 * tests / methods < 80 THEN 'min_test_coverage' END,
    CASE WHEN complexity > 10000 THEN 'max_complexity' END, CASE WHEN undocumented > 0 THEN 'requires_documentation' END, CASE WHEN smells > 0 THEN 'no_code_smells' END], lambda x: x IS NOT NULL) AS failures FROM c)
  SELECT source, failures, len(failures) = 0 AS valid FROM r""")
def task_rules(spark, sf_dir):
    """A source as a task's target and its documents as methods; every third is a test."""
    counts = table(spark, sf_dir, "documents").groupBy("source").agg(
        F.count_if(F.col("doc_id") % 3 == 0).alias("tests"),
        F.count("*").alias("methods"),
        F.max("n_chars").alias("complexity"),
        F.count_if(F.col("lang") == "fr").alias("undocumented"),
        F.count_if(F.col("n_chars") > 3000).alias("smells"),
        F.bool_or(F.col("doc_id") % 7 == 0).alias("has_file"),
    )
    failures = D.task_failures({
        "requires_test": F.col("tests") == 0, "requires_file": ~F.col("has_file"), "min_test_coverage": 100.0 * F.col("tests") / F.col("methods") < 80,
        "max_complexity": F.col("complexity") > 10_000, "requires_documentation": F.col("undocumented") > 0, "no_code_smells": F.col("smells") > 0,
    })
    return counts.select("source", failures.alias("failures")).withColumn("valid", F.size("failures") == 0)


@query("A27", """WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events)
  SELECT user_id, list_filter([CASE WHEN avg((event_type <> 'error')::INT) < 0.7 AND count(*) > 10 THEN 'success' END, CASE WHEN avg(value) < 60 AND count(*) > 10 THEN 'confidence' END,
    CASE WHEN count(*) FILTER (k <= 100 AND event_type = 'signup') > 0.1 * count(*) FILTER (k <= 100) THEN 'parsing' END], lambda x: x IS NOT NULL) AS advice FROM e GROUP BY user_id""")
def improvement(spark, sf_dir):
    """Rates over all calls of a prompt, and the share of unreadable answers in the last hundred."""
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "value", "ts", "event_id")
    own = events.groupBy("user_id").agg(
        F.count("*").alias("n"), F.avg((F.col("event_type") != "error").cast("int")).alias("r"), F.avg("value").alias("m")
    )
    last = top_in_groups(events, 100, "user_id", F.desc("ts"), F.desc("event_id"))
    bad = last.groupBy("user_id").agg((F.count_if(F.col("event_type") == "signup") > 0.1 * F.count("*")).alias("bad"))
    many = F.col("n") > 10
    advice = F.array_compact(F.array(
        F.when((F.col("r") < 0.7) & many, "success"), F.when((F.col("m") < 60) & many, "confidence"), F.when(F.col("bad"), "parsing")
    ))
    return own.join(bad, "user_id").select("user_id", advice.alias("advice"))
