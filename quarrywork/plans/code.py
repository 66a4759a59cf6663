"""Queries, requests, code and style sheets told by their words and lines.

Where the tables hold no code, a row's columns are written out as a small source file, whose figures SQL works out
without reading it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import code as C
from ..functions import scalars as S
from ..session import table
from . import query


def _holds(column: str, words) -> str:
    return " OR ".join(f"contains(lower({column}), '{w}')" for w in words)


def _sum(column: str, words) -> str:
    return " + ".join(f"contains(lower({column}), '{w}')::INT" for w in words)


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _case(kinds, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {_holds('text', words)} THEN '{name}'" for name, words in kinds) + f" ELSE {default} END"


@query("X05", rf"""SELECT conv_id, turn, CASE WHEN {_holds("text", C.PATTERN_WORDS)} THEN 'pattern-search'
  WHEN n >= 2 OR (n >= 1 AND regexp_matches(text, '\b[A-Z][a-zA-Z0-9]+(?:\.[A-Z][a-zA-Z0-9]+)*\b')) THEN 'graph-first' WHEN n = 1 THEN 'hybrid' ELSE 'semantic-first' END AS strategy
  FROM (SELECT *, {_sum("text", C.RELATION_WORDS)} AS n FROM conversations)""")
def strategies(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", C.strategy(F.col("text")).alias("strategy"))


@query("X07", rf"""SELECT conv_id, turn, array_to_string(list_filter(regexp_split_to_array(lower(text), '[ ?.,!:;]+'),
  lambda w: length(w) > 2 AND NOT list_contains({_list(C.STOP_WORDS)}, w))[1:5], ' ') AS term FROM conversations""")
def search_terms(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", S.search_term(F.col("text"), C.STOP_WORDS).alias("term"))


@query("X13", """SELECT p_partkey, p_size % 7 + 2 + (p_size % 2 = 0)::INT + 2 * (p_size % 3 = 0)::INT AS complexity FROM part""")
def cyclomatic(spark, sf_dir):
    branches = F.repeat(F.lit("    if ready:\n        go()\n"), (F.col("p_size") % 7).cast("int"))
    joined = F.when(F.col("p_size") % 2 == 0, "    x = a and b or c\n").otherwise("")
    more = F.when(F.col("p_size") % 3 == 0, "    elif left:\n    except Error:\n").otherwise("    # andor\n")
    source = F.concat(F.lit("def f():\n    for x in y:\n"), branches, joined, more)
    return table(spark, sf_dir, "part").select("p_partkey", C.cyclomatic(source).alias("complexity"))


@query("X14", """SELECT p_partkey, k * (k + 3) // 2 + 1 + greatest(k - 1, 0) AS cognitive FROM (SELECT *, p_size % 8 AS k FROM part)""")
def cognitive(spark, sf_dir):
    """Branches in one another, and then one at the margin, which is one level less deep than the last."""
    k = (F.col("p_size") % 8).cast("int")
    line = lambda i: F.when(i > 0, F.concat(F.repeat(F.lit("    "), i), F.lit("if x:\n\n"))).otherwise("")
    nested = F.array_join(F.transform(F.sequence(F.lit(0), k), line), "")
    source = F.concat(F.lit("def f():\n"), nested, F.lit("for x in y:\n"))
    return table(spark, sf_dir, "part").select("p_partkey", C.cognitive(source).cast("long").alias("cognitive"))


@query("X17", """SELECT p_partkey, list_filter([CASE WHEN p_size > 40 THEN 'long_method' END, CASE WHEN p_size % 9 > 5 THEN 'too_many_parameters' END,
  CASE WHEN p_size % 13 > 10 THEN 'high_complexity' END, CASE WHEN p_size % 6 > 3 THEN 'deep_nesting' END,
  CASE WHEN p_size % 2 = 0 AND p_size % 4 <> 0 THEN 'async_without_error_handling' END], lambda x: x IS NOT NULL) AS smells FROM part""")
def smells(spark, sf_dir):
    size = F.col("p_size")
    source = F.concat(F.when(size % 2 == 0, "async def f():\n").otherwise("def f():\n"), F.when(size % 4 == 0, "    try:\n").otherwise("    # try:\n"))
    unhandled = C.is_async(source) & ~C.handles_errors(source)
    found = C.smells(size + 10, size % 9, size % 13, size % 6, unhandled)
    return table(spark, sf_dir, "part").select("p_partkey", found.alias("smells"))


@query("X18", """WITH m AS (SELECT p_partkey, p_partkey % 20 AS cc, p_partkey % 18 AS cog, p_partkey % 130 AS loc, p_size % 7 AS nest, p_size % 8 AS params, p_size % 9 AS db,
    p_size % 11 = 0 AS bad, p_size % 3 = 0 AS logs, p_size % 2 = 0 AS async, p_size % 5 = 0 AS throws FROM part),
  s AS (SELECT p_partkey, 100 - CASE WHEN cc > 15 THEN 30 WHEN cc > 10 THEN 20 WHEN cc > 7 THEN 10 ELSE 0 END - CASE WHEN cog > 15 THEN 25 WHEN cog > 10 THEN 15 ELSE 0 END
    - CASE WHEN loc > 100 THEN 25 WHEN loc > 50 THEN 15 ELSE 0 END - CASE WHEN nest > 4 THEN 20 WHEN nest > 3 THEN 10 ELSE 0 END - CASE WHEN params > 5 THEN 15 ELSE 0 END
    - CASE WHEN bad THEN 20 ELSE 0 END - CASE WHEN db > 5 THEN 10 ELSE 0 END + CASE WHEN logs AND loc > 20 THEN 5 ELSE 0 END + CASE WHEN async AND throws THEN 5 ELSE 0 END AS score FROM m)
  SELECT p_partkey, score, CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END AS grade FROM s""")
def grades(spark, sf_dir):
    key, size = F.col("p_partkey"), F.col("p_size")
    score = C.method_score(
        key % 20, key % 18, key % 130, size % 7, size % 8, size % 9, size % 11 == 0, size % 3 == 0, size % 2 == 0, size % 5 == 0
    )
    scored = table(spark, sf_dir, "part").select("p_partkey", score.cast("long").alias("score"))
    return scored.withColumn("grade", S.letter_grade(F.col("score")))


@query("X19", """SELECT p_partkey, p_size % 4 AS database_calls, p_size % 3 = 0 AS http, p_size % 2 = 0 AS logging, CASE WHEN p_size % 5 = 0 THEN ['Lost', 'Io.Late'] ELSE [] END AS throws,
  p_size % 7 = 0 AS public FROM part""")
def flags(spark, sf_dir):
    size = F.col("p_size")
    when = lambda k, code: F.when(size % k == 0, code).otherwise("")
    calls = F.repeat(F.lit("  await db.SaveChangesAsync(); "), (size % 4).cast("int"))
    source = F.concat(
        F.when(size % 7 == 0, "public ").otherwise("private "), F.lit("void F() {\n"), calls, when(3, "http.GetAsync(u);"), when(2, "_logger.LogError(e);"),
        when(5, "throw new Lost(); throw new Io.Late(); throw new Lost();"), F.lit("}"))
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        C.database_calls(source).cast("long").alias("database_calls"),
        C.holds_any(source, C.HTTP_CALLS).alias("http"),
        C.holds_any(source, C.LOGGING).alias("logging"),
        C.thrown(source).alias("throws"),
        source.rlike(r"\bpublic\b").alias("public"),
    )


@query("X21", r"""WITH l AS (SELECT page_id, generate_subscripts(x, 1)::INT AS line, lower(unnest(x)) AS t FROM (SELECT page_id, string_split(html, chr(10)) AS x FROM pages))
  SELECT page_id, line, unnest(list_distinct(regexp_extract_all(t, '#[0-9a-f]{6}\b|#[0-9a-f]{3}\b|rgba?\([^)]*\)'))) AS color FROM l""")
def hard_colors(spark, sf_dir):
    return S.colors_by_line(table(spark, sf_dir, "pages"), "page_id", "html")


@query("X27", """SELECT doc_id, lang AS module, CASE WHEN lang IN ('en', 'de') THEN 'standard' ELSE 'unknown' END AS kind FROM documents UNION ALL SELECT doc_id, '.' || source, 'local' FROM documents
  UNION ALL SELECT doc_id, source || '.part', CASE WHEN source IN ('src1', 'src2') THEN 'project' WHEN source IN ('src2', 'src3') THEN 'third-party' ELSE 'unknown' END FROM documents""")
def imports(spark, sf_dir):
    head = F.concat(F.lit("import "), "lang", F.lit("\nfrom ."), "source", F.lit(" import x\nfrom "), "source", F.lit(".part import y\nimport "), "lang", F.lit("\n"))
    found = C.classified_imports(S.imports(F.concat(head, F.coalesce("text", F.lit("")))), ("en", "de"), ("src2", "src3"), ("src1", "src2"))
    return table(spark, sf_dir, "documents").select("doc_id", F.inline(found))


@query("X33", f"""WITH c AS (SELECT item_id, text || ' ' || CASE item_id % 8 WHEN 0 THEN 'a Flutter app' WHEN 1 THEN 'secure endpoint' WHEN 2 THEN 'fast llm' WHEN 3 THEN 'clean c#'
    WHEN 4 THEN 'migrate the SHOP' WHEN 5 THEN 'testing the bank' WHEN 6 THEN 'medical web' ELSE 'python' END AS text FROM benchmark),
  k AS (SELECT *, {_case(C.PROJECT_TYPES, "NULL")} AS project_type, {_case(C.GOALS, "'NewFeature'")} AS goal, {_case(C.TRADES, "NULL")} AS domain FROM c)
  SELECT item_id, project_type, goal, domain, list_filter([{", ".join(f"CASE WHEN {_holds('text', w)} THEN '{n}' END" for n, w in C.TECHNOLOGIES)}], lambda x: x IS NOT NULL) AS technologies,
    list_distinct(list_concat(CASE goal {" ".join(f"WHEN '{k}' THEN {_list(v)}" for k, v in C.GOAL_CATEGORIES.items())} ELSE [] END,
      CASE project_type {" ".join(f"WHEN '{k}' THEN {_list(v)}" for k, v in C.TYPE_CATEGORIES.items())} ELSE [] END)).list_sort() AS categories FROM k""")
def intents(spark, sf_dir):
    asks = ("a Flutter app", "secure endpoint", "fast llm", "clean c#", "migrate the SHOP", "testing the bank", "medical web")
    more = S.mapped(F.col("item_id") % 8, dict(enumerate(asks)), "python")
    told = table(spark, sf_dir, "benchmark").select("item_id", C.intent(F.concat_ws(" ", "text", more)).alias("i")).select("item_id", "i.*")
    return told.withColumn("categories", F.array_sort("categories"))


_STYLED = """(SELECT page_id, html || CASE WHEN page_id % 3 = 0 THEN '<b style="color: red; a:b">' || '<i class="x" style="float: left">' ELSE '' END || CASE WHEN page_id % 5 = 0 THEN '@media x' ELSE '' END
  || CASE WHEN page_id % 4 = 0 THEN 'var(--x)' ELSE '' END || CASE WHEN page_id % 7 = 0 THEN 'a:focus {-moz-x: 1}' ELSE '' END AS t FROM pages)"""


def _styled(spark, sf_dir):
    key = F.col("page_id")
    when = lambda k, part: F.when(key % k == 0, part).otherwise("")
    parts = when(3, '<b style="color: red; a:b"><i class="x" style="float: left">'), when(5, "@media x"), when(4, "var(--x)"), when(7, "a:focus {-moz-x: 1}")
    return table(spark, sf_dir, "pages").select("page_id", F.concat("html", *parts).alias("t"))


_ISSUES = f"""SELECT page_id, len(regexp_extract_all(t, 'style="[^"]+"'))::INT AS inline_styles, NOT contains(t, 'var(--') AND NOT contains(t, ':root') AS no_variables,
  contains(t, 'float:') AND NOT regexp_matches(t, 'display: ?(grid|flex)') AS float_layout, NOT contains(t, '@media') AS no_responsive, NOT contains(t, ':focus') AS no_focus,
  contains(t, '-webkit-') OR contains(t, '-moz-') AS prefixes FROM {_STYLED}"""


@query("X47", _ISSUES)
def style_issues(spark, sf_dir):
    return _styled(spark, sf_dir).select("page_id", C.style_issues(F.col("t")).alias("i")).select("page_id", "i.*")


@query("X40", f"""SELECT page_id, greatest(0, least(100, 100 - 1.5 * inline_styles - 5 * ((inline_styles > 0)::INT + no_variables::INT + float_layout::INT + no_responsive::INT + no_focus::INT + prefixes::INT)
    + 10 * (NOT no_variables)::INT + 10 * (NOT no_responsive)::INT))::DOUBLE AS score, CASE WHEN page_id % 3 = 0 THEN ['b: a=b, color=red', 'i: float=left'] ELSE [] END AS styles FROM ({_ISSUES})""")
def style_scores(spark, sf_dir):
    """A page's score, and its elements' own styles written out in order of their names."""
    t = F.col("t")
    pairs = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat_ws("=", e["key"], e["value"])), ", ")
    styles = F.transform(C.inline_styles(t), lambda x: F.concat_ws(": ", x["element"], pairs(x["styles"])))
    return _styled(spark, sf_dir).select("page_id", C.style_score(C.style_issues(t)).alias("score"), styles.alias("styles"))


@query("X41", """SELECT c_custkey, ('0x' || substr(md5(c_custkey::VARCHAR), 1, 8))::BIGINT % 100 < 30 AS test FROM customer""")
def ab_buckets(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", S.bucket(F.col("c_custkey"), 30).alias("test"))


@query("X43", f"""WITH n AS (SELECT p_partkey, {_list([*C.RELATED, "cobol", "Python"])}[p_partkey % {len(C.RELATED) + 2} + 1] AS language FROM part)
  SELECT p_partkey, CASE lower(language) {" ".join(f"WHEN '{k}' THEN {_list(v)}" for k, v in C.RELATED.items())} ELSE [] END AS related FROM n""")
def related(spark, sf_dir):
    names = F.array(*map(F.lit, [*C.RELATED, "cobol", "Python"]))
    language = F.element_at(names, (F.col("p_partkey") % (len(C.RELATED) + 2) + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", C.related_languages(language).alias("related"))


@query("X44", """SELECT doc_id, list_filter([lang, source], lambda x: x IS NOT NULL) AS names FROM documents""")
def template_names(spark, sf_dir):
    written = lambda c: F.coalesce(F.concat(F.lit("{{"), c, F.lit("}} ")), F.lit(""))
    text = F.concat(written("lang"), written("source"), F.coalesce("text", F.lit("")), written("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", S.template_names(text).alias("names"))


@query("X50", """SELECT p_partkey, p_size % 3 = 0 OR p_size % 4 = 0 AS is_test, CASE WHEN p_size % 4 = 0 OR p_size % 5 = 0 THEN 'pytest' WHEN p_size % 7 = 0 THEN 'unittest' ELSE 'unknown' END AS framework,
  p_size % 2 = 0 AS async, p_size % 6 + 1 AS assertions FROM part""")
def tests(spark, sf_dir):
    size = F.col("p_size")
    name = F.when(size % 3 == 0, "test_it").otherwise("it_test_")
    decorators = F.when(size % 4 == 0, F.array(F.lit("@pytest.mark.slow"))).otherwise(F.array().cast("array<string>"))
    used = F.when(size % 5 == 0, F.array(F.lit("pytest"))).when(size % 7 == 0, F.array(F.lit("unittest.mock"))).otherwise(F.array(F.lit("os")))
    lines = F.repeat(F.lit("    assert x\n    y = 1\n"), (size % 6).cast("int"))
    source = F.concat(F.when(size % 2 == 0, "async def f():\n").otherwise("def f():\n"), lines, F.lit("    x.should.be()\n"))
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        C.is_test(name, decorators).alias("is_test"),
        C.test_framework(decorators, used).alias("framework"),
        C.is_async(source).alias("async"),
        C.assertions(source).cast("long").alias("assertions"),
    )


_DOM = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS name, {_sum('text', words)} AS n FROM documents" for k, words in C.DOMAINS.items())


@query("X08", f"SELECT doc_id, name, round(least(1.0, 0.2 * n), 2)::DOUBLE AS confidence FROM ({_DOM}) WHERE n > 0")
def domains(spark, sf_dir):
    from ..operators.text import detected

    found = detected(table(spark, sf_dir, "documents"), "doc_id", "text", C.DOMAINS)
    return found.select("doc_id", "name", F.round("confidence", 2).cast("double").alias("confidence"))


@query("X48", """SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN ['Sys', 'App', 'Foo', 'IBar', 'Task'] ELSE ['Sys', 'Task'] END AS words FROM part""")
def detection_words(spark, sf_dir):
    whole = "using Sys;\nnamespace App;\nclass Foo\ninterface IBar\nasync Task F() { await Run(); }"
    example = F.when(F.col("p_size") % 2 == 0, whole).otherwise("using Sys;\nasync Task F()")
    keywords = ("using", "namespace", "class", "interface", "async", "await")
    return table(spark, sf_dir, "part").select("p_partkey", S.words_after(example, keywords, 5).alias("words"))
