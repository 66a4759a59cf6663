"""Operators on micro-tables whose results follow from their definitions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quarrywork.functions import code as C
from quarrywork.functions import scalars as S
from quarrywork.operators import blocks, ensembles, graph, ranking, sets, text, usage, vectors
from quarrywork.sources import chunks, files, snapshots


def value(spark, column, row=(0,), schema="x int"):
    return spark.createDataFrame([row], schema).select(column.alias("v")).first().v


def test_contrast(spark):
    assert value(spark, S.contrast(F.lit("#000"), F.lit("#fff"))) == pytest.approx(21.0)
    assert value(spark, S.contrast(F.lit("#777"), F.lit("#fff"))) == pytest.approx(4.48, abs=0.01)
    assert value(spark, S.luminance(F.lit("#12345"))) == 0


def test_recency_and_strength(spark):
    for age, expected in ((None, 0.5), (0, 1.0), (3, 0.8), (10, 0.5), (45, 0.3), (120, 0.1)):
        assert float(value(spark, S.recency(F.lit(age).cast("int")))) == expected
    for n, expected in ((1, 0.208), (3, 0.416), (5, 0.538), (30, 0.95)):
        assert round(value(spark, S.co_edit_strength(F.lit(n))), 3) == expected


def test_head_and_tail(spark):
    assert value(spark, S.head_and_tail(F.lit("a" * 1400), 1400)) == "a" * 1400
    cut = value(spark, S.head_and_tail(F.lit("a" * 1000 + "b" * 1000), 1400))
    assert len(cut) == 1400 and cut[838:841] == "..." and cut.endswith("b" * 559)


def test_templates(spark):
    text_ = F.lit("{{b}} {{a}} {{b}}")
    assert value(spark, S.template_names(text_)) == ["b", "a"]
    assert value(spark, S.rendered(text_, {"a": F.lit("1"), "b": F.lit("2")})) == "2 1 2"


def edges(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "d"), ("c", "b"), ("e", "e"), ("a", "z")]
    return spark.createDataFrame(pairs, "src string, dst string")


def test_reachability_and_cycles(spark):
    seeds = spark.createDataFrame([("a",), ("d",)], "seed string")
    got = {(r.seed, r.node): r.depth for r in graph.reachable(edges(spark), seeds).collect()}
    assert got == {("a", "b"): 1, ("a", "z"): 1, ("a", "c"): 2, ("a", "d"): 3}
    assert sorted(tuple(r.path) for r in graph.cycles(edges(spark)).collect()) == [("b", "c"), ("e",)]
    degree = {r.node: (r.n_out, r.n_in) for r in graph.degrees(edges(spark)).collect()}
    assert degree["b"] == (1, 2) and degree["e"] == (1, 1)


def test_latency_ranks(spark):
    calls = spark.createDataFrame([("t", float(i)) for i in range(1, 21)], "tool string, ms double")
    r = usage.latency(calls, "tool", "ms").first()
    assert (r.median, r.p90, r.p95, r["mean"]) == (11, 19, 20, 10)


def test_pairs_of_tools(spark):
    at = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    calls = [("s", "a", at(1)), ("s", "b", at(2)), ("s", "b", at(2)), ("s", "a", at(2)), ("s", "b", at(3)), ("q", "a", at(9))]
    frame = spark.createDataFrame(calls, "session string, tool string, ts timestamp")
    got = {(r.tool, r.then): r.times for r in usage.followed_by(frame, "session", "tool", "ts", 1).collect()}
    assert got == {("a", "b"): 4, ("b", "a"): 0} or got == {("a", "b"): 4}


def test_changes_and_upserts(spark):
    now = spark.createDataFrame([("a", 5), ("b", 1), ("c", 2)], "path string, m int")
    before = spark.createDataFrame([("b", 1), ("c", 1), ("d", 1)], "path string, i int")
    got = {r.path: r.change for r in sets.changes(now, before, "path", F.col("m") > F.col("i")).collect()}
    assert got == {"a": "new", "b": "unchanged", "c": "modified", "d": "deleted"}
    stored = spark.createDataFrame([("a", 1, "old"), ("b", 9, "old")], "id string, at int, v string")
    new = spark.createDataFrame([("a", 1, "new"), ("b", 2, "new"), ("c", 1, "new")], "id string, at int, v string")
    assert {r.id: r.v for r in sets.upserted(stored, new, ["id"], "at").collect()} == {"a": "new", "b": "old", "c": "new"}


def test_table_upsert(spark, tmp_path):
    schema = "id string, context string, kind string, v int, indexed_at int"
    path = str(tmp_path / "elements")
    snapshots.create(spark, path, spark.createDataFrame([("1", "x", "f", 1, 1), ("2", "y", "f", 1, 1)], schema))
    incoming = spark.createDataFrame([("1", "x", "f", 2, 2), ("3", "x", "f", 1, 2)], schema)
    snapshots.upsert(spark, path, incoming)
    assert {r.id: r.v for r in snapshots.read(spark, path).collect()} == {"1": 2, "2": 1, "3": 1}


def test_sections(spark):
    docs = spark.createDataFrame([(1, "# A\ntext\n## B\nx\n# C\n"), (2, "no header")], "id int, body string")
    got = [(r.pos, r.level, r.title, r.end_pos) for r in files.sections(docs, "id", "body").orderBy("pos").collect()]
    assert got == [(1, 1, "A", 4), (3, 2, "B", 4), (5, 1, "C", 6)]


def test_files(spark, tmp_path):
    for name in ("a.py", "bin/b.py", "c.min.js", "d.log", "deep/e.MD", "deep/f.md", "vendor/g.cs", "h.razor.cs", "yarn.lock", "i.json", "Dockerfile"):
        target = tmp_path / "src" / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text("x = 1")
    got = {r.path.rsplit("/", 1)[1]: r.content for r in files.scan(spark, str(tmp_path / "src")).collect()}
    assert got == dict.fromkeys(("a.py", "f.md", "i.json", "Dockerfile"), "x = 1")
    top = files.scan(spark, str(tmp_path / "src"), recursive=False)
    assert {r.path.rsplit("/", 1)[1] for r in top.select("path").collect()} == {"a.py", "i.json", "Dockerfile"}


def test_lines_of_long_texts(spark):
    text_ = "\n".join("x" * (i % 37) for i in range(3000))
    docs = spark.createDataFrame([(1, text_), (2, ""), (3, None), (4, "\n")], "id int, body string")
    got = {}
    for r in chunks.lines(docs, "id", "body").collect():
        got.setdefault(r.id, []).append((r.pos, r.start, r.line))
    assert sorted(got) == [1, 2, 4]
    for pos, start, line in got[1]:
        assert text_[start : start + len(line)] == line == "x" * ((pos - 1) % 37)
    assert sorted(got[4]) == [(1, 0, ""), (2, 1, "")]


def test_markdown_of_odd_texts(spark):
    texts = ["+++\ntitle = \"A b\"\n+++\nplain", "", None, "x" * 3000, "```\na\n```\n# H"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, body string")
    got = {(r.id, r.chunk): (r.name, r.value) for r in files.markdown(docs, "id", "body").collect()}
    assert got[(0, "front_matter")] == ("title", "A b") and got[(0, "full_content")] == ("Content", "plain")
    assert got[(3, "full_content")][1] == "x" * 2000 + "..." and got[(4, "code")] == ("text", "a\n") and got[(4, "section")] == ("H", "1 4")
    assert {i for i, _ in got} == {0, 3, 4}


def test_json_chunks(spark):
    deep = '{"a": {"b": {"c": {"d": {"e": "far too deep"}}}}, "s": "12345", "t": "123456", "short": {"x": 1}, "l": [1, {"x": "long enough"}], "n": null}'
    many = "[" + ",".join('{"items": %d}' % i for i in range(101)) + ', [1], "text of some length"]'
    rows = [(1, deep), (2, "{bad"), (3, None), (4, many), (5, '{"long": ["%s"]}' % ("y" * 3000)), (6, "17"), (7, "{}"), (8, "")]
    got = {(r.id, r.path): (r.type, r.depth, r.content) for r in chunks.json_entries(spark.createDataFrame(rows, "id int, body string"), "id", "body").collect()}
    assert got[(1, "t")] == ("value", 0, "t: 123456") and (1, "s") not in got and (1, "short") not in got and (1, "n") not in got
    assert got[(1, "a.b.c.d")] == ("object", 3, '{"e":"far too deep"}') and (1, "a.b.c.d.e") not in got
    assert got[(1, "l")] == ("array", 0, '[1,{"x":"long enough"}]') and (1, "l[1]") not in got
    assert got[(2, "")] == ("parse_error", 0, "{bad") and {k for k in got if k[0] in (3, 6, 7)} == set()
    assert sorted(k[1] for k in got if k[0] == 4) == sorted(f"[{i}]" for i in range(100))
    assert got[(5, "long")][2] == '["' + "y" * 1998 + "..."


def test_near_names_of_any_length(spark):
    import random

    rng = random.Random(3)
    names = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(0, 7))) for _ in range(60)} | {"", "abcd"})
    frame = spark.createDataFrame([(n,) for n in names] * 2 + [(None,)], "name string")
    got = {(r.a, r.b): r.edits for r in text.near_names(frame, "name").collect()}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
        return row[-1]

    assert got == {(a, b): distance(a, b) for a in names for b in names if a < b and distance(a, b) <= 2}


def test_similarities_by_blocks(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    rows = [(i, i % 3, [float(x) for x in rng.normal(size=4)]) for i in range(90)] + [(90, 0, [0.0] * 4), (91, 0, None)]
    frame = spark.createDataFrame(rows, "id int, label int, v array<double>")
    found = vectors.similarities(frame.filter("id % 10 = 0"), frame, "id", "v", "label", least=0.5, block=(3, 7)).collect()
    got = {(r.query, r.id): r.score for r in found}
    assert len(found) == len(got)
    for a, _, x in rows[:90]:
        for b, _, y in rows[:90]:
            score = float(np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y))
            if a % 10 == 0 and a != b and abs(score - 0.5) > 1e-9:
                assert ((a, b) in got) == (score >= 0.5) and got.get((a, b), score) == pytest.approx(score)
    assert vectors.similarities(frame.limit(0), frame, "id", "v").count() == 0
    named = frame.selectExpr("string(id) AS id", "string(label) AS label", "v").filter("id < 5")
    assert vectors.similarities(named.filter("id = '1'"), named, "id", "v", "label", block=(1, 1)).count() == 4


def test_reachability_to_the_end(spark):
    chain = [(i, i + 1) for i in range(25)] + [(25, 20)]
    frame = spark.createDataFrame(chain, "src int, dst int")
    got = {r.node: r.depth for r in graph.reachable(frame, spark.createDataFrame([(0,)], "seed int")).collect()}
    assert got == {i: i for i in range(1, 26)}
    assert graph.reachable(frame, spark.createDataFrame([(99,)], "seed int")).count() == 0
    assert graph.reachable(frame, spark.createDataFrame([(0,)], "seed int"), 2).count() == 2


def test_latency_equals_sorted_values(spark):
    import random

    rng = random.Random(2)
    calls = [("a", float(rng.randrange(300))) for _ in range(2000)] + [("b", 5.0)] * 40 + [(None, 1.0), ("c", 3.0)]
    got = {r.tool: r for r in usage.latency(spark.createDataFrame(calls, "tool string, ms double"), "tool", "ms").collect()}
    for tool in ("a", "b", "c", None):
        own = sorted(ms for t, ms in calls if t == tool)
        r = got[tool]
        assert (r.n, r.least, r.most) == (len(own), own[0], own[-1])
        assert [r.median, r.p90, r.p95] == [own[int(len(own) * q)] for q in (0.5, 0.9, 0.95)]


def test_queries_by_strategy(spark):
    for asked, expected in (
        ("authentication flow", "pattern-search"), ("classes that implement IRepo", "graph-first"), ("relationship of orders", "hybrid"),
        ("who calls it", "graph-first"), ("explain the domain", "semantic-first"),
    ):
        assert value(spark, C.strategy(F.lit(asked))) == expected


def test_method_scores(spark):
    names = ("cyclomatic_", "cognitive_", "loc", "nesting", "params", "calls")
    flags = ("unhandled", "logs", "asynchronous", "throws")
    base = dict.fromkeys(names, 0) | dict.fromkeys(flags, False)
    for change, expected in (
        ({}, 100), ({"cyclomatic_": 7}, 100), ({"cyclomatic_": 8}, 90), ({"cyclomatic_": 11}, 80), ({"cyclomatic_": 16}, 70), ({"cognitive_": 11}, 85),
        ({"cognitive_": 16}, 75), ({"loc": 51}, 85), ({"loc": 101}, 75), ({"nesting": 4}, 90), ({"nesting": 5}, 80), ({"params": 6}, 85), ({"calls": 6}, 90),
        ({"unhandled": True}, 80), ({"logs": True}, 100), ({"logs": True, "loc": 21}, 105), ({"asynchronous": True, "throws": True}, 105),
    ):
        row = base | change
        assert value(spark, C.method_score(**{k: F.lit(v) for k, v in row.items()})) == expected, change


def test_python_figures(spark):
    source = "async def f(a):\n    if a and b:\n        for x in y:\n            await g(x)\n    elif c:\n        pass\n\n    while d: x = 1 if e else 2\n"
    assert value(spark, C.cyclomatic(F.lit(source))) == 1 + 1 + 1 + 1 + 1 + 1 + 1
    assert value(spark, C.cognitive(F.lit(source))) == 2 + 3 + 3 + 3
    assert value(spark, C.is_async(F.lit(source))) and not value(spark, C.handles_errors(F.lit(source)))
    assert value(spark, C.assertions(F.lit("assert x\nself.assertTrue(y)\nz = 1\nExpect(x).Should.be()"))) == 3


def test_intents(spark):
    r = value(spark, C.intent(F.lit("Secure the Flutter app with AI for a bank")))
    assert (r.project_type, r.goal, r.technologies, r.domain) == ("MobileApp", "Security", ["Flutter", "AI"], "fintech")
    assert r.categories == ["Security", "Validation", "ComponentModel", "StateManagement"]
    r = value(spark, C.intent(F.lit("hello")))
    assert (r.project_type, r.goal, r.technologies, r.domain, r.categories) == (None, "NewFeature", [], None, [])


def test_groups_of_alike_blocks(spark):
    """Against one pass over the blocks in order."""
    import random

    rng = random.Random(7)
    words = [f"w{i}" for i in range(14)]
    rows = []
    for i in range(70):
        text_ = " ".join(rng.sample(words, 8) if rng.random() < 0.6 else words[:8])
        rows.append((i, "0.0", text_, rng.choice([1, 2, 4, 9, 10, 30, 35]), *[rng.random() < 0.3 for _ in range(4)]))
    frame = spark.createDataFrame(rows, "page int, pos string, content string, elements int, image boolean, button boolean, form boolean, price boolean")
    got = {r.page: r.group for r in blocks.groups(frame, "page").collect()}

    def alike(a, b):
        x, y = a[2].split(), b[2].split()
        checks = [abs(a[3] - b[3]) <= 2, *[p == q for p, q in zip(a[4:], b[4:])], len(set(x) & set(y)) > 0.6 * max(len(x), len(y))]
        return sum(checks) >= 5

    want = {}
    for a in rows:
        if a[0] not in want:
            want |= {b[0]: f"{a[0]}.0.0" for b in rows if b[0] not in want and (a is b or alike(a, b))}
    assert got == want and 5 < len(set(want.values())) < 40
    assert blocks.groups(frame.limit(0), "page").count() == 0


def test_blocks_of_a_page(spark):
    html = "\n".join(["x"] * 9 + ['<div class="a"><img><div id="q" class="b">'] + ["y"] * 9 + ['<div id="z">'])
    r = blocks.found(spark.createDataFrame([(1, html), (2, None)], "page int, html string"), "page", "html").collect()
    assert [(x.page, x.pos, x.elements, x.image, x.price) for x in r] == [(1, "9.0", 3, True, False), (1, "9.1", 3, True, False)]
    assert r[0].content == "\n".join(["x"] * 5 + ['<div class="a"><img><div id="q" class="b">'] + ["y"] * 5)


def test_ensembles(spark):
    rows = [(1, "a", 7.0, "m", "high"), (1, "b", 8.0, "m", "high"), (1, "c", 10.0, "n", "low"), (2, "a", 8.0, "m", "low"), (2, "b", 9.0, "m", "high")]
    votes = spark.createDataFrame(rows, "item int, model string, score double, message string, severity string")
    got = {r.item: r for r in ensembles.voted(votes, "item").collect()}
    assert (got[1].score, got[1].passed, got[1].issues, got[1].votes) == (8, True, ["m/high"], 3)
    assert (got[2].score, got[2].issues) == (8, [])
    asked = lambda i: ensembles.consulted(votes, "item", F.lit(i), 10, "model").groupBy("item").count().collect()
    assert {r.item: r["count"] for r in asked(1)} == {1: 1, 2: 1} and {r.item: r["count"] for r in asked(10)} == {1: 3, 2: 2}
    assert {r.item: r["count"] for r in asked(8)} == {1: 2, 2: 1}


def test_bm25_and_fusion(spark):
    docs = spark.createDataFrame([(1, "red fox"), (2, "red red"), (3, "blue"), (4, None)], "id int, body string")
    scores = {r.id: r.score for r in text.bm25(docs, "id", "body", ["red", "fox"]).collect()}
    assert set(scores) == {1, 2} and scores[1] > scores[2]
    a = spark.createDataFrame([(1, 0.4), (2, 0.8)], "k int, score double")
    b = spark.createDataFrame([(2, 0.4), (3, 0.2)], "k int, score double")
    merged = {r.k: r.score for r in ranking.fused(a, b, ["k"]).collect()}
    assert merged == {1: pytest.approx(0.4), 2: pytest.approx(0.6), 3: pytest.approx(0.2)}
