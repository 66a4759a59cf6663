import random

from quarrywork.sources import files, nesting


def paired(text):
    """(at, end) of each brace, by a stack."""
    found, open_ = {}, []
    for at, c in enumerate(text):
        if c == "{":
            open_.append(at)
            found[at] = None
        elif c == "}" and open_:
            found[open_.pop()] = at
    return found


def test_extents_equal_a_stack(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choices("{}a\n", k=rng.randint(0, 60))) for _ in range(60)] + ["{" * 700 + "}" * 600, "}" * 300 + "{}" * 400]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    rows = docs.selectExpr("id", "t").select("id", nesting.extents(nesting.marks(docs.t, "[{}]"), lambda m: m == "{").alias("e")).collect()
    for r in rows:
        assert {e.at: e.end for e in r.e} == paired(texts[r.id])
        assert all(e.line == texts[r.id][: e.at].count("\n") + 1 and e.inner == e.at + 1 for e in r.e)


PAGE = """@page "/x"
@section Top {
  <p>{ a }</p>
}
<nav id="menu"><NAV class='sub deep'>x</NAV></nav>
<Grid Items="a"><Cell /></Grid><Grid>
}
@code {
  void A() { if (x) { y(); } }
}
<div id="big">%s</div><h2>short</h2><h3>last</h3>
<style> .a { } </style><style> </style>
<p style="color: red; background: blue; border: 1px solid green; x"><p STYLE="color: red; background: blue; border: 1px solid green; y">
<form>never closed
@functions { int z;"""


def test_markup(spark):
    text = PAGE % ("z" * 1600)
    docs = spark.createDataFrame([(1, text, "k"), (2, None, "k"), (3, "", "k")], "id int, html string, name string")
    rows = nesting.markup(docs, "id", "html").collect()
    assert {r.id for r in rows} == {1}
    got = {(r.chunk, r.pos, r.name): r.value for r in rows}
    assert len(got) == len(rows)
    assert got.pop(("section", 2, "Top")) == "@section Top {\n  <p>{ a }</p>\n}"
    assert got.pop(("code", 8, "code")) == "@code {\n  void A() { if (x) { y(); } }\n}"
    assert got.pop(("functions", 15, "functions")) == "@functions {"
    assert got.pop(("html_section", 11, "big")) == ('<div id="big">' + "z" * 1600)[:1500]
    assert got.pop(("html_section", 11, "Section_2")).startswith("<h3>last")
    assert got.pop(("element", 5, "nav_menu")) == "<NAV class='sub deep'>x</NAV>"
    assert got.pop(("element", 5, "nav_sub")) == "x"
    assert got.pop(("style_tag", 12, "InlineStyles_1")) == ".a { }"
    assert got.pop(("inline_style", 13, "p_L13")) == "color: red; background: blue; border: 1px solid green; x"
    assert set(got) == {("component", 0, name) for name in ("Grid", "Cell", "NAV")}  # capitals are what tells a component


CONFIG = """# c
services:
  web:
    image: nginx:1.2   # c
    ports:
    - "80:80"
    - target: 90
      published: 91
    depends_on: [db, "cache"]
    command: |
      image: no

      - c
  db:
    image: 'pg'
    depends_on:
      cache:
        condition: ok
  cache:
    depends_on:
      - db
other: 1
"""


def test_services(spark):
    docs = spark.createDataFrame([(1, CONFIG), (2, None), (3, "")], "id int, t string")
    rows = nesting.services(docs, "id", "t").orderBy("pos", "value").collect()
    assert [tuple(r[1:]) for r in rows] == [
        ("service", 3, "web", ""), ("image", 4, "web", "nginx:1.2"), ("port", 6, "web", "80:80"), ("port", 7, "web", "90"), ("needs", 9, "web", "cache"),
        ("needs", 9, "web", "db"), ("service", 14, "db", ""), ("image", 15, "db", "pg"), ("needs", 17, "db", "cache"), ("service", 19, "cache", ""), ("needs", 21, "cache", "db"),
    ]


def nested(text):
    """Entries of an indented text without scalars, by a stack."""
    out, stack = [], []
    for line, row in enumerate(text.split("\n"), 1):
        if not row.strip():
            continue
        indent = len(row) - len(row.lstrip())
        name, value = (x.strip() for x in row.split(":"))
        while stack and stack[-1][0] >= indent:
            stack.pop()
        out.append((line, stack[-1][2] if stack else 0, [s[1] for s in stack], name, value))
        stack.append((indent, name, line))
    return out


def test_indented_equals_a_stack(spark):
    rng = random.Random(7)
    texts = ["\n".join(" " * rng.randint(0, 7) + f"k{rng.randint(0, 9)}: {rng.choice(['', 'v'])}" for _ in range(n)) for n in (1, 5, 40, 256, 257, 900)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    rows = nesting.entries(docs, "id", "t").collect()
    for i, text in enumerate(texts):
        assert sorted(tuple(r[1:]) for r in rows if r.id == i) == nested(text)


def test_long_files(spark):
    """Twenty thousand headers, brackets and entries are no trouble."""
    n = 20000
    texts = ["\n".join(f"{'#' * (i % 6 + 1)} h{i}" for i in range(n)), "@code {" + "{}\n" * n + "}", "\n".join(" " * (i % 9) + f"k{i}: v" for i in range(n))]
    docs = spark.createDataFrame([(1, *texts)], "id int, a string, b string, c string")
    heads = files.sections(docs, "id", "a")
    assert heads.count() == n and heads.filter("level = 1 AND end_pos - pos < 5").count() == 1  # the last, n not a multiple of six
    assert nesting.markup(docs, "id", "b").filter("chunk = 'code'").selectExpr("length(value)").first()[0] == len(texts[1])
    assert nesting.entries(docs, "id", "c").count() == n
