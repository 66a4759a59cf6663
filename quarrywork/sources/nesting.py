"""What nests in a text: brackets, elements, indented entries. Built-in functions only, and all of it within the row:
marks and their running depths are arrays, so neither texts nor marks move, and the work grows with a text's length (a
sort of its marks apart)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import let
from .chunks import starts

# What counts in markup, and how much of it is kept.
SEMANTIC = ("form", "table", "nav", "header", "footer", "aside", "main", "section", "article")
CODE = r"@section\s+\w+\s*\{|@code\s*\{|@functions\s*\{"
HTML_SECTION = r'<(?:h[1-3]|div[^>]*id\s*=\s*"[^"]+")'
COMPONENT = r"<([A-Z][a-zA-Z0-9]*)[^>]*>"
STYLE_TAG = r"(?is)<style[^>]*>.*?</style>"
INLINE_STYLE = r'(?i)style\s*=\s*"[^"]{50,}"'
SHORTEST_SECTION, LONGEST_SECTION, LONGEST_ELEMENT = 100, 1500, 1000

#: Lines that a fold takes at once; their square is what it moves.
_AT_ONCE = 256


def marks(text: Column, pattern: str) -> Column:
    """(at, line, mark) of each match, in order: its character offset from 0, its line from 1, what matched."""
    breaks = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))
    parts = F.arrays_zip(F.split(text, pattern).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("mark"))
    sized = F.transform(
        F.filter(parts, lambda p: p["mark"].isNotNull()),
        lambda p: F.struct(
            p["mark"].alias("mark"), F.length(p["gap"]).cast("long").alias("gap"), breaks(p["gap"]).cast("long").alias("lines"),
            (F.length(p["gap"]) + F.length(p["mark"])).cast("long").alias("all"),
            (breaks(p["gap"]) + breaks(p["mark"])).cast("long").alias("all_lines")),
    )

    def placed(s: Column) -> Column:
        before = F.zip_with(
            starts(F.transform(s, lambda p: p["all"])), starts(F.transform(s, lambda p: p["all_lines"])),
            lambda at, line: F.struct(at.alias("at"), line.alias("line")))
        return F.zip_with(
            s, before, lambda p, b: F.struct((b["at"] + p["gap"]).alias("at"), (b["line"] + p["lines"] + 1).alias("line"), p["mark"].alias("mark"))
        )

    return F.coalesce(let(sized, placed), F.array().cast("array<struct<at: bigint, line: bigint, mark: string>>"))


def extents(found: Column, opens) -> Column:
    """(at, line, mark, inner, end) of each opening among marks that open or close: where its inside begins and where its
    own closing mark begins. An opening that nothing closes has a null end, and a stray closing closes nothing.

    At one depth openings and closings alternate, so the closing is the next mark of the opening's depth.
    """

    def leveled(m: Column) -> Column:
        depth = starts(F.transform(m, lambda x: F.when(opens(x["mark"]), 1).otherwise(-1).cast("long")))
        return F.array_sort(
            F.zip_with(
                m, depth,
                lambda x, d: F.struct(
                    F.when(opens(x["mark"]), d + 1).otherwise(d).alias("level"), x["at"].alias("at"), x["line"].alias("line"),
                    x["mark"].alias("mark"), opens(x["mark"]).alias("open")),
            )
        )

    def closed(s: Column) -> Column:
        def one(x: Column, after: Column) -> Column:
            end = F.when((after["level"] == x["level"]) & ~after["open"], after["at"])
            return F.when(
                x["open"],
                F.struct(x["at"].alias("at"), x["line"].alias("line"), x["mark"].alias("mark"), (x["at"] + F.length(x["mark"])).alias("inner"), end.alias("end")),
            )

        pairs = F.zip_with(s, F.slice(s, F.lit(2), F.greatest(F.size(s) - 1, F.lit(0))), one)
        return F.array_sort(F.filter(pairs, lambda x: x.isNotNull()))

    none = F.array().cast("array<struct<at: bigint, line: bigint, mark: string, inner: bigint, end: bigint>>")
    return let(found, lambda m: F.when(F.size(m) > 0, let(leveled(m), closed)).otherwise(none))


def _row(chunk: str, line: Column, name: Column, value: Column) -> Column:
    return F.struct(F.lit(chunk).alias("chunk"), line.cast("int").alias("pos"), name.alias("name"), value.alias("value"))


def _cut(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("..."))).otherwise(text)


def _between(text: Column, first: Column, after: Column) -> Column:
    return F.substring(text, (first + 1).cast("int"), (after - first).cast("int"))


def code_blocks(text: Column) -> Column:
    """Named sections, code and function blocks of a page, each from its mark to its own closing bracket, whatever brackets
    lie inside; one that isn't closed is its opening only."""
    found = extents(marks(text, rf"{CODE}|[{{}}]"), lambda m: m.endswith("{"))
    kind = lambda m: F.regexp_extract(m, r"^@(\w+)", 1)

    def row(x: Column) -> Column:
        name = F.when(kind(x["mark"]) == "section", F.regexp_extract(x["mark"], r"^@section\s+(\w+)", 1)).otherwise(kind(x["mark"]))
        return F.struct(
            kind(x["mark"]).alias("chunk"), x["line"].cast("int").alias("pos"), name.alias("name"),
            _between(text, x["at"], F.coalesce(x["end"] + 1, x["inner"])).alias("value"))

    return F.transform(F.filter(found, lambda x: x["mark"].startswith("@")), row)


def elements(text: Column, tag: str) -> Column:
    """The elements of a tag with all that lies in them, nested ones too, named by id, else first class, else number; one
    that isn't closed is none."""
    found = extents(marks(text, rf"(?is)<{tag}\b[^>]*>|</{tag}\s*>"), lambda m: ~m.startswith("</"))
    attribute = lambda m, name: F.regexp_extract(m, rf"(?i)\b{name}\s*=\s*[\"']([^\"']+)[\"']", 1)

    def row(x: Column, i: Column) -> Column:
        named, styled = attribute(x["mark"], "id"), F.substring_index(attribute(x["mark"], "class"), " ", 1)
        name = F.when(named != "", named).when(styled != "", styled).otherwise(F.concat(F.lit(tag), (i + 1).cast("string")))
        inside = F.regexp_replace(_between(text, x["inner"], x["end"]), r"(?s)^\s+|\s+$", "")
        return _row("element", x["line"], F.concat(F.lit(tag + "_"), name), _cut(inside, LONGEST_ELEMENT))

    return F.transform(F.filter(found, lambda x: x["end"].isNotNull()), row)


def html_sections(text: Column) -> Column:
    """From each heading of the first three levels or named div to the next one; short ones count but aren't kept."""

    def rows(s: Column) -> Column:
        def row(x: Column, after: Column) -> Column:
            own = F.regexp_extract(x["mark"], r'id\s*=\s*"([^"]+)"', 1)
            name = F.when(own != "", own).otherwise(F.concat(F.lit("Section_"), x["i"].cast("string")))
            end = F.coalesce(after["at"], F.length(text).cast("long"))
            value = F.left(_between(text, x["at"], end), F.lit(LONGEST_SECTION))
            return F.when(end - x["at"] >= SHORTEST_SECTION, _row("html_section", x["line"], name, value))

        numbered = F.transform(s, lambda x, i: F.struct(i.alias("i"), x["at"].alias("at"), x["line"].alias("line"), x["mark"].alias("mark")))
        return F.array_compact(F.zip_with(numbered, F.slice(s, F.lit(2), F.greatest(F.size(s) - 1, F.lit(0))), row))

    return let(marks(text, HTML_SECTION), rows)


def styles(text: Column) -> Column:
    """Style elements that aren't empty, numbered, and style attributes of at least 50 characters with their element; of
    several of an element's kind on one line the first."""
    tags = F.filter(
        F.transform(marks(text, STYLE_TAG), lambda x: F.struct(x["line"].alias("line"), F.trim(F.regexp_extract(x["mark"], r"(?is)^<style[^>]*>\s*(.*?)\s*</style>$", 1)).alias("css"))),
        lambda x: x["css"] != "",
    )
    tags = F.transform(tags, lambda x, i: _row("style_tag", x["line"], F.concat(F.lit("InlineStyles_"), (i + 1).cast("string")), x["css"]))

    def attribute(x: Column) -> Column:
        near = F.substring(text, (F.greatest(x["at"] - 100, F.lit(0)) + 1).cast("int"), F.lit(150))
        element = F.regexp_extract(near, r"(?i)<(\w+)[^>]*style\s*=", 1)
        name = F.concat(F.when(element == "", "unknown").otherwise(element), F.lit("_L"), x["line"].cast("string"))
        return F.struct(name.alias("name"), x["at"].alias("at"), x["line"].alias("line"), F.trim(F.regexp_extract(x["mark"], r'"([^"]*)"', 1)).alias("css"))

    def first(s: Column) -> Column:
        def row(x: Column, before: Column) -> Column:
            return F.when(before.isNull() | (before["name"] != x["name"]), _row("inline_style", x["line"], x["name"], x["css"]))

        shifted = F.slice(F.array_prepend(s, F.lit(None)), F.lit(1), F.size(s))
        return F.array_compact(F.zip_with(s, shifted, row))

    return F.concat(tags, let(F.array_sort(F.transform(marks(text, INLINE_STYLE), attribute)), first))


def components(text: Column) -> Column:
    """The components that a page uses, each once."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(COMPONENT), F.lit(1)))
    return F.transform(found, lambda x: _row("component", F.lit(0), x, F.lit("")))


def markup(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, chunk, pos, name, value): code and function blocks, named and HTML sections, semantic elements, component
    usages, style elements and long style attributes of each page; ``pos`` is the line, 0 for usages. A null page has none."""
    every = lambda t: F.concat(code_blocks(t), html_sections(t), *[elements(t, tag) for tag in SEMANTIC], components(t), styles(t))
    return pages.filter(F.col(html).isNotNull()).select(key, F.inline(let(F.col(html), every)))


# --- Indented entries -------------------------------------------------------------------------------------

_ENTRY = r"""^("[^"]*"|'[^']*'|[^\s:#\-][^:#]*?)\s*:(?:\s+(.*))?$"""
_FRAME = "array<struct<width: int, name: string, line: int>>"
_FOUND = "array<struct<line: int, parent: int, path: array<string>, name: string, value: string>>"


def _read(line: Column, i: Column) -> Column:
    """A line's own parts. Widths are twice the indentation, and a dash's is one more: a list may stand at its key's."""
    indent = F.length(F.regexp_extract(line, "^ *", 0))
    dash = F.regexp_extract(line, r"^ *(-(?: +|$))", 1)
    rest = F.trim(F.regexp_replace(F.regexp_replace(line, r"^ *-(?: +|$)", ""), r"(?:^|\s)#.*$", ""))
    bare = lambda x: F.regexp_replace(x, r"""^(["'])(.*)\1$""", "$2")
    name = F.regexp_extract(rest, _ENTRY, 1)
    value = F.when(name != "", F.regexp_extract(rest, _ENTRY, 2)).otherwise(rest)
    return F.struct(
        (i + 1).alias("line"), indent.alias("indent"), (dash != "").alias("dash"), bare(name).alias("name"), bare(F.trim(value)).alias("value"),
        F.when(dash != "", 2 * indent + 1).otherwise(2 * indent).alias("width"), (2 * (indent + F.length(dash))).alias("inner"),
        ((rest == "") & (dash == "") | rest.rlike(r"^(---|\.\.\.)$")).alias("blank"))


def indented(text: Column) -> Column:
    """(line, parent, path, name, value) of each entry ``name: value`` and each list item (named ``-``) of an indented text:
    the names of all entries around it, and the line of the nearest, 0 for none. Comments, blank lines and the lines of
    block scalars are none; a text that isn't indented entries gives those lines that look like them.

    One fold whose state is the open entries and the block scalar's indentation. Lines are folded in runs, so that
    what is copied grows with the text and not with its square.
    """

    def step(state: Column, x: Column) -> Column:
        hidden = x["blank"] | ((state["skip"] >= 0) & (x["indent"] > state["skip"]))
        around = F.filter(state["stack"], lambda s: s["width"] < x["width"])
        named = x["name"] != ""
        frame = lambda width, name: F.struct(width.alias("width"), name.alias("name"), x["line"].alias("line"))
        none = F.array().cast(_FRAME)
        item = F.when(x["dash"], F.array(frame(x["width"], F.lit("-")))).otherwise(none)
        own = F.when(named, F.array(frame(F.when(x["dash"], x["inner"]).otherwise(x["width"]), x["name"]))).otherwise(none)
        path = F.concat(F.transform(around, lambda s: s["name"]), F.when(x["dash"] & named, F.array(F.lit("-"))).otherwise(F.array().cast("array<string>")))
        entry = F.struct(
            x["line"].alias("line"), F.coalesce(F.try_element_at(around, F.lit(-1))["line"], F.lit(0)).alias("parent"), path.alias("path"),
            F.when(named, x["name"]).otherwise("-").alias("name"), x["value"].alias("value"))
        scalar = F.when(x["value"].rlike(r"^[|>][-+0-9]*$"), x["indent"]).otherwise(-1)
        return F.struct(
            F.when(hidden, state["stack"]).otherwise(F.concat(around, item, own)).cast(_FRAME).alias("stack"),
            F.when(hidden, state["skip"]).otherwise(scalar).cast("int").alias("skip"),
            F.when(~hidden & (x["dash"] | named), F.array_append(state["out"], entry)).otherwise(state["out"]).cast(_FOUND).alias("out"))

    def run(state: Column, lines: Column) -> Column:
        begun = F.struct(state["stack"].alias("stack"), state["skip"].alias("skip"), F.array().cast(_FOUND).alias("out"))
        return let(
            F.aggregate(lines, begun, step),
            lambda s: F.struct(s["stack"].alias("stack"), s["skip"].alias("skip"), F.array_append(state["out"], s["out"]).cast(f"array<{_FOUND}>").alias("out")),
        )

    lines = F.transform(F.split(text, r"\r?\n"), _read)
    runs = let(lines, lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / _AT_ONCE).cast("int")), lambda b: F.slice(x, b * _AT_ONCE + 1, F.lit(_AT_ONCE))))
    start = F.struct(F.array().cast(_FRAME).alias("stack"), F.lit(-1).alias("skip"), F.array().cast(f"array<{_FOUND}>").alias("out"))
    return F.aggregate(runs, start, run, lambda s: F.flatten(s["out"]))


def entries(files: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, parent, path, name, value) of each indented file; see :func:`indented`. A null text has none."""
    return files.filter(F.col(text).isNotNull()).select(key, F.inline(indented(F.col(text))))


def services(files: DataFrame, key: str, text: str) -> DataFrame:
    """(key, chunk, pos, name, value) of a composition of containers: each service with its image, the ports that it opens
    and the services that it needs; ports and needs as lists, maps or lists in brackets. ``pos`` is the line."""
    found = entries(files, key, text).filter(F.try_element_at("path", F.lit(1)) == "services")
    depth, of = F.size("path"), F.try_element_at("path", F.lit(2))
    part = F.when(depth >= 3, F.try_element_at("path", F.lit(3))).when(depth == 2, F.col("name"))
    listed = F.when((depth == 2) & F.col("value").startswith("["), F.split(F.regexp_replace("value", r"""^\[\s*|["']|\s*\]$""", ""), r"\s*,\s*"))
    kind = F.when(part == "ports", "port").when(part == "depends_on", "needs")
    one = (
        F.when((depth == 3) & (F.col("name") == "-"), F.col("value"))
        .when((depth == 3) & (part == "depends_on"), F.col("name"))
        .when((depth == 4) & (part == "ports") & (F.col("name") == "target"), F.col("value"))
    )
    row = lambda chunk, name, value: F.struct(chunk.alias("chunk"), name.alias("name"), value.alias("value"))
    rows = F.when((depth == 1) & (F.col("name") != "-"), F.array(row(F.lit("service"), F.col("name"), F.lit(""))))
    rows = rows.when((depth == 2) & (F.col("name") == "image"), F.array(row(F.lit("image"), of, F.col("value"))))
    rows = rows.when(kind.isNotNull(), F.transform(F.coalesce(listed, F.array_compact(F.array(one))), lambda v: row(kind, of, v)))
    return found.select(key, F.col("line").alias("pos"), F.inline(rows)).select(key, "chunk", "pos", "name", "value")
