"""Files of many formats as rows: a directory scan, and rule tables that say what a format's chunks are.

Each rule is a regular expression over a whole file, with a name and a value as its groups; all rules of a file's
kind are read in one pass over the row. Whole-language parsers are no part of this.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import let
from .chunks import starts

# Which files are read.
GLOBS = (
    "*.cs", "*.vb", "*.cshtml", "*.razor", "*.py", "*.md", "*.css", "*.scss", "*.less", "*.js", "*.jsx", "*.ts",
    "*.tsx", "*.dart", "*.tf", "*.tfvars", "*.csproj", "*.vbproj", "*.fsproj", "*.sln", "*.json", "*.yml", "*.yaml",
    "*.config", "*.bicep", "Dockerfile", "*.dockerfile",
)
EXCLUDED_FOLDERS = (
    "/.git/", "/bin/", "/obj/", "/node_modules/", "/packages/", "/dist/", "/build/", "/.next/", "/.turbo/", "/.cache/",
    "/target/", "/out/", "/.vscode/", "/.vs/", "/.idea/", "/coverage/", "/test-results/", "/__pycache__/", "/vendor/",
    "/bower_components/", "/.nuget/", "/debug/", "/release/", "/.angular/", "/.dart_tool/", "/clientbin/", "/stylecop/",
    "/testsresults/",
)
EXCLUDED_NAMES = ("package-lock.json", "yarn.lock", "pnpm-lock.yaml", "packages.lock.json")
EXCLUDED_ENDINGS = (".min.js", ".min.css", ".map", ".log", ".dll", ".exe", ".pdb", ".cache", ".cshtml.cs", ".razor.cs")

_escaped = lambda words: "|".join(w.replace(".", r"\.") for w in words)
EXCLUDED = rf"(?:{_escaped(EXCLUDED_FOLDERS)})|(?:{_escaped(EXCLUDED_ENDINGS)})$|(?:^|/)(?:{_escaped(EXCLUDED_NAMES)})$"


def excluded(path: Column) -> Column:
    """Whether a path, of either kind of slash and any case, is never read."""
    return F.lower(F.replace(path, F.lit("\\"), F.lit("/"))).rlike(EXCLUDED)


def scan(spark: SparkSession, folder: str, recursive: bool = True, globs: tuple[str, ...] = GLOBS) -> DataFrame:
    """(path, content, modified, length) of a folder's files of these names, each once, without what is excluded.
    Contents are read only where they are asked for."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    found = reader.option("pathGlobFilter", "{" + ",".join(globs) + "}").load(folder)
    return found.filter(~excluded(F.col("path"))).select(
        "path", F.decode("content", "UTF-8").alias("content"), F.col("modificationTime").alias("modified"), "length"
    )


def kind_of(path: Column) -> Column:
    """The kind of file that a path names, by which its rules are picked; ``basic`` for any other."""
    name = F.lower(F.regexp_extract(path, r"([^/\\]*)$", 1))
    out = F.when(F.lit(False), "basic")
    for kind, pattern in KINDS:
        out = out.when(name.rlike(pattern), kind)
    return out.otherwise("basic")


KINDS = (
    ("package", r"^package\.json$"),
    ("settings", r"^(appsettings.*|tsconfig.*)\.json$"),
    ("webconfig", r"\.config$"),
    ("compose", r"^(docker-)?compose.*\.ya?ml$"),
    ("docker", r"^dockerfile|\.dockerfile$"),
    ("project", r"\.(cs|vb|fs)proj$"),
    ("solution", r"\.sln$"),
    ("terraform", r"\.(tf|tfvars)$"),
    ("bicep", r"\.bicep$"),
    ("style", r"\.(css|scss|less)$"),
    ("markdown", r"\.(md|markdown)$"),
    ("markup", r"\.(cshtml|razor|html?)$"),
    ("python", r"\.py$"),
    ("script", r"\.(jsx?|tsx?)$"),
    ("csharp", r"\.cs$"),
    ("json", r"\.json$"),
)


@dataclass(frozen=True)
class Chunk:
    """What a kind of file has: ``name`` and ``value`` are groups of the pattern, 0 for none."""

    kind: str
    chunk: str
    pattern: str
    name: int = 1
    value: int = 0


CHUNKS = (
    Chunk("style", "variable", r"(?m)(--[\w-]+)\s*:\s*([^;{}]+);", 1, 2),
    Chunk("style", "media", r"@media\s+([^{]+?)\s*\{"),
    Chunk("style", "keyframes", r"@keyframes\s+([\w-]+)"),
    Chunk("style", "mixin", r"@mixin\s+([\w-]+)"),
    Chunk("style", "rule", r"(?:^|[{};])\s*([.#\w*:\[][^{};@]*?)\s*\{([^{}]*)\}", 1, 2),
    Chunk("docker", "stage", r"(?im)^FROM[ \t]+(\S+)(?:[ \t]+AS[ \t]+(\S+))?", 2, 1),
    Chunk("docker", "copied", r"(?im)^COPY[ \t]+--from=(\S+)"),
    Chunk("docker", "port", r"(?im)^EXPOSE[ \t]+(\d+(?:/(?:tcp|udp))?)"),
    Chunk("docker", "variable", r"(?im)^ENV[ \t]+(\w+)(?:=|[ \t]+)([^\n]+)", 1, 2),
    Chunk("docker", "folder", r"(?im)^WORKDIR[ \t]+([^\n]+)"),
    Chunk("docker", "start", r"(?im)^(ENTRYPOINT|CMD)[ \t]+([^\n]+)", 1, 2),
    Chunk("project", "package", r'<PackageReference\s+Include="([^"]+)"(?:\s+Version="([^"]*)")?', 1, 2),
    Chunk("project", "reference", r'<ProjectReference\s+Include="([^"]+)"'),
    Chunk("solution", "project", r'(?m)^Project\("[^"]*"\)\s*=\s*"([^"]+)",\s*"([^"]+)"', 1, 2),
    Chunk("terraform", "resource", r'(?m)^[ \t]*resource\s+"([^"]+)"\s+"([^"]+)"', 2, 1),
    Chunk("terraform", "module", r'(?m)^[ \t]*module\s+"([^"]+)"'),
    Chunk("terraform", "variable", r'(?m)^[ \t]*variable\s+"([^"]+)"'),
    Chunk("bicep", "resource", r"(?m)^resource\s+(\w+)\s+'([^']+)'", 1, 2),
    Chunk("bicep", "module", r"(?m)^module\s+(\w+)\s+'([^']+)'", 1, 2),
    Chunk("bicep", "param", r"(?m)^param\s+(\w+)\s+(\w+)", 1, 2),
    Chunk("webconfig", "setting", r'<add\s+key="([^"]+)"\s+value="([^"]*)"', 1, 2),
)


def extracted(files: DataFrame, key: str, path: str, text: str, chunks: tuple[Chunk, ...] = CHUNKS) -> DataFrame:
    """(key, kind, chunk, pos, name, value): every chunk of each file, numbered within its sort; an absent part is empty.
    Only the rules of a file's own kind are tried."""
    kind = kind_of(F.col(path))

    def found(c: Chunk) -> Column:
        group = lambda k: F.regexp_extract_all(text, F.lit(c.pattern), F.lit(k)) if k else None
        names, values = group(c.name), group(c.value)

        def row(x: Column, i: Column) -> Column:
            value = F.trim(values[i]) if values is not None else F.lit("")
            return F.struct(F.lit(c.chunk).alias("chunk"), i.alias("pos"), F.trim(x).alias("name"), value.alias("value"))

        empty = F.array().cast("array<struct<chunk: string, pos: int, name: string, value: string>>")
        return F.when(F.col("_kind") == c.kind, F.transform(names, row)).otherwise(empty)

    rows = files.select(F.col(key), F.col(text), kind.alias("_kind"))
    return rows.select(key, F.col("_kind").alias("kind"), F.inline(F.concat(*map(found, chunks))))


def settings(files: DataFrame, key: str, path: str, text: str) -> DataFrame:
    """(key, kind, chunk, name, value): entries of JSON configuration files. Of package.json its dependencies and scripts,
    of others their top-level sections; text that isn't JSON gives none."""
    kind = kind_of(F.col(path))
    entries = lambda where: F.map_entries(F.from_json(F.get_json_object(text, where), "map<string,string>"))
    rows = lambda found, chunk: F.transform(
        F.coalesce(found, F.array().cast("array<struct<key: string, value: string>>")),
        lambda e: F.struct(F.lit(chunk).alias("chunk"), e["key"].alias("name"), e["value"].alias("value")),
    )
    package = F.concat(
        rows(entries("$.dependencies"), "dependency"), rows(entries("$.devDependencies"), "development"), rows(entries("$.scripts"), "script")
    )
    told = F.when(F.col("_kind") == "package", package).otherwise(rows(entries("$"), "section"))
    known = files.select(F.col(key), F.col(text), kind.alias("_kind")).filter(F.col("_kind").isin("package", "settings"))
    return known.select(key, F.col("_kind").alias("kind"), F.inline(told))


def resources(files: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, type, name) of the resources of a JSON deployment template; none for any other text."""
    parsed = F.from_json(text, "resources array<struct<type: string, name: string>>")["resources"]
    return files.select(key, F.posexplode(parsed).alias("pos", "_r")).select(key, "pos", "_r.type", "_r.name")


# --- Markdown ---------------------------------------------------------------------------------------------

FENCE = r"(?s)```(\w*)[^\n]*\n(.*?)```"


def front_matter(text: Column) -> Column:
    """The pairs between ``---`` lines (name: value) or ``+++`` lines (name = value) at a text's beginning."""
    yaml = F.regexp_extract(text, r"(?s)^---\r?\n(.*?)\r?\n---\r?\n", 1)
    toml = F.regexp_extract(text, r"(?s)^\+\+\+\r?\n(.*?)\r?\n\+\+\+\r?\n", 1)
    pairs = lambda part, pattern: F.arrays_zip(
        F.regexp_extract_all(part, F.lit(pattern), F.lit(1)).alias("name"),
        F.transform(F.regexp_extract_all(part, F.lit(pattern), F.lit(2)), lambda v: F.trim(v)).alias("value"),
    )
    return F.when(yaml != "", pairs(yaml, r"(?m)^(\w+):[ \t]*(.+)$")).otherwise(pairs(toml, r'(?m)^(\w+)\s*=\s*"?(.+?)"?$'))


def body(text: Column) -> Column:
    """A text without its front matter."""
    return F.regexp_replace(text, r"(?s)\A(?:---\r?\n.*?\r?\n---\r?\n|\+\+\+\r?\n.*?\r?\n\+\+\+\r?\n)", "")


def sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, level, title, end_pos): Markdown headers and the lines at which their sections end.

    A section ends before the next header of its level or a higher one, so sections nest; at the last line without
    any. Of each level the headers as high as it are listed once, and a header's place among them by running counts tells
    the one after it: within the row, and no longer with more headers.
    """
    lines = F.split(text, "\n")
    heads = F.filter(
        F.transform(lines, lambda x, i: F.struct((i + 1).alias("pos"), F.length(F.regexp_extract(x, r"^(#{1,6})\s+\S", 1)).alias("level"),
                                                 F.trim(F.regexp_extract(x, r"^#{1,6}\s+(.+)$", 1)).alias("title"))),
        lambda h: h["level"] > 0,
    )

    def ended(h: Column) -> Column:
        high = F.array(*[F.transform(F.filter(h, _as_high(k)), lambda x: x["pos"]) for k in range(1, 7)])
        before = [starts(F.transform(F.transform(h, _as_high(k)), lambda x: x.cast("long"))) for k in range(1, 7)]
        places = F.arrays_zip(h.alias("h"), *[b.alias(f"k{k}") for k, b in enumerate(before, 1)])
        ends = let(high, lambda listed: F.transform(places, lambda p: F.try_element_at(
            F.element_at(listed, p["h"]["level"]), (F.element_at(F.array(*[p[f"k{k}"] for k in range(1, 7)]), p["h"]["level"]) + 2).cast("int"))))
        return F.zip_with(h, ends, lambda x, after: F.struct(x["pos"].alias("pos"), x["level"].alias("level"), x["title"].alias("title"), (after - 1).alias("end_pos")))

    rows = docs.select(key, F.size(lines).alias("_n"), F.inline(let(heads, ended)))
    return rows.select(key, "pos", "level", "title", F.coalesce("end_pos", "_n").alias("end_pos"))


def _as_high(level: int):
    return lambda x: x["level"] <= level


def link_kind(target: Column) -> Column:
    return (
        F.when(target.rlike("^https?://"), "external")
        .when(target.startswith("#"), "internal_anchor")
        .when(target.rlike(r"\.(md|markdown)$"), "markdown_reference")
        .otherwise("relative")
    )


def markdown(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, chunk, pos, name, value): front matter, sections, fenced code and links of each text; the whole of it, up to
    2000 characters, as ``full_content`` where it has no header."""
    plain = docs.select(key, front_matter(F.col(text)).alias("_m"), body(F.col(text)).alias("_b"))
    row = lambda chunk, pos, name, value: F.struct(
        F.lit(chunk).alias("chunk"), pos.cast("int").alias("pos"), name.alias("name"), value.alias("value")
    )
    matter = plain.select(key, F.inline(F.transform("_m", lambda m, i: row("front_matter", i, m["name"], m["value"]))))
    zipped = lambda pattern: F.arrays_zip(
        *[F.regexp_extract_all("_b", F.lit(pattern), F.lit(k)).alias(n) for k, n in ((1, "a"), (2, "b"))]
    )
    fences = F.transform(zipped(FENCE), lambda f, i: row("code", i, F.when(f["a"] == "", "text").otherwise(f["a"]), f["b"]))
    links = F.transform(zipped(r"\[([^\]]+)\]\(([^\)]+)\)"), lambda f, i: row("link", i, link_kind(f["b"]), f["b"]))
    headed = F.col("_b").rlike(r"(?m)^#{1,6}\s+\S")
    cut = F.when(F.length("_b") > 2000, F.concat(F.substring("_b", 1, 2000), F.lit("..."))).otherwise(F.col("_b"))
    whole = F.when(~headed & (F.trim("_b") != ""), F.array(row("full_content", F.lit(0), F.lit("Content"), cut)))
    others = plain.select(key, F.inline(F.concat(fences, links, F.coalesce(whole, F.slice(links, 1, 0)))))
    heads = sections(plain, key, "_b").select(
        key, F.lit("section").alias("chunk"), "pos", F.col("title").alias("name"),
        F.concat_ws(" ", "level", "end_pos").alias("value"))
    return matter.unionByName(others).unionByName(heads)
