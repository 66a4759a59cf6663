"""File sources: a directory scan, and chunks of files of many formats.

The tables hold prose and pages. Where a format isn't among them, a row's columns are written out as a small file of
it, so that SQL names the chunks without reading the file.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import table
from ..sources import files as X
from ..sources import nesting
from . import query


@query("S01")
def directory(spark, sf_dir):
    """The input folder's own files, by name; their contents aren't read."""
    found = X.scan(spark, sf_dir, globs=("*.parquet", "*.json", "*.log"))
    return found.select(F.regexp_extract("path", r"([^/]*/[^/]*)$", 1).alias("path"), "length").distinct()


_PATHS = ("/Src/App", "/bin/", "/x/node_modules/", "/a.git/", "/.GIT/", "/out/")
_NAMES = ("a.cs", "b.min.js", "c.map", "yarn.lock", "d.log.txt", "e.razor.cs", "f.PDB")


@query("S02", f"""WITH p AS (SELECT page_id, {list(_PATHS)!r}[page_id % {len(_PATHS)} + 1] || '/' || {list(_NAMES)!r}[page_id % {len(_NAMES)} + 1] AS path FROM pages)
  SELECT page_id, path FROM p WHERE page_id % {len(_PATHS)} IN (0, 3) AND page_id % {len(_NAMES)} IN (0, 4)""")
def exclusion(spark, sf_dir):
    pick = lambda names: F.element_at(F.array(*map(F.lit, names)), (F.col("page_id") % len(names) + 1).cast("int"))
    paths = table(spark, sf_dir, "pages").select("page_id", F.concat_ws("/", pick(_PATHS), pick(_NAMES)).alias("path"))
    return paths.filter(~X.excluded(F.col("path")))


_FILES = {
    "package.json": "package", "AppSettings.Dev.json": "settings", "docker-compose.yml": "compose", "Dockerfile.test": "docker", "x.csproj": "project",
    "y.sln": "solution", "main.tf": "terraform", "m.bicep": "bicep", "s.SCSS": "style", "README.md": "markdown", "i.razor": "markup", "a.py": "python",
    "b.tsx": "script", "c.cs": "csharp", "d.json": "json", "e.txt": "basic", "web.config": "webconfig",
}


@query("S04", f"SELECT doc_id, {list(_FILES.values())!r}[doc_id % {len(_FILES)} + 1] AS kind FROM documents")
def routing(spark, sf_dir):
    names = F.array(*map(F.lit, _FILES))
    path = F.concat(F.lit("/src/"), F.col("source"), F.lit("/"), F.element_at(names, (F.col("doc_id") % len(_FILES) + 1).cast("int")))
    return table(spark, sf_dir, "documents").select("doc_id", X.kind_of(path).alias("kind"))


_MD = """SELECT doc_id, 'front_matter' AS chunk, 0 AS pos, 'lang' AS name, lang AS value FROM documents UNION ALL SELECT doc_id, 'front_matter', 1, 'source', source FROM documents
  UNION ALL SELECT doc_id, 'section', 1, 'Top', '1 12' FROM documents UNION ALL SELECT doc_id, 'section', 3, source, '2 7' FROM documents
  UNION ALL SELECT doc_id, 'section', 5, 'Deep', '4 7' FROM documents UNION ALL SELECT doc_id, 'section', 8, 'Last', '2 12' FROM documents
  UNION ALL SELECT doc_id, 'code', 0, 'sql', 'SELECT ' || doc_id || chr(10) FROM documents
  UNION ALL SELECT doc_id, 'link', k, kind, target FROM documents, (VALUES (0, 'external', 'https://x.org/'), (1, 'internal_anchor', '#top'), (2, 'markdown_reference', 'a/b.md'), (3, 'relative', 'img.png')) v(k, kind, target)"""


@query("S06", f"SELECT doc_id, chunk, pos::INT AS pos, name, value FROM ({_MD}) WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 'full_content', 0, 'Content', CASE WHEN length(text) > 2000 THEN substring(text, 1, 2000) || '...' ELSE text END FROM documents WHERE doc_id % 2 = 1 AND length(trim(text)) > 0 AND NOT regexp_matches(text, '(?m)^#{{1,6}}\\s+\\S')")
def markdown(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    built = F.concat(
        F.lit("---\nlang: "), "lang", F.lit("\nsource: "), "source", F.lit("\n---\n# Top\n[a](https://x.org/)\n## "), "source",
        F.lit("\n#no header\n####   Deep\n[b](#top) and [c](a/b.md)\n\n## Last\n```sql\nSELECT "), F.col("doc_id").cast("string"), F.lit("\n```\n[d](img.png)"))
    text = F.when(F.col("doc_id") % 2 == 0, built).otherwise(F.col("text"))
    return X.markdown(docs.select("doc_id", text.alias("text")), "doc_id", "text")


def _as(spark, sf_dir, name, *parts):
    """(doc_id, path, content): one file of each document's columns."""
    content = F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    return table(spark, sf_dir, "documents").select("doc_id", F.lit(name).alias("path"), content.alias("content"))


def _rows(kind: str, *chunks: tuple[str, int, str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT doc_id, '{kind}' AS kind, '{c}' AS chunk, {pos} AS pos, {name} AS name, {value} AS value FROM documents" for c, pos, name, value in chunks
    )


@query("S07", _rows("style", ("variable", 0, "'--main'", "'#' || doc_id"), ("media", 0, "'(max-width: 9px)'", "''"), ("keyframes", 0, "'spin'", "''"), ("mixin", 0, "source", "''"),
                    ("rule", 0, "':root'", "'--main: #' || doc_id || ';'"), ("rule", 1, "'.' || source", "'color: red'"), ("rule", 2, "'p > a:hover'", "''")))
def style(spark, sf_dir):
    key = F.col("doc_id").cast("string")
    files = _as(spark, sf_dir, "a.scss", ":root { --main: #", key, "; }\n@mixin ", F.col("source"), " ($x) { }\n.", F.col("source"),
                " { color: red }\n@media (max-width: 9px) {\np > a:hover {} }\n@keyframes spin { from { } }")
    return X.extracted(files, "doc_id", "path", "content").filter("NOT (chunk = 'rule' AND name = 'from')")


@query("S09", """SELECT doc_id, 'package' AS kind, 'dependency' AS chunk, source AS name, '^' || doc_id AS value FROM documents WHERE doc_id % 2 = 0
  UNION ALL SELECT doc_id, 'package', 'development', 'jest', '1' FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 'package', 'script', 'test', 'run ' || lang FROM documents WHERE doc_id % 2 = 0
  UNION ALL SELECT doc_id, 'settings', 'section', 'Logging', '{"Level":"' || lang || '"}' FROM documents WHERE doc_id % 2 = 1
  UNION ALL SELECT doc_id, 'webconfig', 'setting', source, lang FROM documents UNION ALL SELECT doc_id, 'yaml', 'setting', 'logging.level.' || source, lang FROM documents
  UNION ALL SELECT doc_id, 'yaml', 'setting', 'logging.sinks.-.name', '#' || doc_id FROM documents UNION ALL SELECT doc_id, 'yaml', 'setting', 'logging.sinks.-.size', '5' FROM documents
  UNION ALL SELECT doc_id, 'yaml', 'setting', 'motto', '|' FROM documents UNION ALL SELECT doc_id, 'yaml', 'setting', 'tags.-', source FROM documents""")
def config(spark, sf_dir):
    key, lang = F.col("doc_id").cast("string"), F.col("lang")
    package = F.concat(F.lit('{"dependencies": {"'), "source", F.lit('": "^'), key, F.lit('"}, "devDependencies": {"jest": "1"}, "scripts": {"test": "run '), lang, F.lit('"}}'))
    even = F.col("doc_id") % 2 == 0
    files = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.when(even, "a/package.json").otherwise("a/appsettings.json").alias("path"),
        F.when(even, package).otherwise(F.concat(F.lit('{"Logging": {"Level": "'), lang, F.lit('"}}'))).alias("content"),
    )
    web = _as(spark, sf_dir, "web.config", '<appSettings>\n<add key="', F.col("source"), '" value="', lang, '" />\n</appSettings>')
    yaml = _as(spark, sf_dir, "a.yml", "# all\nlogging:\n  level:\n    ", F.col("source"), ": ", lang, "  # own\n  sinks:\n  - name: '#", key, "'\n    size: 5\n"
               "motto: |\n  a: b\n\n  - c\ntags:\n- ", F.col("source"), "\n")  # fmt: skip
    told = nesting.entries(yaml, "doc_id", "content").filter("value <> ''")
    told = told.select("doc_id", F.lit("yaml").alias("kind"), F.lit("setting").alias("chunk"), F.concat_ws(".", "path", "name").alias("name"), "value")
    found = X.settings(files, "doc_id", "path", "content").unionByName(X.extracted(web, "doc_id", "path", "content").drop("pos"))
    return found.unionByName(told)


@query("S10", _rows("docker", ("stage", 0, "source", "'base:' || doc_id"), ("stage", 1, "''", "'scratch'"), ("copied", 0, "source", "''"), ("port", 0, "'8080/tcp'", "''"), ("variable", 0, "'LANG'", "lang"), ("folder", 0, "'/app'", "''"), ("start", 0, "'CMD'", "'[\"run\"]'"))
       + " UNION ALL " + _rows("compose", ("service", 2, "source", "''"), ("image", 3, "source", "'base:' || doc_id"), ("port", 5, "source", "'80:80'"), ("needs", 6, "source", "'db'"),
                               ("needs", 6, "source", "lang"), ("service", 7, "'db'", "''"), ("needs", 9, "'db'", "'disk'")))
def docker(spark, sf_dir):
    files = _as(spark, sf_dir, "Dockerfile", "FROM base:", F.col("doc_id").cast("string"), " AS ", F.col("source"), "\nRUN x\nfrom scratch\nCOPY --from=", F.col("source"),
                " /a /b\n# EXPOSE 1\nEXPOSE 8080/tcp\nEXPOSE x\nENV LANG=", F.col("lang"), '\nWORKDIR /app\nCMD ["run"]\n')
    composed = _as(spark, sf_dir, "compose.yml", "services:\n  ", F.col("source"), ":\n    image: base:", F.col("doc_id").cast("string"), '\n    ports:\n      - "80:80"\n'
                   "    depends_on: [db, ", F.col("lang"), "]\n  db:\n    depends_on:\n      disk:\n        condition: up\nvolumes:\n  image: x\n")  # fmt: skip
    told = nesting.services(composed, "doc_id", "content").withColumn("kind", F.lit("compose"))
    return X.extracted(files, "doc_id", "path", "content").unionByName(told)


@query("S11", _rows("project", ("package", 0, "'Lib.' || source", "'1.' || doc_id"), ("package", 1, "'Bare'", "''"), ("reference", 0, "'../' || lang || '.csproj'", "''"))
       + " UNION ALL " + _rows("solution", ("project", 0, "source", "'src' || chr(92) || lang || '.csproj'"), ("project", 1, "'Tests'", "'t.csproj'")))
def project(spark, sf_dir):
    files = _as(spark, sf_dir, "x.csproj", '<Project><ItemGroup>\n<PackageReference Include="Lib.', F.col("source"), '" Version="1.', F.col("doc_id").cast("string"),
                '" />\n<PackageReference Include="Bare" /><ProjectReference Include="../', F.col("lang"), '.csproj" /></ItemGroup></Project>')
    solution = _as(spark, sf_dir, "y.sln", 'Microsoft Visual Studio Solution File\nProject("{F1}") = "', F.col("source"), '", "src\\', F.col("lang"), '.csproj", "{A1}"\nEndProject\n'
                   'Project("{F1}") = "Tests", "t.csproj", "{A2}"\nEndProject\n')  # fmt: skip
    return X.extracted(files.unionByName(solution), "doc_id", "path", "content")


@query("S12", _rows("terraform", ("resource", 0, "source", "'db_table'"), ("module", 0, "'net_' || lang", "''"), ("variable", 0, "'size'", "''"))
       + " UNION ALL SELECT doc_id, 'template', 'resource', 0, source, 'X.Y/' || lang FROM documents UNION ALL "
       + _rows("bicep", ("resource", 0, "source", "'A.B/c@1'"), ("module", 0, "'net'", "'net_' || lang || '.bicep'"), ("param", 0, "'size'", "'int'")))
def infrastructure(spark, sf_dir):
    files = _as(spark, sf_dir, "main.tf", 'resource "db_table" "', F.col("source"), '" {\n}\n# resource\nmodule "net_', F.col("lang"), '" {}\n  variable "size" {}\n')
    template = _as(spark, sf_dir, "arm.json", '{"resources": [{"type": "X.Y/', F.col("lang"), '", "name": "', F.col("source"), '"}]}')
    found = X.resources(template, "doc_id", "content").select(
        "doc_id", F.lit("template").alias("kind"), F.lit("resource").alias("chunk"), "pos", "name", F.col("type").alias("value")
    )
    bicep = _as(spark, sf_dir, "m.bicep", "resource ", F.col("source"), " 'A.B/c@1' = {\n  name: 'x'\n}\nmodule net 'net_", F.col("lang"), ".bicep' = {}\nparam size int = 3\n")
    return X.extracted(files.unionByName(bicep), "doc_id", "path", "content").unionByName(found)
