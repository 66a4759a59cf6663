"""Chunks of texts: lines, blocks and JSON entries. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import let

#: Lengths that are added up at once; their square is what a fold moves.
_AT_ONCE = 256


def _prefix(values: Column) -> Column:
    """0 and the running sums of a short array."""
    return F.aggregate(values, F.array(F.lit(0).cast("long")), lambda sums, x: F.array_append(sums, F.element_at(sums, -1) + x))


def starts(lengths: Column) -> Column:
    """The sum of all entries before each, by running sums of blocks and within them: no row of it moves."""

    def cut(lengths: Column) -> Column:
        last = F.floor((F.size(lengths) - 1) / _AT_ONCE).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(lengths, b * _AT_ONCE + 1, F.lit(_AT_ONCE)))

    def within(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda s, v: s + v))
        return let(
            _prefix(sums),
            lambda before: F.flatten(
                F.transform(blocks, lambda x, i: F.slice(F.transform(_prefix(x), lambda p: p + before[i]), F.lit(1), F.size(x)))
            ),
        )

    return let(lengths, lambda found: F.when(F.size(found) > 0, let(cut(found), within)))


def lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, line, start): every line with its number from 1 and its character offset, worked out in the row."""
    split = docs.select(key, F.split(text, "\n").alias("_l"))
    with_starts = split.select(key, "_l", starts(F.transform("_l", lambda x: F.length(x).cast("long") + 1)).alias("_s"))
    rows = F.transform("_l", lambda x, i: F.struct((i + 1).alias("pos"), x.alias("line"), F.col("_s")[i].alias("start")))
    return with_starts.select(key, F.inline(rows))


def tag_blocks(pages: DataFrame, key: str, html: str, tags: tuple[str, ...]) -> DataFrame:
    """(key, tag, pos, content): the content of each element of these tags that holds no other of its kind."""
    found = [
        F.transform(
            F.regexp_extract_all(html, F.lit(rf"(?is)<{t}\b[^>]*>((?:(?!<{t}\b).)*?)</{t}>"), F.lit(1)),
            _labelled(t),
        )
        for t in tags
    ]
    return pages.select(key, F.inline(F.concat(*found)))


def _labelled(tag: str):
    return lambda x, i: F.struct(F.lit(tag).alias("tag"), i.alias("pos"), x.alias("content"))


def headings(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, pos, level): the headings of a page in their order."""
    found = F.regexp_extract_all(html, F.lit(r"(?i)<h([1-6])\b"), F.lit(1))
    return pages.select(key, F.posexplode(found).alias("pos", "level")).withColumn("level", F.col("level").cast("int"))


def links(pages: DataFrame, key: str, html: str) -> DataFrame:
    found = F.regexp_extract_all(html, F.lit(r'(?i)<a\s[^>]*href="([^"]*)"'), F.lit(1))
    return pages.select(key, F.posexplode(found).alias("pos", "href"))


def json_entries(docs: DataFrame, key: str, text: str, deepest: int = 3, most: int = 100) -> DataFrame:
    """(key, path, type, depth, content): the chunks of JSON texts, parsed once to VARIANT and exploded level by level.

    An object's members are at depth 0, and objects of more than 10 characters are entered down to depth ``deepest``; arrays are
    chunks with more than 10, but aren't entered. Other values are chunks with more than 5, as ``name: value``. Of an array that is the
    whole text, the first ``most`` items count if they are objects or arrays. Contents of more than 2000 characters are cut and
    end in ``...``; they are spelled as VARIANT does, without blanks and by sorted names. A text that isn't JSON is one chunk of
    type ``parse_error``; a single value has no chunks. Nothing is shuffled.
    """
    spark, columns = docs.sparkSession, (key, "path", "type", "depth", "content")
    cut = lambda c: F.when(F.length(c) > 2000, F.concat(F.left(c, F.lit(2000)), F.lit("..."))).otherwise(c)
    whole = docs.filter(F.col(text).isNotNull()).select(key, F.trim(F.col(text)).alias("_t"), F.try_parse_json(text).alias("_v"))
    bad = whole.filter(F.col("_v").isNull())
    found = bad.select(key, F.lit("").alias("path"), F.lit("parse_error").alias("type"), F.lit(0).alias("depth"), cut(F.col("_t")).alias("content"))

    def members(rows: DataFrame) -> DataFrame:
        explode = spark.tvf.variant_explode(F.col("_v").outer()).select(F.col("pos").alias("_pos"), F.col("key").alias("_key"), F.col("value").alias("_m"))
        shape = F.schema_of_variant("_m")
        kind = F.when(shape.startswith("OBJECT"), "object").when(shape.startswith("ARRAY"), "array").otherwise("value")
        spelled = F.when(kind == "value", F.try_variant_get("_m", "$", "string")).otherwise(F.to_json("_m"))
        return rows.lateralJoin(explode).withColumns({"type": kind, "_s": spelled}).filter(F.length("_s") > F.when(F.col("type") == "value", 5).otherwise(10))

    items = members(whole.filter(F.schema_of_variant("_v").startswith("ARRAY"))).filter((F.col("_pos") < most) & (F.col("type") != "value"))
    found = found.unionByName(items.withColumns({"path": F.concat(F.lit("["), "_pos", F.lit("]")), "depth": F.lit(0), "content": cut(F.col("_s"))}).select(*columns))
    level = whole.filter(F.schema_of_variant("_v").startswith("OBJECT")).select(key, "_v", F.lit("").alias("path"))
    for depth in range(deepest + 1):
        own = F.concat_ws(".", F.when(F.col("path") != "", F.col("path")), F.col("_key"))
        content = F.when(F.col("type") == "value", F.concat("_key", F.lit(": "), "_s")).otherwise(cut(F.col("_s")))
        rows = members(level).withColumns({"path": own, "depth": F.lit(depth), "content": content})
        found = found.unionByName(rows.select(*columns))
        level = rows.filter("type = 'object'").select(key, F.col("_m").alias("_v"), "path")
    return found
