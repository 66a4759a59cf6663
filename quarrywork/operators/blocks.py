"""Repeated markup: the blocks of pages, which of them are alike, and groups of these.

Two blocks are alike if five of six checks hold: numbers of elements at most two apart, the same of image, button, form
and price, and more than three fifths of their words in common. Five of the six need no text, so blocks with equal figures
are one signature, and signatures alike are found without comparing blocks. Words are compared with those of a group's
leader only, and only where exactly one of the five fails.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, drop_table

FLAGS = ("image", "button", "form", "price")
#: Lines before and after a block's own, the most that element counts differ, and the share of words in common.
AROUND, APART, COMMON = 5, 2, 0.6
OPENING = r'<div[^>]*class="[^"]+"[^>]*>'


def found(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, pos, content, elements, image, button, form, price): the lines around each element with a class."""
    lines = F.split(html, "\n")
    places = F.filter(
        F.transform(lines, lambda x, i: F.struct(i.alias("line"), F.regexp_count(x, F.lit(OPENING)).alias("k"))), lambda x: x["k"] > 0
    )
    rows = pages.select(key, lines.alias("_l"), F.inline(places))
    first = F.greatest(F.col("line") - AROUND, F.lit(0))
    content = F.array_join(F.slice("_l", first + 1, F.col("line") + AROUND - first + 1), "\n")
    each = rows.select(key, "line", content.alias("content"), F.posexplode(F.array_repeat(F.lit(0), F.col("k"))).alias("pos", "_"))
    holds = lambda *words: F.array_contains(F.array(*[F.contains("content", F.lit(w)) for w in words]), True)
    return each.select(
        key,
        F.concat_ws(".", "line", "pos").alias("pos"),
        "content",
        F.regexp_count("content", F.lit(r"<\w")).alias("elements"),
        holds("<img").alias("image"),
        holds("<button", "@onclick").alias("button"),
        holds("<EditForm", "<form").alias("form"),
        F.contains(F.lower("content"), F.lit("price")).alias("price"),
    )


def similarity(a: Column, b: Column) -> Column:
    """The share of the six checks that hold, of two blocks as structs."""
    words = lambda x: F.filter(F.split(x["content"], r"[ \n\t]+"), lambda w: w != "")
    x, y = words(a), words(b)
    longest = F.greatest(F.size(x), F.size(y))
    text = (longest > 0) & (F.size(F.array_intersect(x, y)) > COMMON * longest)
    checks = [F.abs(a["elements"] - b["elements"]) <= APART, *[a[f] == b[f] for f in FLAGS], text]
    return sum((c.cast("int") for c in checks), F.lit(0)) / 6.0


def _placed(blocks: DataFrame, key: str) -> DataFrame:
    """``blocks`` with ``first``, their place in the order of all, their distinct words ``w`` and the number ``n`` of words."""
    place = F.split("pos", r"\.")
    words = F.filter(F.split("content", r"[ \n\t]+"), lambda w: w != "")
    order = F.struct(F.col(key).alias("key"), place[0].cast("int").alias("line"), place[1].cast("int").alias("at"))
    return blocks.withColumns({"first": order, "w": F.array_distinct(words), "n": F.size(words)})


def _met(rows: DataFrame, others: DataFrame) -> DataFrame:
    """``rows`` with ``_met``, those of ``others`` that differ from a row in one flag at most; ``same`` if in none."""
    flip = lambda f: F.struct(*[(~F.col(g) if g == f else F.col(g)).alias(g) for g in FLAGS], F.lit(f is None).alias("same"))
    sides = others.select("first", "elements", "n", "w", F.inline(F.array(*[flip(f) for f in (None, *FLAGS)])))
    kept = F.array_sort(F.collect_list(F.struct("first", "elements", "n", "w", "same")))
    return rows.join(F.broadcast(sides.groupBy(*FLAGS).agg(kept.alias("_met"))), [*FLAGS], "left")


def _by_figures(x: Column) -> Column:
    return x["same"] & (F.abs(F.col("elements") - x["elements"]) <= APART)


def _by_words(x: Column) -> Column:
    """Whether a row and one it met, which fail just one of the five figures, have the words in common."""
    least = COMMON * F.greatest("n", x["n"])
    near = F.abs(F.col("elements") - x["elements"]) <= APART
    return (x["same"] != near) & (F.least(F.size("w"), F.size(x["w"])) > least) & (F.size(F.array_intersect("w", x["w"])) > least)


def _sure(heads: list, alike: set) -> list:
    """Those of ``heads``, in order, that lead for certain; ``alike`` are pairs of places in it, the later first, alike by words.

    What a leader takes by figures it takes with all of equal figures. Of a head that is taken by words alone the next of its figures is
    not known yet, and neither is any later head that could be alike to that one.
    """
    flags = [[h[f] for f in FLAGS] for h in heads]
    leads, unsure = [], []
    for i, head in enumerate(heads):
        failed = lambda j: sum(a != b for a, b in zip(flags[i], flags[j])) + (abs(head["elements"] - heads[j]["elements"]) > APART)  # noqa: B023, E731
        if any(failed(j) == 0 for j in leads):
            continue
        if any((i, j) in alike for j in leads) or any(failed(j) <= 1 for j in unsure):
            unsure.append(i)
        else:
            leads.append(i)
    return [heads[i] for i in leads]


def groups(blocks: DataFrame, key: str) -> DataFrame:
    """``blocks`` with the (key, line, at) of the block that leads their group, as text.

    Blocks are gone through in order: one that no group has taken leads a new one and takes all later ones alike that are left. Two
    blocks of equal flags and near numbers of elements are alike whatever they say, so there are few leaders: no more than
    distinct figures, whose number grows with the square root of the text at most. Each round looks at the first block left of each
    figures, the only ones that can lead, and compares what is left with those that do: blocks meet leaders, never each other.
    The driver sees figures of these first ones, no text.
    """
    rows = _placed(blocks, key)
    left, leaders, written = rows.select("first", "elements", *FLAGS, "n", "w"), None, None
    while True:
        first = left.select("first", "elements", *FLAGS).groupBy("elements", *FLAGS).agg(F.min("first").alias("first"))
        heads = cut(left.join(F.broadcast(first), ["elements", *FLAGS, "first"], "semi").dropDuplicates(["elements", *FLAGS]))
        ordered = heads.select("first", "elements", *FLAGS).orderBy("first").collect()
        if not ordered:
            drop_table(heads)
            break
        place = {h["first"]: i for i, h in enumerate(ordered)}
        pairs = _met(heads, heads).select("first", F.explode(F.filter("_met", lambda x: (x["first"] < F.col("first")) & _by_words(x))).alias("x"))
        alike = {(place[p["first"]], place[p["other"]]) for p in pairs.select("first", F.col("x.first").alias("other")).collect()}
        lead = blocks.sparkSession.createDataFrame([(h["elements"], *[h[f] for f in FLAGS]) for h in _sure(ordered, alike)], f"elements int, {', '.join(f'{f} boolean' for f in FLAGS)}")
        new = cut(heads.join(F.broadcast(lead), ["elements", *FLAGS], "semi").select("first", "elements", *FLAGS, "n", "w"))
        taken = F.exists("_met", lambda x: _by_figures(x)) | F.exists("_met", lambda x: (x["first"] < F.col("first")) & _by_words(x))
        after = cut(_met(left, new).filter(~F.coalesce(taken, F.lit(False))).select("first", "elements", *FLAGS, "n", "w"))
        drop_table(heads)
        if written is not None:
            drop_table(written)
        written = left = after
        leaders = new if leaders is None else leaders.unionByName(new)
    found = rows.withColumn("_lead", F.col("first"))
    if leaders is not None:
        by_figures = F.array_min(F.transform(F.filter("_met", _by_figures), lambda x: x["first"]))
        by_words = F.filter("_met", lambda x: (x["first"] < F.coalesce("_lead", "first")) & _by_words(x))
        found = _met(rows, leaders).withColumn("_lead", by_figures)
        found = found.withColumn("_lead", F.least("_lead", F.array_min(F.transform(by_words, lambda x: x["first"]))))
    if written is not None:
        drop_table(written)
    return found.select(*blocks.columns, F.concat_ws(".", *[F.col("_lead")[c].cast("string") for c in ("key", "line", "at")]).alias("group"))
