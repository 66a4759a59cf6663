"""Scores, texts and buckets as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- vectors ----------------------------------------------------------------------------------------------


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, also where a lambda uses it for each entry."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def usable(a: Column) -> Column:
    """Whether a vector is there and has an entry other than zero."""
    return F.coalesce(F.exists(a, lambda x: x != 0), F.lit(False))


def cosine(a: Column, query: Iterable[float]) -> Column:
    """Similarity to a fixed vector, whose norm is worked out once."""
    values = [float(x) for x in query]
    size = sum(x * x for x in values) ** 0.5 or 1.0
    return dot(a, F.array(*map(F.lit, values))) / (norm(a) * size)


# --- texts ------------------------------------------------------------------------------------------------


def contains_any(text: Column, words: Iterable[str]) -> Column:
    """Whether any of the words is a substring, whatever the case."""
    lowered = F.lower(text)
    return reduce(lambda a, b: a | b, [lowered.contains(w.lower()) for w in words], F.lit(False))


def count_contained(text: Column, words: Iterable[str]) -> Column:
    """How many of the words are substrings, whatever the case."""
    lowered = F.lower(text)
    return sum((lowered.contains(w.lower()).cast("int") for w in words), F.lit(0))


def head_and_tail(text: Column, most: int, head: float = 0.6, mark: str = "...") -> Column:
    """A long text's beginning and end with a mark in between, ``most`` characters in all."""
    first = int((most - len(mark)) * head)
    last = most - len(mark) - first
    cut = F.concat(F.substring(text, 1, first), F.lit(mark), F.right(text, F.lit(last)))
    return F.when(F.length(text) > most, cut).otherwise(text)


def capped(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def search_term(text: Column, stop_words: Iterable[str], most: int = 5) -> Column:
    """The first few words that tell something."""
    words = F.split(F.lower(text), r"[ ?.,!:;]+")
    stop = F.array(*map(F.lit, stop_words))
    telling = F.filter(words, lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w))
    return F.array_join(F.slice(telling, 1, most), " ")


def word_overlap(a: Column, b: Column) -> Column:
    """Distinct common words over the longer word list."""
    x, y = (F.filter(F.split(c, r"\s+"), lambda w: w != "") for c in (a, b))
    longest = F.greatest(F.size(x), F.size(y))
    return F.when(longest > 0, F.size(F.array_intersect(x, y)) / longest).otherwise(F.lit(0.0))


def lines_of_code(text: Column) -> Column:
    """Lines with something on them that isn't a whole-line comment."""
    trimmed = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    code = F.filter(trimmed, lambda x: (x != "") & ~x.startswith("//") & ~x.startswith("#"))
    return F.size(code)


def template_names(text: Column) -> Column:
    """Names in ``{{name}}`` in the order in which they come first."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\{\{(\w+)\}\}"), F.lit(1)))


def rendered(template: Column, values: Mapping[str, Column]) -> Column:
    """A template with each ``{{name}}`` replaced."""
    return reduce(lambda t, kv: F.replace(t, F.lit("{{%s}}" % kv[0]), kv[1]), values.items(), template)


def escaped_for_search(text: Column) -> Column:
    """Every character that search syntax gives a meaning gets one backslash."""
    return F.regexp_replace(text, r'([\\+\-&|!(){}\[\]^"~*?:/])', r"\\$1")


# --- buckets and scores -----------------------------------------------------------------------------------


def laddered(value: Column, steps: Iterable[tuple[float, object]], otherwise: object) -> Column:
    """The first result whose bound is above the value; ``otherwise`` beyond all of them."""
    out = None
    for bound, result in steps:
        out = F.when(value < bound, F.lit(result)) if out is None else out.when(value < bound, F.lit(result))
    return out.otherwise(F.lit(otherwise))


def recency(age_days: Column) -> Column:
    return F.when(age_days.isNull(), 0.5).otherwise(
        laddered(age_days, [(1, 1.0), (7, 0.8), (30, 0.5), (90, 0.3)], 0.1)
    )


def importance(access: Column, edit: Column, selected: Column, discussed: Column, recent: Column) -> Column:
    weighed = 0.1 * access + 0.3 * edit + 0.2 * selected + 0.2 * discussed + 0.2 * recent
    return weighed / (access + edit + selected + discussed + 1)


def co_edit_strength(times: Column) -> Column:
    return F.least(F.lit(0.95), 0.3 * F.log(times + 1))


def letter_grade(score: Column) -> Column:
    return laddered(score, [(60, "F"), (70, "D"), (80, "C"), (90, "B")], "A")


def penalty_score(counts: Mapping[str, Column], weights: Mapping[str, float]) -> Column:
    """Ten less the weight of every issue, not below zero."""
    return F.greatest(F.lit(0.0), 10.0 - sum((weights[k] * c for k, c in counts.items()), F.lit(0.0)))


def age_weight(age_hours: Column) -> Column:
    """3 within a day, 2 within a week, 1 beyond."""
    return F.when(age_hours <= 24, 3).when(age_hours <= 168, 2).otherwise(1)


def learned_score(score: Column, importance_: Column, reward: Column) -> Column:
    return score * (1 + 0.5 * importance_) * (1 + 0.2 * reward)


def guarded_rate(good: Column, total: Column, default: float = 0.5) -> Column:
    return F.when(total > 0, good / total).otherwise(F.lit(default))


def luminance(color: Column) -> Column:
    """Relative luminance of ``#rrggbb`` or ``#rgb``; 0 for anything else."""
    plain = F.regexp_replace(F.lower(color), "^#", "")
    six = F.when(F.length(plain) == 3, F.regexp_replace(plain, "(.)(.)(.)", "$1$1$2$2$3$3")).otherwise(plain)

    def channel(at: int) -> Column:
        x = F.conv(F.substring(six, at, 2), 16, 10).cast("double") / 255
        return F.when(x <= 0.03928, x / 12.92).otherwise(F.pow((x + 0.055) / 1.055, 2.4))

    value = 0.2126 * channel(1) + 0.7152 * channel(3) + 0.0722 * channel(5)
    return F.when(six.rlike("^[0-9a-f]{6}$"), value).otherwise(F.lit(0.0))


def contrast(a: Column, b: Column) -> Column:
    x, y = luminance(a), luminance(b)
    return (F.greatest(x, y) + 0.05) / (F.least(x, y) + 0.05)


def mapped(value: Column, table: Mapping[str, object], otherwise: object = None) -> Column:
    out = reduce(lambda w, kv: w.when(value == kv[0], F.lit(kv[1])), table.items(), F.when(F.lit(False), F.lit(otherwise)))
    return out.otherwise(F.lit(otherwise))


Body = Callable[[Column], Column]


# --- code and queries -------------------------------------------------------------------------------------


def deepest_indent(text: Column, width: int = 4) -> Column:
    indents = F.transform(F.split(text, "\n"), lambda x: F.floor(F.length(F.regexp_extract(x, "^( *)", 1)) / width))
    return F.coalesce(F.array_max(indents), F.lit(0))


def colors_by_line(pages: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, color): each line's distinct hex, rgb() and rgba() colours. Only lines that have some become rows."""
    pattern = r"#[0-9a-f]{6}\b|#[0-9a-f]{3}\b|rgba?\([^)]*\)"
    found = F.transform(
        F.split(F.lower(F.col(text)), "\n"),
        lambda x, i: F.struct((i + 1).alias("line"), F.array_distinct(F.regexp_extract_all(x, F.lit(pattern), F.lit(0))).alias("_c")),
    )
    rows = pages.select(key, F.inline(F.filter(found, lambda x: F.size(x["_c"]) > 0)))
    return rows.select(key, "line", F.explode("_c").alias("color"))


def slug(text: Column, words: int = 3) -> Column:
    return F.array_join(F.slice(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""), 1, words), "-")


def bucket(key: Column, percent: int) -> Column:
    """Whether a key falls in the test share; the same key always does or never."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long") % 100 < percent


def fused_score(semantic: Column, graph: Column, semantic_weight: float) -> Column:
    return semantic_weight * semantic + (1 - semantic_weight) * graph


def progress(elapsed: Column, estimate: Column) -> tuple[Column, Column]:
    """(percent, seconds left): at most 99 before the end, and never less than none left."""
    share = F.when(estimate > 0, 100.0 * elapsed / estimate).otherwise(F.lit(0.0))
    return F.least(F.lit(99.0), share), F.greatest(F.lit(0.0), estimate - elapsed)


def imports(text: Column) -> Column:
    """Modules that Python's or JavaScript's import lines name, in order, each once."""
    pattern = r"(?m)^\s*(?:import .* from ['\"]([^'\"]+)['\"]|from\s+([\w.]+)\s+import|import\s+([\w.]+))"
    found = [F.regexp_extract_all(text, F.lit(pattern), F.lit(k)) for k in (1, 2, 3)]
    return F.array_distinct(F.filter(F.transform(F.arrays_zip(*found), lambda x: F.concat(x["0"], x["1"], x["2"])), lambda m: m != ""))


def metadata(columns: list[str]) -> Column:
    """``name=value`` of every column that isn't null, in order of the names."""
    return F.array_sort(F.array_compact(F.array(*[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in columns])))


def ladder(text: Column, steps: tuple[tuple[str, str], ...], default: str) -> Column:
    """The name of the first keyword that the text holds."""
    out = F.when(F.lit(False), default)
    for keyword, name in steps:
        out = out.when(F.contains(text, F.lit(keyword)), name)
    return out.otherwise(default)


def nearest_name(name: Column, known: tuple[str, ...], most: int) -> Column:
    """Of the known names within ``most`` edits the nearest, of equal ones the first in the alphabet; else null."""
    measured = [F.struct(F.levenshtein(name, F.lit(k)).alias("d"), F.lit(k).alias("k")) for k in known]
    return F.array_min(F.filter(F.array(*measured), lambda x: x["d"] <= most))["k"]


def execution_estimate(mean: Column, n: Column, guess: Column, sure: Column, late: Column, early: Column) -> tuple[Column, Column]:
    """(duration, confidence): measured means weigh more from ten runs on; a trend beyond a tenth counts a tenth."""
    mixed = F.when(n >= 10, 0.7 * mean + 0.3 * guess).otherwise(0.5 * mean + 0.5 * guess)
    trend = F.when(late > 1.1 * early, 1.1).when(late < 0.9 * early, 0.9).otherwise(1.0)
    return mixed * trend, F.least(sure + F.least(2 * n, F.lit(30)), F.lit(98))


def off_scale(text: Column, pattern: str, allowed: tuple[int, ...]) -> Column:
    """The distinct numbers that the pattern finds and the scale doesn't have, in order."""
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda x: x.cast("int"))
    return F.array_sort(F.array_except(found, F.array(*map(F.lit, allowed))))


def words_after(text: Column, keywords: tuple[str, ...], most: int) -> Column:
    """The word after each keyword's first occurrence, as far as there is one; at most ``most``."""
    found = F.array(*[F.regexp_extract(text, rf"\b{k}\s+(\w+)", 1) for k in keywords])
    return F.slice(F.filter(found, lambda x: x != ""), 1, most)


def topics(text: Column, known: tuple[tuple[str, tuple[str, ...]], ...]) -> Column:
    """The topics any of whose keywords the text holds, in the order of the list."""
    small = F.lower(text)
    named = []
    for name, keywords in known:
        hit = F.lit(False)
        for k in keywords:
            hit = hit | F.contains(small, F.lit(k))
        named.append(F.when(hit, name))
    return F.array_compact(F.array(*named))
