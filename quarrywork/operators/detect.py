"""Rule tables over the lines of texts: detectors, validators and reviews are data, the operator is one."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import let


@dataclass(frozen=True)
class Rule:
    """A line that ``regex`` finds is a finding of this kind. ``language`` restricts it to texts in it."""

    id: str
    regex: str
    type: str
    severity: str = "medium"
    language: str | None = None
    confidence: float = 1.0
    positive: bool = True


def detect(
    docs: DataFrame, key: str, text: str, rules: Iterable[Rule], language: str | None = None, around: int = 5
) -> DataFrame:
    """(key, rule, type, severity, line, context, confidence, positive): a row for each line and rule that fits.

    All rules' patterns as one alternative pick the lines, inside the row; only these become rows, and only these
    are held against each rule. The context is the lines around a finding.
    """
    rules = list(rules)
    schema = "rule string, type string, severity string, confidence double, positive boolean"
    if not rules:
        return docs.select(key).limit(0).selectExpr(f"`{key}`", "0 AS line", "'' AS context", *_nothing(schema))
    any_rule = "|".join(f"(?:{r.regex})" for r in rules)
    placed = F.transform(F.split(text, "\n"), lambda x, i: F.struct((i + 1).alias("line"), x.alias("found")))
    lines = docs.select(
        key,
        *([language] if language else []),
        F.split(text, "\n").alias("_all"),
        F.inline(F.filter(placed, lambda x: x["found"].rlike(any_rule))),
    )
    hits = [
        F.when(
            F.col("found").rlike(r.regex) & (F.lit(True) if r.language is None or not language else F.col(language) == r.language),
            F.struct(
                F.lit(r.id).alias("rule"), F.lit(r.type).alias("type"), F.lit(r.severity).alias("severity"),
                F.lit(r.confidence).alias("confidence"), F.lit(r.positive).alias("positive"),
            ),
        )
        for r in rules
    ]
    first = F.greatest(F.lit(1), F.col("line") - around)
    context = F.array_join(F.slice("_all", first, F.col("line") + around - first + 1), "\n")
    return lines.select(key, "line", context.alias("context"), F.inline(F.array_compact(F.array(*hits))))


#: What a line's words are, in lower case; more words than this in one rule table are an error.
TOKEN = "[a-z0-9_]+"
MOST_WORDS = 200_000


def detect_by_words(
    docs: DataFrame, key: str, text: str, rules: DataFrame, language: str | None = None, around: int = 5
) -> DataFrame:
    """As :func:`detect`, for hundreds or thousands of rules that are rows: (rule, regex, words, type, severity, confidence,
    positive and, with ``language``, language, null for any). ``words`` are such that a line without any of them, whole
    and in any case, can't match; a rule without words is an error.

    An inverted index: of a text's words those that any rule needs are found by one look-up each, a line is kept if it has
    one of them, and only the rules that a line's words name are tried on it. So a text costs the same with few rules
    and with many, and neither a text nor a line without a rule's word moves or becomes a row. All rules' words are one
    row of at most ``MOST_WORDS``, which is sent to every task; the rules themselves are joined by word.
    A null text has no finding; a rule fits a line once.
    """
    lower = F.transform("words", lambda w: F.lower(w))
    checked = F.when(F.size(F.coalesce(lower, F.array())) > 0, lower).otherwise(F.raise_error(F.lit("a rule needs words")))
    rules = rules.withColumn("_of", checked)
    known = rules.select(F.explode("_of").alias("_w")).agg(F.collect_set("_w").alias("_known"))
    few = F.when(F.size("_known") <= MOST_WORDS, F.col("_known")).otherwise(F.raise_error(F.lit("too many words of rules")))
    words = lambda x: F.regexp_extract_all(F.lower(x), F.lit(TOKEN), F.lit(0))

    def lines(all_: Column, present: Column) -> Column:
        tokens = F.transform(all_, lambda x, i: F.struct((i + 1).alias("line"), x.alias("_found"), F.array_intersect(words(x), present).alias("_has")))

        def told(x: Column) -> Column:
            first = F.greatest(F.lit(1), x["line"] - around)
            context = F.array_join(F.slice(all_, first, x["line"] + around - first + 1), "\n")
            return F.struct(x["line"].alias("line"), x["_found"].alias("_found"), x["_has"].alias("_has"), context.alias("context"))

        return F.transform(F.filter(tokens, lambda x: F.size(x["_has"]) > 0), told)

    own = [F.col(language).alias("_language")] if language else []
    rows = docs.select(F.col(key), *own, F.col(text).alias("_text")).crossJoin(F.broadcast(known.select(few.alias("_known"))))
    present = F.array_intersect(words(F.col("_text")), F.col("_known"))
    placed = let(present, lambda p: F.when(F.size(p) > 0, let(F.split("_text", "\n"), lambda all_: lines(all_, p))))
    found = rows.select(key, *(["_language"] if language else []), F.inline(placed))
    asked = found.select("*", F.explode("_has").alias("_word"))
    listed = rules.select(
        "rule", "type", "severity", "confidence", "positive", F.col("regex").alias("_regex"), "_of",
        *([F.col("language").alias("_only")] if language else []), F.explode(F.array_distinct("_of")).alias("_word"))
    once = F.try_element_at(F.array_intersect("_has", "_of"), F.lit(1)) == F.col("_word")
    fits = once & F.rlike(F.col("_found"), F.col("_regex"))
    if language:
        fits = fits & (F.col("_only").isNull() | (F.col("_only") == F.col("_language")))
    return asked.join(listed, "_word").filter(fits).select(key, "rule", "type", "severity", "line", "context", "confidence", "positive")


def _nothing(schema: str) -> list[str]:
    return [f"CAST(NULL AS {t}) AS {n}" for n, t in (c.split() for c in schema.split(", "))]


def score(findings: DataFrame, key: str, weights: dict[str, float]) -> DataFrame:
    """(key, issues, score): ten less the weight of each finding's severity, not below zero."""
    weight = F.coalesce(*[F.when(F.col("severity") == k, F.lit(v)) for k, v in weights.items()], F.lit(0.0))
    rolled = findings.groupBy(key).agg(F.count("*").alias("issues"), F.sum(weight).alias("_w"))
    return rolled.select(key, "issues", F.greatest(F.lit(0.0), 10 - F.col("_w")).alias("score"))


def missing(docs: DataFrame, key: str, found: DataFrame, types: Iterable[str]) -> DataFrame:
    """(key, type) of the required types that a text has no finding of."""
    wanted = docs.select(key, F.explode(F.array(*map(F.lit, types))).alias("type"))
    return wanted.join(found.select(key, "type").distinct(), [key, "type"], "anti")


def task_failures(checks: dict[str, Column]) -> Column:
    """The names of the checks that a task's target fails, in order; without any it is valid."""
    return F.array_compact(F.array(*[F.when(failed, name) for name, failed in checks.items()]))
