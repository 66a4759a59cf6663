"""Quality rules as a learned decision list. DataFrame functions only on the path of the documents.

Base statistics come from whole texts with built-in functions. On labelled documents, a bounded sample, sequential
covering learns rules for bad documents: a rule grows, one threshold condition at a time, on two thirds of the
rows to the best FOIL gain, and is pruned back, condition by condition from its end, as long as that helps on the
other third. Rows that a rule covers are taken away and the next one is learned, until none is precise enough. The
rules, in their order, become one ``CASE WHEN`` expression that Spark evaluates in the scan.

For learning, each statistic is cut at quantiles that Spark computes, and the rows are aggregated to counts of equal
cuts and label, which is all that the driver sees.

Defined cases: a null, empty or blank text has no words and fails the base rules. Repeated rows are judged alike;
other columns pass through untouched, but for
those named like a result, which it replaces. Without labels of both kinds there are no rules and only the base rules drop.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, drop_table, sample_rows, table

#: Labelled rows that rules are learned on, at most; cuts of a statistic; rules and conditions of a list.
LABELLED_ROWS = 20_000
CUTS, MAX_RULES, MAX_CONDITIONS = 24, 8, 3
#: A rule must cover this many rows and be right about this share of them, on the rows that prune it too.
MIN_ROWS, MIN_PRECISION = 10, 0.85
SPACE = " \t\n\x0b\x0c\r"
RUN = 8

Condition = tuple[str, str, float]  # statistic, ">=" or "<", threshold


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _words(text: Column) -> Column:
    """The words as an array; empty without a word."""
    inner = F.btrim(text, F.lit(SPACE))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, r"[\x20\x09-\x0D]+"))


def _run_hashes(hashes: Column) -> Column:
    """A hash of every run of eight words."""
    return F.transform(F.sequence(F.lit(1), F.size(hashes) - RUN + 1), lambda i: F.xxhash64(F.slice(hashes, i, RUN)))


def _repeated_places(placed: Column) -> Column:
    """The places, in order, of runs that equal a neighbour in the order of their hashes."""
    last = F.size(placed) - 1

    def place(run: Column, i: Column) -> Column:
        before, after = placed[F.greatest(i - 1, F.lit(0))]["h"], placed[F.least(i + 1, last)]["h"]
        return F.when(((i > 0) & (before == run["h"])) | ((i < last) & (after == run["h"])), run["i"])

    return F.sort_array(F.filter(F.transform(placed, place), lambda x: x.isNotNull()))


def _covered_words(places: Column) -> Column:
    """Words under runs of eight that begin at these places, each counted once."""
    end = F.size(places) - 1

    def own(p: Column, i: Column) -> Column:
        return F.when(i < end, F.least(F.lit(RUN), places[F.least(i + 1, end)] - p)).otherwise(F.lit(RUN))

    return F.aggregate(F.transform(places, own), F.lit(0), lambda s, x: s + x)


def _repeat_words(words: Column) -> Column:
    """Words in runs of eight that occur twice or more. Only where a run repeats are places sorted."""
    sort = lambda runs: F.sort_array(F.transform(runs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    counted = lambda runs: F.when(
        F.size(F.array_distinct(runs)) < F.size(runs),
        _let(sort(runs), lambda placed: _let(_repeated_places(placed), _covered_words)),
    ).otherwise(F.lit(0))
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(
        F.size(words) > RUN, _let(hashes, lambda h: _let(_run_hashes(h), counted))
    ).otherwise(F.lit(0))


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words, and the shares for learning.

    All are made in one generator of one row, below which no filter on them is pushed, so a text is read once.
    """
    docs = docs.drop(*(c for c in docs.columns if c in {*BASE, *LEARNED} and c != text))
    value = F.coalesce(F.col(text), F.lit(""))
    without = lambda chars: F.length(value) - F.length(F.translate(value, chars, ""))
    lines = F.filter(F.split(value, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")

    def row(w: Column, lines: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.translate(value, SPACE, "")).cast("long").alias("word_chars"),
            without("#*$%&|<>").cast("long").alias("n_symbols"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            _repeat_words(w).cast("long").alias("n_repeat_words"),
            F.size(F.array_distinct(w)).alias("_kinds"),
            F.size(lines).alias("_lines"),
            without("!").alias("_bangs"),
            without("ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("_capitals"),
            without("0123456789").alias("_digits"),
        )

    made = _let(_words(value), lambda w: _let(lines, lambda l: row(w, l)))
    counted = docs.select("*", F.inline_outer(F.array(made)))
    n = F.greatest(F.col("n_words"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    shares = {
        "mean_word": F.col("word_chars") / n,
        "symbol_share": F.col("n_symbols") / n,
        "bang_share": F.col("_bangs") / n,
        "capital_share": F.col("_capitals") / chars,
        "digit_share": F.col("_digits") / chars,
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("_lines"), F.lit(1)),
        "repeat_share": F.col("n_repeat_words") / n,
        "kinds_share": F.col("_kinds") / n,
    }
    return counted.withColumns(shares).drop("_kinds", "_lines", "_bangs", "_capitals", "_digits")


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
LEARNED = (
    "n_words", "mean_word", "symbol_share", "bang_share", "capital_share", "digit_share", "dup_line_share",
    "repeat_share", "kinds_share",
)


@dataclass(frozen=True)
class Rule:
    """All of its conditions hold for a bad document."""

    conditions: tuple[Condition, ...]
    rows: int
    precision: float

    def column(self) -> Column:
        out = F.lit(True)
        for name, sign, threshold in self.conditions:
            out = out & ((F.col(name) >= threshold) if sign == ">=" else (F.col(name) < threshold))
        return out


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def verdict(rules: list[Rule]) -> Column:
    """The decision list as one ordered expression: whether the document is bad."""
    out = F.when(F.lit(False), True)
    for rule in rules:
        out = out.when(rule.column(), True)
    return F.coalesce(out.otherwise(False), F.lit(False))


# --- learning ---------------------------------------------------------------------------------------------


def _covered(cells: list[tuple], conditions: list[tuple[int, str, int]]) -> list[tuple]:
    return [c for c in cells if all((c[0][f] >= k) == (sign == ">=") for f, sign, k in conditions)]


def _counts(cells: list[tuple]) -> tuple[int, int]:
    return sum(c[2] for c in cells), sum(c[3] for c in cells)


def learn(
    cells: list[tuple], max_rules: int = MAX_RULES, max_conditions: int = MAX_CONDITIONS
) -> list[tuple[list[tuple[int, str, int]], int, float]]:
    """Sequential covering over cells (cut of each statistic, whether they prune, bad rows, good rows).

    A condition (f, ">=", k) holds where the f-th statistic's cut is k or more.
    """
    rules = []
    while len(rules) < max_rules:
        grow, prune = [c for c in cells if not c[1]], [c for c in cells if c[1]]
        conditions: list[tuple[int, str, int]] = []
        inside = grow
        while len(conditions) < max_conditions:
            bad, good = _counts(inside)
            if not bad or not good:
                break
            before = math.log2(bad / (bad + good))
            best = None
            for f in range(len(inside[0][0])):
                by_cut: dict[int, list[int]] = {}
                for c in inside:
                    at = by_cut.setdefault(c[0][f], [0, 0])
                    at[0] += c[2]
                    at[1] += c[3]
                low_bad = low_good = 0
                for k in sorted(by_cut)[1:]:
                    below = max(j for j in by_cut if j < k)
                    low_bad, low_good = low_bad + by_cut[below][0], low_good + by_cut[below][1]
                    for sign, b, g in ((">=", bad - low_bad, good - low_good), ("<", low_bad, low_good)):
                        if b >= MIN_ROWS:
                            gain = b * (math.log2(b / (b + g)) - before)
                            if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                                best = gain, (f, sign, k)
            if best is None:
                break
            conditions.append(best[1])
            inside = _covered(grow, conditions)
        value = lambda some: (lambda b, g: (b - g) / max(1, b + g))(*_counts(_covered(prune, some)))
        while len(conditions) > 1 and value(conditions[:-1]) >= value(conditions):
            conditions.pop()
        if not conditions:
            break
        checked, all_rows = _counts(_covered(prune, conditions)), _counts(_covered(cells, conditions))
        sure = lambda b, g: b + g > 0 and b / (b + g) >= MIN_PRECISION
        if not sure(*all_rows) or not (sure(*checked) or not sum(checked)) or sum(all_rows) < MIN_ROWS:
            break
        rules.append((conditions, sum(all_rows), all_rows[0] / sum(all_rows)))
        gone = {id(c) for c in _covered(cells, conditions)}
        cells = [c for c in cells if id(c) not in gone]
    return rules


def _at_most(name: str) -> Callable[[Column], Column]:
    return lambda t: t <= F.col(name)


def train(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> list[Rule]:
    """Rules from at most ``rows`` labelled documents that pass the base rules, each text counted once."""
    known = labels.filter(F.col("quality").isNotNull()).groupBy("doc_id").agg((F.min("quality") == 0).alias("bad"))
    known = docs.select("doc_id").dropDuplicates().join(known, "doc_id")
    chosen = cut(sample_rows(known, "doc_id", rows, "bad"), "quality-sample")
    # at most ``rows`` narrow rows: a bounded broadcast
    told = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["text", "bad"])
    prunes = F.pmod(F.xxhash64(F.lit("prune"), "doc_id"), F.lit(3)) == 0
    table_ = cut(
        statistics(told).filter(~base_failed()).select("bad", prunes.alias("prunes"), *LEARNED), "quality-statistics"
    )
    shares = [i / CUTS for i in range(1, CUTS)]
    # cuts are midway between neighbouring quantiles of bad and of good rows, so rare values have some too
    found = table_.groupBy("bad").agg(
        *[F.percentile(F.col(c).cast("double"), F.array(*map(F.lit, shares))).alias(c) for c in LEARNED]
    )
    quantiles = found.collect()
    values = {c: sorted({float(q) for r in quantiles for q in r[c] or []}) for c in LEARNED}
    thresholds = {c: [(a + b) / 2 for a, b in zip(v, v[1:])] for c, v in values.items()}
    cut_of = [
        F.size(F.filter(F.array(*map(F.lit, thresholds[c])).cast("array<double>"), _at_most(c))).alias(f"_{i}")
        for i, c in enumerate(LEARNED)
    ]
    grouped = table_.select("bad", "prunes", *cut_of).groupBy("prunes", *[f"_{i}" for i in range(len(LEARNED))])
    counts = grouped.agg(F.count_if("bad").alias("bad"), F.count_if(~F.col("bad")).alias("good")).collect()
    cells = [(tuple(r[f"_{i}"] for i in range(len(LEARNED))), r.prunes, r.bad, r.good) for r in counts]
    cells.sort(key=lambda c: (c[0], c[1]))
    drop_table(chosen)
    drop_table(table_)
    return [
        Rule(tuple((LEARNED[f], sign, thresholds[LEARNED[f]][k - 1]) for f, sign, k in conditions), n, precision)
        for conditions, n, precision in learn(cells)
    ]


def judge(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """``docs`` with the base statistics, base_failed and kept. One pass, no shuffle."""
    own = [c for c in docs.columns if c not in {*BASE, *LEARNED, "base_failed", "kept"}]
    judged = statistics(docs.select(*own), text).withColumn("base_failed", base_failed())
    return judged.withColumn("kept", ~F.col("base_failed") & ~verdict(rules)).select(*own, *BASE, "base_failed", "kept")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = train(docs, table(spark, sf_dir, "labels"))
    return judge(docs, rules).drop("text")
