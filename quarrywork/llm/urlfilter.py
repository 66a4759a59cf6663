"""URL filters by association rules. DataFrame functions only; Spark's FP-growth does the mining.

A url's tokens are those of its host and path. FP-growth mines token combinations from two thirds of the labelled urls, a
row's token ``=bad`` standing for its label. Rules of at most ``MOST_TOKENS`` tokens that lead to it are pruned by
confidence, support and lift over the share of bad urls; one whose tokens include those of another rule with at least
its confidence is redundant and goes; one that isn't as sure on the other third of the urls goes too. What is left is
matched by an inverted index, from each token to the rules that need it: a rule matches a url that has as many
of its tokens as it has. Up to ``INLINE_RULES`` rules the index is a literal map and matching moves nothing; beyond
that, tokens are joined with it.

A list of host and path rules, whose longest match wins, is judged before these.

Labels: the number in a url's path names the document that the page was made from; the label is bad where that
document has quality 0 or is toxic. A fixed fold of documents isn't needed, as labels are no input of a match.

Defined cases: a null url and one without ``://`` have empty host and path, no tokens and the verdict allow. Repeated rows
are judged alike. Without labels, or without rules that are sure enough, nothing but the list blocks. Of several
matches any blocks. Of equally long list rules that fit, the later one in the list counts. A url of any length is read
whole; mining takes all its tokens. Empty tables give no rows. Other columns aren't read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, drop_table, sample_rows, table

#: The list that the query judges by: (host, path, verdict).
LIST = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
BAD = "=bad"
#: Labelled urls that rules are learned on, at most.
LABELLED_ROWS = 50_000
#: Share and number of the mined urls that a rule holds for, its confidence, and how many times the share of bad urls
#: this must be; urls of the other third that must confirm it.
MIN_SUPPORT, MIN_ROWS, MIN_CONFIDENCE, MIN_LIFT, CONFIRMING_ROWS = 0.001, 20, 0.5, 1.5, 10
#: Tokens of a rule.
MOST_TOKENS = 3
#: Tokens of a row that FP-growth gets at once, at most: sets of so many are listed.
TOGETHER = 9
#: Rules that fit a literal index.
INLINE_RULES = 2000


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def tokens_of(host: Column, path: Column) -> Column:
    """Distinct tokens, one for one fact: labels of the host, parts of those that have a hyphen, and words of the path.
    Numbers in a path are no tokens but for there being one."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    parts = F.filter(F.flatten(F.transform(F.filter(labels, lambda x: x.contains("-")), lambda x: F.split(x, "-"))), lambda x: x != "")
    words = F.filter(F.split(F.lower(path), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    return F.array_distinct(
        F.concat(
            F.transform(labels, lambda x: F.concat(F.lit("host:"), x)),
            F.transform(parts, lambda x: F.concat(F.lit("part:"), x)),
            F.transform(words, lambda x: F.concat(F.lit("path:"), F.regexp_replace(x, r"^\d+$", "#"))),
        )
    )


@dataclass(frozen=True)
class Rule:
    tokens: tuple[str, ...]
    confidence: float
    support: float


def _subsets(of: str, most: int = MOST_TOKENS) -> Column:
    """All sets of one to three entries of a sorted array."""
    found = [F.transform(of, lambda x: F.array(x))]
    for _ in range(most - 1):
        longer = lambda s: F.transform(F.filter(of, lambda y: y > F.element_at(s, -1)), lambda y: F.array_append(s, y))
        found.append(F.flatten(F.transform(found[-1], longer)))
    return F.concat(*found)


def projections(rows: DataFrame, parts: int) -> DataFrame:
    """(part, tokens, bad): each row once for every set of at most three of the ``parts`` that its tokens fall in, with its
    tokens of these. A set of tokens is counted in the projection on just the parts that its own tokens fall in, in each row that has
    it, so the counts are those of whole rows."""
    placed = rows.withColumn("_parts", F.array_sort(F.array_distinct(F.transform("tokens", lambda t: _part(t, parts)))))
    each = placed.select("tokens", "bad", F.explode(_subsets("_parts")).alias("part"))
    return each.withColumn("tokens", F.filter("tokens", lambda t: F.array_contains("part", _part(t, parts))))


def _part(token: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(parts)).cast("int")


def _load(parts: int) -> Column:
    """The most tokens that a row has in three parts."""
    parts_of = F.transform("tokens", lambda t: _part(t, parts))
    counts = F.transform(F.array_distinct(parts_of), lambda p: F.size(F.filter(parts_of, lambda x: x == p)))
    return F.aggregate(F.slice(F.sort_array(counts, asc=False), 1, MOST_TOKENS), F.lit(0), lambda a, x: a + x)


def candidates(mined: DataFrame, rows: int, min_support: float, min_rows: int, least: float) -> DataFrame:
    """(tokens, confidence, support) of the rules of at most :data:`MOST_TOKENS` tokens that FP-growth finds in rows of
    (tokens, bad), without redundant ones.

    FP-growth lists every frequent set, of n tokens that come together 2**n. So tokens that are too rare with the label to be in a rule go
    first, tokens that come in the same rows are one, and rows are projected onto as many parts as bound a projection's tokens: the sets that are listed then are few for each
    projection, however long the urls, and the projections of a row grow with the cube of its tokens, as its sets of three do.
    """
    # a rule is counted where it leads to a bad url, so its rows are those with the label
    often = max(1, math.ceil(round(min(1.0, max(min_support, min_rows / rows) * least) * rows, 6)))
    single = mined.filter("bad").select(F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").count().filter(F.col("count") >= often)
    numbered = mined.withColumn("_row", F.monotonically_increasing_id())
    exploded = cut(numbered.select("_row", "bad", F.explode(F.array_distinct("tokens")).alias("token")).join(single, "token"), "tokens")
    rows_of = (F.sum(F.xxhash64("_row", F.lit(i)).cast("decimal(20,0)")).alias(f"_rows{i}") for i in range(2))
    alike = exploded.groupBy("token").agg(*rows_of).groupBy("_rows0", "_rows1").agg(F.array_sort(F.collect_list("token")).alias("members"))
    alike = cut(alike.select("members"), "alike")
    one = alike.select(F.col("members")[0].alias("token"))
    able = cut(exploded.join(one, "token").groupBy("_row", "bad").agg(F.array_sort(F.collect_list("token")).alias("tokens")), "able")
    drop_table(exploded)
    parts = 1
    while (able.agg(F.max(_load(parts))).first()[0] or 0) > TOGETHER:
        parts *= 2
    split = projections(able, parts)
    tag = lambda t: F.concat(F.array_join(F.col("part").cast("array<string>"), "."), F.lit("|"), t)
    items = F.transform(F.when(F.col("bad"), F.array_append("tokens", F.lit(BAD))).otherwise(F.col("tokens")), tag)
    items = cut(split.select("part", items.alias("items")), "projections")
    n = max(1, items.count())
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, (often - 0.5) / n), minConfidence=least).fit(items)
    untagged = F.transform("antecedent", lambda t: F.regexp_replace(t, r"^[\d.]+\|", ""))
    rules = model.associationRules.filter(F.col("consequent")[0].endswith("|" + BAD) & (F.size("antecedent") <= MOST_TOKENS))
    rules = rules.select(F.regexp_extract(F.col("antecedent")[0], r"^[\d.]+", 0).alias("_part"), F.sort_array(untagged).alias("tokens"), "confidence", (F.col("support") * n / rows).alias("support"))
    own = F.array_join(F.array_sort(F.array_distinct(F.transform("tokens", lambda t: _part(t, parts)))).cast("array<string>"), ".")
    rules = rules.filter((own == F.col("_part")) & (F.round(F.col("support") * rows) >= often)).drop("_part")
    rules = rules.filter(F.round(F.col("support") / F.col("confidence") * rows) >= max(min_rows, min_support * rows))
    pairs = lambda x, i: F.transform(F.slice("tokens", i + 2, F.lit(MOST_TOKENS)), lambda y: F.array(x, y))
    subsets = F.concat(F.transform("tokens", lambda x: F.array(x)), F.flatten(F.transform("tokens", pairs)))
    inner = rules.select("tokens", "confidence", F.explode(subsets).alias("_subset")).filter(F.size("_subset") < F.size("tokens"))
    other = rules.select(F.col("tokens").alias("_subset"), F.col("confidence").alias("_confidence"))
    redundant = inner.join(other, "_subset").filter("_confidence >= confidence").select("tokens")
    rules = rules.join(redundant, "tokens", "anti")
    # each token of a rule stands for all that come in just its rows
    spelled = rules.select("tokens", "confidence", "support", F.posexplode("tokens").alias("_i", "_token"))
    spelled = spelled.join(alike.withColumn("_token", F.col("members")[0]), "_token")
    spelled = spelled.groupBy("tokens", "confidence", "support").agg(F.collect_list("members").alias("_members"))
    append = lambda done, members: F.flatten(F.transform(done, lambda d: F.transform(members, lambda m: F.array_append(d, m))))
    every = F.aggregate("_members", F.array(F.array().cast("array<string>")), append)
    return spelled.select(F.explode(every).alias("tokens"), "confidence", "support").withColumn("tokens", F.array_sort("tokens"))


def mine(
    labelled: DataFrame,
    min_support: float = MIN_SUPPORT,
    min_confidence: float = MIN_CONFIDENCE,
    min_rows: int = MIN_ROWS,
    min_lift: float = MIN_LIFT,
    confirming_rows: int = CONFIRMING_ROWS,
) -> list[Rule]:
    """Rules from rows of (tokens, bad, confirms), in the order of their tokens. Only what all pruning leaves reaches the
    driver. Without rows that confirm, or with 0 ``confirming_rows``, rules aren't held against others."""
    mined = labelled.filter(~F.col("confirms"))
    n = mined.agg(F.count("*").alias("rows"), F.count_if("bad").alias("bad")).first()
    if not n.bad:
        return []
    least = max(min_confidence, min(1.0, min_lift * n.bad / n.rows))
    rules = candidates(mined, n.rows, min_support, min_rows, least)
    if confirming_rows:
        inside = F.size(F.array_except("_rule", "tokens")) == 0
        of_rules = rules.select(F.col("tokens").alias("_rule"), F.col("tokens")[0].alias("_first"))
        others = labelled.filter("confirms").select("tokens", "bad", F.explode("tokens").alias("_first"))
        held = others.join(of_rules, "_first").filter(inside).groupBy(F.col("_rule").alias("tokens"))
        held = held.agg(F.count("*").alias("_rows"), F.avg(F.col("bad").cast("double")).alias("_held"))
        rules = rules.join(held.filter((F.col("_rows") >= confirming_rows) & (F.col("_held") >= least)), "tokens")
    found = sorted(rules.select("tokens", "confidence", "support").collect(), key=lambda r: (len(r.tokens), r.tokens))
    return [Rule(tuple(r.tokens), round(r.confidence, 6), round(r.support, 6)) for r in found]


def matches(pages: DataFrame, rules: list[Rule], tokens: str = "tokens", into: str = "matched", inline: int = INLINE_RULES) -> DataFrame:
    """``pages`` with whether any rule's tokens are all among the row's."""
    if not rules:
        return pages.withColumn(into, F.lit(False))
    index: dict[str, list[int]] = {}
    for i, rule in enumerate(rules):
        for token in rule.tokens:
            index.setdefault(token, []).append(i)
    sizes = [len(r.tokens) for r in rules]
    if len(rules) <= inline:
        by_token = F.create_map(*(x for t, ids in index.items() for x in (F.lit(t), F.array(*map(F.lit, ids)))))
        lengths = F.array(*map(F.lit, sizes))
        hits = F.flatten(F.transform(F.col(tokens), lambda t: F.coalesce(F.try_element_at(by_token, t), F.array().cast("array<int>"))))
        needed = lambda r: F.element_at(lengths, r + 1)
        full = F.exists(F.array_distinct(hits), lambda r: F.size(F.filter(hits, lambda h: h == r)) == needed(r))
        return pages.withColumn(into, F.coalesce(full, F.lit(False)))
    spark = pages.sparkSession
    entries = spark.createDataFrame(
        [(t, i, sizes[i]) for t, ids in index.items() for i in ids], "token string, rule int, need int"
    )
    sets = pages.select(F.col(tokens).alias("_set")).distinct()
    hit = (
        sets.select("_set", F.explode("_set").alias("token"))
        .join(entries, "token")
        .groupBy("_set", "rule", "need")
        .count()
        .filter("count = need")
        .select("_set")
        .distinct()
        .withColumn("_hit", F.lit(True))
    )
    whole = pages.select(F.struct(*pages.columns).alias("_row"), F.col(tokens).alias("_set")).join(hit, "_set", "left")
    kept = [F.col("_row")[c].alias(c) for c in pages.columns if c != into]
    return whole.select(*kept, F.coalesce("_hit", F.lit(False)).alias(into))


def listed(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = LIST) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, start, kind in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule = F.when(fits, F.lit(name + start)).otherwise(rule)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def labelled_urls(pages: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> DataFrame:
    """(tokens, bad, confirms) of at most ``rows`` pages whose document has a label. A document's pages are either all mined
    or all confirm."""
    known = (
        labels.filter("quality IS NOT NULL OR toxic IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.max(F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("bad"))
    )
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    numbered = pages.select(
        "page_id",
        tokens_of(host, path).alias("tokens"),
        F.regexp_extract(path, r"/(\d{1,18})(?:[/.]|$)", 1).alias("number"),
    ).filter("number != ''")
    joined = numbered.withColumn("doc_id", F.col("number").cast("long")).join(known, "doc_id")
    confirms = F.pmod(F.xxhash64(F.lit("confirm"), "doc_id"), F.lit(3)) == 0
    return sample_rows(joined.withColumn("confirms", confirms), "page_id", rows, "tokens", "bad", "confirms").drop("page_id")


def judge(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """(page_id, host, path, rule, verdict)"""
    split = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    found = matches(split.withColumn("tokens", tokens_of(F.col("host"), F.col("path"))), rules)
    rule, verdict = listed(F.col("host"), F.col("path"))
    own = F.when(F.col("matched"), F.lit("block")).otherwise(F.lit("allow"))
    return found.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    sample = cut(labelled_urls(pages, table(spark, sf_dir, "labels")), "labelled-urls")
    rules = mine(sample)
    drop_table(sample)
    return judge(pages, rules)
