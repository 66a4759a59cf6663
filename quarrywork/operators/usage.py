"""Usage, latency and importance from append-only event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


#: Ranges that a tool's values are cut into.
RANGES = 64
#: Rows that a task counts in order, on average at most.
AT_ONCE = 500_000


def tool_usage(calls: DataFrame, tool: str, ok: F.Column, ms: str, ts: str, query: str) -> DataFrame:
    """(tool, calls, ok, failed, total_ms, mean_ms, first, last, last_query, n_queries)"""
    return calls.groupBy(F.col(tool).alias("tool")).agg(
        F.count("*").alias("calls"),
        F.count_if(ok).alias("ok"),
        F.count_if(~ok).alias("failed"),
        F.sum(ms).alias("total_ms"),
        F.avg(ms).alias("mean_ms"),
        F.min(ts).alias("first_at"),
        F.max(ts).alias("last_at"),
        F.max_by(query, ts).alias("last_query"),
        F.count_distinct(query).alias("n_queries"),
    )


def latency(calls: DataFrame, tool: str, ms: str) -> DataFrame:
    """(tool, n, least, most, mean, median, p90, p95): the values at floor(n * q) of the sorted ones.

    Equal values are counted first. A tool's values are cut into ranges at rough quantiles, so that the rank within a
    range is a window of that range alone, and what lies before comes from the ranges' sums: a tool that most calls are
    of is dealt to as many tasks as there are ranges, and no tool's values are gathered in one array.
    """
    counts = calls.groupBy(F.col(tool).alias("tool"), F.col(ms).alias("ms")).agg(F.count("*").alias("k"))
    shares = F.array(*[F.lit(i / RANGES) for i in range(1, RANGES)])
    cuts = counts.groupBy(F.col("tool").alias("_t")).agg(F.percentile_approx("ms", shares, F.lit(1000)).alias("_cuts"))
    lies = F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col("ms"))), F.lit(0))
    ranged = counts.join(cuts, F.col("tool").eqNullSafe(F.col("_t"))).select("tool", "ms", "k", lies.alias("_range"))
    sums = ranged.groupBy("tool", "_range").agg(F.sum("k").alias("_k"))
    order = W.partitionBy("tool").orderBy("_range")
    sums = sums.select(
        F.col("tool").alias("_tool"),
        F.col("_range").alias("_r"),
        F.coalesce(F.sum("_k").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_k").over(W.partitionBy("tool")).alias("n"),
    )
    joined = ranged.join(sums, F.col("tool").eqNullSafe(F.col("_tool")) & (F.col("_range") == F.col("_r")))
    inner = W.partitionBy("tool", "_range").orderBy("ms").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = joined.select("tool", "ms", "k", "n", (F.col("_before") + F.sum("k").over(inner)).alias("upto"))

    def nth(share: float) -> F.Column:
        at = F.floor(F.col("n") * share)
        return F.max(F.when((at < F.col("upto")) & (at >= F.col("upto") - F.col("k")), F.col("ms")))

    return placed.groupBy("tool").agg(
        F.max("n").alias("n"),
        F.min("ms").alias("least"),
        F.max("ms").alias("most"),
        F.floor(F.sum(F.col("ms") * F.col("k")) / F.max("n")).alias("mean"),
        nth(0.5).alias("median"),
        nth(0.9).alias("p90"),
        nth(0.95).alias("p95"),
    )


def trend(calls: DataFrame, tool: str, ms: str, *order: F.Column) -> DataFrame:
    """(tool, recent, before, trend): the mean of the last five calls against the five before, within 20 %."""
    rank = F.row_number().over(W.partitionBy(tool).orderBy(*order))
    last = calls.select(F.col(tool).alias("tool"), F.col(ms).alias("ms"), rank.alias("r")).filter("r <= 10")
    means = last.groupBy("tool").agg(
        F.count("*").alias("n"),
        F.avg(F.when(F.col("r") <= 5, F.col("ms"))).alias("recent"),
        F.avg(F.when(F.col("r") > 5, F.col("ms"))).alias("before"),
    )
    kind = (
        F.when(F.col("n") < 10, "insufficient_data")
        .when(F.col("recent") > 1.2 * F.col("before"), "increasing")
        .when(F.col("recent") < 0.8 * F.col("before"), "decreasing")
        .otherwise("stable")
    )
    return means.select("tool", "recent", "before", kind.alias("trend"))


def followed_by(calls: DataFrame, session: str, tool: str, ts: str, least: int = 3) -> DataFrame:
    """(tool, then, times, sessions): pairs of a tool and another that comes later in a session.

    Counted without pairing rows: for each session and tool, the other calls of the session count the earlier ones of that tool,
    which is a running count over the session's calls, one for each of its tools. These are dealt to as many tasks as there are rows
    for, so a task's share doesn't grow with the table.
    """
    names = calls.groupBy(session, tool).agg(F.count("*").alias("_n")).select(F.col(session).alias("_s"), F.col(tool).alias("_first"), "_n")
    at = F.unix_micros(F.col(ts).cast("timestamp")).alias("_at")
    later = calls.filter(F.col(ts).isNotNull()).select(session, F.col(tool).alias("_then"), at)
    # a row for each call and each tool of its session; sessions have few tools
    spread = later.join(names.drop("_n"), F.col(session) == F.col("_s")).select(session, "_first", "_then", "_at")
    tools = names.groupBy("_s").agg(F.sum("_n").alias("_calls"), F.count("*").alias("_tools"))
    rows = tools.agg(F.sum(F.col("_calls") * F.col("_tools"))).first()[0] or 0
    dealt = spread.repartition(max(1, -(-rows // AT_ONCE)), session, "_first")
    before = W.partitionBy(session, "_first").orderBy("_at").rangeBetween(W.unboundedPreceding, -1)
    ahead = F.sum((F.col("_first") == F.col("_then")).cast("long")).over(before)
    counted = dealt.withColumn("_before", F.coalesce(ahead, F.lit(0))).filter("_first <> _then AND _before > 0")
    pairs = counted.groupBy("_first", "_then").agg(F.sum("_before").alias("times"), F.count_distinct(session).alias("sessions"))
    return pairs.filter(F.col("times") >= least).select(F.col("_first").alias("tool"), F.col("_then").alias("then"), "times", "sessions")


def budget(calls: DataFrame, key: str, ts: str, amount: str, seconds: int = 60) -> DataFrame:
    """``calls`` with the sum over the last ``seconds`` before and including each one."""
    window = W.partitionBy(key).orderBy("_micros").rangeBetween(-seconds * 1_000_000 + 1, 0)
    return calls.withColumn("_micros", F.unix_micros(F.col(ts).cast("timestamp"))).withColumn("used", F.sum(amount).over(window)).drop("_micros")


#: (importance, recency, frequency) that a first event of each kind sets; counters that every one adds to.
FIRST = {
    "access": (0.5, 1.0, 0.1),
    "edit": (0.6, 1.0, 0.2),
    "search": (0.5, 0.5, 0.1),
    "selected": (0.6, 1.0, 0.2),
}
COUNTS = {"access": ("access",), "edit": ("edit",), "search": ("search",), "selected": ("access", "search", "selected")}
LATER_COUNTS = {**COUNTS, "selected": ("access", "selected")}


def importance_counts(events: DataFrame, path: str, kind: str, ts: str) -> DataFrame:
    """(path, access, edit, search, selected): counters by kind of event; a first selection also counts as found.

    The saturating scores that go with the counters only depend on how many events of which kind there were and
    which was first, so this is one aggregation and not a fold over each path's events.
    """
    first = F.min_by(kind, F.struct(ts, kind))
    n = {k: F.count_if(F.col(kind) == k) for k in FIRST}
    rolled = events.groupBy(path).agg(first.alias("first_kind"), *[c.alias(f"_{k}") for k, c in n.items()])
    return rolled.select(
        path,
        "first_kind",
        (F.col("_access") + F.col("_selected")).alias("access"),
        F.col("_edit").alias("edit"),
        (F.col("_search") + (F.col("first_kind") == "selected").cast("int")).alias("search"),
        F.col("_selected").alias("selected"),
    )


#: What a later event of a kind adds to a score below a bound; from there on the score is ``SATURATED``.
IMPORTANCE_STEPS = {"edit": (0.05, 0.9), "selected": (0.02, 0.95)}
FREQUENCY_STEPS = {"access": (0.05, 0.9), "edit": (0.1, 0.9)}
SATURATED = 0.95
#: After so many steps a score is ``SATURATED`` for good, whatever comes: the smallest step is 0.02 and 0.45 the longest way of
#: importance, 0.05 and 0.8 that of frequency, and one more step goes from beyond the bound to the end.
STEPS = 32


def importance_scores(events: DataFrame, path: str, kind: str, ts: str, tie: str) -> DataFrame:
    """(path, importance, recency, frequency) after all events of each path in the order of (ts, tie), which is unique in it.

    The first event sets the scores, later ones step them up to saturation. The order counts, but only of the first
    ``STEPS`` events that move a score, as no later one changes it. So what is folded is bounded, and is cut to that in
    each task before it is shuffled, however many events a path has. Other kinds of event are left out.
    """
    known = events.filter(F.col(kind).isin(*FIRST)).select(
        F.col(path).alias("_path"), F.col(kind).alias("_kind"), F.struct(F.col(ts).alias("ts"), F.col(tie).alias("tie")).alias("_at"))
    first = known.groupBy("_path").agg(F.min(F.struct("_at", "_kind")).alias("_first"), F.bool_or(F.col("_kind") != "search").alias("_moved"))

    def moves(steps: dict, name: str) -> DataFrame:
        rank = F.row_number().over(W.partitionBy("_path").orderBy("_at"))
        some = known.filter(F.col("_kind").isin(*steps)).withColumn("_r", rank).filter(F.col("_r") <= STEPS + 1)  # the first event may be among them
        return some.groupBy(F.col("_path").alias(f"_{name}_path")).agg(F.array_sort(F.collect_list(F.struct("_at", "_kind"))).alias(f"_{name}"))

    def folded(steps: dict, name: str, place: int) -> F.Column:
        begun = F.coalesce(*[F.when(F.col("_first._kind") == k, F.lit(v[place])) for k, v in FIRST.items()])
        later = F.filter(F.coalesce(f"_{name}", F.filter(F.array("_first"), lambda _: F.lit(False))), lambda x: x["_at"] > F.col("_first._at"))

        def step(score: F.Column, x: F.Column) -> F.Column:
            return F.coalesce(*[F.when(x["_kind"] == k, F.when(score < bound, score + more).otherwise(SATURATED)) for k, (more, bound) in steps.items()])

        return F.aggregate(later, begun, step).alias(name)

    joined = first
    for name, steps in (("importance", IMPORTANCE_STEPS), ("frequency", FREQUENCY_STEPS)):
        joined = joined.join(moves(steps, name), F.col("_path").eqNullSafe(F.col(f"_{name}_path")), "left")
    recent = F.when(F.col("_moved"), 1.0).otherwise(0.5).alias("recency")
    return joined.select(F.col("_path").alias(path), folded(IMPORTANCE_STEPS, "importance", 0), recent, folded(FREQUENCY_STEPS, "frequency", 2))
