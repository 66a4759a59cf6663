"""Toxicity scores from class-conditional Kneser-Ney models.

Two interpolated Kneser-Ney models, one of toxic and one of ordinary documents, spell words letter by letter: n-grams
of up to ``ORDER`` characters, a word's begin and end among them, so that a word never seen still tells by its parts.
The highest order counts in how many texts of a class a word with the n-gram stands; lower orders count in how many
ways it is continued to the left. What the discount takes off, and a prior on top of it, goes to the next shorter
history, and at last to letter counts that both classes share: a rare expression so says little either way.

Every word of a document gets its two log-likelihoods. The evidence is how far the toxic one exceeds the ordinary one,
beyond a margin and up to a bound, as a mean over the document's words, which normalises its length. (The mean of
the bare differences, negative ones too, is swamped by the many ordinary words; README has figures.) A logistic curve, fitted
on rows that the counts don't hold and with both classes of equal weight, turns the logarithm of the evidence into
a score, so that one half is the point where toxic and ordinary texts are told apart equally well.

Counting runs in Spark over all labelled rows that may be learned from, words first and then their n-grams; only the
calibration has a bounded sample. An n-gram goes into the model if it is counted more often than the discount, whatever
the size of the corpus: one that isn't adds nothing to its backoff, so nothing is cut off. The models are fitted in Spark, an order at a
time; the driver gets a key and a difference, 12 bytes, of each n-gram and history, and broadcasts them. They grow with the different n-grams that
come twice (figures in the README). Scoring is one pass over the whole texts with no shuffle.

Defined cases: a null or empty text has no evidence and gets the score of no evidence, as do texts
without a word; repeated rows are scored alike, each on its own; columns other than ``doc_id`` and ``text``
pass through or are dropped, never read, but for one named as the result, which it replaces. Without labels of both
classes every score is the share of toxic labels, or 0 if there is none. Of several labels of one document the highest
counts; null labels don't.
"""

from __future__ import annotations

import re
import weakref
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, drop_table, fold, sample_rows, table

#: Labelled rows, of either class, that the score is calibrated on, at most.
CALIBRATION_ROWS = 3000
#: Labels, of 12 bytes each, that are broadcast to pick out labelled texts.
BROADCAST_LABELS = 500_000
#: Counts that a task gathers before it hands them on.
GATHERED = 200_000
#: Characters of the longest n-grams.
ORDER = 6
#: What is taken off every count for the backoff.
DISCOUNT = 1.0
#: Backoff counts that every history gets on top of its own.
PRIOR = 50.0
#: Log-likelihood difference from which a word counts, and the most that one word counts.
MARGIN, MOST = 1.0, 8.0
#: Added to the evidence before its logarithm is taken.
FLOOR = 0.003
WORD = re.compile(r"[^\W_]+")
#: The characters around a word; no word holds them.
BEGIN, END = "\x02", "\x03"
CLASSES = ("toxic", "ordinary")
#: Words whose differences a worker remembers, at most, the longest that it does, and characters looked up at once.
REMEMBERED, LONGEST, AT_ONCE = 1_000_000, 40, 1 << 19
#: Powers of an odd multiplier: n-grams are told apart by polynomials of their characters modulo 2^64.
POWERS = np.cumprod(np.full(ORDER, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


def found_at(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether each is among the sorted keys, its place or some other)"""
    if not len(keys):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.intp)
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return keys[at] == wanted, at


@dataclass
class Order:
    """The n-grams of one length: what each tells, and what is added where a history is left for a shorter one."""

    grams: np.ndarray
    told: np.ndarray
    histories: np.ndarray
    left: np.ndarray


def walk(orders: list[Order], columns: list[np.ndarray], reach: np.ndarray) -> np.ndarray:
    """What the longest known n-gram that ends at each place tells, with what leaving longer histories adds.

    ``columns[j]`` are the characters j places before; ``reach`` is how many of them belong to the same word.
    """
    n = len(columns[0])
    grams, histories = [columns[0] * POWERS[0]], [np.zeros(n, np.uint64)]
    for k in range(1, len(orders)):
        grams.append(grams[-1] + columns[k] * POWERS[k])
        histories.append(histories[-1] + columns[k] * POWERS[k - 1])
    value, rest = np.zeros(n), np.arange(n)
    for k in range(len(orders) - 1, -1, -1):
        order, near = orders[k], reach[rest] < k
        here, rest = rest[~near], rest[near]
        known, at = found_at(order.grams, grams[k][here])
        value[here[known]] += order.told[at[known]]
        here = here[~known]
        known, at = found_at(order.histories, histories[k][here])
        value[here[known]] += order.left[at[known]]
        rest = np.concatenate([rest, here])
    return value


@dataclass
class Model:
    """Log-likelihood differences, toxic less ordinary, by n-gram and by history that is left."""

    orders: list[Order]
    slope: float = 1.0
    offset: float = 0.0
    known: dict[str, float] = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "known": {}}

    def differences(self, distinct: list[str]) -> np.ndarray:
        """Of each word: the sum over its characters and its end."""
        marked = [BEGIN + w + END for w in distinct]
        letters = codes("".join(marked))
        lengths = np.fromiter(map(len, marked), np.int64, len(marked))
        owner = np.repeat(np.arange(len(marked)), lengths)
        place = np.arange(len(letters)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        before = np.concatenate([np.zeros(ORDER - 1, np.uint64), letters])
        told = np.zeros(len(letters))
        for low in range(0, len(letters), AT_ONCE):
            high = min(low + AT_ONCE, len(letters))
            columns = [before[low + ORDER - 1 - j : high + ORDER - 1 - j] for j in range(ORDER)]
            told[low:high] = walk(self.orders, columns, place[low:high])
        told[place == 0] = 0.0  # every word begins
        return np.bincount(owner, told, len(marked))

    def evidence(self, text: str | None) -> float:
        return self.evidences([text])[0]

    def evidences(self, texts: list[str | None]) -> list[float]:
        """Of each text: the mean over its words of what their differences have beyond the margin, up to the most.
        Words that are new in any of some texts are looked up together."""
        out: list[float] = []
        held: list[list[str]] = []
        size = 0
        for i, text in enumerate(texts):
            held.append(words(text))
            size += len(text or "")
            if size >= AT_ONCE or i == len(texts) - 1:
                out += self._evidences(held)
                held, size = [], 0
        return out

    def _evidences(self, found: list[list[str]]) -> list[float]:
        new = list(set().union(*found) - self.known.keys())
        if new:
            self.known.update(zip(new, np.clip(self.differences(new) - MARGIN, 0, MOST).round(6).tolist()))
        means = [sum(map(self.known.__getitem__, f)) / len(f) if f else 0.0 for f in found]
        for word in new:
            if len(word) > LONGEST:
                del self.known[word]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        return means

    def scores(self, texts: list[str | None]) -> list[float]:
        if self.slope == 0:
            return [self.offset] * len(texts)
        z = np.clip(self.slope * np.log(np.array(self.evidences(texts)) + FLOOR) + self.offset, -30, 30)
        return np.round(1 / (1 + np.exp(-z)), 6).tolist()

    def score(self, text: str | None) -> float:
        return self.scores([text])[0]


# --- counting ---------------------------------------------------------------------------------------------


def count_words(texts: DataFrame) -> DataFrame:
    """(w, toxic, ordinary): how many texts of each class hold each word. Counted within tasks before the shuffle."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, Counter] = {1: Counter(), 0: Counter()}

        def out() -> Iterator[pd.DataFrame]:
            for toxic, own in sums.items():
                if own:  # a table without rows has no type of its own
                    n = np.fromiter(own.values(), np.int64, len(own))
                    yield pd.DataFrame({"w": list(own), "toxic": n * toxic, "ordinary": n * (1 - toxic)})
                own.clear()

        for batch in batches:
            for toxic, text in zip(batch.toxic, batch.text):
                sums[int(toxic)].update(set(words(text)))
                if len(sums[0]) + len(sums[1]) >= GATHERED:
                    yield from out()
        yield from out()

    found = texts.select("toxic", "text").mapInPandas(count, "w string, toxic long, ordinary long")
    return found.groupBy("w").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def count_grams(found: DataFrame) -> DataFrame:
    """(g, toxic, ordinary) of all orders: counts of the highest, and of those that begin a word; else the number of
    different characters that come before. At each character after the begin ends one n-gram, of ``ORDER`` characters or
    fewer."""
    marked = found.select(F.concat(F.lit(BEGIN), "w", F.lit(END)).alias("m"), "toxic", "ordinary")
    ends = F.sequence(F.lit(2), F.char_length("m"))
    gram = lambda i: F.substring("m", F.greatest(i - ORDER + 1, F.lit(1)), F.least(i, F.lit(ORDER)))
    counted = marked.select(F.explode(F.transform(ends, gram)).alias("g"), "toxic", "ordinary").groupBy("g")
    counted = cut(counted.agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")), "toxic-grams")
    levels = [counted.filter(F.char_length("g") == ORDER)]
    for k in range(ORDER - 1, 0, -1):
        ways = levels[-1].groupBy(F.expr("substring(g, 2)").alias("g"))
        ways = ways.agg(F.count_if(F.col("toxic") > 0).alias("toxic"), F.count_if(F.col("ordinary") > 0).alias("ordinary"))
        levels.append(ways.unionByName(counted.filter((F.char_length("g") == k) & F.col("g").startswith(BEGIN))))
    whole = levels[0]
    for level in levels[1:]:
        whole = whole.unionByName(level)
    done = cut(whole, "toxic-orders")
    drop_table(counted)
    return done


@dataclass
class Counts:
    """What a model needs of the n-gram counts. ``kept`` is a table in the shared folder that goes when this object does."""

    whole: DataFrame  # g, toxic, ordinary
    kept: DataFrame  # those that are told apart from their backoff

    def __post_init__(self) -> None:
        weakref.finalize(self, drop_table, self.kept).atexit = False

    @property
    def grams(self) -> pd.DataFrame:
        """What is kept, brought to the driver to be looked at; nothing here asks for it."""
        return self.kept.toPandas()


def summed(grams: DataFrame, discount: float = DISCOUNT, rare: float = 0.0) -> Counts:
    """The n-grams that are counted more often than the discount, all that the model tells apart from their backoff. A caller who has no room for
    them may ask for a share ``rare`` of the class's count too; :func:`train` doesn't."""
    total = grams.filter(F.char_length("g") == ORDER).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in CLASSES]).first()
    often = [F.col(c) > max(discount, rare * total[c]) for c in CLASSES]
    return Counts(grams, cut(grams.filter(often[0] | often[1]), "toxic-kept"))


def shares(counts: Counts, discount: float, prior: float) -> DataFrame:
    """(g, kept, n, above_*, back_*) of what is kept and of all that it ends with: in each class, the share of the history's counts that is above the
    discount, and the share that the history leaves to its backoff."""
    zero = [F.lit(0).cast("long").alias(c) for c in CLASSES]
    flags = lambda kept, asked: (F.lit(kept).alias("kept"), F.lit(asked).alias("asked"))
    ends = F.expr("explode(transform(sequence(1, char_length(g)), i -> substring(g, i)))")
    rows = counts.whole.select("g", *CLASSES, *flags(False, False))
    rows = rows.unionByName(counts.kept.select("g", *zero, *flags(True, True)))
    rows = rows.unionByName(counts.kept.select(ends.alias("g"), *zero, *flags(False, True)))
    nodes = rows.groupBy("g").agg(*[F.sum(c).alias(c) for c in CLASSES], F.max("kept").alias("kept"), F.max("asked").alias("asked"))
    of_history = Window.partitionBy(F.expr("substring(g, 1, char_length(g) - 1)"))
    told = [F.expr("toxic + ordinary").alias("n")]
    for c in CLASSES:
        above = F.when(F.col("kept"), F.greatest(F.col(c) - F.lit(discount), F.lit(0.0))).otherwise(0.0)
        total = F.sum(c).over(of_history) + F.lit(prior)
        told += [(above / total).alias(f"above_{c}"), (1 - F.sum(above).over(of_history) / total).alias(f"back_{c}")]
    return cut(nodes.select("g", "kept", "asked", *told).filter("asked").drop("asked"), "toxic-shares")


def keys(grams: list[str], k: int) -> np.ndarray:
    """Of n-grams of ``k`` characters: what they are looked up by."""
    spelled = codes("".join(grams)).reshape(len(grams), k)
    return sum((spelled[:, k - 1 - j] * POWERS[j] for j in range(k)), np.zeros(len(grams), np.uint64))


def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for k, some in batch.groupby(batch.g.str.len()):
            yield pd.DataFrame({"k": some.k, "history": some.history, "key": keys(some.g.tolist(), int(k)).view(np.int64), "told": some.told})


def fit(counts: Counts, discount: float = DISCOUNT, prior: float = PRIOR) -> Model:
    """The difference of the two models, from their counts, one order after the other. Probabilities are joined with those of the next shorter
    n-gram; a key and a difference of each n-gram and history come to the driver."""
    nodes = shares(counts, discount, prior)
    letters = nodes.filter("kept AND char_length(g) = 1").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("different")).first()
    seen = (F.when(F.col("kept"), F.col("n")).otherwise(0) + 0.5) / (letters.n + 0.5 * (letters.different + 1))  # shared by both classes
    levels: list[DataFrame] = []
    for k in range(1, ORDER + 1):
        some = nodes.filter(F.char_length("g") == k)
        if k == 1:
            some = some.withColumns({f"lower_{c}": seen for c in CLASSES})
        else:
            shorter = levels[-1].select(F.col("g").alias("end"), *[F.col(f"p_{c}").alias(f"lower_{c}") for c in CLASSES])
            some = some.withColumn("end", F.expr("substring(g, 2)")).join(shorter, "end")
        p = [F.expr(f"above_{c} + back_{c} * lower_{c}").alias(f"p_{c}") for c in CLASSES]
        levels.append(cut(some.select("g", "kept", *p), f"toxic-{k}"))
    told = levels[0]
    for level in levels[1:]:
        told = told.unionByName(level)
    size, difference = F.char_length("g").alias("k"), "cast(ln({0}_toxic) - ln({0}_ordinary) as float) AS told"
    told = told.filter("kept").select("g", size, F.lit(False).alias("history"), F.expr(difference.format("p")))
    left = nodes.filter("kept").select(F.expr("substring(g, 1, char_length(g) - 1)").alias("g"), size, F.lit(True).alias("history"), F.expr(difference.format("back")))
    found = told.unionByName(left.distinct()).mapInPandas(keyed, "k int, history boolean, key long, told float").toArrow()
    for level in [nodes, *levels]:
        drop_table(level)
    size, history, key, told = (found.column(c).to_numpy() for c in ("k", "history", "key", "told"))
    key = key.view(np.uint64)

    def ordered(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(which)
        at = at[np.argsort(key[at])]
        return key[at], told[at]

    return Model([Order(*ordered((size == k) & ~history), *ordered((size == k) & history)) for k in range(1, ORDER + 1)])


def calibrate(model: Model, evidence: np.ndarray, toxic: np.ndarray) -> Model:
    """Fit the logistic curve by Newton's method on rows that the counts don't hold, both classes of equal weight."""
    if not 0 < toxic.sum() < len(toxic):
        model.slope, model.offset = 0.0, float(toxic.mean()) if len(toxic) else 0.0
        return model
    x = np.log(evidence + FLOOR)
    mean, scale = x.mean(), x.std() or 1.0
    x = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    weight = np.where(toxic == 1, 0.5 / toxic.sum(), 0.5 / (len(toxic) - toxic.sum())) * len(toxic)
    beta = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + np.eye(2)
        step = np.clip(np.linalg.solve(hessian, x.T @ (weight * (toxic - p)) - beta), -2, 2)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    model.slope = max(float(beta[0] / scale), 1e-9)
    model.offset = float(beta[1] - beta[0] * mean / scale)
    return model


def learnable(labels: DataFrame, folds: int | None, held_out: int) -> DataFrame:
    """(doc_id, toxic) of the labels that may be learned from."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    return known.filter(fold("doc_id", folds) != held_out) if folds else known


def train(
    docs: DataFrame,
    labels: DataFrame,
    folds: int | None = 5,
    held_out: int = 0,
    calibration_rows: int = CALIBRATION_ROWS,
) -> Model:
    """Fit a model on labelled documents outside the held-out fold.

    One labelled row in seven calibrates, at most ``calibration_rows`` in a fixed pseudo-random order. All
    others are counted. Equal texts are counted once for a class.
    """
    known = cut(learnable(labels, folds, held_out), "toxic-labels")
    # counted first: so many narrow rows are broadcast, and no text moves for them; more are joined
    bounded = F.broadcast if known.count() <= BROADCAST_LABELS else lambda df: df
    calibrates = F.pmod(F.xxhash64(F.lit("calibrate"), "doc_id"), F.lit(7)) == 0
    counted = docs.select("doc_id", "text").join(bounded(known.filter(~calibrates)), "doc_id")
    found = cut(count_words(counted.select("toxic", "text").dropDuplicates()), "toxic-words")
    grams = count_grams(found)
    model = fit(summed(grams))
    drop_table(found)
    drop_table(grams)

    present = docs.select("doc_id").join(bounded(known.filter(calibrates)), "doc_id").dropDuplicates()
    chosen = cut(sample_rows(present, "doc_id", calibration_rows, "toxic"), "toxic-sample")
    # at most calibration_rows narrow rows: a bounded broadcast
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("toxic", "text").dropDuplicates()

    def gauge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"toxic": batch.toxic, "evidence": model.evidences(batch.text.tolist())})

    rows = texts.mapInPandas(gauge, "toxic int, evidence double").toPandas()
    drop_table(chosen)
    drop_table(known)
    return calibrate(model, rows.evidence.to_numpy(float), rows.toxic.to_numpy(float))


def score(docs: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with a column ``into``: how likely the text is toxic. One pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scorer(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fitted = shared.value
        for batch in batches:
            yield pd.Series(fitted.scores(batch.tolist()), dtype=float)

    return docs.withColumn(into, scorer(F.col(text)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select(
        "doc_id",
        (fold("doc_id", 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
