"""Full-text ranking, keyword tables and near matches of names."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut

K1, B = 1.2, 0.75


def tokens(text: str | F.Column) -> F.Column:
    return F.filter(F.split(F.lower(F.col(text) if isinstance(text, str) else text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def bm25(docs: DataFrame, key: str, text: str, terms: Iterable[str], k1: float = K1, b: float = B) -> DataFrame:
    """(key, score) of the documents that hold any of the terms.

    A row's term counts are made in the row, in one pass over its text, and no token is ever exploded. These narrow
    counts are written to the shared folder, so that texts are read once; document frequencies and the mean length come
    from one aggregate over them, which joins back as a single row.
    """
    terms = sorted({t.lower() for t in terms})
    equal = lambda t: lambda w: w == t
    told = F.transform(
        F.array(tokens(text)),
        lambda w: F.struct(F.size(w).alias("_n"), *[F.size(F.filter(w, equal(t))).alias(f"_{i}") for i, t in enumerate(terms)]),
    )
    counted = cut(docs.select(key, F.inline(told)))
    total = counted.agg(
        F.count("*").alias("_docs"),
        F.avg("_n").alias("_mean"),
        *[F.count_if(F.col(f"_{i}") > 0).alias(f"_df{i}") for i in range(len(terms))],
    )
    hit = counted.filter(F.greatest(*[F.col(f"_{i}") for i in range(len(terms))], F.lit(0)) > 0)

    def weigh(i: int) -> F.Column:
        tf, df = F.col(f"_{i}"), F.col(f"_df{i}")
        idf = F.log(1 + (F.col("_docs") - df + 0.5) / (df + 0.5))
        return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("_n") / F.col("_mean")))

    # one row of totals, known to be one: a bounded broadcast
    joined = hit.join(F.broadcast(total), F.lit(True))
    return joined.select(key, sum((weigh(i) for i in range(len(terms))), F.lit(0.0)).alias("score"))


def near_names(names: DataFrame, name: str, most: int = 2) -> DataFrame:
    """(a, b, edits): all pairs of different names within ``most`` edits, the smaller first.

    Two names within k edits have a common form with at most k characters left out of each, so names are joined on
    these forms, which are few for a name, and what meets is measured. Names of any lengths are found.
    """
    column = F.col(name)
    shorter = lambda s: F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s)))
    )
    forms = [F.array(column)]
    for _ in range(most):
        forms.append(F.array_distinct(F.flatten(F.transform(forms[-1], shorter))))
    own = names.select(name).filter(column.isNotNull()).distinct()
    rows = own.select(column.alias("n"), F.explode(F.array_distinct(F.concat(*forms))).alias("form"))
    pairs = rows.withColumnRenamed("n", "a").join(rows.withColumnRenamed("n", "b"), "form").filter("a < b").select("a", "b").distinct()
    return pairs.withColumn("edits", F.levenshtein("a", "b")).filter(F.col("edits") <= most)


def keyword_table(spark: SparkSession, lists: dict[str, Iterable[str]]) -> DataFrame:
    rows = [(name, word) for name, words in lists.items() for word in words]
    return spark.createDataFrame(rows, T.StructType().add("name", "string").add("word", "string"))


def detected(docs: DataFrame, key: str, text: str, lists: dict[str, Iterable[str]]) -> DataFrame:
    """(key, name, confidence): the lists of which a text holds words, a fifth for each word, one at most."""
    lowered = F.lower(F.col(text))
    found = [
        F.struct(
            F.lit(name).alias("name"), sum((lowered.contains(w).cast("int") for w in words), F.lit(0)).alias("n")
        )
        for name, words in lists.items()
    ]
    rows = docs.select(key, F.inline(F.filter(F.array(*found), lambda x: x["n"] > 0)))
    return rows.select(key, "name", F.least(F.lit(1.0), F.col("n") * 0.2).alias("confidence"))
