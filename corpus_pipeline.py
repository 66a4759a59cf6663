"""A corpus pipeline of four stages: quality rules, toxicity, near-duplicates, packing.

Every stage but the last returns the columns of ``documents``, for the rows that it keeps. Between stages
the rows are written as a table in the shared folder and read again.

Defined cases: null, empty and blank texts fail the quality rules; rows of one id are judged each by its own text, and of
rows that are equal or alike one stays; a null id is kept as any other. Other columns pass through, whatever their names.
Empty tables give no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrywork.llm import neardup, packing, quality, toxicity
from quarrywork.llm.common import cut, drop_table, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or that the learned list rejects go."""
    rules = quality.train(docs, table(spark, sf_dir, "labels"))
    whole = docs.select("text", F.struct(*docs.columns).alias("_row"))
    return quality.judge(whole, rules).filter("kept").select("_row.*")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is at least a half go."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    whole = docs.select("text", F.struct(*docs.columns).alias("_row"))
    return toxicity.score(whole, model, into="_toxicity").filter(F.col("_toxicity") < 0.5).select("_row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays: shingles of five words, similarity 0.8."""
    return neardup.deduplicate(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, placed in windows."""
    return packing.packed(docs, public_tokenizers.path(packing.TOKENIZER))


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("packing", pack),
]

#: A trained classifier and a placement that depends on the tasks aren't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        after = cut(stage(spark, docs, sf_dir), f"stage-{name}")
        if i:
            drop_table(docs)
        docs = after
    return docs
