"""Chat formatting with collapse of cumulative snapshots. DataFrame functions only.

Logs often hold a conversation several times, each time with a few turns more. Every turn gets a rolling
hash of all turns up to it; a conversation whose last hash occurs inside a longer one is a prefix of that and
an anti-join drops it. Of equal conversations the one with the smallest id stays. Only the text of
conversations that stay is shuffled for rendering; before that only hashes move.

The rolling hash of a prefix is the pair of running sums of two 64-bit hashes of (position, role, text), so
it is a window aggregate that can spill, not a value that grows. Prefixes are aggregated to distinct ones before
the join, so a first turn that very many conversations share is one row.

Defined cases: turns are put in order by turn, then role and text; a null turn comes first. Exact repetitions of a
row are one turn. Roles are trimmed and lower-cased, a null or blank one is ``unknown``; a null text is empty. Rows with a
null conv_id belong to no conversation and are left out. Columns other than the four aren't read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import cut, table

BEGIN, END = "<|im_start|>", "<|im_end|>"


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with defaults filled in and repeated rows dropped."""
    role = F.lower(F.trim(F.col("role")))
    return (
        conversations.filter(F.col("conv_id").isNotNull())
        .select(
            "conv_id",
            "turn",
            F.when(role != "", role).otherwise(F.lit("unknown")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        )
    )


def prefixes(conversations: DataFrame) -> DataFrame:
    """(conv_id, n, of, h1, h2): the rolling hashes of the first n of all ``of`` turns."""
    turns = turns_of(conversations).select(
        "conv_id",
        "turn",
        F.xxhash64("role", "text").alias("said"),
        F.xxhash64(F.lit("second"), "text", "role").alias("said_too"),
        "role",
        F.md5("text").alias("digest"),
    )
    turns = turns.groupBy("conv_id", "turn", "role", "digest").agg(
        F.min("said").alias("said"), F.min("said_too").alias("said_too")
    )
    order = W.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "digest")
    placed = turns.withColumn("n", F.row_number().over(order))
    rolling = order.rowsBetween(W.unboundedPreceding, W.currentRow)

    def running(column: str) -> F.Column:
        return F.sum(F.xxhash64("n", column).cast("decimal(20,0)")).over(rolling)

    return placed.select(
        "conv_id",
        "n",
        F.lead("n").over(order).isNull().alias("last"),
        running("said").alias("h1"),
        running("said_too").alias("h2"),
    )


def maximal(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns) of the conversations that are no prefix of another and the first of equal ones."""
    rolled = cut(prefixes(conversations), "prefixes")
    inner = rolled.filter(~F.col("last")).select("n", "h1", "h2").distinct()
    whole = rolled.filter("last").groupBy("n", "h1", "h2").agg(F.min("conv_id").alias("conv_id"))
    return whole.join(inner, ["n", "h1", "h2"], "anti").select("conv_id", F.col("n").cast("long").alias("n_turns"))


def rendered(conversations: DataFrame, kept: DataFrame) -> DataFrame:
    """(conv_id, n_turns, rendered): each kept conversation as one marked-up text."""
    turns = turns_of(conversations).join(kept, "conv_id").distinct()
    said = F.concat(F.lit(BEGIN), "role", F.lit("\n"), "text", F.lit(END + "\n"))
    entry = F.struct(F.col("turn").isNotNull().alias("numbered"), "turn", "role", F.md5("text").alias("d"), said.alias("said"))
    gathered = turns.groupBy("conv_id", "n_turns").agg(F.sort_array(F.collect_list(entry)).alias("all"))
    return gathered.select("conv_id", "n_turns", F.array_join(F.col("all.said"), "").alias("rendered"))


def format_chats(conversations: DataFrame) -> DataFrame:
    return rendered(conversations, maximal(conversations))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


ORACLE = """
WITH t AS (
  SELECT DISTINCT conv_id, turn, coalesce(nullif(lower(trim(role)), ''), 'unknown') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, count(*) AS n_turns,
    list('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10)
         ORDER BY turn NULLS FIRST, role, md5(text)) AS said
  FROM t GROUP BY conv_id),
u AS (SELECT min(conv_id) AS conv_id, n_turns, said FROM c GROUP BY n_turns, said),
inner_prefixes AS (
  SELECT DISTINCT said[1:k] AS said FROM (SELECT said, unnest(range(1, len(said))) AS k FROM u))
SELECT conv_id, n_turns, array_to_string(said, '') AS rendered
FROM u WHERE said NOT IN (SELECT said FROM inner_prefixes)
"""
