"""The prefix trie of conversations, from chained digests.

Every conversation is a sequence of turns; a node is a distinct sequence of first turns. A prefix is known by a chained
SHA-256 digest: within blocks of :data:`BLOCK` turns each digest is made from the one before and the turn's own, and the
blocks' digests are chained by the same rule, so no array is longer than a block and a long conversation is many tasks.
Prefixes are exploded, one row each, and grouped by (depth, digest) to nodes; only digests and word counts move, no text.

Subtree sums: a node belongs to its smallest member, so that member's nodes are one path downwards from where it becomes the
smallest. A path's own sums are exploded to all paths above, at the deepest node that they share, and summed there;
sums along each path from its end complete them. That is at most a row for each prefix, where a row for each
node and ancestor would be quadratic in a conversation's length.

Defined cases: turns are in order of turn, null first, ties by a digest of role and text; repeated rows are turns of their own.
A null role or text is empty. Rows without a conv_id belong to no conversation. No rows give no nodes, not even a root. Other columns
aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import cut, numbered, table

BLOCK = 64
#: Members of a node whose numbers are written into one string at once.
TOGETHER = 4096
WORD = r"[^\x20\x09-\x0D]+"


def _struct_digest(role: Column, text: Column) -> Column:
    """A digest of a turn: the role's length keeps the two apart."""
    return F.sha2(F.concat_ws(":", F.length(role).cast("string"), role, text), 256)


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, n, said, words): every turn with its place from 1, its digest and the words of its text."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    said = conversations.filter(F.col("conv_id").isNotNull()).select(
        "conv_id", "turn", _struct_digest(role, text).alias("said"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words")
    )
    placed = cut(numbered(said, F.col("conv_id"), F.asc_nulls_first("turn"), F.col("said"), into="_row"), "turns")
    first = placed.groupBy("conv_id").agg(F.min("_row").alias("_first"))
    return placed.join(first, "conv_id").select("conv_id", (F.col("_row") - F.col("_first") + 1).alias("n"), "said", "words")


def rebuilt(turns: DataFrame, family: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """(every conversation, its turns) once each begins with the first turns of its family's first conversation: as many as a
    check sum of its number says. Its own turns after as many follow."""
    shared = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("long")
    own = turns.withColumn("_h", shared).filter("n > _h").drop("_h")
    everyone = turns.select("conv_id").distinct()
    heads = turns.filter(F.col("n") < most).select(F.col("conv_id").alias("_base"), "n", "said", "words")
    base = F.col("conv_id") - F.col("conv_id") % family
    lent = everyone.select("conv_id", base.alias("_base"), shared.alias("_h")).join(heads, "_base").filter("n <= _h")
    count = lent.groupBy("conv_id").agg(F.count("*").alias("_lent"))
    moved = own.join(count, "conv_id", "left").withColumn(
        "n", F.col("n") - shared + F.coalesce("_lent", F.lit(0))
    )
    return everyone, lent.select("conv_id", "n", "said", "words").unionByName(moved.drop("_lent"))


def chained(items: DataFrame) -> DataFrame:
    """(conv_id, i, digest): the digest of each sequence's items 0 to i. ``items`` has (conv_id, i, said)."""
    block = F.expr(f"i div {BLOCK}").alias("block")
    entry = F.struct("i", "said")
    gathered = items.groupBy("conv_id", block).agg(F.sort_array(F.collect_list(entry)).alias("all"))
    chain = F.aggregate(
        F.col("all.said"),
        F.array().cast("array<string>"),
        lambda done, said: F.array_append(done, F.sha2(F.concat(F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit("")), said), 256)),
    )
    inner = cut(gathered.select("conv_id", "block", chain.alias("chain")), "chains")
    if not inner.filter("block > 0").limit(1).count():
        return inner.select("conv_id", F.posexplode("chain").alias("i", "digest")).withColumn("i", F.col("i").cast("long"))
    whole = inner.select("conv_id", F.col("block").alias("i"), F.element_at("chain", -1).alias("said"))
    before = chained(whole).select("conv_id", (F.col("i") + 1).alias("block"), F.col("digest").alias("before"))
    rows = inner.join(before, ["conv_id", "block"], "left").select("conv_id", "block", "before", F.posexplode("chain").alias("at", "digest"))
    digest = F.when(F.col("before").isNull(), F.col("digest")).otherwise(F.sha2(F.concat("before", F.lit("+"), "digest"), 256))
    return rows.select("conv_id", (F.col("block") * BLOCK + F.col("at")).alias("i"), digest.alias("digest"))


def _joined_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by node; one hash at a time is open, and a part of its text goes in and is gone."""
    node, state, first = None, None, True

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([node[0]], pa.int64()), pa.array([node[1]], pa.int64()), pa.array([state.hexdigest()])], ["conv_id", "depth", "ends_sha256"]
        )

    for batch in batches:
        for conv, depth, part in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "depth", "part"))):
            if (conv, depth) != node:
                if node is not None:
                    yield row()
                node, state, first = (conv, depth), hashlib.sha256(), True
            state.update(("" if first else ",").encode() + part.encode())
            first = False
    if node is not None:
        yield row()


def ends(last: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256) of each node that conversations end at. ``last`` has (conv_id, depth, member)."""
    placed = numbered(last, F.col("conv_id"), F.col("depth"), F.col("member"), into="_at")
    some = placed.groupBy("conv_id", "depth", F.expr(f"_at div {TOGETHER}").alias("_part")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("member")), lambda x: x.cast("string")), ",").alias("part")
    )
    dealt = some.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "_part")
    return dealt.select("conv_id", "depth", "part").mapInArrow(_joined_hashes, "conv_id long, depth long, ends_sha256 string")


def _sums_from_end(rows: DataFrame, *columns: str) -> DataFrame:
    """``rows`` with each of ``columns`` summed from a path's end up to the row, by blocks of depths and within them."""
    rows = rows.withColumn("_block", F.expr("depth div 1024"))
    blocks = rows.groupBy("conv_id", "_block").agg(*[F.sum(c).alias(f"_{c}") for c in columns])
    below = W.partitionBy("conv_id").orderBy(F.desc("_block")).rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select("conv_id", "_block", *[F.coalesce(F.sum(f"_{c}").over(below), F.lit(0)).alias(f"_{c}") for c in columns])
    within = W.partitionBy("conv_id", "_block").orderBy(F.desc("depth")).rowsBetween(W.unboundedPreceding, W.currentRow)
    summed = rows.join(blocks, ["conv_id", "_block"])
    return summed.withColumns({c: F.sum(c).over(within) + F.col(f"_{c}") for c in columns}).drop("_block", *[f"_{c}" for c in columns])


def trie(everyone: DataFrame, turns: DataFrame) -> DataFrame:
    """One row of each node: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).

    ``everyone`` has the conversations (conv_id), ``turns`` their turns (conv_id, n from 1, said, words).
    """
    turns, everyone = cut(turns, "turns"), cut(everyone, "conversations")
    digests = chained(turns.select("conv_id", (F.col("n") - 1).alias("i"), "said"))
    rows = cut(
        digests.join(turns.select("conv_id", (F.col("n") - 1).alias("i"), "words"), ["conv_id", "i"]).select(
            "conv_id", (F.col("i") + 1).alias("depth"), "digest", "words"
        ),
        "prefixes",
    )
    nodes = rows.groupBy("depth", "digest").agg(F.min("conv_id").alias("top"), F.count("*").alias("n_convs"))
    known = cut(rows.join(nodes, ["depth", "digest"]).select("conv_id", "depth", "words", "top", "n_convs"), "members")
    root = everyone.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    root = cut(root, "root")
    found = root.first()
    if found is None:
        schema = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
        return everyone.sparkSession.createDataFrame([], schema)
    first = F.lit(found["conv_id"])

    own = known.filter("conv_id = top").select("conv_id", "depth", "n_convs", ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"))
    own = own.unionByName(root.select("conv_id", F.lit(0).cast("long").alias("depth"), "n_convs", F.lit(0).cast("long").alias("saved_tokens")))
    paths = own.groupBy("conv_id").agg(F.min("depth").alias("begin"), F.max("depth").alias("end"), F.sum("saved_tokens").alias("saved"))
    above = known.filter("conv_id <> top").groupBy("conv_id", "top").agg(F.max("depth").alias("at"))
    above = above.unionByName(everyone.filter(F.col("conv_id") != first).select("conv_id", first.alias("top"), F.lit(0).cast("long").alias("at")))
    above = above.groupBy("conv_id", "top").agg(F.max("at").alias("at"))
    hung = cut(above.join(paths, "conv_id").select("top", "at", (F.col("at") == F.col("begin") - 1).alias("next"), "conv_id", "saved"), "above")

    children = hung.filter("next").groupBy(F.col("top").alias("conv_id"), F.col("at").alias("depth")).agg(F.count("*").alias("branches"))
    placed = own.join(paths.select("conv_id", "begin", "end"), "conv_id").join(children, ["conv_id", "depth"], "left")
    n_children = F.coalesce("branches", F.lit(0)) + (F.col("depth") < F.col("end")).cast("long")
    placed = cut(placed.withColumn("n_children", n_children).drop("branches", "end"), "nodes")
    leaves = placed.filter("n_children = 0").select("conv_id", F.lit(1).cast("long").alias("leaf"))
    brought = hung.join(leaves, "conv_id", "left").groupBy(F.col("top").alias("conv_id"), F.col("at").alias("depth")).agg(
        F.sum("saved").alias("_saved"), F.sum("leaf").alias("_leaves")
    )
    whole = placed.join(brought, ["conv_id", "depth"], "left").withColumns({
        "saved_tokens": F.col("saved_tokens") + F.coalesce("_saved", F.lit(0)),
        "n_leaves": (F.col("n_children") == 0).cast("long") + F.coalesce("_leaves", F.lit(0)),
    }).drop("_saved", "_leaves")
    whole = _sums_from_end(whole, "saved_tokens", "n_leaves")

    parents = hung.filter("next").select("conv_id", F.col("top").alias("_parent"), (F.col("at") + 1).alias("depth"))
    parent = F.when(F.col("depth") > F.col("begin"), F.col("conv_id")).otherwise(F.col("_parent"))
    whole = whole.join(parents, ["conv_id", "depth"], "left").withColumn("parent_conv_id", parent)

    length = known.groupBy("conv_id").agg(F.max("depth").alias("depth"))
    last = known.join(length, ["conv_id", "depth"]).select(F.col("top").alias("conv_id"), "depth", F.col("conv_id").alias("member"))
    turnless = everyone.join(length, "conv_id", "anti").select(first.alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.col("conv_id").alias("member"))
    whole = whole.join(ends(last.unionByName(turnless)), ["conv_id", "depth"], "left")
    return whole.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(*rebuilt(turns(table(spark, sf_dir, "conversations"))))


#: CRC-32 bit by bit, as SQL has no function for it.
_CRC = """xor(list_reduce(list_concat([4294967295], list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b:
  list_reduce(list_concat([xor(c::BIGINT, b::BIGINT)], range(8)), lambda r, i: xor(r // 2, CASE WHEN r % 2 = 1 THEN 3988292384 ELSE 0 END))), 4294967295)"""

ORACLE = f"""
WITH t AS (
  SELECT conv_id, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || ':' || coalesce(text, '')) AS said,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words
  FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, said) AS n FROM t),
h AS (SELECT DISTINCT conv_id, {_CRC} % 4 AS h FROM t),
lent AS (SELECT h.conv_id, o.n, o.said, o.words FROM h JOIN o ON o.conv_id = h.conv_id - h.conv_id % 20 AND o.n <= h.h),
r AS (SELECT conv_id, said, words, row_number() OVER (PARTITION BY conv_id ORDER BY own, n) AS n FROM (
  SELECT conv_id, 0 AS own, n, said, words FROM lent
  UNION ALL SELECT o.conv_id, 1, n, said, words FROM o JOIN h USING (conv_id) WHERE n > h)),
p AS (
  SELECT conv_id, n AS depth, words, sha256(string_agg(said, '' ) OVER (PARTITION BY conv_id ORDER BY n)) AS digest,
    n = count(*) OVER (PARTITION BY conv_id) AS last FROM r
  UNION ALL SELECT conv_id, 0, 0, 'root', conv_id NOT IN (SELECT conv_id FROM r) FROM h),
v AS (
  SELECT depth, digest, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(words) AS saved,
    sha256(coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256 FROM p GROUP BY depth, digest),
e AS (
  SELECT v.depth, v.digest, u.digest AS above FROM v JOIN p ON p.conv_id = v.conv_id AND p.depth = v.depth - 1
  JOIN v u ON u.depth = p.depth AND u.digest = p.digest),
c AS (SELECT depth - 1 AS depth, above AS digest, count(*) AS n_children FROM e GROUP BY ALL),
s AS (
  SELECT a.depth, a.digest, sum(v.saved) AS saved_tokens, count(*) FILTER (c.n_children IS NULL) AS n_leaves
  FROM v JOIN p a ON a.conv_id = v.conv_id AND a.depth <= v.depth LEFT JOIN c ON c.depth = v.depth AND c.digest = v.digest GROUP BY ALL)
SELECT v.conv_id, v.depth, u.conv_id AS parent_conv_id, v.n_convs, coalesce(c.n_children, 0) AS n_children, s.n_leaves,
  s.saved_tokens::BIGINT AS saved_tokens, v.ends_sha256
FROM v JOIN s USING (depth, digest) LEFT JOIN c USING (depth, digest) LEFT JOIN e USING (depth, digest)
LEFT JOIN v u ON u.depth = v.depth - 1 AND u.digest = e.above
"""
