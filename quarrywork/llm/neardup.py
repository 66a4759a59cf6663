"""Near-duplicate documents with SuperMinHash signatures.

Words are lower-cased (A-Z only) and split at ASCII white space. A document is the set of its distinct
word shingles, as 64-bit hashes. SuperMinHash gives every element a random permutation of the signature's
places and adds its rank there to a random fraction, so the smallest value of each place varies less than with
independent hashes. Ranks are handed out round by round to all elements at once; as a round's values lie
above those of the rounds before, the signature is done, early, once every place has a value.

Documents with equal sets are one class and go on as its smallest id. Bands of the signature hash to
buckets. Buckets are never expanded into all pairs:

1. every member is compared with a few pivots of its bucket; what the full sets confirm is united;
2. buckets that still hold several components compare members of different components, in blocks of bounded
   members and shingles. The bucket's largest component is dealt out once, as its members aren't compared with each
   other; only the other components' members go to every block. Within a block, a full set is a row of bits over
   the elements that any two members share, so that intersections are exact and cheap; only links leave the block,
   one of a member for each other component.

So a group of near copies adds about as many rows as it has members, and a pair in two components is always
compared. With 38 bands of 5 places a pair at the threshold of 0.8 shares no bucket with a chance of 3e-7; the
signatures hold a pair with a pivot back with a chance of about 1e-6, and then the second step finds it.

Defined cases: null, empty and blank texts have no shingles, are their own component and link with nothing;
with fewer words than a shingle has, the whole sequence is the one shingle. Every row gets a result: repeated
rows the same one, and rows of one id with different texts each the component of its own text, which links with
others as any text does. Rows with a
null id link with nothing and keep a null component. Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, drop_table, table
from .components import components

BANDS, ROWS = 38, 5
#: Places of a signature; the bands take the first 190.
PLACES = 512
#: Pivots that a bucket has over all bands, at most; a member of many buckets meets few different ones.
PIVOTS = 4
#: Places of 512 in which two-bit signatures may differ: expected 77 at 0.8, standard deviation 8 at most.
MOST_DIFFERENT = 115
LONGS = PLACES // 64
#: Members of one bucket, and their shingles, that a block of it has on average at most; larger buckets have
#: several blocks. Two of them meet in one group of a Python worker.
BLOCK, BLOCK_SHINGLES = 4096, 1 << 21
#: Ids, of 8 bytes each, that are broadcast to pick out documents.
BROADCAST_IDS = 500_000

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
STEPS = GOLDEN * np.arange(1, PLACES + 1, dtype=np.uint64)
MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64, a public-domain generator."""
    x = (x ^ (x >> np.uint64(30))) * MIX_1
    x = (x ^ (x >> np.uint64(27))) * MIX_2
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a whole text."""
    found = text.encode("utf-8", "replace").lower().split() if text else []
    if not found:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
    span = min(size, len(found))
    out = np.full(len(found) - span + 1, span, np.uint64)
    for k in range(span):
        out = mix(out * GOLDEN + hashes[k : len(found) - span + 1 + k])
    return np.unique(out)


def super_minhash(elements: np.ndarray, places: int = PLACES) -> np.ndarray:
    """The signature: for each place the smallest (rank, fraction) of any element, in one 64-bit number.

    In round j every element draws a fraction and a place among those that it has not used. The first
    round needs no record of the permutation; the later ones keep it, but only small sets need many.
    """
    signature = np.full(places, np.iinfo(np.uint64).max, np.uint64)
    n = len(elements)
    if not n:
        return signature
    order, each = None, np.arange(n)
    for j in range(places):
        drawn = mix(elements + STEPS[j])
        value = (np.uint64(j) << np.uint64(40)) | (drawn >> np.uint64(24))
        pick = j + ((drawn & np.uint64(0xFFFFFF)) % np.uint64(places - j)).astype(np.intp)
        if order is None:
            place, first = pick, pick
        else:
            place = order[each, pick]
            order[each, pick] = order[:, j]
        np.minimum.at(signature, place, value)
        if signature.max() >> np.uint64(40) <= j:
            break
        if order is None:
            order = np.tile(np.arange(places, dtype=np.uint8 if places <= 256 else np.uint16), (n, 1))
            order[each, first] = 0
    return signature


def said(text: str) -> Column:
    """By which texts of one id are told apart."""
    return F.xxhash64(F.col(text)).alias("said")


def sketch(docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """A row for each document: its set's size, digest and signature, and the buckets of its bands."""
    schema = "id long, said long, n_shingles long, digest binary, bands array<long>, bits array<long>"

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spread = mix(np.arange(1, BANDS + 1, dtype=np.uint64) * GOLDEN)
        for batch in batches:
            out = {"n": [], "digest": [], "bands": [], "bits": []}
            for value in batch.column(2).to_pylist():
                found = shingle_set(value, size)
                out["n"].append(len(found))
                out["digest"].append(xxhash.xxh3_128_digest(found.tobytes()))
                if not len(found):
                    out["bands"].append([]), out["bits"].append([0] * (2 * LONGS))
                    continue
                mixed = mix(super_minhash(found))
                band = spread.copy()
                for row in mixed[: BANDS * ROWS].reshape(BANDS, ROWS).T:
                    band = mix(band * GOLDEN + row)
                planes = [np.packbits((mixed >> np.uint64(k)).astype(np.uint8) & 1).view(np.int64) for k in (63, 62)]
                out["bands"].append(band.view(np.int64))
                out["bits"].append(np.concatenate(planes))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(out["n"], pa.int64()), pa.array(out["digest"], pa.binary())]
                + [pa.array(out[k], longs) for k in ("bands", "bits")],
                names=["id", "said", "n_shingles", "digest", "bands", "bits"],
            )

    return docs.select(F.col(key).cast("long").alias("id"), said(text), F.col(text).alias("text")).mapInArrow(sketches, schema)


def shingle_sets(docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(id, elements): the full set of each document, as sorted 64-bit numbers."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(t, size).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["id", "elements"])

    return docs.select(F.col(key).cast("long").alias("id"), F.col(text)).mapInArrow(sets, "id long, elements binary")


def overlap(a: bytes, b: bytes) -> tuple[int, int]:
    """Sizes of the intersection and the union of two sets."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both, len(x) + len(y) - both


def close(x: Column, y: Column) -> Column:
    """Whether two signatures, two bits of each place in two planes, differ in few enough places."""
    differ = sum(
        F.bit_count(x[k].bitwiseXOR(y[k]).bitwiseOR(x[k + LONGS].bitwiseXOR(y[k + LONGS]))) for k in range(LONGS)
    )
    return differ <= MOST_DIFFERENT


def alike(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs (a, b) whose signatures agree in enough places."""
    own = sketches.select("id", "bits").dropDuplicates(["id"])
    joined = pairs.join(own.select(F.col("id").alias("a"), F.col("bits").alias("x")), "a").join(
        own.select(F.col("id").alias("b"), F.col("bits").alias("y")), "b"
    )
    return joined.filter(close(F.col("x"), F.col("y"))).select("a", "b")


def only(docs: DataFrame, key: str, text: str, nodes: DataFrame, leaders: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``_id``, text) of the rows of ``docs`` that lead one of the classes ``nodes``, a small share of them; and the
    table that names them, for the caller to drop.

    Up to ``BROADCAST_IDS`` of them, which are counted first, are broadcast, so that no text moves; more are joined.
    """
    named = cut(nodes.select(F.col("id").alias("node")).distinct(), "nodes")
    few = named.count() <= BROADCAST_IDS
    bounded = F.broadcast if few else lambda df: df
    wanted = cut(leaders.select("node", "id", "said").join(bounded(named), "node", "semi"), "wanted")
    drop_table(named)
    told = docs.select(F.col(key).cast("long").alias("id"), said(text), F.col(text).alias("_text"))
    return told.join(bounded(wanted), ["id", "said"]).select(F.col("node").alias("_id"), "_text"), wanted


def confirm(
    pairs: DataFrame, docs: DataFrame, key: str, text: str, leaders: DataFrame, size: int, percent: int
) -> DataFrame:
    """The pairs (a, b) whose full sets overlap by the threshold. Sets are made for these documents only."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                both, either = overlap(a, b)
                kept.append(100 * both >= percent * either)
            yield batch.select([0, 1]).filter(pa.array(kept, pa.bool_()))

    ends = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id")))
    sought, ids = only(docs, key, text, ends, leaders)
    sets = cut(shingle_sets(sought, "_id", "_text", size).distinct(), "sets")
    joined = pairs.join(sets.select(F.col("id").alias("a"), F.col("elements").alias("x")), "a").join(
        sets.select(F.col("id").alias("b"), F.col("elements").alias("y")), "b"
    )
    found = cut(joined.select("a", "b", "x", "y").mapInArrow(verify, "a long, b long"), "links")
    drop_table(sets)
    drop_table(ids)
    return found


def linked_rows(
    labels: np.ndarray, sets: list[np.ndarray], percent: int, second: np.ndarray | None = None
) -> list[tuple[int, int]]:
    """Places (x, y) of sets in different components that overlap by the threshold, one y of each for an x.

    Exact, so that one y stands for its whole component. Without ``second``, the largest component's own members
    aren't compared with anything but by the others. Where some are marked as ``second``, the others are compared with
    these alone.
    """
    names, code, count = np.unique(labels, return_inverse=True, return_counts=True)
    if len(names) == 1:
        return []
    if second is None or not second.any():
        rest, others = np.flatnonzero(code != count.argmax()), np.arange(len(sets))
    else:
        rest, others = np.flatnonzero(~second), np.flatnonzero(second)
    lengths = np.fromiter(map(len, sets), np.int64, len(sets))
    _, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.cumsum(times > 1) - 1
    row, shared = np.repeat(np.arange(len(sets)), lengths), times[at] > 1
    row, column = row[shared], column[at[shared]]
    common = np.zeros((len(rest), len(others)), np.int32)
    for low in range(0, int(column.max(initial=-1)) + 1, 8192):
        here = (column >= low) & (column < low + 8192)
        wide = np.zeros((len(sets), 8192 if column.max() >= low + 8192 else -(-(int(column.max()) + 1 - low) // 64) * 64), bool)
        wide[row[here], column[here] - low] = True
        bits = np.packbits(wide, axis=1).view(np.uint64)
        beside = bits[others]
        for i in np.flatnonzero(bits[rest].any(axis=1)):
            common[i] += np.bitwise_count(beside & bits[rest[i]]).sum(axis=1, dtype=np.int32)
    found = []
    for i, x in enumerate(rest):
        either = lengths[others] + lengths[x] - common[i]
        hit = others[(100 * common[i] >= percent * either) & (code[others] != code[x])]
        found += [(int(x), int(hit[k])) for k in np.unique(code[hit], return_index=True)[1]]
    return found


def dealt(named: DataFrame, block: int = BLOCK, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """(bucket, i, j, second, id, label): who meets whom in which group, from rows (bucket, id, label, n_shingles).

    A bucket that fits a block is one group. Otherwise its largest component (``j`` is -1 - its block) is dealt into
    blocks, once for each block of the others; each of the others goes to all these blocks, and to all pairs of blocks of
    the others. Buckets of one component are left out.
    """
    sums = named.groupBy("bucket", "label").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    whole = sums.groupBy("bucket").agg(
        F.max(F.struct("n", "s", "label")).alias("top"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.count("*").alias("kinds")
    )
    blocks = lambda n, s: F.greatest(F.ceil(n / block), F.ceil(s / block_shingles)).cast("int")
    plan = whole.filter("kinds > 1").select(
        "bucket",
        "kinds",
        (blocks(F.col("n"), F.col("s")) == 1).alias("fits"),
        F.col("top.label").alias("top"),
        blocks(F.col("top.n"), F.col("top.s")).alias("large"),
        blocks(F.col("n") - F.col("top.n"), F.col("s") - F.col("top.s")).alias("small"),
    )
    rows = named.select("bucket", "id", "label").join(plan, "bucket")
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    place = lambda i, j, second: F.struct(i.alias("i"), j.alias("j"), second.alias("second"))
    of_top = F.transform(every("small"), lambda i: place(i, -1 - own("large"), F.lit(True)))
    with_top = F.transform(every("large"), lambda k: place(own("small"), -1 - k, F.lit(False)))
    apart = F.transform(
        every("small"), lambda o: place(F.least(own("small"), o), F.greatest(own("small"), o), own("small") > o)
    )
    others = F.when(F.col("kinds") == 2, with_top).otherwise(F.concat(with_top, apart))
    one = F.array(place(F.lit(0), F.lit(0), F.lit(False)))
    places = F.when(F.col("fits"), one).when(F.col("label") == F.col("top"), of_top).otherwise(others)
    return rows.select("bucket", "id", "label", F.inline(places))


def across(
    left: DataFrame, docs: DataFrame, key: str, text: str, leaders: DataFrame, size: int, percent: int
) -> DataFrame:
    """Pairs (a, b) of members of one bucket that are in different components and overlap by the threshold."""

    def compare(group: pa.Table) -> pa.Table:
        ids, labels = group["id"].to_numpy(), group["label"].to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in group["elements"].to_pylist()]
        found = linked_rows(labels, sets, percent, group["second"].to_numpy(zero_copy_only=False).astype(bool))
        pairs = np.array([(min(ids[x], ids[y]), max(ids[x], ids[y])) for x, y in found], np.int64).reshape(-1, 2)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    sought, ids = only(docs, key, text, left, leaders)
    sets = shingle_sets(sought, "_id", "_text", size).distinct()
    # merged, so that the rows of one set come one after the other and compress before they move
    groups = left.join(sets.hint("merge"), "id").groupBy("bucket", "i", "j")
    found = cut(groups.applyInArrow(compare, "a long, b long").distinct(), "more")
    drop_table(ids)
    return found


def buckets(classes: DataFrame, *columns: str | Column) -> DataFrame:
    """A row for each band of each class; the bucket's key already tells the bands apart."""
    return classes.select("id", *columns, F.posexplode("bands").alias("band", "bucket"))


def grouped(
    docs: DataFrame, key: str, text: str, size: int, percent: int, block: int = BLOCK, block_shingles: int = BLOCK_SHINGLES
) -> DataFrame:
    """(id, said, n_shingles, component, least), a row for each row of ``docs``: ``said`` is a hash of the text,
    ``component`` a number of the component, null where nothing links, and ``least`` its smallest id."""
    sketches = cut(sketch(docs, key, text, size), "sketches")
    held = sketches.filter((F.col("n_shingles") > 0) & F.col("id").isNotNull())
    # a class, of equal sets, is the node of its smallest id; where an id leads several, all but one get another number
    first = held.groupBy("digest").agg(F.min(F.struct("id", "said")).alias("first")).select("digest", "first.*")
    first = cut(first, "firsts")
    several = first.groupBy("id").agg(F.min("said").alias("_own"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    several = cut(several, "several")
    other = -1 - F.shiftrightunsigned(F.xxhash64("digest"), 2)
    node = F.when(F.col("_own").isNull() | (F.col("_own") == F.col("said")), F.col("id")).otherwise(other)
    leaders = cut(first.join(several, "id", "left").select("digest", "id", "said", node.alias("node")), "leaders")
    classes = cut(
        held.join(leaders.select("id", "said", "node"), ["id", "said"])
        .dropDuplicates(["id", "said"])  # as the join is dealt, so that nothing moves again
        .select(F.col("node").alias("id"), "n_shingles", "bands", "bits"),
        "classes",
    )

    # first every member with its bucket's pivot, which is another one in each of a few groups of bands
    rank = F.xxhash64("id", F.col("band") % PIVOTS)
    rows = buckets(classes, "n_shingles").select("bucket", "id", "n_shingles", rank.alias("rank"))
    pivots = rows.groupBy("bucket").agg(F.min(F.struct("rank", "id")).alias("first"), F.count("*").alias("n"))
    pivots = pivots.filter("n > 1").select("bucket", F.col("first.id").alias("pivot"))
    shared = cut(rows.join(pivots, "bucket").select("bucket", "id", "n_shingles", "pivot"), "buckets")
    pairs = shared.filter("id != pivot")
    pairs = pairs.select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct()
    tried = cut(alike(pairs, classes), "tried")
    links = confirm(tried, docs, key, text, leaders, size, percent)
    united = components(links)
    for done in (classes, tried):
        drop_table(done)

    # then members of one bucket that are still in different components
    label = F.coalesce(F.col("component"), F.col("id")).alias("label")
    named = shared.join(united.withColumnRenamed("node", "id"), "id", "left").select("bucket", "id", "n_shingles", label)
    left = cut(dealt(named, block, block_shingles), "mixed")
    more = across(left, docs, key, text, leaders, size, percent)
    again = components(united.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    for done in (links, shared, left, more, united):
        drop_table(done)

    # members of a class have the component of its leader; an id that leads several may name several components
    own = leaders.join(again, "node", "left").withColumn("component", F.coalesce("component", "node"))
    if several.isEmpty():
        own = own.withColumn("least", F.col("component"))
    else:
        own = own.join(own.groupBy("component").agg(F.min("id").alias("least")), "component")
    drop_table(first)
    drop_table(several)
    own = own.select("digest", "component", "least")
    linked = (F.col("n_shingles") > 0) & F.col("id").isNotNull()
    return (
        sketches.select("id", "said", "n_shingles", "digest")
        .join(own, "digest", "left")
        .select("id", "said", "n_shingles", F.when(linked, F.col("component")).alias("component"),
                F.when(linked, F.col("least")).otherwise(F.col("id")).alias("least"))
    )


def near_duplicates(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    size: int = 5,
    percent: int = 80,
    block: int = BLOCK,
    block_shingles: int = BLOCK_SHINGLES,
) -> DataFrame:
    """(``key``, n_shingles, component_id, kept), a row for each row of ``docs``.

    ``component_id`` is the smallest id that links reach; ``kept`` marks the document that has it.
    """
    found = grouped(docs, key, text, size, percent, block, block_shingles)
    return found.select(
        F.col("id").alias(key),
        "n_shingles",
        F.col("least").alias("component_id"),
        F.coalesce(F.col("id") == F.col("least"), F.lit(True)).alias("kept"),
    )


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component, all its columns kept.

    Rows are told apart by id and text: the row that stays has the component's smallest id, of several texts of this
    id that are in the component the one with the smallest hash, and of equal rows one. An id's other texts are judged in
    their own components. Rows with a null id, and texts without a word, link with nothing and all stay.
    """
    found = grouped(docs, key, text, size, percent).filter(F.col("component").isNotNull())
    rows = found.groupBy("id", "said", "component").agg(F.count("*").alias("n"))
    first = rows.groupBy("component").agg(F.min(F.struct("id", "said")).alias("first"))
    judged = rows.join(first, "component").withColumn("stays", F.struct("id", "said") == F.col("first"))
    judged = cut(judged.filter(~F.col("stays") | (F.col("n") > 1)).select("id", "said", "stays"), "copies")
    marked = docs.select(F.struct(*docs.columns).alias("_row"), F.col(key).cast("long").alias("id"), said(text))
    stay = marked.join(judged, ["id", "said"], "anti").select("_row.*")
    if judged.filter("stays").isEmpty():
        return stay
    again = marked.join(judged.filter("stays"), ["id", "said"], "semi").groupBy("id", "said")
    one = again.agg(F.min_by("_row", F.xxhash64(F.to_json("_row"))).alias("_row")).select("_row.*")
    return stay.unionByName(one)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingles of two words, as its contract says."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), size=2)


ORACLE = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'),
    lambda x: x != '') AS words
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) = 1 THEN [words[1]]
    ELSE list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) END AS shingles
  FROM w),
e AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM s),
link AS (
  SELECT a.doc_id AS x, b.doc_id AS y
  FROM e a JOIN e b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
linked AS (SELECT x, y FROM link UNION SELECT y, x FROM link),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM s UNION SELECT reach.doc_id, linked.y FROM reach JOIN linked ON reach.other = linked.x),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT s.doc_id, len(shingles) AS n_shingles, component_id, s.doc_id = component_id AS kept
FROM s JOIN least USING (doc_id)
"""
