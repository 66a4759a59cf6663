"""Importance resampling towards a target distribution, by hashed word n-grams.

Every text is a bag of its runs of one to three words. How much likelier a hash bucket is in the target table than in
the corpus is the bucket's gain, a text's weight is the sum over its bag, and Gumbel noise on the weights draws
without replacement. Words become integers by a dictionary of the block that they are in, an n-gram is a tuple of such
numbers packed into one, each distinct tuple of a block is hashed once, from the check sums of its words' bytes, and
its bucket is joined back to where it occurs. A block is at most :data:`BLOCK` words, so a dictionary never grows with the
corpus and a text of any length passes through in pieces that overlap by two words. No text is shuffled: the corpus is read
once for the bucket counts (10,000 sums a task) and once for the weights.

Defined cases: a null or wordless text has no features, weight 0 and no rank unless ``least_words`` is 0; rows of one id
are judged each by its own text; the decimal text of a null id is empty, and it comes last among ties. An empty corpus
gives no rows, an empty target gains for rare buckets only. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, numbered, table

BUCKETS = 10_000
LONGEST = 3
#: Words that one dictionary is made for: few enough to stay in a cache. Their numbers fit in 21 bits, so that three of them fit in a long.
BLOCK = 1 << 17
_BITS = 21
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: The reflected polynomial of CRC-32 (fixed value).
_POLYNOMIAL = 0xEDB88320


@cache
def _shifts(power: int) -> np.ndarray:
    """What 2**power zero bytes after a message make of each byte of its CRC register: four tables of 256."""
    if power == 0:
        bits = []
        for i in range(32):
            x = 1 << i
            for _ in range(8):
                x = x >> 1 ^ (_POLYNOMIAL if x & 1 else 0)
            bits.append(x)
    else:
        bits = _shifted(_shifted(np.array([1 << i for i in range(32)], np.uint32), power - 1), power - 1).tolist()
    tables = np.zeros((4, 256), np.uint32)
    for place in range(4):
        for value in range(256):
            for i in range(8):
                if value >> i & 1:
                    tables[place, value] ^= np.uint32(bits[8 * place + i])
    return tables


def _shifted(crc: np.ndarray, power: int) -> np.ndarray:
    t = _shifts(power)
    return t[0][crc & 255] ^ t[1][crc >> 8 & 255] ^ t[2][crc >> 16 & 255] ^ t[3][crc >> 24]


def joined_crc(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The CRC-32 of two byte strings, one after the other, from theirs and the second's length."""
    found, power = first.astype(np.uint32), 0
    while (length >> power).any():
        on = (length >> power & 1).astype(bool)
        found[on] = _shifted(found[on], power)
        power += 1
    return found ^ second


def _block(words: list[bytes], document: np.ndarray, new: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document, bucket) of every n-gram that ends at or after place ``new``."""
    numbers: dict[bytes, int] = defaultdict()
    numbers.default_factory = numbers.__len__
    ids = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    alone = np.fromiter(map(zlib.crc32, numbers), np.uint32, len(numbers))
    after = np.fromiter((zlib.crc32(b" " + w) for w in numbers), np.uint32, len(numbers))
    length = np.fromiter((len(w) + 1 for w in numbers), np.int64, len(numbers))
    mask = (1 << _BITS) - 1
    for n in range(1, LONGEST + 1):
        last = np.arange(max(n - 1, new), len(ids))
        last = last[document[last - n + 1] == document[last]]
        packed = np.zeros(len(last), np.int64)
        for back in range(n - 1, -1, -1):
            packed = packed << _BITS | ids[last - back]
        distinct, where = np.unique(packed, return_inverse=True)
        parts = [distinct >> _BITS * i & mask for i in range(n - 1, -1, -1)]
        crc = alone[parts[0]]
        for part in parts[1:]:
            crc = joined_crc(crc, after[part], length[part])
        yield document[last], (crc % np.uint32(buckets)).astype(np.int64)[where]


def features(texts: list[str | None], buckets: int, block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(documents, buckets, words of each document so far): the n-grams of a batch, block by block."""
    words: list[bytes] = []
    owners: list[tuple[int, int]] = []  # a document and how many of the words at hand are its next ones
    n_words = np.zeros(len(texts), np.int64)
    new = 0

    def flush() -> Iterator[tuple]:
        document = np.repeat([d for d, _ in owners], [n for _, n in owners]).astype(np.int64)
        for found in _block(words, document, new, buckets):
            yield *found, n_words

    for i, text in enumerate(texts):
        said = _WORD.findall((text or "").encode("utf-8", "surrogatepass").translate(_LOWER))
        n_words[i] = len(said)
        at = 0
        while at < len(said):
            some = said[at : at + block - len(words)]
            words += some
            owners.append((i, len(some)))
            at += len(some)
            if len(words) == block:
                yield from flush()
                del words[: 1 - LONGEST]
                owners[:] = [(d, 1) for d, n in owners[1 - LONGEST :] for _ in range(min(n, LONGEST - 1))][1 - LONGEST :]
                new = len(words)
    yield from flush()


def bucket_counts(docs: DataFrame, text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in all texts: one row of a task for each bucket, summed by Spark."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, found, _ in features(batch.column(0).to_pylist(), buckets):
                total += np.bincount(found, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    rows = docs.select(text).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    found = np.zeros(buckets, np.int64)
    for bucket, n in rows:
        found[bucket] = n
    return found


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(target's share / corpus's share)) of each bucket, one added to every count."""
    every, wanted = int(corpus.sum()) + len(corpus), int(target.sum()) + len(target)
    ratio = ((t + 1) * every / ((s + 1) * wanted) for s, t in zip(corpus.tolist(), target.tolist()))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64)


def noise(key: object, seed: int) -> int:
    """Gumbel noise in thousandths, from a digest of the key."""
    h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighted(docs: DataFrame, gain: np.ndarray, key: str = "doc_id", text: str = "text", seed: int = 42) -> DataFrame:
    """(key, n_words, n_features, weight, score) of every document."""
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, n_words long, n_features long, weight long, score long"

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            weight, number, n_words = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
            for document, bucket, n_words in features(batch.column(1).to_pylist(), len(gain)):
                number += np.bincount(document, minlength=n)
                np.add.at(weight, document, gain[bucket])
            keys = batch.column(0)
            score = weight + np.array([noise(k, seed) for k in keys.to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays(
                [keys, *map(pa.array, (n_words, number, weight, score))], [key, "n_words", "n_features", "weight", "score"]
            )

    return docs.select(key, text).mapInArrow(weigh, schema)


def resample(
    docs: DataFrame,
    target: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    percent: int = 5,
    least_words: int = 20,
    buckets: int = BUCKETS,
    seed: int = 42,
) -> DataFrame:
    """(key, n_words, n_features, weight, score, rank): every document, and the place of those that are drawn.

    Of the N documents of at least ``least_words`` words, floor(percent * N / 100) of the highest scores are drawn, ties to the
    smaller key. The order is a sort by ranges; no task and no driver sees all of it.
    """
    gain = gains(bucket_counts(docs, text, buckets), bucket_counts(target, text, buckets))
    scored = cut(weighted(docs, gain, key, text, seed), "weights")
    able = scored.filter(F.col("n_words") >= least_words)
    drawn = able.count() * percent // 100
    placed = numbered(able, F.desc("score"), F.asc_nulls_last(key), into="rank")
    rank = F.when(F.col("rank") <= drawn, F.col("rank"))
    rest = scored.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return placed.withColumn("rank", rank).unionByName(rest)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")
