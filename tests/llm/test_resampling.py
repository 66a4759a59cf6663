"""Importance resampling against a plain version that counts n-grams in a dictionary."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quarrywork.llm import resampling

SF = "/root/testdata/sf0.001"


def bag(text, buckets=10_000):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    grams = [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
    return len(words), Counter(zlib.crc32(g.encode()) % buckets for g in grams)


def plain(docs, target):
    bags = [(k, *bag(t)) for k, t in docs]
    s, t = Counter(), Counter()
    for _, _, b in bags:
        s += b
    for x in target:
        t += bag(x)[1]
    S, T = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000))))
    rows = []
    for k, n, b in bags:
        weight = sum(c * gain(x) for x, c in b.items())
        h = int(hashlib.sha256(f"42:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        rows.append((k, n, b.total(), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0]))
    rank = {id(r): i + 1 for i, r in enumerate(able[: 5 * len(able) // 100])}
    return sorted(((r[0], r[2], r[3], r[4], rank.get(id(r))) for r in rows), key=repr)


def test_given_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    found = [tuple(r) for r in resampling.query(spark, SF).select("doc_id", "n_features", "weight", "score", "rank").collect()]
    assert sorted(found, key=repr) == plain([tuple(r) for r in docs], target)


def test_odd_rows(spark):
    said = "Ünder the ÄPPLE tree 42 a_b-c " * 8
    rows = [(i, said + str(i)) for i in range(60)] + [(7, None), (None, said), (8, ""), (9, " .,\n"), (10, "x " * 50_000)]
    rows += [(3, said + "3")] * 2
    docs = spark.createDataFrame([(k, t, 1, "y") for k, t in rows], "doc_id long, text string, rank int, score string")
    target = spark.createDataFrame([(0, "the tree"), (1, None)], "item_id long, text string")
    found = resampling.resample(docs, target)
    got = sorted((tuple(r) for r in found.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)
    want = plain(rows, ["the tree", None])
    assert [g[:4] for g in got] == [w[:4] for w in want]  # of equal rows either may have the better place
    assert sorted(g[4] for g in got if g[4]) == list(range(1, 1 + sum(w[4] is not None for w in want)))


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert resampling.resample(docs, docs).collect() == []
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert [r.n_features for r in resampling.resample(one, docs).collect()] == [3]


@given(st.lists(st.text(st.sampled_from("aB zé9.\n"), max_size=40), max_size=6), st.integers(3, 9))
@settings(deadline=None, max_examples=60)
def test_blocks_change_nothing(texts, block):
    found = [Counter() for _ in texts]
    for document, bucket, _ in resampling.features(texts, 10_000, block):
        for d, b in zip(document.tolist(), bucket.tolist()):
            found[d][b] += 1
    assert found == [bag(t)[1] for t in texts]


@given(st.lists(st.tuples(st.binary(max_size=20), st.binary(max_size=300)), min_size=1, max_size=5))
@settings(deadline=None)
def test_joined_crc(pairs):
    first, second = (np.array([zlib.crc32(p[i]) for p in pairs], np.uint32) for i in (0, 1))
    length = np.array([len(p[1]) for p in pairs])
    assert resampling.joined_crc(first, second, length).tolist() == [zlib.crc32(a + b) for a, b in pairs]
