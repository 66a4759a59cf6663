import random

import numpy as np
import pytest

from quarrywork.llm import neardup
from quarrywork.llm.components import components, forest


def shingles(text, size):
    found = text.encode().lower().split() if text else []
    if not found:
        return set()
    span = min(size, len(found))
    return {tuple(found[i : i + span]) for i in range(len(found) - span + 1)}


def brute_force(docs, size, percent):
    sets = {i: shingles(t, size) for i, t in docs}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    docs, base = [], [rng.choice(words) for _ in range(120)]
    for _ in range(60):  # near copies at many distances, around the threshold too
        copy = list(base)
        for _ in range(rng.randrange(0, 16)):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        docs.append(" ".join(copy))
    docs += [docs[0]] * 5 + [docs[0].upper()]
    docs += [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 40))) for _ in range(60)]
    docs += ["", None, " \n\t", "one", "One", "a b", "a  b", "a b c"]
    docs.append(" ".join(words) * 20)
    return list(enumerate(docs, start=10))


@pytest.mark.parametrize("size", [2, 5])
def test_equals_brute_force(spark, size):
    docs = corpus()
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, digest string, id int")
    got = neardup.near_duplicates(frame, size=size).collect()
    assert len(got) == len(docs)
    expected = brute_force(docs, size, 80)
    for r in got:
        assert (r.n_shingles, r.component_id) == expected[r.doc_id]
        assert r.kept == (r.doc_id == r.component_id)


def test_blocks_lose_no_link(spark):
    docs = corpus()
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    expected = brute_force(docs, 2, 80)
    for limits in ({"block": 7}, {"block_shingles": 300}, {"block": 1}):
        got = neardup.near_duplicates(frame, size=2, **limits).collect()
        assert all((r.n_shingles, r.component_id) == expected[r.doc_id] for r in got)


def test_joined_ids_give_the_same_as_broadcast_ones(spark, monkeypatch):
    docs = corpus()
    monkeypatch.setattr(neardup, "BROADCAST_IDS", 0)
    got = neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), size=2).collect()
    expected = brute_force(docs, 2, 80)
    assert all((r.n_shingles, r.component_id) == expected[r.doc_id] for r in got)


def test_a_large_component_is_dealt_out_once(spark):
    rows = [(7, i, 1, 10) for i in range(1000)] + [(7, 5000 + i, 5000 + i, 10) for i in range(3)] + [(8, 1, 1, 10), (8, 2, 1, 10)]
    named = spark.createDataFrame(rows, "bucket long, id long, label long, n_shingles long")
    got = neardup.dealt(named, block=100).toPandas()
    assert set(got.bucket) == {7}
    assert (got.label == 1).sum() == 1000  # ten blocks and one of the others
    assert len(got) == 1000 + 3 * 10 + 3
    assert got.groupby(["i", "j"]).size().max() < 250
    few = neardup.dealt(named, block=2000).toPandas()
    assert len(few) == 1003 and set(few.i) == set(few.j) == {0}
    by_size = neardup.dealt(named, block_shingles=1000).toPandas()
    assert (by_size.label == 1).sum() == 1000 and by_size.groupby(["i", "j"]).size().max() < 250


def test_every_two_components_meet(spark):
    rng = random.Random(4)
    rows = [(1, i, rng.choice([0] * 30 + list(range(1, 12))), rng.randrange(1, 50)) for i in range(300)]
    named = spark.createDataFrame(rows, "bucket long, id long, label long, n_shingles long")
    for limits in ({"block": 9}, {"block": 40}, {"block_shingles": 500}):
        met = set()
        for _, group in neardup.dealt(named, **limits).toPandas().groupby(["i", "j"]):
            own = [(r.id, r.label, r.second) for r in group.itertuples()]
            second = any(x[2] for x in own)
            met |= {frozenset((a, b)) for a, x, p in own for b, y, q in own if x != y and (p != q or not second)}
        assert met == {frozenset((a, b)) for _, a, x, _ in rows for _, b, y, _ in rows if x != y}


def test_long_texts_among_short_ones(spark):
    rng = random.Random(9)
    long = [f"w{rng.randrange(10**6)}" for _ in range(200_000)]
    docs = [(1, " ".join(long)), (2, " ".join(long[:190_000])), (3, " ".join(long[:150_000])), (4, "a b c d e f g")]
    docs += [(i, "a b c d e f g") for i in range(5, 9)]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3} | {i: 4 for i in range(4, 9)}


def test_linked_rows_equal_brute_force():
    rng = np.random.default_rng(2)
    for span in (40, 40_000):
        sets = [np.unique(rng.integers(0, span, rng.integers(1, 60), dtype=np.uint32)) for _ in range(80)]
        sets += [np.unique(np.append(s[1:], np.uint32(7))) for s in sets[:40]]
        labels = rng.integers(0, 60, len(sets))
        got = {(x, int(labels[y])) for x, y in neardup.linked_rows(labels, sets, 80)}
        got |= {(y, int(labels[x])) for x, y in neardup.linked_rows(labels, sets, 80)}
        for x in range(len(sets)):
            for y in range(x):
                both = len(set(sets[x].tolist()) & set(sets[y].tolist()))
                if labels[x] != labels[y] and 100 * both >= 80 * (len(sets[x]) + len(sets[y]) - both):
                    assert (x, int(labels[y])) in got or (y, int(labels[x])) in got


def test_linked_rows_pass_over_members_just_below_the_threshold():
    def of(common, own, first):  # 44 elements, so many of them those of x
        return np.array([*range(common), *range(first, first + own)], np.uint64)

    x = of(44, 0, 0)
    component = [of(38, 6, 1000), of(38, 6, 2000), of(40, 4, 3000), of(30, 14, 4000)]  # 38/50, 38/50, 40/48, 30/58
    assert neardup.linked_rows(np.array([1, 1, 1, 1, 2]), [*component, x], 80) == [(4, 2)]
    assert neardup.linked_rows(np.array([1, 1, 2]), [component[0], component[1], x], 80) == []


def test_empty_repeated_and_null_ids(spark):
    schema = "doc_id long, text string"
    assert neardup.near_duplicates(spark.createDataFrame([], schema)).collect() == []
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f")]
    got = neardup.near_duplicates(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == [(0, 0), (1, 1), (1, 1), (2, 1)]


def test_deduplicate_keeps_columns(spark):
    rows = [(1, "a b c d e f", "x"), (2, "a b c d e f", "y"), (3, None, "z")]
    got = neardup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert got.columns == ["doc_id", "text", "lang"]
    assert sorted(r.doc_id for r in got.collect()) == [1, 3]


def test_deduplicate_decides_by_row(spark):
    """Brute force over rows: each text of an id is judged for itself, and no unique text goes."""
    rng = random.Random(12)
    texts = [t for _, t in corpus() if t and t.strip() and len(t) < 5000]
    rows = [(rng.randrange(1, 60), rng.choice(texts), rng.randrange(3)) for _ in range(150)]
    rows += [(1, "same words as in the other row"), (2, "same words as in the other row"), (2, "totally other words that stand here alone"),
             (3, "unique text that comes twice in this table"), (3, "unique text that comes twice in this table"),
             (2, "and a third text of number two alone"), (None, "same words as in the other row"), (70, ""), (70, "")]
    rows = [(*r, 1)[:3] for r in rows]
    frame = spark.createDataFrame(rows, "doc_id long, text string, id int").withColumnsRenamed({"id": "said"})
    got = neardup.deduplicate(frame)
    assert got.columns == frame.columns
    kept = [(r.doc_id, r.text) for r in got.collect()]
    sets = {t: shingles(t, 5) for _, t, _ in rows if t}
    names = list(sets)
    parent = {t: t for t in names}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in names:
        for b in names:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    linked = [(i, t) for i, t in kept if t and i is not None]
    assert sorted(find(t) for _, t in linked) == sorted({find(t) for i, t, _ in rows if t and i is not None})
    smallest = {}
    for i, t, _ in rows:
        if t and i is not None:
            smallest[find(t)] = min(i, smallest.get(find(t), i))
    assert all(i == smallest[find(t)] for i, t in linked)
    assert sorted(((i or 0), t) for i, t in kept if not t or i is None) == [(0, "same words as in the other row"), (70, ""), (70, "")]
    assert all(r.component_id is not None for r in neardup.near_duplicates(frame.filter("doc_id IS NOT NULL")).collect())


def test_signature_is_unbiased_with_less_variance():
    rng = np.random.default_rng(1)
    errors = []
    for _ in range(300):
        u = rng.integers(0, 2**63, 200, dtype=np.uint64)
        a, b = u[:120], u[40:160]
        errors.append((neardup.super_minhash(a) == neardup.super_minhash(b)).mean() - 80 / 160)
    independent = (0.25 / neardup.PLACES) ** 0.5
    assert abs(np.mean(errors)) < 4 * independent / 300**0.5
    assert np.std(errors) < independent


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)]
    expected = forest(edges)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in expected.items() if k != v or k in set(got)}
    assert {k for k, v in expected.items() if k != v} <= set(got)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
