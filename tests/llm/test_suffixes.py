"""Repeated strings against a dictionary of all strings of the length."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarrywork.llm import suffixes

SF = "/root/testdata/sf0.001"


def plain(rows, length):
    data = [(k, (t or "").encode()) for k, t in rows]
    seen = Counter(hash(d[i : i + length]) for _, d in data for i in range(len(d) - length + 1))
    found = []
    for key, d in data:
        gone = np.zeros(len(d) + 1, bool)
        end = 0
        for i in range(len(d) - length + 1):
            if seen[hash(d[i : i + length])] > 1:
                gone[max(i, end) : i + length] = True
                end = i + length
        edges = np.diff(np.concatenate([[0], gone.astype(int)]))
        spans = tuple(zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist()))
        kept = bytes(b for b, x in zip(d, gone) if not x)
        found.append((key, len(d), spans, kept))
    return sorted(found, key=repr)


def built(spark, rows, length):
    docs = spark.createDataFrame([(k, t, 3, "n") for k, t in rows], "doc_id long, text string, n int, _n string").repartition(3)
    found = suffixes.without_repeats(docs, length=length).collect()
    return sorted(((r.doc_id, r.n_bytes, tuple(map(tuple, r.spans)), bytes(r.kept)) for r in found), key=repr)


def test_given_tables(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = [(k, n, sum(b - a for a, b in s), len(s), hashlib.sha256(kept).hexdigest()) for k, n, s, kept in plain(rows, 400)]
    assert sum(x[2] > 0 for x in want) > 5
    assert sorted(map(tuple, suffixes.query(spark, SF).collect())) == sorted(want)


@pytest.mark.parametrize("seed", [1, 2])
def test_pieces_of_each_other(spark, seed):
    """Texts that are made of pieces of a few sources, cut anywhere, with edits, periodic parts and copies."""
    r = random.Random(seed)
    source = ["".join(r.choice("abcdeé ") for _ in range(300)) for _ in range(4)] + ["ab" * 120, "x" * 200, "the cat " * 30]
    rows = []
    for i in range(70):
        parts = []
        for _ in range(r.randint(1, 4)):
            s = r.choice(source)
            a = r.randrange(len(s) - 20)
            parts.append(s[a : a + r.randint(10, 160)] + "".join(r.choice("pqrs") for _ in range(r.randint(0, 12))))
        rows.append((i, "".join(parts)))
    rows += [(100, rows[0][1]), (101, rows[0][1]), (7, "short"), (None, None), (8, ""), (None, rows[3][1] + "z")]
    assert built(spark, rows, 40) == plain(rows, 40)


def test_one_text_repeats_itself(spark):
    r = random.Random(3)
    once = "".join(r.choice("abcdefgh") for _ in range(150))
    rows = [(1, once + "-" + once), (2, "y" * 1000), (3, "abcab" * 100)]
    assert built(spark, rows, 60) == plain(rows, 60)


def test_exact_length(spark):
    r = random.Random(4)
    said = "".join(r.choice("abcdefgh") for _ in range(60))
    rows = [(i, "".join(r.choice("stuv") for _ in range(i)) + said + "".join(r.choice("wxyz") for _ in range(40 - i))) for i in range(40)]
    rows += [(50, said[1:] + "!" * 30), (51, said[:-1] + "?" * 30)]
    assert built(spark, rows, 60) == plain(rows, 60)


def test_empty_table(spark):
    assert built(spark, [], 40) == []
    assert built(spark, [(1, "a"), (1, "a")], 40) == plain([(1, "a"), (1, "a")], 40)


@given(st.binary(min_size=120, max_size=300), st.integers(0, 40), st.integers(0, 40))
@settings(deadline=None, max_examples=60)
def test_three_equal_phrases(data, before, after):
    """Strings of the length share three phrases wherever they lie: what finds every repetition."""
    length = 100
    width = suffixes.window(length)
    one, two = data[:length] , bytes(range(before)) + data[:length] + bytes(range(after))
    a, b = suffixes.anchors(one, width), suffixes.anchors(two, width) - before
    certain = [x for x in a if width - 1 <= x <= length - suffixes.GRAM - width + 1]
    assert certain == [x for x in b if width - 1 <= x <= length - suffixes.GRAM - width + 1]
    assert certain[0] <= 2 * width - 2 and len(certain) > 3


def test_tables_go_once_they_are_read(spark, monkeypatch):
    """What lies in the shared folder at once is what bounds the disk: of the wide tables one or two at a time."""
    r = random.Random(9)
    said = "".join(r.choice("abcdefgh") for _ in range(90))
    rows = [(i, "".join(r.choice("stuv") for _ in range(30)) + said[i % 7 :]) for i in range(20)]
    held, at_once, written, dropped = {}, {}, suffixes.written, suffixes.drop_table

    def write(df, name):
        out = written(df, name)
        held[out.inputFiles()[0].rsplit("/", 1)[0]] = name
        at_once[name] = set(held.values())
        return out

    def drop(df):
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            del held[folder]
        dropped(df)

    monkeypatch.setattr(suffixes, "written", write)
    monkeypatch.setattr(suffixes, "drop_table", drop)
    assert built(spark, rows, 60) == plain(rows, 60)
    assert at_once["strings"] == {"texts", "rows", "whole", "contexts", "strings"}
    assert at_once["marks"] == {"texts", "rows", "whole", "some", "marks"}


def test_lists_are_gathered_from_sorted_rows(spark, monkeypatch):
    plans, written = [], suffixes.written

    def spied(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, name)

    monkeypatch.setattr(suffixes, "written", spied)
    before = {key: spark.conf.get(key, None) for key in suffixes._SETTINGS}
    rows = [(i, "".join(random.Random(i % 3).choices("abcd ", k=600)) + str(i)) for i in range(6)]
    assert built(spark, rows, 400) == plain(rows, 400)
    assert any("collect_list" in p for p in plans) and not any("ObjectHashAggregate" in p for p in plans)
    assert {key: spark.conf.get(key, None) for key in before} == before


def test_rows_of_one_key_can_be_split(spark, monkeypatch):
    """Where rows are joined with the counts of their keys, each side is dealt for the join alone, not for counting too: only then does Spark split a key."""
    plans, written = {}, suffixes.written

    def spied(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return written(df, name)

    monkeypatch.setattr(suffixes, "written", spied)
    r = random.Random(5)
    said = "".join(r.choice("abcdefgh") for _ in range(90))
    rows = [(i, "".join(r.choice("stuv") for _ in range(40)) + said + "".join(r.choice("wxyz") for _ in range(40))) for i in range(30)] + [(i, said * 2) for i in range(30, 60)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert built(spark, rows, 60) == plain(rows, 60)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    for name in ("rows", "strings", "some"):
        assert re.findall(r"[-:] Sort \[.*\n[ :]*\+- (\w+)", plans[name]) == ["Exchange"] * 2, plans[name]
