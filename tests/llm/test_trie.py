"""The conversation trie against DuckDB on the given tables and against a plain trie on odd rows."""

import hashlib
import re
import zlib
from collections import defaultdict

import duckdb
import pytest

from quarrywork.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, words int"


def plain(rows):
    said = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            digest = hashlib.sha256(f"{len(role or '')}:{role or ''}:{text or ''}".encode()).hexdigest()
            said[c].append(((turn is not None, turn or 0), digest, (role or "", text or "")))
    turns = {c: [x[2] for x in sorted(v)] for c, v in said.items()}
    whole = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = turns.get(c - c % 20, [])[:h] + own[h:]
    members = defaultdict(list)
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            members[tuple(whole[c][:d])].append(c)
    words = lambda node: len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
    found = []
    for node, convs in members.items():
        below = [x for x in members if x[: len(node)] == node]
        children = [x for x in below if len(x) == len(node) + 1]
        leaves = [x for x in below if not any(y != x and y[: len(x)] == x for y in below)]
        ends = ",".join(str(c) for c in convs if len(whole[c]) == len(node))
        found.append((
            convs[0], len(node), members[node[:-1]][0] if node else None, len(convs), len(children), len(leaves),
            sum((len(members[x]) - 1) * words(x) for x in below), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(found, key=repr)


def built(spark, rows):
    frame = spark.createDataFrame([(*r, "x", 7) for r in rows], SCHEMA)
    return sorted((tuple(r) for r in trie.trie(*trie.rebuilt(trie.turns(frame))).collect()), key=repr)


def test_given_tables(spark):
    sf = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    found = trie.query(spark, sf)
    want = duck.sql(trie.ORACLE)
    places = [want.columns.index(c) for c in found.columns]
    want = sorted((tuple(r[i] for i in places) for r in want.fetchall()), key=repr)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == want
    rows = duck.sql("SELECT conv_id, turn, role, text FROM conversations").fetchall()
    assert plain(rows) == want


def test_odd_rows(spark):
    rows = [(c, t, "user", f"say {t}") for c in range(0, 45) for t in range(c % 6)]
    rows += [(50, None, None, None), (50, 1, "a", None), (50, 1, "b", "one two"), (50, 1, "b", "one two"), (51, None, "", "")]
    rows += [(None, 1, "user", "lost"), (63, 2, "user", "x " * 5000), (64, 2, "user", "x " * 5000), (65, 0, "user", "say 0")]
    assert built(spark, rows) == plain(rows)


def test_long_conversations(spark, monkeypatch):
    """Copies and branches of a conversation of more turns than two levels of blocks hold."""
    monkeypatch.setattr(trie, "BLOCK", 4)
    rows = [(c, t, "u", f"w {t}" if t < cut else f"w {t} {c}") for c, cut in ((100, 90), (101, 90), (102, 17), (103, 50), (120, 0)) for t in range(90)]
    assert built(spark, rows) == plain(rows)


def test_turnless_only(spark):
    rows = [(c, 0, "u", "t") for c in range(1001, 1020)]
    assert built(spark, rows) == plain(rows)


def test_empty_table(spark):
    assert built(spark, []) == []


@pytest.mark.parametrize("together", [1, 3])
def test_parts_of_ends(spark, monkeypatch, together):
    monkeypatch.setattr(trie, "TOGETHER", together)
    rows = [(c, 0, "u", "same") for c in range(200, 300)]
    assert built(spark, rows) == plain(rows)
