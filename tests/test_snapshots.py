import pytest
from pyspark.sql import functions as F

from quarrywork.sources import snapshots as S


def elements(files):
    """Two rows of each file, one of them of the kind that its number names."""
    kinds = F.explode(F.array(F.lit("all"), (F.col("n") % 3).cast("string")))
    return files.select("file_path", "modified", F.lit("c").alias("context"), kinds.alias("kind"))


def listing(spark, rows):
    return spark.createDataFrame([(f"f{n}", n, m) for n, m in rows], "file_path string, n int, modified int")


def rows(table):
    return sorted((r.file_path, r.kind, r.modified) for r in table.collect())


def expected(files):
    return sorted((f"f{n}", k, m) for n, m in files for k in ("all", str(n % 3)))


@pytest.fixture
def folder(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path / "shared"))
    return str(tmp_path / "table")


def test_reindex(spark, folder):
    first, second = [(1, 1), (2, 1), (3, 1), (4, 1)], [(1, 1), (2, 2), (4, 1), (5, 9)]
    S.reindex(spark, folder, listing(spark, first), elements)
    assert rows(S.read(spark, folder)) == expected(first)
    found = S.reindex(spark, folder, listing(spark, second), elements)
    assert {r.file_path: r.change for r in found.collect()} == {"f1": "unchanged", "f2": "modified", "f3": "deleted", "f4": "unchanged", "f5": "new"}
    assert rows(S.read(spark, folder)) == expected(second)
    assert rows(S.read(spark, folder, 1)) == expected(first)  # a reader of the version before still has it
    S.reindex(spark, folder, listing(spark, second), elements)
    assert S.versions(spark, folder) == [1, 2]  # nothing changed, nothing written
    assert S.vacuum(spark, folder) == 0  # kind 1 lies in the first snapshot still
    assert rows(S.read(spark, folder)) == expected(second)
    S.reindex(spark, folder, listing(spark, []), elements)
    assert S.vacuum(spark, folder) == 3  # an empty table names no row files, the last write's neither
    assert rows(S.read(spark, folder)) == []


def test_only_touched_partitions_are_written(spark, folder):
    S.reindex(spark, folder, listing(spark, [(1, 1), (2, 1)]), lambda f: elements(f).filter("kind <> 'all'"))
    S.reindex(spark, folder, listing(spark, [(1, 1), (2, 2)]), lambda f: elements(f).filter("kind <> 'all'"))
    parts = {p[1]: p[2] for p in S._manifest(spark, folder, 2)["parts"]}
    assert parts["1"] == S._manifest(spark, folder, 1)["parts"][0][2] != parts["2"]


def test_a_killed_write_leaves_the_table(spark, folder, monkeypatch):
    S.reindex(spark, folder, listing(spark, [(1, 1)]), elements)

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as patch:
        patch.setattr(S, "_publish", killed)
        with pytest.raises(KeyboardInterrupt):
            S.reindex(spark, folder, listing(spark, [(2, 1)]), elements)
    assert rows(S.read(spark, folder)) == expected([(1, 1)])
    S.reindex(spark, folder, listing(spark, [(2, 1)]), elements)
    assert rows(S.read(spark, folder)) == expected([(2, 1)])
    assert S.vacuum(spark, folder) == 2  # the first version's and what the killed write left


def test_failed_tasks_leave_the_table(spark, folder):
    S.reindex(spark, folder, listing(spark, [(1, 1)]), elements)
    broken = S.read(spark, folder).withColumn("modified", F.raise_error(F.lit("lost")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        S.commit(spark, folder, broken, [("c", "all")], 1)
    assert S.versions(spark, folder) == [1] and rows(S.read(spark, folder)) == expected([(1, 1)])


def test_the_second_of_two_writers_is_refused(spark, folder):
    S.reindex(spark, folder, listing(spark, [(1, 1)]), elements)
    table = S.read(spark, folder)
    assert S.commit(spark, folder, table.filter("kind = '1'"), [("c", "1")], 1) == 2
    with pytest.raises(S.Conflict):
        S.commit(spark, folder, table.limit(0), [("c", "1"), ("c", "all")], 1)
    assert rows(S.read(spark, folder)) == expected([(1, 1)])


def test_upsert_and_nulls(spark, folder):
    data = lambda rows: spark.createDataFrame(rows, "id string, context string, kind string, v int, indexed_at int")
    S.create(spark, folder, data([("a", "c", "x", 1, 1), ("b", None, "x", 1, 1), ("d", "c=/ ?", None, 1, 5)]))
    S.upsert(spark, folder, data([("b", None, "x", 2, 1), ("d", "c=/ ?", None, 2, 4), ("e", "c", "x", 2, 2)]))
    got = {r.id: (r.context, r.kind, r.v) for r in S.read(spark, folder).collect()}
    assert got == {"a": ("c", "x", 1), "b": (None, "x", 2), "d": ("c=/ ?", None, 1), "e": ("c", "x", 2)}
