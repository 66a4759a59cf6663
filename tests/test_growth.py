"""What a step writes grows with its rows, not with their pairs."""

import pyarrow as pa
from pyspark.sql import functions as F

from quarrywork.operators import blocks, graph, usage, vectors


def test_groups_meet_leaders_only(spark, monkeypatch):
    """400 texts with the same common words, half of them with a price: every two of them might be alike by their words."""
    written, cut = [], blocks.cut

    def counted(df):
        table = cut(df)
        written.append(table.count())
        return table

    monkeypatch.setattr(blocks, "cut", counted)
    flags = [F.lit(False).alias(f) for f in blocks.FLAGS[:3]]
    word = lambda k: F.concat(F.lit("w"), (F.xxhash64("page", F.lit(k)) % 20).cast("string"))
    frame = spark.range(400).select(
        F.col("id").alias("page"), F.lit("0.0").alias("pos"), F.lit(3).alias("elements"), *flags, (F.col("id") % 2 == 0).alias("price")
    ).withColumn("content", F.concat_ws(" ", *[word(k) for k in range(20)], "page"))
    got = blocks.groups(frame, "page")
    assert got.count() == 400
    assert sum(written) <= 2 * 400


def test_a_worker_holds_few_pairs(spark, monkeypatch):
    """What one group of two blocks gives is bounded, whatever the number of queries."""
    dealt, of = [], vectors._blocks

    def seen(*args):
        dealt.append(of(*args))
        return dealt[-1]

    monkeypatch.setattr(vectors, "_blocks", seen)
    frame = spark.range(6000).select("id", F.array(F.rand(1), F.rand(2)).alias("v"))
    vectors.similarities(frame.filter("id < 1200"), frame, "id", "v")
    a, b = (side.groupBy("_i", "_j").count() for side in dealt[0])
    most = a.join(b.withColumnRenamed("count", "m"), ["_i", "_j"]).agg(F.max(F.col("count") * F.col("m"))).first()[0]
    assert most <= 2 * 250_000


def test_copies_grow_with_rows(spark, monkeypatch):
    """Where all pairs of a fiftieth of the rows with the rows are asked for, no more than the rows again are moved for it."""
    dealt, of = [], vectors._blocks

    def seen(*args):
        dealt.append(of(*args))
        return dealt[-1]

    monkeypatch.setattr(vectors, "_blocks", seen)
    frame = spark.range(40_000).select("id", F.array(F.rand(1), F.rand(2)).alias("v"))
    vectors.similarities(frame.filter("id % 50 = 0"), frame, "id", "v")
    assert sum(side.count() for side in dealt[0]) <= 2 * 40_800


def test_pairs_leave_a_few_at_a_time(spark, monkeypatch):
    """A group of any size: no batch of its pairs has more than the bound, and all of them come."""
    monkeypatch.setattr(vectors, "AT_MOST", 300)
    rows = [(False, i, [1.0, i]) for i in range(50)] + [(True, i, [1.0, -i]) for i in range(130)]
    other, key, v = (pa.array(x) for x in zip(*rows))
    whole = pa.RecordBatch.from_arrays([other, key, v], names=["_other", "id", "_v"])
    pieces = list(vectors._meeting("id", (), None)(iter([whole.slice(i, 40) for i in range(0, 180, 40)])))
    assert max(p.num_rows for p in pieces) <= 300 and sum(p.num_rows for p in pieces) == 50 * 130 - 50
    got = {(q, i): s for p in pieces for q, i, s in zip(*(c.to_pylist() for c in p.columns))}
    assert len(got) == 50 * 129 and abs(got[3, 2] - (1 - 6) / (10 * 5) ** 0.5) < 1e-12


def test_tasks_grow_with_rows(spark, monkeypatch):
    """Joins that make several rows of one are dealt by rows, not put together by the size of what they read."""
    monkeypatch.setattr(graph, "AT_ONCE", 50)
    monkeypatch.setattr(usage, "AT_ONCE", 100)
    rows = spark.range(1000).select((F.col("id") / 4).cast("long").alias("g"), (F.col("id") % 7).alias("x"), F.timestamp_seconds("id").alias("ts"))
    for found, parts in ((graph.pairs_within(rows, "g", "x"), 20), (usage.followed_by(rows.withColumn("x", F.col("x").cast("string")), "g", "x", "ts"), 40)):
        assert f", {parts}), REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()


class Handle:
    """What a state's handle does, with the number of its timers."""

    def __init__(self):
        self.timers, self.rows = [], []

    def registerTimer(self, at):
        self.timers.append(at)

    def getListState(self, *_):
        return self

    def getValueState(self, *_):
        return self

    def appendList(self, rows):
        self.rows += rows


def test_one_timer_for_a_batch():
    import pandas as pd

    from quarrywork.streaming import keyed

    step, handle = keyed._Debounce(1000), Handle()
    step.init(handle)
    rows = pd.DataFrame({"at": range(5_000_000, 6_000_000, 1000), "number": range(1000), "kind": "edit", "done": False})

    class Times:
        getCurrentWatermarkInMs = staticmethod(lambda: 0)

    list(step.handleInputRows(("p",), iter([rows]), Times))
    assert handle.timers == [5000] and len(handle.rows) == 1000
