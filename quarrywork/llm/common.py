"""Shared helpers of the training-data operators.

Nothing outside this subpackage imports it.
"""

from __future__ import annotations

import tempfile
import uuid
import zlib
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The white space that separates words in every contract of this subpackage.
WORD_GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, through Spark's reader so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is what the cluster names in ``spark.checkpoint.dir``. Only where that is unset (tests,
    single-machine use) a fresh temporary folder is made and set for the session's context; a cluster must name one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="quarrywork-"))
    return context.getCheckpointDir().rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    The lineage ends there: a lost executor costs a reread, not a recomputation.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Remove a table that :func:`cut` wrote, once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fold(key: str | Column, n: int) -> Column:
    """The fold ``crc32(key as text) mod n``; null keys fall in fold 0."""
    column = F.col(key) if isinstance(key, str) else key
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % F.lit(n), F.lit(0)).cast("int")


def py_fold(key: object, n: int) -> int:
    return 0 if key is None else zlib.crc32(str(key).encode()) % n


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions) if conditions else F.lit(False)


def sample_rows(df: DataFrame, key: str, rows: int, *extra: str) -> DataFrame:
    """At most ``rows`` keys in a fixed pseudo-random order, for fitting a model on a bounded sample."""
    return df.select(key, *extra).orderBy(F.xxhash64(F.col(key)), F.col(key)).limit(rows)


def numbered(df: DataFrame, *order: Column, into: str) -> DataFrame:
    """``df`` with the place of each row in ``order``, from 1: a sort by ranges, each range numbered by its own task.

    Ties that the order leaves have any order, but one that stays: the sorted rows are a table in the shared folder.
    Only the number of rows of each range, as many as there are tasks, is put before each range's numbers.
    """
    within = 33  # bits that monotonically_increasing_id gives to a task's rows
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    written = cut(ordered.withColumn("_at", F.monotonically_increasing_id()), "sorted")
    task = F.shiftrightunsigned("_at", within)
    sizes = written.groupBy(task.alias("_task")).agg(F.count("*").alias("_n"))
    before = sizes.select("_task", (F.sum("_n").over(Window.orderBy("_task")) - F.col("_n")).alias("_before"))
    rows = written.withColumn("_task", task).join(F.broadcast(before), "_task")
    place = F.col("_before") + F.col("_at").bitwiseAND((1 << within) - 1) + 1
    return rows.select(*[F.col(f"`{c}`") for c in df.columns], place.alias(into))
