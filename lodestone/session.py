"""Sessions, and cutting the lineage of loops."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of text of a table that is sent to all tasks at most.
FEW_ROWS, FEW_BYTES = 1 << 18, 32 << 20
#: Rows of one task of a shuffle whose size is known beforehand.
TASK_ROWS = 1 << 19
#: Bytes of a shuffle's partition, compressed, that may be held as a hash table.
HASHED_BYTES = 8 << 20


def get_session(app: str = "lodestone", **conf: str) -> SparkSession:
    """A session with adaptive execution; the cluster's own settings stand."""
    builder = SparkSession.builder.appName(app).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where it is unset and the
    master is local, since the machines of a cluster don't share theirs."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lodestone-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder: a loop's next round starts from
    files that survive the loss of executors.

    The files' sizes are what Spark knows of the table.  ``DataFrame.checkpoint``
    would hand on the estimate of its plan, the product of both sides for a join: in
    a loop of joins that number gets twice as many digits every round, until it
    fills the driver's memory.
    """
    spark, path = df.sparkSession, shared_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(values: DataFrame, number: str) -> DataFrame:
    """The distinct rows of ``values`` with a ``number`` each, written out so that it stays."""
    return cut(values.distinct().withColumn(number, F.monotonically_increasing_id()))


@contextmanager
def dealt_for(spark: SparkSession, rows: int) -> Iterator[None]:
    """Shuffles of what is written inside have a task for ``TASK_ROWS`` of ``rows`` at
    least, so a task's memory doesn't grow with the table.  Such tasks aren't merged
    again by their compressed bytes; adaptive execution still splits skewed ones."""
    number, merged = "spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled"
    before = {name: spark.conf.get(name) for name in (number, merged)}
    tasks = -(-rows // TASK_ROWS)
    if tasks > int(before[number]):
        spark.conf.set(number, str(tasks))
        spark.conf.set(merged, "false")
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


@contextmanager
def hashed(spark: SparkSession) -> Iterator[None]:
    """Joins of what is written inside look rows up by hash, unsorted, where adaptive
    execution has seen that every partition of one side is small."""
    name, advised = "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = {n: spark.conf.get(n) for n in (name, advised)}
    spark.conf.set(advised, str(HASHED_BYTES))
    spark.conf.set(name, str(HASHED_BYTES))
    try:
        yield
    finally:
        for n, value in before.items():
            spark.conf.set(n, value)


def few(df: DataFrame) -> DataFrame:
    """``df``, a cut table of texts, marked for broadcast if counting shows it to be
    small; a larger one meets others in a shuffle."""
    n, size = df.agg(F.count("*"), F.sum(F.octet_length(F.concat_ws("", *df.columns)))).first()
    return F.broadcast(df) if n <= FEW_ROWS and (size or 0) <= FEW_BYTES else df


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a table in the checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
