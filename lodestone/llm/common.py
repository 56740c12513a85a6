"""Helpers that several operators share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch handed to a Python worker.  Long texts
#: make batches heavy, so both are bounded.
ARROW_ROWS = 1000
ARROW_BYTES = 4 << 20
#: Rows of hashes or ids that are sent to all tasks: a few dozen MB at most.
FEW = 1 << 20


class Cache:
    """A bounded store of encoded units in two generations.

    What a full young generation doesn't meet again is forgotten with the next
    one, so common units stay however long the tail is.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], limit: int):
        self.encode, self.limit = encode, limit
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def clear(self) -> None:
        self.young, self.old = {}, {}

    def joined(self, lists: list[list[str]]) -> list[bytes]:
        """The encoded units of each list, joined."""
        missing = set().union(*lists).difference(self.young)
        if len(self.young) + len(missing) > self.limit:
            self.old, self.young, missing = self.young, {}, set().union(*lists)
        if missing:
            old = self.old
            known = missing.intersection(old) if old else ()
            self.young.update(zip(known, map(old.__getitem__, known)))
            new = list(missing.difference(known))
            if new:
                self.young.update(zip(new, self.encode(new)))
        get = self.young.__getitem__
        return [b"".join(map(get, x)) for x in lists]


Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def tidy(run: Run, forget: Callable[[], None] | None = None) -> Run:
    """``run`` for a Python stage that leaves nothing behind: workers live on and serve
    the next stages, so what ``forget`` lets go and freed memory go back to the system.
    """

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        if forget is not None:
            forget()
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc
            trim(0)

    return tidied


def tune(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session's Python stages."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where it is unset (tests, a single machine) a temporary folder is made
    and set as this session's checkpoint folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if configured:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(configured)
        return configured.rstrip("/")
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="lodestone-"))
    return context.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a table in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back.

    Cuts the lineage with files that outlive any executor, so a lost executor
    costs a reread and not a recomputation.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame) -> DataFrame:
    """``df``, a written table of a few longs a row, marked for broadcast if it has
    ``FEW`` rows at most; more rows meet the others in a shuffle."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, by Spark's reader only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """``name``, longer by as much as it takes to be no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def texts_of(docs: DataFrame, column: str = "text") -> DataFrame:
    """``doc_id`` and ``text`` alone; a null text reads as the empty text."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col(column).cast("string"), F.lit("")).alias("text"),
    )
