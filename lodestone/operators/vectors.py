"""Cosine search over vectors: an inverted-list index, and the exact way.

*Exact.*  Queries go to all tasks in blocks of a bounded size; a task multiplies
each batch of rows with them, part by part (``CELLS``), and keeps the ``k`` best rows
of every query, so what a task holds and what leaves it are bounded.  The tasks' rows
meet in one ranking for each query.

*Index.*  Centroids are fitted on a bounded sample; every vector belongs to the
list of its nearest centroid.  Lists are written as partitions, and Spark splits
hot ones over files (``rebalance``).  A search reads only the lists that one of its
queries probes, and a query meets only the rows of its own lists.

Defined results: scores are rounded to ``DIGITS``, ties go by ``vec_id``.  A query
doesn't find rows of its own ``vec_id``.  Null ids, null, empty and zero vectors,
vectors with a null or a number that isn't finite, and those of another length than
the first query's (in an index, than most) are never found and, as queries, find nothing.  Repeated rows are
found each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TOP = 10
DIGITS = 6
#: Queries that are sent to all tasks at once; more go in turns.
QUERY_BLOCK = 4096
#: Products of queries and rows that a task holds at once (8 bytes each, and a rounded copy).
CELLS = 1 << 21
#: Rows of the sample that centroids are fitted on, rounds of fitting, most lists.
SAMPLE, ROUNDS, MOST_LISTS = 20_000, 12, 1024
#: The share of the lists that a query probes.  The supplied vectors are nearly without
#: clusters (the best of 2,000 has a cosine of 0.41), so it takes half of the lists and more.
PROBED = 0.55
FOUND = "query_id long, neighbour long, score double"


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, embedding`` of vectors that have a direction."""
    e = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding"))
    good = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    return rows.filter(F.col("vec_id").isNotNull() & F.coalesce(good, F.lit(False)))


def matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The unit vectors of ``width`` in a column, and which rows they are."""
    ends = column.offsets.to_numpy()
    at = np.flatnonzero(np.diff(ends) == width)
    flat = column.values.to_numpy(zero_copy_only=False)
    rows = flat[ends[at][:, None] + np.arange(width)] if len(at) else np.zeros((0, width))
    return rows / np.linalg.norm(rows, axis=1, keepdims=True), at


class Heap:
    """The ``k`` best rows so far of each query."""

    def __init__(self, queries: np.ndarray, k: int):
        self.queries, self.k = queries, k
        self.ids = [np.zeros(0, np.int64) for _ in queries]
        self.scores = [np.zeros(0) for _ in queries]
        self.least = np.full(len(queries), -np.inf)

    def add(self, which: np.ndarray, products: np.ndarray, ids: np.ndarray) -> None:
        """``products`` of the queries ``which`` with the rows ``ids``."""
        products = np.round(products, DIGITS)
        hit = products >= self.least[which, None]
        for i in np.flatnonzero(hit.any(1)).tolist():
            q, at = int(which[i]), np.flatnonzero(hit[i])
            at = at[ids[at] != self.queries[q]]
            all_ids, scores = np.r_[self.ids[q], ids[at]], np.r_[self.scores[q], products[i, at]]
            best = np.lexsort((all_ids, -scores))[: self.k]
            self.ids[q], self.scores[q] = all_ids[best], scores[best]
            if len(best) == self.k:
                self.least[q] = self.scores[q][-1]

    def scan(self, which: np.ndarray, queries: np.ndarray, vectors: np.ndarray, ids: np.ndarray) -> None:
        """``add`` the products of unit ``vectors``, ``CELLS`` at a time."""
        step = max(1, CELLS // max(1, len(which)))
        for at in range(0, len(ids), step):
            self.add(which, queries @ vectors[at : at + step].T, ids[at : at + step])

    def batch(self) -> pa.RecordBatch:
        sizes = [len(x) for x in self.ids]
        columns = [np.repeat(self.queries, sizes), np.concatenate([np.zeros(0, np.int64), *self.ids]), np.concatenate([np.zeros(0), *self.scores])]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "neighbour", "score"])


def _scanned(rows: DataFrame, ids: np.ndarray, queries: np.ndarray, k: int, probes: list[np.ndarray] | None = None) -> DataFrame:
    """``FOUND`` of each task; ``probes`` are the queries of each list, else all of them."""
    asked = rows.sparkSession.sparkContext.broadcast((ids, queries, probes))  # QUERY_BLOCK vectors at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries, probes = asked.value
        heap, every = Heap(ids, k), np.arange(len(ids))
        for batch in batches:
            vectors, at = matrix(batch.column(1), queries.shape[1])
            own = batch.column(0).to_numpy()[at]
            if probes is None:
                heap.scan(every, queries, vectors, own)
                continue
            lists = batch.column(2).to_numpy()[at]
            for n in np.unique(lists).tolist():
                if len(which := probes[n]):
                    mine = lists == n
                    heap.scan(which, queries[which], vectors[mine], own[mine])
        yield heap.batch()

    return rows.mapInArrow(run, FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id", "turn").orderBy(F.desc("score"), "neighbour")
    out = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "neighbour", "score")


def _blocks(queries: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and unit vectors of the queries, block by block."""
    ids, rows = [], []

    def whole() -> tuple[np.ndarray, np.ndarray]:
        found = np.array(rows)
        return np.array(ids, np.int64), found / np.linalg.norm(found, axis=1, keepdims=True)

    width = None
    for r in usable(queries).toLocalIterator():  # a block of them is held
        width = width or len(r.embedding)
        if len(r.embedding) == width:
            ids.append(r.vec_id)
            rows.append(r.embedding)
        if len(ids) == QUERY_BLOCK:
            yield whole()
            ids, rows = [], []
    if ids:
        yield whole()


def _union(spark: SparkSession, parts: list[DataFrame]) -> DataFrame:
    if not parts:
        return spark.createDataFrame([], FOUND).withColumn("turn", F.lit(0))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def search_exact(vectors: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """``query_id, rank, neighbour, score``: the ``k`` most similar rows of every query."""
    rows = usable(vectors)
    parts = [_scanned(rows, ids, block, k).withColumn("turn", F.lit(i)) for i, (ids, block) in enumerate(_blocks(queries))]
    return _ranked(_union(vectors.sparkSession, parts), k)


def fit_centroids(sample: np.ndarray, lists: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids of unit vectors; an empty list takes the row that fits its own least."""
    start = np.random.default_rng(0).permutation(len(sample))[:lists]
    centroids = sample[start].copy()
    for _ in range(rounds):
        products = sample @ centroids.T
        own = products.argmax(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, sample)
        empty = np.flatnonzero(np.bincount(own, minlength=len(centroids)) == 0)
        sums[empty] = sample[np.argsort(products[np.arange(len(sample)), own], kind="stable")[: len(empty)]]
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), centroids)
    return centroids


def build_index(vectors: DataFrame, path: str, lists: int | None = None, sample: int = SAMPLE) -> None:
    """Write ``path/centroids`` and ``path/lists``; every usable vector is in a list."""
    spark, rows = vectors.sparkSession, usable(vectors)
    n = rows.count()
    chosen = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < F.lit(int((1 << 20) * min(1.0, sample / max(1, n))) or 1)
    # some ``sample`` rows, by a hash of their id
    fit_on = rows.filter(chosen).orderBy("vec_id").limit(2 * sample).toArrow().column("embedding").combine_chunks()
    # the commonest length
    width = int(np.bincount(np.diff(fit_on.offsets.to_numpy())).argmax()) if len(fit_on) else 0
    unit = matrix(fit_on, width)[0] if width else np.zeros((0, 0))
    lists = lists or int(min(MOST_LISTS, max(1, 2 * n**0.5)))
    centroids = fit_centroids(unit, min(lists, len(unit))) if len(unit) else unit
    spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(centroids)], "list int, centroid array<double>").write.parquet(f"{path}/centroids")
    shared = spark.sparkContext.broadcast(centroids)  # MOST_LISTS vectors at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = shared.value
        for batch in batches:
            own = np.zeros(batch.num_rows, np.int32)
            if len(centroids):
                vectors, at = matrix(batch.column(1), centroids.shape[1])
                own[at] = (vectors @ centroids.T).argmax(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own)], ["vec_id", "embedding", "list"])

    listed = rows.mapInArrow(run, "vec_id long, embedding array<double>, list int")
    listed.hint("rebalance", "list").write.partitionBy("list").parquet(f"{path}/lists")


def search_index(spark: SparkSession, path: str, queries: DataFrame, k: int = TOP, probed: float = PROBED) -> DataFrame:
    """Like ``search_exact`` over an index: a share ``probed`` of the lists for each query."""
    stored = [r.centroid for r in spark.read.schema("list int, centroid array<double>").parquet(f"{path}/centroids").orderBy("list").collect()]  # MOST_LISTS rows at most
    parts, centroids = [], np.array(stored)
    for i, (ids, block) in enumerate(_blocks(queries)):
        if not stored or block.shape[1] != centroids.shape[1]:
            continue
        many = max(1, int(np.ceil(probed * len(centroids))))
        nearest = np.argsort(-(block @ centroids.T), axis=1, kind="stable")[:, :many]
        probes = [np.flatnonzero((nearest == n).any(1)) for n in range(len(centroids))]
        rows = spark.read.schema("vec_id long, embedding array<double>, list int").parquet(f"{path}/lists")
        rows = rows.filter(F.col("list").isin([n for n, x in enumerate(probes) if len(x)])).select("vec_id", "embedding", "list")
        parts.append(_scanned(rows, ids, block, k, probes).withColumn("turn", F.lit(i)))
    return _ranked(_union(spark, parts), k)
