r"""Ranked lexical search by Block-Max WAND over segments of an inverted index.

*Index.*  Every task cuts its documents into segments of about
``SEGMENT_POSTINGS`` postings and writes a row for each term of a segment, in
order of terms.  A row's postings lie in blocks of ``BLOCK_POSTINGS``, compressed
as variable-byte gaps and frequencies; beside them stand each block's last
document, its greatest impact and where it ends.  Nothing is shuffled, and a
segment's size has a bound whatever the corpus holds.

*Search.*  Only the rows of asked terms leave the index; a task gets one segment.
There a query's threshold is the score of its ``k``-th best document so far.

* A query of which the terms' greatest impacts don't reach the threshold is over.
* Shallow moves: the block borders of all lists are passed together, and the sum of
  the maxima of the blocks that would hold a document is its bound.  Lists of one
  block are opened at once and add what they really hold.
* Documents under the threshold are skipped with their blocks still compressed.
  Of the others those of the greatest bounds come first: only the blocks that they
  lie in are decompressed, they get their scores, the threshold rises, and what
  falls under it is skipped in turn.

A first round over ``SEED_SEGMENTS`` segments gives the threshold that all
segments start with: the ``k``-th best score of some documents is never above that
of all.  Results of segments meet in one small ranking for each query.

*Scores* are whole numbers (see ``factor``), so ties are exact and go by
``doc_id``.  Local numbers follow ``doc_id``, and what ties with the ``k``-th is
looked at, so the order of documents decides nothing.

Defined results: null and empty texts have no terms and are never found; a query
without terms has no rows.  Every row is a document of its own, also repeated ones
(of equal score and id, any); a null ``doc_id`` comes last among ties.  Equal
query rows count once; rows of one ``item_id`` and different texts are ranked
each for themselves.  Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK_POSTINGS = 128
SEGMENT_POSTINGS = 1 << 21
SEED_SEGMENTS = 8
TOP = 10
#: Pairs of query and term that are sent to all tasks at once; more go in turns.
PAIRS = 1 << 18
#: Documents of a query that are scored before the threshold is looked at again.
FIRST_ROUND, GROWTH = 64, 8
INDEX = "segment long, term binary, n int, top int, heads binary, data binary"
FOUND = "query int, doc_id long, score long"
#: What is no part of a term becomes a space; of bytes, since all beyond ASCII is.
_TABLE = bytes(c | 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_ROWS = 1 << 14


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


def length_part(n, documents: int, terms: int):
    """What a document of ``n`` terms adds under the line of ``factor``."""
    return 100 - 90 + (90 * n * documents) // terms


def factor(tf, m):
    """A term's impact in a document, before its weight."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Variable-byte form of whole numbers, and where each ends."""
    sizes = np.ones(len(values), np.int64)
    for bits in range(7, 63, 7):
        if not (more := values >= 1 << bits).any():
            break
        sizes += more
    ends = np.cumsum(sizes)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for i in range(int(sizes.max(initial=0))):
        there = sizes > i
        high = np.where(sizes[there] > i + 1, 128, 0)
        out[(ends - sizes)[there] + i] = (values[there] >> 7 * i) & 127 | high
    return out, ends


def unpacked(raw: np.ndarray) -> np.ndarray:
    ends = np.flatnonzero(raw < 128)
    if len(ends) == len(raw):
        return raw.astype(np.int64)
    starts = np.r_[0, ends[:-1] + 1]
    shift = 7 * (np.arange(len(raw)) - np.repeat(starts, ends - starts + 1))
    return np.add.reduceat((raw & 127).astype(np.int64) << shift, starts)


class Builder:
    """Gathers documents until a segment is full."""

    def __init__(self, documents: int, terms: int):
        self.documents, self.terms = documents, terms
        self.clear()

    def clear(self) -> None:
        self.names: dict[bytes, int] = {}
        self.ids, self.tfs, self.sizes, self.lengths, self.docs = array("i"), array("i"), array("i"), array("q"), []

    def add(self, doc_id: int | None, text: str) -> None:
        words = terms_of(text)
        if not words:
            return
        counts, names = Counter(words), self.names
        self.ids.extend([names.setdefault(w, len(names)) for w in counts])
        self.tfs.extend(counts.values())
        self.sizes.append(len(counts))
        self.lengths.append(len(words))
        self.docs.append(doc_id)

    def rows(self, segment: int) -> Iterator[pa.RecordBatch]:
        """The segment's rows of ``INDEX``; the first, without a term, has its documents."""
        if not self.docs:
            return
        size = len(self.docs)
        by_id = sorted(range(size), key=lambda i: (self.docs[i] is None, self.docs[i] or 0))
        place = np.empty(size, np.int64)
        place[by_id] = np.arange(size)
        known = sum(x is not None for x in self.docs)
        doc_ids = np.array([self.docs[i] or 0 for i in by_id], np.int64)
        m = length_part(np.frombuffer(self.lengths, np.int64)[by_id], self.documents, self.terms)
        names = sorted(self.names)
        rank = np.empty(len(names), np.int64)
        rank[np.fromiter(map(self.names.__getitem__, names), np.int64, len(names))] = np.arange(len(names))
        key = rank[np.frombuffer(self.ids, np.int32)] * size + place[np.repeat(np.arange(size), np.frombuffer(self.sizes, np.int32))]
        order = np.argsort(key, kind="stable")
        key, tf = key[order], np.frombuffer(self.tfs, np.int32)[order].astype(np.int64)
        term, doc = key // size, key % size
        starts = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
        n = np.diff(np.r_[starts, len(term)])
        heads = np.flatnonzero((np.arange(len(term)) - np.repeat(starts, n)) % BLOCK_POSTINGS == 0)
        impact = factor(tf, m[doc])
        gaps = np.diff(doc, prepend=0)
        gaps[heads] = doc[heads]
        pairs = np.empty(2 * len(doc), np.int64)
        pairs[0::2], pairs[1::2] = gaps, tf
        data, ends = packed(pairs)
        ends = ends[1::2]
        tails = np.r_[heads[1:], len(doc)] - 1
        blocks = -(-n // BLOCK_POSTINGS)
        data_from = np.r_[0, ends[starts[1:] - 1], len(data)]
        head = np.stack([doc[tails], np.maximum.reduceat(impact, heads), ends[tails] - np.repeat(data_from[:-1], blocks)], 1).astype(np.int32)
        column = lambda offsets, raw: pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw))])
        fields = [x.split()[0] for x in INDEX.split(", ")]
        of = lambda rows, *columns: pa.RecordBatch.from_arrays([pa.array(np.full(rows, segment, np.int64)), *columns], fields)
        yield of(1, pa.array([b""], pa.binary()), pa.array([size], pa.int32()), pa.array([known], pa.int32()), pa.array([doc_ids.tobytes()], pa.binary()), pa.array([m.astype(np.int64).tobytes()], pa.binary()))
        whole = of(
            len(names),
            pa.array(names, pa.binary()),
            pa.array(n.astype(np.int32)),
            pa.array(np.maximum.reduceat(impact, starts).astype(np.int32)),
            column(12 * np.r_[0, np.cumsum(blocks)], head),
            column(data_from, data),
        )
        for at in range(0, len(names), _ROWS):
            yield whole.slice(at, _ROWS)


def corpus_size(docs: DataFrame) -> tuple[int, int]:
    """Documents with a term, and terms of all documents."""
    n = common.texts_of(docs).select(F.regexp_count("text", F.lit(TERM)).cast("long").alias("n"))
    found = n.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    return found[0], found[1] or 0


def build_index(docs: DataFrame, path: str, segment_postings: int = SEGMENT_POSTINGS) -> None:
    """Write the index of every document to ``path``: ``segments`` and ``size``."""
    spark = docs.sparkSession
    common.tune(spark)
    documents, terms = corpus_size(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        builder, segment = Builder(documents, terms), TaskContext.get().partitionId() << 32
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                builder.add(doc_id, text)
                if len(builder.ids) >= segment_postings:
                    yield from builder.rows(segment)
                    builder.clear()
                    segment += 1
        yield from builder.rows(segment)

    common.texts_of(docs).mapInArrow(run, INDEX).write.parquet(f"{path}/segments")
    spark.createDataFrame([(documents, terms)], "documents long, terms long").write.parquet(f"{path}/size")


class Postings:
    """A term's list in a segment; blocks are opened when they are asked for."""

    def __init__(self, n: int, top: int, heads: bytes, data: bytes, m: np.ndarray):
        head = np.frombuffer(heads, np.int32).reshape(-1, 3)
        self.n, self.top, self.m = n, top, m
        self.lasts, self.maxes, self.ends = head[:, 0].astype(np.int64), head[:, 1].astype(np.int64), head[:, 2]
        self.spans = np.diff(self.lasts, prepend=-1)
        self.data = np.frombuffer(data, np.uint8)
        self.closed = np.ones(len(head), bool)
        # what a closed block holds reads as its last document
        self.docs = np.repeat(self.lasts, BLOCK_POSTINGS)[:n]
        self.impacts = np.zeros(n, np.int64)

    def open(self, blocks: np.ndarray) -> None:
        blocks = blocks[self.closed[blocks]]
        if not len(blocks):
            return
        self.closed[blocks] = False
        begin = np.where(blocks > 0, self.ends[blocks - 1], 0).tolist()
        pairs = unpacked(np.concatenate([self.data[a:b] for a, b in zip(begin, self.ends[blocks].tolist())]))
        sizes = np.minimum(BLOCK_POSTINGS, self.n - blocks * BLOCK_POSTINGS)
        first = np.r_[0, np.cumsum(sizes)[:-1]]
        docs = np.cumsum(pairs[0::2])
        docs -= np.repeat(docs[first] - pairs[0::2][first], sizes)
        at = np.arange(len(docs)) + np.repeat(blocks * BLOCK_POSTINGS - first, sizes)
        self.docs[at], self.impacts[at] = docs, factor(pairs[1::2], self.m[docs])

    def impacts_of(self, docs: np.ndarray) -> np.ndarray:
        """Impacts in ``docs`` (in order); opens the blocks that they would lie in."""
        out = np.zeros(len(docs), np.int64)
        block = np.searchsorted(self.lasts, docs)
        inside = block < len(self.lasts)
        self.open(np.unique(block[inside]))
        at = np.searchsorted(self.docs, docs[inside])
        out[inside] = np.where(self.docs[at] == docs[inside], self.impacts[at], 0)
        return out


class Segment:
    """The asked lists of a segment."""

    def __init__(self, rows: list[tuple[bytes, int, int, bytes, bytes]]):
        (_, self.size, self.known, ids, m), *lists = sorted(rows)
        self.doc_ids, self.m = np.frombuffer(ids, np.int64), np.frombuffer(m, np.int64)
        self.lists = {term: Postings(*row, self.m) for term, *row in lists}

    def best(self, query: list[tuple[bytes, int]], k: int, threshold: int) -> tuple[np.ndarray, np.ndarray]:
        """Local numbers and scores of the ``k`` best documents of ``threshold`` or more."""
        none = np.zeros(0, np.int64)
        lists = [(w, p) for term, w in query if w > 0 and (p := self.lists.get(term))]
        threshold = max(threshold, 1)
        if sum(w * p.top for w, p in lists) < threshold:
            return none, none
        sure, rest = np.zeros(self.size, np.int64), []
        for w, p in lists:
            if len(p.lasts) == 1:
                p.open(np.zeros(1, np.int64))
                sure[p.docs] += w * p.impacts
            else:
                rest.append((w, p))
        bound = sure.copy()
        for w, p in rest:
            bound[: p.lasts[-1] + 1] += np.repeat(w * p.maxes, p.spans)
        left = np.flatnonzero(bound >= threshold)
        found, scores, size = none, none, max(FIRST_ROUND, k)
        while len(left):
            if len(left) > size:
                part = np.argpartition(-bound[left], size - 1)
                now, left = np.sort(left[part[:size]]), left[part[size:]]
            else:
                now, left = np.sort(left), none
            score = sure[now]
            for w, p in rest:
                score = score + w * p.impacts_of(now)
            found, scores = np.r_[found, now], np.r_[scores, score]
            best = np.lexsort((found, -scores))[:k]
            found, scores = found[best], scores[best]
            if len(scores) == k:
                threshold = max(threshold, int(scores[-1]))
            left, size = left[bound[left] >= threshold], size * GROWTH
        good = scores >= threshold
        return found[good], scores[good]


def _asked(items: DataFrame) -> DataFrame:
    """``item_id, term`` of every query, its text beside it to tell queries apart."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct()
    terms = F.array_distinct(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(TERM), F.lit(0)))
    return rows.select("item_id", F.sha2("text", 256).alias("text_key"), F.explode(F.transform(terms, lambda x: x.cast("binary"))).alias("term"))


def _searched(index: DataFrame, queries: list[list[tuple[bytes, int]]], k: int, thresholds: dict[int, int]) -> DataFrame:
    """``FOUND``: the best of each segment for each query."""
    spark = index.sparkSession
    asked = spark.sparkContext.broadcast((queries, thresholds))  # PAIRS pairs at most

    def run(table: pa.Table) -> pa.Table:
        queries, thresholds = asked.value
        segment = Segment(list(zip(*(table.column(c).to_pylist() for c in ("term", "n", "top", "heads", "data")))))
        number, ids, scores = [np.zeros(0, np.int32)], [pa.array([], pa.int64())], [np.zeros(0, np.int64)]
        for i, query in enumerate(queries):
            found, score = segment.best(query, k, thresholds.get(i, 1))
            number.append(np.full(len(found), i, np.int32))
            ids.append(pa.array(segment.doc_ids[found], mask=found >= segment.known))
            scores.append(score)
        return pa.table([pa.array(np.concatenate(number)), pa.concat_arrays(ids), pa.array(np.concatenate(scores))], ["query", "doc_id", "score"])

    return index.groupBy("segment").applyInArrow(run, FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(spark: SparkSession, path: str, items: DataFrame, k: int = TOP, pairs: int = PAIRS) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of each query."""
    common.tune(spark)
    index = spark.read.schema(INDEX).parquet(f"{path}/segments")
    documents = spark.read.parquet(f"{path}/size").first()["documents"]
    asked = common.materialise(_asked(items), "asked")
    turns, out = max(1, -(-asked.count() // pairs)), []
    seeds = [r.segment for r in index.filter(F.col("term") == F.lit(b"")).select("segment").orderBy("segment").limit(SEED_SEGMENTS).collect()]
    for turn in range(turns):
        mine = asked.filter(F.pmod(F.xxhash64("item_id", "text_key"), F.lit(turns)) == turn) if turns > 1 else asked
        names = mine.select("term").distinct()
        rows = common.materialise(index.join(common.small(names.unionByName(spark.createDataFrame([(b"",)], "term binary"))), "term", "left_semi"), "asked_lists")
        held = rows.filter(F.col("term") != F.lit(b"")).groupBy("term").agg(F.sum("n").alias("df"))
        weight = F.floor(1000 * F.log((2 * F.lit(documents) + 2) / (2 * F.col("df") + 1))).cast("long")
        weighed = mine.join(held.select("term", weight.alias("weight")), "term")
        lists = weighed.groupBy("item_id", "text_key").agg(F.array_sort(F.collect_list(F.struct("weight", "term"))).alias("terms")).collect()
        queries = [[(bytes(x["term"]), x["weight"]) for x in reversed(r.terms)] for r in lists]
        first = _best(_searched(rows.filter(F.col("segment").isin(seeds)), queries, k, {}), k)
        thresholds = {r["query"]: r["score"] for r in first.filter(F.col("rank") == k).select("query", "score").collect()}
        found = _best(_searched(rows, queries, k, thresholds), k)
        numbers = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(lists)], "query int, item_id long")
        out.append(found.join(numbers, "query").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    while len(out) > 1:
        out = [a.unionByName(b) for a, b in zip(out[::2], out[1::2])] + out[len(out) & ~1 :]
    return out[0]


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.scratch_path(spark, "lexical_index")
    build_index(common.table(spark, sf_dir, "documents"), path)
    return search(spark, path, common.table(spark, sf_dir, "benchmark"))


ORACLE = rf"""
WITH words AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}') AS t FROM documents
), docs AS (SELECT r, doc_id, t, len(t)::BIGINT AS n FROM words WHERE len(t) > 0
), corpus AS (SELECT count(*)::BIGINT AS dn, sum(n)::BIGINT AS dl FROM docs
), postings AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(t) AS term FROM docs) GROUP BY 1, 2
), asked AS (
  SELECT DISTINCT item_id, text, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM benchmark
), weights AS (
  SELECT term, floor(1000 * ln((2 * dn + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM postings, corpus WHERE term IN (SELECT term FROM asked) GROUP BY term, dn
), scored AS (
  SELECT item_id, text, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * dn) // dl))))::BIGINT AS score
  FROM asked JOIN postings USING (term) JOIN weights USING (term) JOIN docs USING (r), corpus GROUP BY 1, 2, 3, 4
), ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM scored WHERE score > 0
) SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {TOP}"""
