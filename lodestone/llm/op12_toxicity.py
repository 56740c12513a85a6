r"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes ratios.

*Features.*  Words are runs of letters and digits in lower case; their character
n-grams, with a mark at each border, are hashed into ``BUCKETS``.  A text has each
n-gram once, however often it occurs, and all of the text counts.

*Scale.*  The log-count ratio of an n-gram compares the share of toxic and of
clean texts that hold it.  Smoothing is dealt out by class size, so what neither
class has gets the ratio zero; so does one of which the ratio is within
``LEAST_Z`` of its own standard errors, which in a long text would drown the rest.
A feature counts with its ratio, and a logistic regression (L2, classes weighted
alike) is trained on the scaled features.

*Learning.*  Rows whose CRC-32 of ``doc_id`` (as text) leaves 0 modulo 5 are held
out.  Of the others ``TRAIN_DOCUMENTS`` labelled ones of each class are the bound:
beyond it documents are chosen by a hash of their id.  Spark counts the texts that
hold each n-gram; what the driver fits are the features that have a ratio.

Defined results: a null or empty text has no features and is scored by the
intercept.  A ``doc_id`` with two different labels, a null one or a null label
teaches nothing.  Without a label of each class every score is 0.  Rows with a
null ``doc_id`` are not held out.  Repeated rows are scored alike; extra columns
are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Labelled documents of each class that are learned from.
TRAIN_DOCUMENTS = 6_000
BUCKETS = 1 << 20
SHORTEST, LONGEST = 3, 8
#: Standard errors that a ratio must be off zero, and its smoothing.
LEAST_Z, SMOOTHING = 2.5, 2.0
PENALTY, ROUNDS, MEMORY = 1e-3, 60, 8
CACHE_WORDS = 100_000
#: Features worked on at once.
CHUNK = 1 << 21
_WORDS = re.compile(r"[^\W_]+")


def held_out(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def words_of(text: str | None) -> list[str]:
    return list(set(_WORDS.findall((text or "").lower())))


def hashed(grams: np.ndarray) -> np.ndarray:
    """The bucket of polynomial hashes of n-grams."""
    return ((grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int32) % BUCKETS


def buckets_of(words: list[str], known: np.ndarray | None = None) -> list[bytes]:
    """The hashed n-grams of each bordered word, ``known`` ones alone if it is given.

    The words' code points stand in one array; the hashes of all n-grams of a length
    come from those of the length before.
    """
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    points = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    word = np.repeat(np.arange(len(words)), sizes)
    grams, owners, buckets = points.copy(), [], []
    for n in range(2, LONGEST + 1):
        if len(points) < n:
            break
        grams = grams[: len(points) - n + 1] * np.uint64(0x100000001B3) + points[n - 1 :]
        if n >= SHORTEST:
            at = np.flatnonzero(word[: len(grams)] == word[n - 1 :])
            found = hashed(grams[at] + np.uint64(n))
            if known is not None:
                at, found = at[known[found]], found[known[found]]
            owners.append(word[at])
            buckets.append(found)
    owner, bucket = np.concatenate([*owners, np.zeros(0, np.int64)]), np.concatenate([*buckets, np.zeros(0, np.int32)])
    order = np.argsort(owner, kind="stable")
    data, ends = bucket[order].astype(np.int32).tobytes(), 4 * np.cumsum(np.bincount(owner, minlength=len(words)))
    return [data[i:j] for i, j in zip([0, *ends[:-1].tolist()], ends.tolist())]


class Features:
    """The distinct features of texts, those of ``known`` alone if it is given;
    words met before are looked up."""

    def __init__(self, known: np.ndarray | None = None):
        self.cache = common.Cache(lambda words: buckets_of(words, known), CACHE_WORDS)

    def of(self, texts: list[str | None]) -> list[np.ndarray]:
        return [np.unique(np.frombuffer(x, np.int32)) for x in self.cache.joined([words_of(t) for t in texts])]


def log_ratios(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Of the documents of each class that hold a feature; 0 for what may be chance."""
    n = n_toxic + n_clean
    toxic, clean = toxic + SMOOTHING * n_toxic / n, clean + SMOOTHING * n_clean / n
    ratios = np.log(toxic / n_toxic) - np.log(clean / n_clean)
    return np.where(np.abs(ratios) >= LEAST_Z * np.sqrt(1 / toxic + 1 / clean), ratios, 0.0)


@dataclass
class Model:
    """A weight for each bucket, ratio included, and an intercept."""

    weights: np.ndarray
    intercept: float

    def score(self, features: np.ndarray) -> float:
        z = float(self.weights[features].sum(dtype=np.float64)) + self.intercept
        return float(1 / (1 + np.exp(-min(max(z, -500.0), 500.0))))


def _least(value_and_slope, start: np.ndarray, rounds: int = ROUNDS, memory: int = MEMORY) -> np.ndarray:
    """The minimum of a convex function by limited-memory quasi-Newton steps."""
    x, (f, g) = start, value_and_slope(start)
    steps: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        d, back = g.copy(), []
        for s, y, rho in reversed(steps):
            back.append(a := rho * s.dot(d))
            d -= a * y
        if steps:
            s, y, _rho = steps[-1]
            d *= s.dot(y) / y.dot(y)
        else:
            d /= max(1.0, float(np.abs(d).sum()))
        for (s, y, rho), a in zip(steps, reversed(back)):
            d += (a - rho * y.dot(d)) * s
        slope, t = -g.dot(d), 1.0
        while True:
            f2, g2 = value_and_slope(x - t * d)
            if f2 <= f + 1e-4 * t * slope or t < 1e-8:
                break
            t /= 2
        s, y = -t * d, g2 - g
        x, near, f, g = x + s, f - f2 <= 1e-7 * max(abs(f), 1.0), f2, g2
        if near:
            break
        if (sy := s.dot(y)) > 1e-12:
            steps = [*steps[-(memory - 1) :], (s, y, 1 / sy)]
    return x


def fit(rows: list[np.ndarray], labels: np.ndarray, ratios: np.ndarray, penalty: float = PENALTY) -> Model:
    """Logistic regression on features scaled by their ratios; classes weigh alike."""
    used = np.flatnonzero(ratios)
    at = np.full(len(ratios), -1, np.int32)
    at[used] = np.arange(len(used), dtype=np.int32)
    r = ratios[used]
    kept = [x[x >= 0] for x in (at[x] for x in rows)]
    sizes = np.array([len(x) for x in kept])
    ends = np.r_[0, np.cumsum(sizes)]
    flat = np.concatenate(kept) if len(kept) else np.zeros(0, np.int32)
    # rows of each chunk
    cuts = [0]
    while cuts[-1] < len(kept):
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(ends, ends[cuts[-1]] + CHUNK, "right")) - 1))
    sign = np.where(labels > 0, 1.0, -1.0)
    weight = np.where(labels > 0, 0.5 / max(1, (labels > 0).sum()), 0.5 / max(1, (labels <= 0).sum()))

    def value_and_slope(v: np.ndarray) -> tuple[float, np.ndarray]:
        scaled, slope, value = v[:-1] * r, np.zeros(len(v)), 0.5 * penalty * v[:-1].dot(v[:-1])
        for a, b in zip(cuts, cuts[1:]):
            part, row = flat[ends[a] : ends[b]], np.repeat(np.arange(b - a), sizes[a:b])
            margin = sign[a:b] * (np.bincount(row, scaled[part], b - a) + v[-1])
            value += (weight[a:b] * np.logaddexp(0, -margin)).sum()
            pull = -weight[a:b] * sign[a:b] / (1 + np.exp(np.clip(margin, -500, 500)))
            slope[:-1] += np.bincount(part, pull[row], len(r))
            slope[-1] += pull.sum()
        slope[:-1] = slope[:-1] * r + penalty * v[:-1]
        return value, slope

    v = _least(value_and_slope, np.zeros(len(r) + 1))
    weights = np.zeros(len(ratios), np.float32)
    weights[used] = v[:-1] * r
    return Model(weights, float(v[-1]))


def training_rows(docs: DataFrame, labels: DataFrame, documents: int = TRAIN_DOCUMENTS) -> DataFrame:
    """``toxic, text`` of the labelled documents that are learned from."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("__most")).filter("toxic = __most").select("doc_id", "toxic")
    n = _sizes(known)
    share = F.when(F.col("toxic") == 1, F.lit(min(1.0, documents / max(1, n.get(1, 0))))).otherwise(F.lit(min(1.0, documents / max(1, n.get(0, 0)))))
    # a document is in by its hash, whatever it holds; some 2 * documents rows at most
    some = common.materialise(known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit(1 << 20) * share), "labels")
    return common.texts_of(docs).join(common.small(some), "doc_id").select("toxic", "text")


def _sizes(rows: DataFrame) -> dict[int, int]:
    return {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # two rows


def _counted(rows: DataFrame) -> DataFrame:
    """``feature, toxic, clean``: how many texts of each class hold a feature; summed in the task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, counts = Features(), np.zeros((2, BUCKETS), np.int32)
        for batch in batches:
            for toxic, x in zip(batch.column(0).to_pylist(), features.of(batch.column(1).to_pylist())):
                counts[toxic][x] += 1
        held = np.flatnonzero(counts.any(0))
        for at in range(0, len(held), 1 << 16):
            x = held[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32)), pa.array(counts[1][x].astype(np.int64)), pa.array(counts[0][x].astype(np.int64))], ["feature", "toxic", "clean"])

    return rows.mapInArrow(run, "feature int, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def train(docs: DataFrame, labels: DataFrame, documents: int = TRAIN_DOCUMENTS) -> Model | None:
    """A model of the labelled documents that aren't held out; None without both classes."""
    spark = docs.sparkSession
    common.tune(spark)
    rows = common.materialise(training_rows(docs, labels, documents), "labelled")
    n = _sizes(rows)
    if len(n) < 2:
        return None
    counts, found = np.zeros((2, BUCKETS)), _counted(rows).toArrow()  # BUCKETS rows at most
    at = found.column("feature").to_numpy()
    counts[1][at], counts[0][at] = found.column("toxic").to_numpy(), found.column("clean").to_numpy()
    ratios = log_ratios(counts[1], counts[0], n[1], n[0])
    known = spark.sparkContext.broadcast(ratios != 0)  # BUCKETS bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(known.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(features.of(batch.column(1).to_pylist()), pa.list_(pa.int32()))], ["toxic", "features"])

    table = rows.mapInArrow(run, "toxic int, features array<int>").toArrow()  # the bounded sample
    features = [x for c in table.column("features").chunks for x in np.split(c.flatten().to_numpy(), (c.offsets.to_numpy() - c.offsets[0].as_py())[1:-1])]
    return fit(features, table.column("toxic").to_numpy(), ratios)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    spark = docs.sparkSession
    common.tune(spark)
    shared = spark.sparkContext.broadcast(model)  # BUCKETS floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        features = Features(known.weights != 0) if known else None
        for batch in batches:
            scores = [known.score(x) for x in features.of(batch.column(1).to_pylist())] if known else [0.0] * batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    found = common.texts_of(docs).mapInArrow(run, "doc_id long, score double")
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return score(docs, train(docs, common.table(spark, sf_dir, "labels")))
