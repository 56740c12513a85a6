"""Language identification by words first, character n-grams behind them.

*Learning.*  The corpus is counted by language: words (runs of letters, lower
case), and from the words' counts their character n-grams, with word borders.
Documents whose CRC-32 of ``doc_id`` (as text) leaves 2 modulo 4 are held out,
as are rows without a language.  Learning takes a bounded sample of labelled
documents: about ``TRAIN_DOCUMENTS``, chosen by a hash of ``doc_id``, all if
there are fewer.  The commonest ``WORDS`` words and ``GRAMS`` n-grams of each
language make the model, so its size is bounded whatever the corpus has.

*Prediction.*  A known word adds its log-frequency in each language.  An unknown
word falls back to the longest n-grams of it that are known, then to shorter
ones, and adds the mean of their log-frequencies.  The language of the greatest
sum wins (the first by name on a tie) and the score is its share of the
likelihoods.  Only the text is looked at, all of it.

Defined results: a null text, or one without letters, is ``und`` with score 0;
so is every text if there is nothing to learn from.  Rows with a null ``doc_id``
are neither learned from nor held out.  Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

TRAIN_DOCUMENTS = 20_000
WORDS = 30_000
GRAMS = 30_000
LONGEST = 5
UNKNOWN = "und"
SMOOTHING = 0.1
CACHE_WORDS = 200_000
_LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters; digits and numbers of any script end a run."""
    words = _LETTERS.findall((text or "").lower())
    if all(map(str.isalpha, words)):
        return words
    return [x for w in words for x in ([w] if w.isalpha() else "".join(c if c.isalpha() else " " for c in w).split())]


def grams_of(word: str, n: int) -> list[str]:
    """The character n-grams of a word between two border marks."""
    bordered = f"<{word}>"
    return [bordered[i : i + n] for i in range(len(bordered) - n + 1)]


def held_out(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


@dataclass
class Model:
    """Log-frequencies: a vector over ``languages`` for each word and n-gram."""

    languages: list[str]
    words: dict[str, np.ndarray] = field(default_factory=dict)
    grams: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def of_counts(cls, words: list[tuple[str, str, int]], grams: list[tuple[str, str, int]]) -> Model:
        languages = sorted({x[0] for x in words})
        at = {x: i for i, x in enumerate(languages)}

        def logs(rows: list[tuple[str, str, int]]) -> dict[str, np.ndarray]:
            counts: dict[str, np.ndarray] = {}
            for lang, unit, n in rows:
                if lang in at:
                    counts.setdefault(unit, np.zeros(len(languages), np.float64))[at[lang]] += n
            total = sum(counts.values(), np.zeros(len(languages)))
            return {k: np.log((v + SMOOTHING) / (total + SMOOTHING * len(counts))).astype(np.float32) for k, v in counts.items()}

        model = cls(languages, logs(words))
        for n in range(1, LONGEST + 1):
            model.grams |= logs([x for x in grams if len(x[1]) == n])
        return model

    def vector(self, word: str) -> np.ndarray:
        """What a word adds for each language."""
        if (known := self.words.get(word)) is not None:
            return known
        for n in range(LONGEST, 0, -1):
            found = [v for g in grams_of(word, n) if (v := self.grams.get(g)) is not None]
            if found:
                return np.mean(found, axis=0, dtype=np.float32)
        return np.zeros(len(self.languages), np.float32)


class Predictor:
    def __init__(self, model: Model):
        self.model = model
        self.cache = common.Cache(lambda words: [model.vector(w).tobytes() for w in words], CACHE_WORDS)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        if not self.model.languages:
            return [(UNKNOWN, 0.0)] * len(texts)
        out = []
        for data in self.cache.joined([words_of(t) for t in texts]):
            if not data:
                out.append((UNKNOWN, 0.0))
                continue
            total = np.frombuffer(data, np.float32).reshape(-1, len(self.model.languages)).sum(0, dtype=np.float64)
            best = int(total.argmax())
            out.append((self.model.languages[best], float(1 / np.exp(total - total[best]).sum())))
        return out


def _counted(rows: DataFrame, units) -> DataFrame:
    """``(lang, unit, n)`` of ``rows(lang, text, n)``, summed in the task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for lang, text, n in zip(*(c.to_pylist() for c in batch.columns)):
                for unit in units(text):
                    counts[lang, unit] += n
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.string()), pa.array(list(counts.values()), pa.int64())],
                ["lang", "unit", "n"],
            )

    return rows.mapInArrow(run, "lang string, unit string, n long").groupBy("lang", "unit").agg(F.sum("n").alias("n"))


def _commonest(counts: DataFrame, most: int, *also: str) -> list[tuple[str, str, int]]:
    """The commonest units of each language (and of each value of ``also``).

    A histogram of the counts tells from which count on there are ``most`` units
    at most; units are kept from there, so they are never sorted by language.  If
    more than ``most`` share the greatest count, a hash chooses about ``most`` of them.
    """
    levels = counts.groupBy("lang", *also, "n").agg(F.count("*").alias("units"))
    upwards = Window.partitionBy("lang", *also).orderBy(F.desc("n"))
    running = levels.select("lang", *also, "n", F.sum("units").over(upwards).alias("running"), F.row_number().over(upwards).alias("level"))
    kept = running.filter((F.col("running") <= most) | (F.col("level") == 1))
    least = kept.groupBy("lang", *also).agg(F.min("n").alias("least"), F.max("running").alias("kept"))
    chosen = F.pmod(F.xxhash64("unit"), F.lit(1 << 20)) * F.col("kept") < F.lit(most << 20)
    top = counts.join(least, ["lang", *also]).filter((F.col("n") >= F.col("least")) & ((F.col("kept") <= most) | chosen))
    return [(x.lang, x.unit, x.n) for x in top.select("lang", "unit", "n").collect()]


def train(docs: DataFrame, documents: int = TRAIN_DOCUMENTS) -> Model:
    """A model of the labelled documents that aren't held out."""
    common.tune(docs.sparkSession)
    labelled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string"), F.col("text").cast("string")).filter(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))
    )
    n = labelled.select("doc_id").count()
    if n > documents:
        # unbiased: a document is in by its hash, whatever it holds
        labelled = labelled.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit(int((1 << 20) * documents / n)))
    words = common.materialise(_counted(labelled.select("lang", "text", F.lit(1).cast("long").alias("n")), words_of), "lang_words")
    grams = _counted(words.select("lang", F.col("unit").alias("text"), "n"), lambda w: [g for k in range(1, LONGEST + 1) for g in grams_of(w, k)])
    return Model.of_counts(_commonest(words, WORDS), _commonest(grams.withColumn("size", F.length("unit")), GRAMS // LONGEST, "size"))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every document."""
    spark = docs.sparkSession
    common.tune(spark)
    shared = spark.sparkContext.broadcast(model)  # bounded by WORDS and GRAMS for each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = Predictor(shared.value)
        for batch in batches:
            found = predictor.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    found = common.texts_of(docs).mapInArrow(run, "doc_id long, lang_pred string, score double")
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    common.shared_dir(spark)
    return identify(docs, train(docs))
