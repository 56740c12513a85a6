"""Licence scans: a trained paragraph classifier with template comparison.

*Model.*  A multinomial logistic regression over the presence of word uni- and
bigrams, with a class for each licence family and one for ordinary text, is
trained on the driver from ``licence_texts``: cut, thinned and padded variants
of every template.  On variants kept apart a temperature is fitted, so that the
probabilities are calibrated; below ``LEAST_PROBABILITY`` the class is unknown.

*Scan.*  Paragraphs are the lines of a text.  One without any anchor word holds no
eight words in a row of a template; the others' n-grams meet the weights
in a broadcast join (the model is of a fixed size) and are summed by paragraph.
The family that wins is confirmed if the paragraph's bigrams are those of one of
its templates: ``CONFIRMED`` of the template's lie in the paragraph, or of the
paragraph's in the template.  All of it is built-in functions.

Defined results: one row for each row of ``documents``; texts without a notice
have zero counts, an empty ``families`` and null for the best paragraph.  A null
text counts as empty.  Repeated rows are repeated.  Extra columns are ignored.
Ties between families go to the first by name.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .licence_texts import ORDINARY, TEMPLATES

NONE, UNKNOWN = "none", "unknown"
LEAST_PROBABILITY = 0.5
CONFIRMED = 0.8
VARIANTS = 24
#: A paragraph with none of these isn't looked at; every eight words in a row of every
#: template hold one.
ANCHORS = (
    r"licen[cs]|copyright|copies|copying|a copy|distribut|warrant|public domain|gnu |mozilla|mpl|creative commons|cc0|cc by|all rights|spdx|compile|gpl"
    r"|permission|granted|without restriction|unencumbered|bsd|endorse|merchantab|liabilit|software|modif|condition|disclaim|contributor|the terms"
    r"|applicable law|extent possible|publication|publish|binary|source code|prohibited|for any purpose|this file|part of this|the copyright|rights reserved|free to|fitness|furnished|transmitted|neighboring|documentation|limitation|of charge|non-commercial|with or without|the hope that|be useful|waived"
)
WORD = r"[a-z0-9][a-z0-9.+\-]*[a-z0-9+]|[a-z0-9]"
_WORD = re.compile(WORD)


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams_of(words: list[str]) -> set[str]:
    return {*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))}


def _variants(text: str, rng: np.random.Generator, n: int) -> list[set[str]]:
    words, out = words_of(text), [grams_of(words_of(text))]
    for _ in range(n - 1):
        size = max(min(4, len(words)), int(len(words) * rng.uniform(0.7, 1.0)))
        at = int(rng.integers(0, len(words) - size + 1))
        part = [w for w in words[at : at + size] if rng.random() > 0.05]
        if rng.random() < 0.5:
            part = ["copyright", "2019", *part]
        out.append(grams_of(part))
    return out


class Classifier:
    """Weights of shape (n-grams + 1, classes); the last row is the bias."""

    def __init__(self, seed: int = 7, steps: int = 200, ridge: float = 1e-4):
        rng = np.random.default_rng(seed)
        self.classes = [*sorted(TEMPLATES), NONE]
        rows = [(self.classes.index(f), g) for f, texts in sorted(TEMPLATES.items()) for t in texts for g in _variants(t, rng, VARIANTS)]
        rows += [(len(self.classes) - 1, g) for t in ORDINARY for g in _variants(t, rng, VARIANTS)]
        rows += [(len(self.classes) - 1, set())] * VARIANTS
        self.grams = sorted({g for _, x in rows for g in x})
        at = {g: i for i, g in enumerate(self.grams)}
        x = np.zeros((len(rows), len(self.grams) + 1), np.float32)
        x[:, -1] = 1
        for i, (_, gs) in enumerate(rows):
            x[i, [at[g] for g in gs]] = 1
        y = np.eye(len(self.classes), dtype=np.float32)[[c for c, _ in rows]]
        apart = np.arange(len(rows)) % 5 == 4
        weight = (1 / y[~apart].sum(0))[y[~apart].argmax(1)][:, None]
        weight /= weight.mean()
        self.weights = self._fit(x[~apart], y[~apart], weight, steps, ridge)
        logits = x[apart] @ self.weights
        self.temperature = min(np.geomspace(0.25, 8, 60), key=lambda t: self._loss(logits / t, y[apart]))
        self.weights = (self.weights / self.temperature).astype(np.float64)
        self.accuracy = float((logits.argmax(1) == y[apart].argmax(1)).mean())

    @staticmethod
    def _shares(logits: np.ndarray) -> np.ndarray:
        e = np.exp(logits - logits.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    @classmethod
    def _loss(cls, logits: np.ndarray, y: np.ndarray) -> float:
        return float(-np.log((cls._shares(logits) * y).sum(1) + 1e-12).mean())

    @classmethod
    def _fit(cls, x, y, weight, steps, ridge) -> np.ndarray:
        w, v = np.zeros((x.shape[1], y.shape[1]), np.float32), 0.0
        for _ in range(steps):
            slope = x.T @ ((cls._shares(x @ w) - y) * weight) / len(x) + ridge * w
            v = 0.9 * v - 0.5 * slope
            w += v
        return w

    def shares(self, text: str) -> dict[str, float]:
        """The probabilities of one paragraph."""
        at = {g: i for i, g in enumerate(self.grams)}
        logits = self.weights[-1] + sum((self.weights[at[g]] for g in grams_of(words_of(text)) if g in at), np.zeros(len(self.classes)))
        return dict(zip(self.classes, self._shares(logits[None])[0].tolist()))


@lru_cache(maxsize=1)
def classifier() -> Classifier:
    return Classifier()


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def _bigrams(words: Column) -> Column:
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(pairs)


def _classified(paragraphs: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, ``family``, ``probability`` of ``paragraphs(*keys, words, pairs)``."""
    spark, model = paragraphs.sparkSession, classifier()
    columns = [f"w{i}" for i in range(len(model.classes))]
    schema = T.StructType([T.StructField("gram", T.StringType()), *(T.StructField(c, T.DoubleType()) for c in columns)])
    weights = spark.createDataFrame([(g, *map(float, w)) for g, w in zip(model.grams, model.weights)], schema)
    grams = paragraphs.select(*keys, F.explode(F.array_distinct(F.concat("words", "pairs"))).alias("gram"))
    # the model has a few thousand n-grams, whatever the corpus holds
    met = grams.join(F.broadcast(weights), "gram")
    sums = met.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in columns))
    logits = F.array(*(F.coalesce(F.col(c), F.lit(0.0)) + F.lit(float(b)) for c, b in zip(columns, model.weights[-1])))
    best = F.array_max("logits")
    total = F.aggregate("logits", F.lit(0.0), lambda s, x: s + F.exp(x - best))
    names = F.array(*map(F.lit, model.classes))
    return sums.select(*keys, logits.alias("logits")).select(
        *keys, F.element_at(names, F.array_position("logits", best).cast("int")).alias("family"), (1 / total).alias("probability")
    )


def _templates(spark: SparkSession) -> DataFrame:
    rows = [(f, " ".join(words_of(t))) for f, ts in sorted(TEMPLATES.items()) for t in ts]
    df = spark.createDataFrame(rows, "template_family string, template string")
    return df.select("template_family", _bigrams(F.split("template", " ")).alias("template_pairs"))


def scan_paragraphs(docs: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, paragraph, family, probability, similarity, confirmed`` of every
    paragraph with an anchor that isn't ordinary text; ``docs(*keys, text)``."""
    line = F.posexplode(F.split("text", "\n"))
    some = docs.select(*keys, line.alias("paragraph", "line"))
    some = some.filter(F.col("line").rlike(f"(?i){ANCHORS}")).select(*keys, "paragraph", _words(F.col("line")).alias("words"))
    some = some.select("*", _bigrams(F.col("words")).alias("pairs"))
    where = [*keys, "paragraph"]
    classed = _classified(some, where).filter(F.col("family") != NONE)
    on = [F.col(f"c.{k}").eqNullSafe(F.col(f"p.{k}")) for k in where]
    condition = on[0]
    for c in on[1:]:
        condition &= c
    met = classed.alias("c").join(some.alias("p"), condition).select(*(F.col(f"c.{k}").alias(k) for k in where), "family", "probability", "pairs")
    # templates are a fixed short list
    beside = met.join(F.broadcast(_templates(docs.sparkSession)), F.col("family") == F.col("template_family"))
    common_pairs = F.size(F.array_intersect("pairs", "template_pairs"))
    least = F.least(F.size("pairs"), F.size("template_pairs"))
    similarity = F.when(least > 0, common_pairs / least).otherwise(0.0)
    judged = beside.groupBy(*where, "family", "probability").agg(F.max(similarity).alias("similarity"))
    sure = F.col("probability") >= LEAST_PROBABILITY
    return judged.select(
        *where,
        F.when(sure, F.col("family")).otherwise(UNKNOWN).alias("family"),
        "probability",
        "similarity",
        (sure & (F.col("similarity") >= CONFIRMED)).alias("confirmed"),
    )


def scan(docs: DataFrame) -> DataFrame:
    """A row for each document: counts, families and the most probable paragraph."""
    common.shared_dir(docs.sparkSession)
    texts = common.texts_of(docs)
    anchored = F.col("text").rlike(f"(?i){ANCHORS}")
    # texts are looked at once; what has no anchor goes on without its text, equal rows as one
    flagged = texts.select("doc_id", F.when(anchored, F.col("text")).alias("text"))
    seen = common.materialise(flagged, "anchored")
    some = seen.filter("text is not null").groupBy("doc_id", "text").agg(F.count("*").alias("copies"))
    some = common.materialise(some.withColumn("content", F.xxhash64("text")), "notices")
    found = scan_paragraphs(some.select("doc_id", "content", "text"), ["doc_id", "content"])
    real = F.col("family") != UNKNOWN
    result = found.groupBy("doc_id", "content").agg(
        F.count("*").alias("n_notices"),
        F.count_if(real).alias("n_known"),
        F.count_if("confirmed").alias("n_confirmed"),
        F.array_join(F.array_sort(F.collect_set(F.when(real, F.col("family")))), ",").alias("families"),
        F.max_by("family", F.struct(F.col("probability"), -F.col("paragraph"))).alias("best_family"),
        F.max("probability").alias("best_probability"),
    )
    left, right = some.select("doc_id", "content", "copies").alias("l"), result.alias("r")
    met = left.join(right, F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("l.content") == F.col("r.content")), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    columns = [zero("n_notices"), zero("n_known"), zero("n_confirmed"), F.coalesce("families", F.lit("")).alias("families"), "best_family", "best_probability"]
    scanned = met.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(F.col("l.doc_id").alias("doc_id"), *columns)
    none = F.lit(0).cast("long")
    plain = seen.filter("text is null").select(
        "doc_id",
        none.alias("n_notices"),
        none.alias("n_known"),
        none.alias("n_confirmed"),
        F.lit("").alias("families"),
        F.lit(None).cast("string").alias("best_family"),
        F.lit(None).cast("double").alias("best_probability"),
    )
    return plain.unionByName(scanned)


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents"))
