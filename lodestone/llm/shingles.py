"""Shingle similarity of pairs of texts, in built-in functions.

A text is lower-cased (A-Z) and cut into words as for fingerprints; its shingles
are a set of 64-bit hashes, and similarity is that of Jaccard.  Texts of fewer
words are one shingle.  Texts are named by ``content``, a 64-bit hash.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WORDS = 5
#: Texts of this similarity or more are near copies.
LEAST = 0.8


def content_of(text: str = "text") -> Column:
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def shingles(text: Column, words_each: int = WORDS) -> Column:
    """The distinct hashes of a text's shingles."""
    lower = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    words = F.filter(F.split(lower, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    hashes = lambda w: F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - words_each, F.lit(0))), lambda i: F.xxhash64(F.slice(w, i + 1, words_each)))
    return F.array_distinct(F.get(F.transform(F.array(words), hashes), F.lit(0)))


def shingle_sets(docs: DataFrame, wanted: DataFrame, words_each: int = WORDS) -> DataFrame:
    """``content, shingles`` of the texts of ``docs`` that are in ``wanted(content)``."""
    texts = docs.select(content_of().alias("content"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    met = texts.join(common.small(common.materialise(wanted.distinct(), "wanted")), "content", "left_semi").dropDuplicates(["content"])
    return common.materialise(met.select("content", shingles(F.col("text"), words_each).alias("shingles")), "shingles")


def similar(pairs: DataFrame, sets: DataFrame, least: float = LEAST) -> DataFrame:
    """Those of ``pairs(a, b)`` whose shingle sets are similar by ``least`` or more."""
    end = lambda name: sets.select(F.col("content").alias(name), F.col("shingles").alias(f"{name}_set"))
    met = pairs.select("a", "b").distinct().join(end("a"), "a").join(end("b"), "b")
    both = F.size(F.array_intersect("a_set", "b_set"))
    # exploded, the intersection is made once
    met = met.select("a", "b", F.explode(F.array(both)).alias("both"), (F.size("a_set") + F.size("b_set")).alias("sum"))
    return met.filter(F.col("both") >= least * (F.col("sum") - F.col("both"))).select("a", "b")
