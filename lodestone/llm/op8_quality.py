"""Quality rules with tokeniser fertility.

Two sets of rules decide whether a document is kept.

*Base rules* count words (``[^\\x20\\x09-\\x0D]+``), their code points, symbol
characters, repeated lines, and the words that lie in an 8-word window which
occurs twice or more in the text.  Too few words or too many repeated ones fail.

*Fertility rules* encode the whole text with a public vocabulary and measure
characters per token, the share of byte-fallback tokens (those for white space
aside) and the entropy of the token distribution in bits.  Every language has a
band; languages without one of their own use the band of the script most of
their letters belong to.  Outside the band a document is rejected.  The least
values hold for long texts; the measures of ``n`` words hang on few of them, so
there the least values are ``n / (n + PRIOR_WORDS)`` of those, at every length.
``fit_bands`` takes the least characters per token from labelled good documents.

Each row is judged by itself: no shuffle, one pass over the texts.

Defined results: a null text counts as empty (no words, so base rules fail).
Repeated rows are judged alike; a null ``doc_id`` stays null; extra columns are
ignored by ``measure`` and kept by ``filter_documents``.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .op5_sentencepiece import MODEL, encoder

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
SYMBOLS = "#*$%&|<>"
SPACE = " \t\n\x0b\x0c\r"
#: Words that count against the least values of a band.
PRIOR_WORDS = 8
#: Good documents of a language that ``fit_bands`` looks at, the share of them that
#: may lie below, and what the bound stays under that.
FIT_DOCUMENTS, FIT_SHARE, FIT_MARGIN = 5_000, 0.005, 0.15
#: (least, most) characters per token, most byte-fallback share, least entropy.  The
#: first are those of ``fit_bands`` over the labelled documents of sf0.1.
LANGUAGE_BANDS = {
    "de": (2.27, 7.0, 0.2, 4.75),
    "en": (2.25, 7.0, 0.2, 4.75),
    "es": (1.97, 7.0, 0.2, 4.75),
    "fr": (1.98, 7.0, 0.2, 4.75),
}
SCRIPT_BANDS = {
    "LATIN": (1.5, 7.0, 0.3, 4.0),
    "CYRILLIC": (1.2, 6.0, 0.3, 4.0),
    "GREEK": (0.7, 5.0, 0.5, 3.5),
    "CJK": (0.3, 3.0, 0.9, 3.5),
    "OTHER": (0.2, 8.0, 1.0, 3.0),
}
RESULT = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, chars_per_token double, byte_share double, token_entropy double"
)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """How many words lie in a window of words that occurs twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words))) + np.arange(len(words))
    starts = np.r_[0, ends[:-1] + 1]
    seen: dict[bytes, int] = {}
    twice = []
    for i, (a, b) in enumerate(zip(starts[:n].tolist(), ends[window - 1 :].tolist())):
        if (first := seen.setdefault(joined[a:b], i)) != i:
            twice += (first, i)
    if not twice:
        return 0
    step = np.zeros(len(words) + 1, np.int64)
    at = np.unique(twice)
    step[at] += 1
    step[at + window] -= 1
    return int((np.cumsum(step) > 0).sum())


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    return (
        len(words),
        len(text) - sum(map(text.count, SPACE)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def script_of(text: str) -> str:
    """The script that most letters of the text belong to."""
    counts: dict[str, int] = {}
    seen: dict[str, int] = {}
    for c in text:
        seen[c] = seen.get(c, 0) + 1
    for c, n in seen.items():
        if c.isalpha():
            name = unicodedata.name(c, "OTHER").split()[0].split("-")[0]
            name = "CJK" if name in ("CJK", "HIRAGANA", "KATAKANA", "HANGUL") else name
            counts[name] = counts.get(name, 0) + n
    best = max(counts, key=lambda k: (counts[k], k), default="OTHER")
    return best if best in SCRIPT_BANDS else "OTHER"


def fertility(text: str, ids: np.ndarray, is_byte: np.ndarray, space_bytes: np.ndarray) -> tuple[float, float, float]:
    """Characters per token, byte-fallback share, token entropy in bits."""
    if not len(ids):
        return 0.0, 0.0, 0.0
    count = np.bincount(ids)
    fallback = count[: len(is_byte)][is_byte[: len(count)]].sum() - count[space_bytes[space_bytes < len(count)]].sum()
    share = count[count > 0] / len(ids)
    return len(text) / len(ids), float(fallback) / len(ids), float(-(share * np.log2(share)).sum())


def within_band(lang: str | None, text: str, n_words: int, cpt: float, byte_share: float, entropy: float) -> bool:
    least, most, most_bytes, least_entropy = LANGUAGE_BANDS.get(lang or "") or SCRIPT_BANDS[script_of(text)]
    weight = n_words / (n_words + PRIOR_WORDS)
    return least * weight <= cpt <= most and byte_share <= most_bytes and entropy >= least_entropy * weight


def judge(texts: list[str | None], langs: list[str | None], model: str = MODEL) -> list[tuple]:
    """The measures and verdicts of ``RESULT`` without ``doc_id``, text by text."""
    enc = encoder(model)
    space_bytes = enc.byte_ids[[ord(c) for c in SPACE]]
    out = []
    texts = [t or "" for t in texts]
    for text, lang, data in zip(texts, langs, enc.ids(texts)):
        base = base_counts(text)
        failed = base[0] < MIN_WORDS or 100 * base[4] > MAX_REPEAT_PERCENT * base[0]
        measures = fertility(text, np.frombuffer(data, "<u4"), enc.is_byte, space_bytes)
        out.append((*base, failed, not failed and within_band(lang, text, base[0], *measures), *measures))
    return out


def measure(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """The measures and the verdict of every document."""
    common.tune(docs.sparkSession)
    names = [x.split()[0] for x in RESULT.split(", ")]
    kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = judge(batch.column(1).to_pylist(), batch.column(2).to_pylist(), model)
            columns = zip(*rows) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), k) for c, k in zip(columns, kinds))], names)

    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("long"), F.col("text"), lang.alias("lang")).mapInArrow(common.tidy(run, lambda: encoder(model).forget()), RESULT)


def filter_documents(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns."""
    common.tune(docs.sparkSession)
    at, lang_at = docs.columns.index("text"), docs.columns.index("lang") if "lang" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(lang_at).to_pylist() if lang_at is not None else [None] * batch.num_rows
            rows = judge(batch.column(at).to_pylist(), langs, model)
            yield batch.filter(pa.array([r[6] for r in rows], pa.bool_()))

    return docs.mapInArrow(common.tidy(run, lambda: encoder(model).forget()), docs.schema)


def fit_bands(docs: DataFrame, labels: DataFrame, documents: int = FIT_DOCUMENTS) -> dict[str, float]:
    """The least characters per token for each language of labelled good documents
    (``labels.quality`` 1): some ``documents`` of a language, chosen by a hash of their
    id, that pass the base rules."""
    good = docs.filter("lang is not null").join(labels.filter("quality = 1").select("doc_id").distinct(), "doc_id", "left_semi")
    some = good.join(good.groupBy("lang").agg(F.count("*").alias("__n")), "lang")
    some = some.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) * F.col("__n") < F.lit((1 << 20) * documents))
    found = measure(some).filter("not base_failed").join(some.select("doc_id", "lang").distinct(), "doc_id")
    low = found.groupBy("lang").agg(F.expr(f"percentile_approx(chars_per_token, {FIT_SHARE}, 10000)").alias("low"))
    return {r.lang: round(r.low - FIT_MARGIN, 2) for r in low.collect()}  # a row for each language


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure(common.table(spark, sf_dir, "documents"))
