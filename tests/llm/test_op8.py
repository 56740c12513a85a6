import math
import re

import pytest

from lodestone.llm import common
from lodestone.llm import op8_quality as op

from .conftest import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    repeated = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    counts = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(repeated))
    return (*counts, counts[0] < 20 or 100 * counts[4] > 30 * counts[0])


TEXTS = ["", " \n \t", "a " * 9, "a " * 8, "a\x0bb\x1cc\xa0d", prose(1, 200), prose(1, 30) + " " + prose(1, 30), "x\nx\n x\n\n\n", "#*$%&|<> é🙂", ("a b c d e f g h " * 3 + prose(3, 60))]


@pytest.mark.parametrize("text", TEXTS)
def test_base_counts(text):
    assert op.base_counts(text) == brute(text)[:5]


def test_whole_table(spark):
    docs = common.table(spark, "/root/testdata/sf0.01", "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = op.measure(docs).collect()
    assert len(got) == len(texts)
    assert [r.doc_id for r in got if (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) != brute(texts[r.doc_id])] == []
    assert all(not r.kept for r in got if r.base_failed)


def test_good_documents_stay_and_junk_goes(spark):
    d = "/root/testdata/sf0.01"
    judged = op.measure(common.table(spark, d, "documents")).join(common.table(spark, d, "labels"), "doc_id").collect()
    good = [r for r in judged if r.quality == 1 and not r.base_failed]
    bad = [r for r in judged if r.quality == 0]
    assert sum(r.kept for r in good) >= 0.99 * len(good)
    assert sum(not r.kept for r in bad) >= 0.5 * len(bad)


def test_fertility_rejects_by_band():
    shout = " ".join(w.upper() + "!!" for w in prose(5, 300).split())
    rows = op.judge([shout, None, "中文字符 " * 200], ["en", None, None])
    assert not rows[0][6] and not rows[1][6]
    assert op.script_of("中文 abc") == "LATIN" and op.script_of("中文字 ab") == "CJK" and op.script_of("абв") == "CYRILLIC" and op.script_of("123") == "OTHER"


def test_bands_bind_at_every_length():
    least, *_, entropy = op.LANGUAGE_BANDS["en"]
    for n in (1, 20, 49, 50, 51, 400, 100_000):
        weight = n / (n + op.PRIOR_WORDS)
        assert op.within_band("en", "", n, least * weight + 1e-9, 0, entropy * weight + 1e-9)
        assert not op.within_band("en", "", n, least * weight - 1e-6, 0, 9)
        assert not op.within_band("en", "", n, 3, 0, entropy * weight - 1e-6)


def test_bands_are_those_of_the_fit(spark):
    """Quantiles by another way; the constants come from sf0.1."""
    d = "/root/testdata/sf0.01"
    docs, labels = common.table(spark, d, "documents"), common.table(spark, d, "labels")
    got = op.fit_bands(docs, labels)
    values = {}
    for r in op.measure(docs).join(labels.filter("quality = 1"), "doc_id").join(docs.select("doc_id", "lang"), "doc_id").filter("lang is not null and not base_failed").collect():
        values.setdefault(r.lang, []).append(r.chars_per_token)
    assert got == {k: pytest.approx(sorted(v)[max(0, math.ceil(len(v) * op.FIT_SHARE) - 1)] - op.FIT_MARGIN, abs=0.006) for k, v in values.items()}


def test_frames(odd, odd_rows, none):
    got = op.measure(odd).collect()
    assert len(got) == len(odd_rows)
    kept = op.filter_documents(odd)
    assert kept.columns == odd.columns and kept.count() == sum(r.kept for r in got)
    assert op.measure(none).count() == op.filter_documents(none).count() == 0
    assert op.measure(odd.drop("lang")).count() == len(odd_rows)
