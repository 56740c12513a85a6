import math
import random
import zlib

import pytest
import regex as re

from lodestone.llm import common
from lodestone.llm import op7_langid as op



@pytest.fixture(scope="module")
def model():
    words = [("de", "und", 50), ("de", "haus", 5), ("en", "and", 60), ("en", "house", 6), ("en", "und", 1)]
    grams = [(lang, g, n) for lang, w, n in words for k in range(1, op.LONGEST + 1) for g in op.grams_of(w, k)]
    return op.Model.of_counts(words, grams)


def test_known_words_then_shorter_and_shorter_grams(model):
    assert model.vector("und") is model.words["und"]
    assert model.vector("hausen").argmax() == model.languages.index("de")
    assert model.vector("houses").argmax() == model.languages.index("en")
    # only single letters of it are known, then none
    assert (model.vector("xhx") != 0).any()
    assert model.vector("中").tolist() == pytest.approx((model.grams["<"] + model.grams[">"]).tolist()) or model.vector("中").tolist() == pytest.approx(((model.grams["<"] + model.grams[">"]) / 2).tolist())


def brute_prediction(rows, text):
    """Log-frequencies and backoff counted anew, by language and length."""
    langs, words = sorted({lang for lang, _ in rows}), [(lang, w) for lang, t in rows for w in re.findall(r"\p{L}+", t.lower())]
    known, total = {w for _, w in words}, dict.fromkeys(langs, 0.0)
    log = lambda unit, lang, bag: math.log((sum(x == (lang, unit) for x in bag) + op.SMOOTHING) / (sum(x[0] == lang for x in bag) + op.SMOOTHING * len({u for _, u in bag})))
    grams = {n: [(lang, f"<{w}>"[i : i + n]) for lang, w in words for i in range(len(w) + 3 - n)] for n in range(1, op.LONGEST + 1)}
    for w in re.findall(r"\p{L}+", text.lower()):
        if w in known:
            for lang in langs:
                total[lang] += log(w, lang, words)
            continue
        for n in range(op.LONGEST, 0, -1):
            found = [g for i in range(len(w) + 3 - n) if (g := f"<{w}>"[i : i + n]) in {u for _, u in grams[n]}]
            if found:
                for lang in langs:
                    total[lang] += sum(log(g, lang, grams[n]) for g in found) / len(found)
                break
    best = max(langs, key=lambda lang: (total[lang], -langs.index(lang)))
    return best, 1 / sum(math.exp(total[lang] - total[best]) for lang in langs)


def test_whole_way_against_brute_force(spark):
    rng, letters = random.Random(4), {"aa": "abcde", "bb": "defgh", "cc": "aefhx"}
    word = lambda lang: "".join(rng.choice(letters[lang]) for _ in range(rng.randint(1, 7)))
    rows = [(lang, " ".join(word(lang) for _ in range(12))) for lang in letters for _ in range(8)]
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 != 2]
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in zip(ids, rows)], "doc_id long, text string, lang string")
    predictor = op.Predictor(op.train(docs))
    texts = [" ".join(word(rng.choice(list(letters))) for _ in range(rng.randint(1, 6))) for _ in range(60)] + ["zz qq", "a1b2²c"]
    for text, (lang, score) in zip(texts, predictor.predict(texts)):
        want, share = brute_prediction(rows, text)
        assert score == pytest.approx(share, rel=1e-3) and (lang == want or share < 0.51)


def test_letters_are_of_the_category():
    assert op.words_of("a²b ½ Ⅷ x_y 3d É") == ["a", "b", "x", "y", "d", "é"]
    assert op.Predictor(op.Model(["en"])).predict(["² ½ Ⅷ ①"]) == [("und", 0.0)]


def test_predictions(model):
    p = op.Predictor(model)
    found = p.predict(["Und das HAUS", "and the house", None, "", "123 ... 🙂", "und " * 5000])
    assert [x for x, _ in found] == ["de", "en", "und", "und", "und", "de"]
    assert all(0 <= s <= 1 for _, s in found) and found[2][1] == 0
    assert op.Predictor(op.Model([])).predict(["x"]) == [("und", 0.0)]


def test_held_out_accuracy(spark):
    docs = common.table(spark, "/root/testdata/sf0.01", "documents")
    rows = op.identify(docs, op.train(docs)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    apart = [r for r in rows if r.held_out]
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.lang == r.lang_pred for r in apart) >= 0.98 * len(apart)


def test_held_out_rows_teach_nothing(spark):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 == 2]
    docs = spark.createDataFrame([(i, "wort", "de") for i in ids], "doc_id long, text string, lang string")
    assert op.train(docs).languages == []


def test_sample_is_bounded(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "concat('w', id % 7, ' same') AS text", "'en' AS lang")
    model = op.train(docs, documents=300)
    assert model.languages == ["en"] and "same" in model.words


def test_frames(spark, odd, odd_rows, none):
    model = op.train(odd)
    got = op.identify(odd, model).collect()
    assert len(got) == len(odd_rows)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert [by[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and by[4].lang_pred == "en"
    assert op.identify(none, op.train(none)).count() == 0
    null_lang = spark.createDataFrame([(1, "a", None)], "doc_id long, text string, lang string")
    assert op.train(null_lang).languages == []


def test_commonest_keeps_within_the_limit(spark):
    rows = [("en", f"w{i}", 100 - i // 3) for i in range(60)] + [("de", f"x{i}", 1) for i in range(10)] + [("fr", f"y{i}", 1) for i in range(4000)]
    df = spark.createDataFrame(rows, "lang string, unit string, n long")
    got = op._commonest(df, 20)
    assert sorted(n for lang, _, n in got if lang == "en") == sorted(100 - i // 3 for i in range(18))
    assert sum(lang == "de" for lang, *_ in got) == 10
    assert 5 <= sum(lang == "fr" for lang, *_ in got) <= 40  # of equals beyond the limit a hash chooses some 20
