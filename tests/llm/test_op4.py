import random
import re

import pytest

from lodestone.llm import op4_decontaminate as op

from .conftest import prose


def distance_to_part(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        now = [i]
        for j, d in enumerate(text, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (c != d)))
        row = now
    return min(row)


def test_search_against_brute_force():
    rng, letters, hits = random.Random(1), "abcdefgh ", 0
    for _ in range(150):
        base = op.plain("x" + "".join(rng.choice(letters) for _ in range(rng.choice((60, 80, 130)))) + "x")
        items, x = op.Items([(1, base)]), list(base)
        for _ in range(rng.randint(0, 8)):
            k, kind = rng.randrange(len(x)), rng.random()
            if kind < 0.34:
                x[k] = rng.choice(letters)
            elif kind < 0.67:
                x.insert(k, rng.choice(letters))
            else:
                del x[k]
        noise = lambda n: "".join(rng.choice(letters) for _ in range(n))
        doc = op.plain(noise(50) + " " + "".join(x) + " " + noise(60))
        least = [(distance_to_part(base[o : o + len(s)], doc), int(m)) for o, s, m in zip(items.offset, items.segments, items.most)]
        want = [d for d, most in least if d <= most]
        got = op._found(items, ["other", doc])
        assert set(got) == ({(1, 1)} if want else set())
        if want:
            hits += 1
            assert got[1, 1][0] == min(want)
    assert hits > 40


def test_parts_give_the_same(monkeypatch):
    items = op.Items([(i, "the cat sat on the mat and " * 6 + str(i)) for i in range(30)])
    docs = [op.plain("the cat sat on the mat and " * n) for n in (3, 10, 500, 2)]
    want = op._found(items, docs)
    monkeypatch.setattr(op, "MOST_HITS", 3000)
    got = op._found(items, docs)
    assert set(got) == set(want) and all(got[k][0] == want[k][0] for k in want)


@pytest.fixture
def benchmark(spark):
    rows = [(1, prose(100, 40)), (2, prose(101, 25)), (3, None), (4, ""), (5, "short"), (6, prose(100, 40))]
    return spark.createDataFrame([(*r, 0) for r in rows], "item_id long, text string, doc_id int")


def test_frames(spark, odd, odd_rows, benchmark):
    rows = [(20, prose(7, 50) + " " + prose(100, 40).upper() + " " + prose(8, 900)), (21, prose(101, 25).replace(" ", "\n  ")), (22, prose(9, 400))]
    extra = [0] * (len(odd.columns) - 5)
    docs = odd.unionByName(spark.createDataFrame([(i, t, "en", "s", 0, *extra) for i, t in rows], odd.schema))
    got = op.contaminated(docs, benchmark).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(20, 1), (20, 6), (21, 2)]
    assert all(r.edits == 0 for r in got)
    place = next(r for r in got if (r.doc_id, r.item_id) == (20, 1))
    assert op.plain(prose(100, 40)).find(op.plain(rows[0][1])[place.begin : place.end]) >= 0
    kept = op.decontaminate(docs, benchmark)
    assert kept.columns == docs.columns
    ids = lambda rows: sorted(-1 if x is None else x for x in rows)
    assert ids(r.doc_id for r in kept.collect()) == ids([i for i, _ in odd_rows] + [22])


def test_blocks(spark, benchmark, monkeypatch):
    docs = spark.createDataFrame([(1, prose(100, 40)), (2, prose(101, 25))], "doc_id long, text string")
    monkeypatch.setattr(op, "BLOCK_CHARS", 200)
    assert sorted((r.doc_id, r.item_id) for r in op.contaminated(docs, benchmark).collect()) == [(1, 1), (1, 6), (2, 2)]
    assert op.decontaminate(docs, benchmark).count() == 0


def test_short_items_count_word_for_word():
    items = op.Items([(1, "What is  2+2?"), (2, "Name the capital of old Peru"), (3, "ox"), (4, ""), (5, "OX")])
    texts = [op.plain(x) for x in ("He asked: what is 2+2? Four.", "name the capital of old Perugia", "so: Name the\ncapital of old Peru!", "an ox, a fox", "foxes")]
    want = {(n, i) for n, t in enumerate(texts) for i, x in ((1, "what is 2+2?"), (2, "name the capital of old peru"), (3, "ox"), (5, "ox")) if re.search(rf"(?<![a-z0-9]){re.escape(x)}(?![a-z0-9])" if x[-1].isalnum() else re.escape(x), t)}
    assert set(op._found(items, texts)) == want == {(0, 1), (2, 2), (3, 3), (3, 5)}


def distance_to_words(pattern, text):
    """Least edits to a part that begins and ends at borders of words."""
    borders = sorted({0, len(text)} | {p for m in re.finditer(r"[a-z0-9]+", text) for p in m.span()})
    parts = [text[a:b] for a in borders for b in borders if a < b and abs(b - a - len(pattern)) < 3]
    return min((op.distance(pattern, part) for part in parts), default=len(pattern))


def test_distance():
    rng = random.Random(5)
    for _ in range(300):
        a, b = ("".join(rng.choice("ab c") for _ in range(rng.randint(0, 7))) for _ in "ab")
        # a part of the text that is framed by marks no pattern holds is the whole text
        assert op.distance(a, b) == op.distance(b, a) == distance_to_part("<" * 20 + a + ">" * 20, "<" * 20 + b + ">" * 20)


def test_one_edit_is_found_from_twenty_characters_on():
    """Every place of the edit, against brute force; whole words alone below ``SHORTEST``."""
    rng, letters = random.Random(4), "abcdefghijklmnop"
    noise = lambda n: "".join(rng.choice(letters) for _ in range(n))
    for n in range(18, 46):
        base = noise(n)
        items = op.Items([(1, base), (2, base)])
        docs = []
        for k in range(n):
            for changed in (base[:k] + "Z" + base[k + 1 :], base[:k] + base[k + 1 :], base[:k] + "z" + base[k:]):
                docs.append(op.plain(f"{noise(30)} {changed} {noise(40)}"))
        docs.append(op.plain(f"{noise(9)} {base[:5]}zz{base[7:12]}zz{base[14:]}"))
        docs.append(op.plain(f"{noise(9)} {base}xyz {noise(9)}"))
        least = [distance_to_words(base, text) if n < op.SHORTEST else distance_to_part(base, text) for text in docs]
        want = {d for d, edits in enumerate(least) if edits <= int(op.BUDGET * n)}
        got = op._found(items, docs)
        assert set(got) == {(d, i) for d in want for i in (1, 2)}
        assert all(got[d, i][0] == least[d] for d, i in got)
        assert len(want) == (0 if n < 20 else 3 * n + (n >= op.SHORTEST))


def test_empty_tables(none, benchmark, odd):
    assert op.contaminated(none, benchmark).count() == 0
    assert op.contaminated(odd, benchmark.filter("false")).count() == 0
    assert op.decontaminate(odd, benchmark.filter("false")).count() == odd.count()
