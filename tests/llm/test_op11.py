import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from lodestone.llm import op11_search as op

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans(op.UPPER, op.LOWER)


def brute(docs, items, k=op.TOP):
    """Every document scored for every item, in Python's own whole numbers."""
    held = [(i, Counter(TERM.findall((t or "").translate(LOW)))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    size, total, df = len(held), sum(n for _, _, n in held), Counter(w for _, c, _ in held for w in c)
    out = []
    for item, text in set(items):
        scores = []
        for i, c, n in held:
            m = 100 - 90 + (90 * n * size) // total
            s = sum(math.floor(1000 * math.log((2 * size + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 8 * m)) for w in set(TERM.findall((text or "").translate(LOW))) if c[w])
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scores)[:k], 1)]
    return out


def corpus(seed, n, vocabulary=400, low=1, high=120):
    rng = random.Random(seed)
    words = [f"w{i:x}" for i in range(vocabulary)]
    pick = lambda: words[min(int(rng.expovariate(1) * vocabulary / 12), vocabulary - 1)]
    return [(i, " ".join(pick() for _ in range(rng.randint(low, high)))) for i in range(n)], lambda m: " ".join(rng.choice(words) if rng.random() < 0.5 else pick() for _ in range(m))


def key(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


@pytest.mark.parametrize("values", [[], [0], [127, 128, 16383, 16384, 5], [1] * 300, [2**21, 2**28 + 3, 0, 2**34]])
def test_numbers_turn_back(values):
    raw, ends = op.packed(np.array(values, np.int64))
    assert op.unpacked(raw).tolist() == values and len(ends) == len(values) and (not values or ends[-1] == len(raw))


def test_terms():
    assert op.terms_of("Ab_cD-9é\tÀÉ’x   @[`{~") == [x.encode() for x in ("ab", "cd", "9é", "ÀÉ’x", " ")]
    for text in ("a\x00b\x7fc", "中文🙂 x", "", None, "ÄB/äb:;"):
        assert op.terms_of(text) == [x.encode() for x in TERM.findall((text or "").translate(LOW))]


def segment_of(docs, size, total):
    builder = op.Builder(size, total)
    for i, t in docs:
        builder.add(i, t)
    return op.Segment([tuple(r[c] for c in ("term", "n", "top", "heads", "data")) for b in builder.rows(0) for r in b.to_pylist()])


def test_closed_blocks_are_skipped():
    """A rare word lifts one document over all others: long lists stay mostly closed."""
    docs = [(i, "common other " + ("rare rare" if i == 2900 else "")) for i in range(3000)]
    segment = segment_of(docs, 3000, sum(len(t.split()) for _, t in docs))
    found, scores = segment.best([(b"rare", 9000), (b"common", 3), (b"other", 2)], 1, 1)
    assert segment.doc_ids[found].tolist() == [2900]
    # the first round looks at a few more documents, whose bounds tie
    assert all(sum(~segment.lists[x].closed) <= 4 for x in (b"common", b"other"))
    # a threshold that nothing reaches opens nothing
    again = segment_of(docs, 3000, 6002)
    assert len(again.best([(b"common", 3), (b"other", 2)], 5, 10**12)[0]) == 0 and again.lists[b"common"].closed.all()


@pytest.mark.parametrize("postings,seeds", [(1 << 21, 8), (500, 1), (4000, 2)])
def test_search_against_brute_force(spark, tmp_path, monkeypatch, postings, seeds):
    monkeypatch.setattr(op, "SEED_SEGMENTS", seeds)
    docs, ask = corpus(7, 900)
    docs += [(i + 5000, docs[3][1]) for i in range(300)] + [(4, "once more")]  # copies: ties beyond ten
    items = [(i, ask(12)) for i in range(25)] + [(90, docs[3][1]), (90, "w1 w2"), (91, None), (92, "..."), (93, "unheard"), (94, "w0")]
    path = str(tmp_path / "index")
    op.build_index(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), path, postings)
    found = op.search(spark, path, spark.createDataFrame(items, "item_id long, text string"))
    assert key(map(tuple, found.collect())) == key(brute(docs, items))
    assert dict(found.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}


def test_queries_in_turns(spark, tmp_path):
    docs, ask = corpus(8, 200)
    items = [(i, ask(9)) for i in range(20)]
    path = str(tmp_path / "index")
    op.build_index(spark.createDataFrame(docs, "doc_id long, text string"), path)
    frame = spark.createDataFrame(items, "item_id long, text string")
    assert key(map(tuple, op.search(spark, path, frame, pairs=40).collect())) == key(brute(docs, items))
    assert key(map(tuple, op.search(spark, path, frame, k=3).collect())) == key(brute(docs, items, 3))


def test_odd_rows(spark, odd, odd_rows, none, tmp_path):
    words = (odd_rows[3][1] or "").split()
    items = [(1, " ".join(words[:30])), (None, "one É 中文"), (2, "same line"), (2, "same line")]
    frame = spark.createDataFrame([(i, t, 0, 0) for i, t in items], "item_id long, text string, term int, segment int")
    op.build_index(odd, str(tmp_path / "a"), 2000)
    assert key(map(tuple, op.search(spark, str(tmp_path / "a"), frame).collect())) == key(brute(odd_rows, items))
    op.build_index(none, str(tmp_path / "b"))
    assert op.search(spark, str(tmp_path / "b"), frame).count() == 0
    assert op.search(spark, str(tmp_path / "a"), frame.limit(0)).count() == 0
