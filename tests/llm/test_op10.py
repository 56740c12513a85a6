import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lodestone.llm import op10_lines as op

from .conftest import prose
from .test_op6 import brute_components


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        now = [i]
        for j, d in enumerate(b, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (c != d)))
        row = now
    return row[-1]


def allowed(n):
    return max([e for least, e in op.THRESHOLDS if n >= least], default=0)


def within(a, b, t):
    """Whether ``t`` edits at most lie between two texts, by trying them."""
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    a, b = a[i:], b[i:]
    if not a or not b or not t:
        return len(a) + len(b) <= t
    return abs(len(a) - len(b)) <= t and (within(a[1:], b[1:], t - 1) or within(a[1:], b, t - 1) or within(a, b[1:], t - 1))


def near(a, b):
    t = allowed(min(len(a), len(b)))
    return t > 0 and abs(len(a) - len(b)) <= t and within(a, b, t)


def edited(rng, line, k):
    x = list(line)
    for _ in range(k):
        if not x:
            break
        at, kind = rng.randrange(len(x)), rng.random()
        if kind < 0.34:
            x[at] = rng.choice("abz é")
        elif kind < 0.67:
            x.insert(at, rng.choice("abz é"))
        else:
            del x[at]
    return "".join(x)


@pytest.fixture(scope="module")
def lines():
    rng, out = random.Random(8), []
    for g in range(40):
        base = prose(g, rng.choice((2, 3, 5, 9, 40))).replace("\n", " ")
        out += [edited(rng, base, rng.randint(0, 4)) for _ in range(4)]
    return sorted({x for x in out if x.strip()})


def test_links_against_brute_force(spark, lines):
    df = spark.createDataFrame([(x,) for x in lines], "line string").select(F.xxhash64("line").alias("h"), "line")
    text = {r.h: r.line for r in df.collect()}
    got = {tuple(sorted((text[r.u], text[r.v]))) for r in op.line_links(df).collect()}
    want = {(a, b) for i, a in enumerate(lines) for b in lines[i + 1 :] if near(a, b)}
    assert got == want and len(want) > 20


@pytest.mark.parametrize("most", [1, 2, 3])
def test_edit_vectors_against_brute_force(spark, most):
    rng, pairs = random.Random(most), []
    for _ in range(400):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(1, 14)))
        pairs.append((a, edited(rng, a, rng.randint(0, 4)) or "a"))
    df = spark.createDataFrame(pairs, "a string, b string")
    got = df.select("a", "b", op.edits_within(F.split("a", ""), F.split("b", ""), most).alias("near"), op.equal_head(F.col("a"), F.col("b")).alias("head")).collect()
    for r in got:
        assert r.near == (edits(r.a, r.b) <= most), (r.a, r.b)
        n = next((i for i, (x, y) in enumerate(zip(r.a, r.b)) if x != y), min(len(r.a), len(r.b)))
        assert r.head == n


def test_sketch_bounds_edits(spark):
    rng, pairs = random.Random(5), []
    for _ in range(300):
        a = prose(rng.randrange(99), 30)
        pairs.append((a, edited(rng, a, 2)))
    df = spark.createDataFrame(pairs, "a string, b string").select(op._sketch_distance(op._sketch(F.col("a")), op._sketch(F.col("b"))).alias("d"))
    assert df.agg(F.max("d")).first()[0] <= 4


def test_classes(spark, odd, odd_rows, none):
    extra = [0] * (len(odd.columns) - 5)
    one = "a line that is long enough to be linked by two edits"
    more = [(20, one + "\nother"), (21, "new\n" + one.replace("long", "lomg")), (22, one.replace("linked", "lInkEd").replace("that", "thaT")), (23, one.replace("long", "lomg") + "!")]
    docs = odd.unionByName(spark.createDataFrame([(i, t, "en", "s", 0, *extra) for i, t in more], odd.schema))
    got = defaultdict(list)
    for r in op.line_classes(docs).collect():
        got[r.doc_id, r.line_no].append((r.class_doc_id, r.class_line_no, r.n_links))
    places = [(i, k, x) for i, t in odd_rows + more if t for k, x in enumerate(t.split("\n")) if x.strip(" \t\n\r\x0b\f")]
    assert sum(map(len, got.values())) == len(places)
    texts = sorted({x for *_, x in places})
    rank = lambda i: (-1 if i is None else i)
    linked = {(i, j) for i, x in enumerate(texts) for j, y in enumerate(texts) if i != j and near(x, y)}
    degree = defaultdict(int)
    for i, _ in linked:
        degree[texts[i]] += 1
    first = {x: min((rank(i), k) for i, k, y in places if y == x) for x in texts}
    least = dict(zip(texts, brute_components([first[x] for x in texts], lambda i, j: (i, j) in linked)))
    for i, k, x in places:
        links, want = degree[x], least[x]
        assert all((rank(a), b, n) == (*want, links) for a, b, n in got[i, k])
    assert op.line_classes(none).count() == 0


def test_strip_lines(spark, odd, none):
    shared = "this shared line of some length stands in many documents of the corpus"
    body = {i: prose(60 + i, 120) for i in range(5)}
    rows = [(30, shared + "\n" + body[0]), (31, body[1] + "\n" + shared), (32, shared.replace("shared", "sharad") + "\n" + body[2]), (33, shared + "\n" + body[0]), (34, body[4])]
    extra = [0] * (len(odd.columns) - 5)
    docs = odd.unionByName(spark.createDataFrame([(i, t, "en", "s", len(t), *extra) for i, t in rows], odd.schema))
    out = op.strip_lines(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    got = {r.doc_id: r for r in out.collect()}
    assert got[30].text == rows[0][1]
    assert got[31].text == body[1] and got[31].n_chars == len(body[1])
    assert got[32].text == body[2]
    assert got[33].text == rows[3][1]  # a copy as a whole
    assert got[34].text == body[4]
    assert op.strip_lines(none).count() == 0


def test_plan_has_no_python(odd):
    lines = op._occurrences(odd.select("doc_id", "text"), ["doc_id"])
    plan = op.line_links(lines)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_strip_lines_of_copies_alone(spark):
    """Passages of several documents go; a copy loses what its source loses."""
    part = {i: "\n".join(prose(300 + 10 * i + k, 25) for k in range(4)) for i in range(6)}
    own = prose(400, 30)
    mixed = "\n".join(part[i] for i in (1, 2, 3)) + "\n" + own
    source = part[4] + "\n" + part[5]
    twice = "\n".join([prose(401, 30)] * 4 + [prose(402, 30)])
    rows = [(1, part[1]), (2, part[2]), (3, part[3]), (4, mixed), (5, part[4]), (6, source), (7, source), (8, twice), (9, twice)]
    got = {r.doc_id: r.text for r in op.strip_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i in (1, 2, 3, 5)] == [part[1], part[2], part[3], part[4]]
    assert got[4] == own
    assert got[6] == part[5]
    assert got[7] in (part[5], "")  # as its source or wholly gone, but never whole
    assert got[8] == got[9] == prose(401, 30) + "\n" + prose(402, 30)
