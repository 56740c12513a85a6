import re
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from lodestone.llm import common
from lodestone.llm import op13_middle as op

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)


def brute(doc_id, text):
    """Cuts by joining whole lists of units."""
    units, digest = UNIT.findall(text or ""), sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    n, text = len(units), text or ""
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


TEXTS = [
    "", "a", "é", "two words", "x" * 5000, "é中🙂 " * 700, "One, two;\nthree\t4 fünf-six ñ" * 90, "a<P>b", "<S>", "x<M", "<<P", "ab<P" * 60,
    " " * 999, "12.5%\r\n" * 300, "\x00a\x7fb", "ſK straße",
]


@pytest.mark.parametrize("step,block", [(1, 7), (3, 64), (256, 1 << 20), (5, 5)])
def test_checkpoints_find_every_unit(step, block):
    for text in TEXTS:
        data, units = text.encode(), UNIT.findall(text)
        index = op.Checkpoints.of(data, step, block)
        assert index.units == len(units) and len(index.numbers) == -(-len(units) // step)
        for u in sorted({0, 1, 2, len(units) // 3, len(units) // 2, len(units) - 1, len(units)} & set(range(len(units) + 1))):
            before = "".join(units[:u])
            assert index.place(data, u) == (len(before.encode()), len(before))


def test_cuts_against_brute_force():
    seen = set()
    for i, text in enumerate(TEXTS * 12):
        for step in (2, op.STEP):
            found = op.cut(i, text, step=step)
            assert found == brute(i, text)
        seen.add(found[1])
    assert seen == {"plain", "psm", "spm"}


def test_every_output_turns_back(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS * 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in op.transform(docs).select("*", op.restore().alias("back")).collect()}
    assert all(found[i].back == t and found[i].output == brute(i, t)[4] for i, t in rows)


def test_odd_rows(spark, odd, odd_rows, none):
    got = op.transform(odd).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output").collect()
    want = [(i, *brute(i, t)) for i, t in odd_rows]
    key = lambda r: (r[0] is None, r[0] or 0, r[5])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert op.transform(none).count() == 0


def test_query(spark, sf):
    docs = common.table(spark, sf, "documents")
    rows = op.op13_middle(spark, sf).join(docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("own")), "doc_id").collect()
    assert len(rows) == docs.count() and all(r.restored_sha256 == r.own for r in rows)
    assert all((r.form == "plain") == (r.prefix_chars is None) and (r.form != "plain" or r.output_sha256 == r.own) for r in rows)
