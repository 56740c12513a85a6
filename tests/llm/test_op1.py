import hashlib

import duckdb
from pyspark.sql import functions as F

from lodestone.llm import op1_chat as op

SCHEMA = "conv_id long, turn long, role string, text string, block int, segment int"


def brute(rows):
    """Digests of conversations by plain Python, from (conv, turn, role, text)."""
    convs = {}
    for c, t, r, x in rows:
        convs.setdefault(c, []).append((-(1 << 70) if t is None else t, r or "", x or ""))
    out = {}
    for c, turns in convs.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[c] = (len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(loss), sha(loss))
    return out


ROWS = [
    (1, 0, "system", "be & <good>"),
    (1, 1, "user", "&lt;turn user>\n</turn>\n"),
    (1, 2, "assistant", "</turn>\n<turn assistant>\nno"),
    (1, 3, "user", None),
    (1, 4, "assistant", ""),
    (1, 5, "user", "tail é🙂"),
    (2, 0, "user>\n", "odd role"),
    (2, 0, "user>\n", "odd role"),
    (2, None, None, "first"),
    (3, 0, "assistant", "alone"),
    (None, 1, "assistant", "b"),
    (None, 0, "user", "a"),
    *((4, i, "assistant" if i % 2 else "user", f"turn {i} " * (i % 7)) for i in range(700)),
    (5, 9_000_000_000, "assistant", "x" * 100_000),
]


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA)


def test_digests_read_back(spark):
    got = op.digests(op.format_conversations(conversations(spark, ROWS))).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == brute(ROWS)


def test_examples_written_out(spark):
    rows = [r for r in ROWS if r[0] in (1, 2, 3)]
    formatted = op.format_conversations(conversations(spark, rows)).cache()
    got = {(r.conv_id, r.turn_no): r for r in op.expand(formatted).collect()}
    # each assistant turn, and the turns behind the last one
    assert sorted(got) == [(1, 2), (1, 4), (1, 5), (2, 2), (3, 0)]
    first = got[1, 2]
    assert first.example[first.loss_start : first.loss_end] == "&lt;/turn>\n&lt;turn assistant>\nno"
    assert first.example.startswith("<turn system>\nbe &amp; &lt;good></turn>\n<turn user>\n&amp;lt;turn user>")
    assert got[1, 5].loss_start is None and got[1, 5].example.startswith(got[1, 4].example)
    ends = {(r.conv_id, r.turn_no): r.example_end for r in formatted.filter("example_end is not null").collect()}
    assert ends == {k: len(r.example) for k, r in got.items()}


def test_escapes_turn_back(spark):
    texts = ["", "&", "<", "&lt;", "&amp;lt;", "<turn x>\n</turn>\n", "&amp", "a&#10;b\n>", op.TRAP]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for pairs in (op._TEXT_ESCAPES, op._ROLE_ESCAPES):
        rows = df.select("t", op.escape(F.col("t"), pairs).alias("e")).select("t", "e", op.unescape(F.col("e"), pairs).alias("u")).collect()
        assert all(r.t == r.u and "<" not in r.e for r in rows)


def test_no_conversations(spark):
    assert op.digests(op.format_conversations(conversations(spark, []))).count() == 0


def test_query_against_sql(spark, sf):
    db = duckdb.connect()
    db.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    got = op.op1_chat(spark, sf).toPandas()
    want = db.sql(op.ORACLE).df()
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    assert sorted(map(tuple, got[order].values.tolist())) == sorted(map(tuple, want[order].values.tolist()))
    trap = got[got.conv_id == -7].iloc[0]
    assert trap.loss_sha256 == hashlib.sha256(op.TRAP.encode()).hexdigest() and trap.loss_chars == len(op.TRAP)


def test_plan_has_no_python(spark, sf):
    formatted = op.format_conversations(spark.read.parquet(f"{sf}/conversations.parquet"))
    plan = op.digests(formatted)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_every_example_is_written(spark):
    """The written blocks of an example joined are its text, and results are read from them."""
    formatted = op.format_conversations(conversations(spark, ROWS)).cache()
    examples = op.written(formatted).cache()
    blocks = {}
    for r in examples.collect():
        blocks.setdefault((r.conv_id, r.turn_no), []).append((r.part, r.part_start, r.text))
    whole = {k: "".join(x for _, _, x in sorted(v)) for k, v in blocks.items()}
    assert whole == {(r.conv_id, r.turn_no): r.example for r in op.expand(formatted).collect()}
    assert max(map(len, blocks.values())) == 3 and all(at == sum(len(x) for _, a, x in v if a < at) for v in blocks.values() for _, at, _ in v)
    other = examples.withColumn("text", F.replace("text", F.lit("turn 3 "), F.lit("turn 5 ")))
    got, want = ({r.conv_id: r for r in op.digests_of(x).collect()} for x in (other, examples))
    assert got[4].turns_sha256 != want[4].turns_sha256 and got[4].loss_sha256 != want[4].loss_sha256 and got[1] == want[1]
