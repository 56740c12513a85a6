"""Stale summaries, the index of usages, and checks of an index."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import checks, invalidation, resolve
from lodestone.schemas import CALL_SITES, FILES, FUNCTIONS, TYPES
from lodestone.sources import usages


def fn(file, name, sig="()", own="h", summary=None, **other):
    row = dict(file_path=f"./{file}.go", ordinal=0, name=name, qualified_name=f"{file}.{name}", ast_hash=own, line_start=1, line_end=2, signature=f"func {name}{sig}", summary=summary, receiver=None, scope="public")
    return tuple((row | other).values())


def call(file, caller, k, target, line=1):
    return (f"./{file}.go", 0, f"{file}.{caller}", k, target.split(".")[-1], line, target)


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


def test_a_signature_reaches_direct_callers_alone(spark):
    chain = [call("a", "A", 0, "b.B"), call("a", "A", 1, "b.B"), call("b", "B", 0, "c.C"), call("c", "C", 0, "[libc:printf]"), call("d", "D", 0, "d.D")]
    calls = spark.createDataFrame(chain, CALL_SITES)
    tree = lambda **c: spark.createDataFrame([fn("a", "A", summary="sa"), fn("b", "B", summary="sb"), fn("c", "C", **({"summary": "sc"} | c)), fn("d", "D", summary="sd"), fn("e", "E", summary="se", own=""), fn("f", "F")], FUNCTIONS)
    stored = invalidation.stamped(tree(), calls)
    now = lambda **c: invalidation.stamps(tree(**c), calls)
    reasons = lambda table: rows(invalidation.stale_reasons(stored, table), "qualified_name", "reason")
    always = [("e.E", "own"), ("f.F", "new")]  # no hash, no summary
    assert reasons(now()) == always
    assert reasons(now(own="h2")) == [("c.C", "own"), *always]
    assert reasons(now(sig="(int)")) == [("b.B", "callees"), *always]
    assert reasons(now(sig="(int)", own="h2")) == [("b.B", "callees"), ("c.C", "own"), *always]
    # another order of calls and repeated ones change nothing, another callee does
    again = spark.createDataFrame([call("a", "A", 5, "b.B"), *chain[2:4], call("d", "D", 0, "c.C")], CALL_SITES)
    assert rows(invalidation.stale_reasons(stored, invalidation.stamps(tree(), again)), "qualified_name", "reason") == [("d.D", "callees"), *always]
    kept = invalidation.keep_summaries(tree(sig="(int)", summary=None), calls, stored)
    assert rows(kept, "qualified_name", "summary") == [("a.A", "sa"), ("b.B", None), ("c.C", "sc"), ("d.D", "sd"), ("e.E", None), ("f.F", None)]
    assert kept.columns == tree().columns


@pytest.mark.parametrize("seed", range(3))
def test_stale_ones_against_sets_of_signatures(spark, seed):
    rng = random.Random(seed)
    version = lambda: [fn(rng.choice("pq"), n, sig=rng.choice(["()", "(x)"]), own=rng.choice("hk"), summary="s", ordinal=i) for i, n in enumerate(rng.choices("abcdefgh", k=9))]
    edges = lambda fs: [call(f[0][2], f[2], k, rng.choice(fs)[3]) for f in fs for k in range(rng.randint(0, 3))]

    def stamp(fs, cs):
        last = {f[3]: f for f in sorted(fs, key=lambda f: (f[0], f[1]))}
        return {q: (f[4], frozenset((c[6], last[c[6]][7]) for c in cs if c[2] == q)) for q, f in last.items()}

    before, after = version(), version()
    one, two = edges(before), edges(after)
    frame = lambda fs, cs: (spark.createDataFrame(fs, FUNCTIONS), spark.createDataFrame(cs, CALL_SITES))
    got = invalidation.stale(invalidation.stamped(*frame(before, one)), invalidation.stamps(*frame(after, two)))
    was, now = stamp(before, one), stamp(after, two)
    assert {r[0] for r in got.collect()} == {q for q in now if was.get(q) != now[q]}
    empty = spark.createDataFrame([], FUNCTIONS), spark.createDataFrame([], CALL_SITES)
    assert not invalidation.stale(invalidation.stamped(*empty), invalidation.stamps(*empty)).count()


def test_usages_of_a_common_name_lie_in_many_files(spark, tmp_path):
    path, n = str(tmp_path / "u"), 20_000
    rare = F.when(F.col("id") % 100 == 0, F.format_string("m.f%d", F.col("id") % 700)).when(F.col("id") % 333 == 0, None)
    calls = spark.range(n).select(
        F.format_string("./f%02d.go", F.col("id") % 40).alias("file_path"),
        F.format_string("m.c%d", F.col("id") % 500).alias("caller"),
        F.col("id").cast("int").alias("ordinal"),
        (F.col("id") % 9).cast("int").alias("line"),
        F.when(F.col("id") % 100 == 0, rare).when(F.col("id") % 333 == 0, rare).otherwise("[libc:printf]").alias("target"),
        F.lit("x").alias("symbol"),
    )
    usages.write_usages(calls, path, range_rows=1000)
    want = lambda t: rows(calls.filter(t), "target", "file_path", "line", "caller", "ordinal")
    got = usages.find_usages(spark, path, ["[libc:printf]"])
    assert rows(got, *usages.ORDER) == want("target = '[libc:printf]'")
    hot = usages.parts_of(spark, path, ["[libc:printf]"])
    assert len(hot) >= 15 and got.rdd.getNumPartitions() > 1
    # a rare name is looked for in few files, and a later file of a common one passes over the earlier
    assert len(usages.parts_of(spark, path, ["m.f100"])) <= 2
    assert rows(usages.find_usages(spark, path, ["m.f100", "m.f0", "none"]), *usages.ORDER) == want("target in ('m.f100', 'm.f0')")
    late = usages.parts_of(spark, path, ["[libc:printf]"], "./f35.go")
    assert len(late) < len(hot) / 2
    assert rows(usages.find_usages(spark, path, ["[libc:printf]"], "./f35.go"), *usages.ORDER) == want("target = '[libc:printf]' and file_path >= './f35.go'")
    counts = calls.filter("target is not null").groupBy("target").agg(F.count("*"), F.countDistinct("caller"), F.countDistinct("file_path"))
    assert rows(usages.usage_counts(spark, path), "symbol", "n_sites", "n_callers", "n_files") == rows(counts, *counts.columns)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(symbol), EqualTo(symbol,[libc:printf])]" in plan or "EqualTo(symbol" in plan


def test_usages_of_an_empty_table(spark, tmp_path):
    path = str(tmp_path / "u")
    usages.write_usages(spark.createDataFrame([], CALL_SITES), path)
    assert not usages.find_usages(spark, path, ["a"]).count() and not usages.usage_counts(spark, path).count() and not usages.find_usages(spark, path, []).count()


def index(spark):
    files = spark.createDataFrame([("./a.go", "go", "h"), ("./a.go", "go", "h"), (None, "go", "h")], FILES)
    functions = [
        fn("a", "A"),
        fn("a", "B", line_start=5, line_end=4),
        fn("a", "C", own="", scope="odd"),
        fn("a", "D", qualified_name="a.DD"),
        fn("b", "E"),
        fn("a", "F", qualified_name=None),
        fn("a", "G", line_end=None),
    ]
    types = [("./a.go", 0, "T", "a.T", "struct", 1, 2, None, []), ("./z.go", 0, "U", "a.U", "trait", 0, 2, None, None)]
    calls = [call("a", "A", 0, "b.E"), call("a", "A", 1, "gone.X"), call("a", "A", 2, "[libc:printf]"), call("a", "A", 3, "[odd:x]"), call("a", "lost", 0, "[unresolved]", 0)]
    return {"files": files, "functions": spark.createDataFrame(functions, FUNCTIONS), "types": spark.createDataFrame(types, TYPES), "call_sites": spark.createDataFrame(calls, CALL_SITES)}


def test_planted_violations_are_found_in_one_job(spark, tmp_path):
    tables = index(spark)
    tracker, group = spark.sparkContext.statusTracker(), "validate"
    # adaptive execution and broadcasts run stages of one query as jobs of their own
    plain = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for key, value in plain.items():
        spark.conf.set(key, value)
    try:
        spark.sparkContext.setJobGroup(group, group)
        got = checks.validate(tables, str(tmp_path / "v"))
        jobs = tracker.getJobIdsForGroup(group)
    finally:
        for key in plain:
            spark.conf.unset(key)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    want = [
        ("call_sites", "caller_exists", "a.lost"),
        ("call_sites", "line_positive", "a.lost"),
        ("call_sites", "target_exists", "a.A"),
        ("call_sites", "target_form", "a.A"),
        ("functions", "file_listed", "b.E"),
        ("functions", "hash_present", "a.C"),
        ("functions", "lines_in_order", "a.B"),
        ("functions", "lines_in_order", "a.G"),
        ("functions", "name_ends_qualified_name", "a.DD"),
        ("functions", "name_ends_qualified_name", None),
        ("functions", "scope_known", "a.C"),
        ("types", "file_listed", "a.U"),
        ("types", "kind_known", "a.U"),
        ("types", "lines_in_order", "a.U"),
    ]
    assert rows(got.violations(spark), "table_name", "rule", "item") == sorted(want, key=str)
    assert got.n_rows == {"functions": 7, "types": 2, "call_sites": 5} and not got.valid
    counts = {}
    for table, rule, _ in want:
        counts[table, rule] = counts.get((table, rule), 0) + 1
    assert {k: n for k, n in got.broken.items() if n} == counts
    assert len(jobs) == 1


def test_whole_and_empty_indexes(spark, tmp_path):
    tables = index(spark)
    good = {"files": tables["files"], "functions": tables["functions"].filter("name = 'A'"), "call_sites": tables["call_sites"].filter("ordinal = 2")}
    assert checks.validate(good, str(tmp_path / "g")).valid
    empty = checks.validate({n: df.limit(0) for n, df in tables.items()}, str(tmp_path / "e"))
    assert empty.valid and set(empty.n_rows.values()) == {0} and not empty.violations(spark).count()
    assert rows(checks.stale_files(tables["files"].filter("path is not null").distinct(), spark.createDataFrame([("./a.go", "go", "k"), ("./n.go", "go", "h")], FILES)), "file_path", "change") == [("./a.go", "modified"), ("./n.go", "added")]
