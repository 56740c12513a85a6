"""An updated index against one that is built anew."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import graph, resolve, update
from lodestone.schemas import CALL_SITES, FUNCTIONS


def tree(rng, files, names):
    """A tree of files with functions and calls: path to (functions, calls)."""
    return {f"./p{f}.go": version(rng, f, names) for f in range(files)}


def version(rng, f, names):
    path, functions, calls = f"./p{f}.go", [], []
    for i in range(rng.randint(0, 4)):
        name, receiver = rng.choice(names), rng.choice([None, None, "T", "U"])
        q = ".".join(filter(None, (f"p{f % 4}", receiver, name)))
        functions.append((path, i, name, q, f"h{rng.randint(0, 3)}", 1, 2, f"func {name}({rng.choice(['', 'x'])})", None, receiver, "public"))
        for k in range(rng.randint(0, 5)):
            raw = rng.choice([rng.choice(names), f"p{rng.randint(0, 3)}.{rng.choice(names)}", f"T.{rng.choice(names)}", f"a.b.{rng.choice(names)}", "printf"])
            calls.append((path, i, q, k, raw, k, "[unresolved]"))
    return functions, calls


def frames(spark, versions):
    fs, cs = ([x for v in versions for x in v[i]] for i in (0, 1))
    return spark.createDataFrame(fs, FUNCTIONS), spark.createDataFrame(cs, CALL_SITES)


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


@pytest.mark.parametrize("seed", range(4))
def test_random_edits_equal_a_rebuild(spark, seed):
    rng, names = random.Random(seed), list("abcdefg")
    before = tree(rng, 9, names)
    after = dict(before)
    for f in rng.sample(range(11), 4):  # some of them new
        after[f"./p{f}.go"] = version(rng, f, names)
    if gone := rng.choice([None, *list(before)]):
        after.pop(gone, None)
    changed = sorted(p for p in before.keys() | after.keys() if before.get(p) != after.get(p))
    old = update.build(*frames(spark, before.values()))
    files = spark.createDataFrame([(p,) for p in changed], "file_path string")
    got = update.update(old, files, *frames(spark, [after[p] for p in changed if p in after]))
    functions, calls = frames(spark, after.values())
    want = resolve.resolve_calls(functions, calls)
    columns = ["file_path", "caller_ordinal", "caller", "ordinal", "raw", "line", "target", "rule"]
    assert rows(got.snapshot.calls, *columns) == rows(want, *columns)
    assert rows(got.snapshot.symbols, "kind", "name", "qualified_name", "n") == rows(resolve.symbol_counts(functions), "kind", "name", "qualified_name", "n")
    assert rows(got.snapshot.functions, "file_path", "ordinal", "ast_hash") == rows(functions, "file_path", "ordinal", "ast_hash")
    a, b = ({tuple(r) for r in graph.call_edges(x).collect()} for x in (old.calls, want))
    assert {(r.src, r.dst, r.change) for r in got.edges.collect()} == {(*e, "gained") for e in b - a} | {(*e, "lost") for e in a - b}
    bag = lambda version_: {q: sorted((f[7], f[4]) for v in version_.values() for f in v[0] if f[3] == q) for q in {f[3] for v in version_.values() for f in v[0]}}
    was, now = bag(before), bag(after)
    diff = {(q, "added" if q not in was else "removed" if q not in now else "modified") for q in was.keys() | now.keys() if was.get(q) != now.get(q)}
    assert {(r.qualified_name, r.change) for r in got.symbols.collect()} == diff


def test_only_calls_of_changed_answers_are_probed_again(spark):
    fn = lambda f, name: (f"./{f}.go", 0, name, f"{f}.{name}", "h", 1, 2, f"func {name}()", None, None, "public")
    call = lambda f, caller, k, raw: (f"./{f}.go", 0, f"{f}.{caller}", k, raw, k, "[unresolved]")
    old = update.build(*frames(spark, [([fn("a", "A"), fn("b", "B"), fn("c", "C")], [call("a", "A", 0, "B"), call("a", "A", 1, "C"), call("a", "A", 2, "printf"), call("c", "C", 0, "New")])]))
    files = spark.createDataFrame([("./b.go",)], "file_path string")
    got = update.update(old, files, *frames(spark, [([fn("b", "New")], [call("b", "New", 0, "C")])]))
    assert rows(got.probed, "caller", "raw") == [("a.A", "B"), ("c.C", "New")]
    assert rows(got.snapshot.calls, "caller", "raw", "target") == [("a.A", "B", "[macro:B]"), ("a.A", "C", "c.C"), ("a.A", "printf", "[libc:printf]"), ("b.New", "C", "c.C"), ("c.C", "New", "b.New")]
    assert rows(got.edges, "src", "dst", "change") == [("a.A", "b.B", "lost"), ("b.New", "c.C", "gained"), ("c.C", "b.New", "gained")]
    # nothing changed, everything gone
    same = update.update(old, files.limit(0), *frames(spark, [([], [])]))
    assert rows(same.snapshot.calls, "caller", "raw", "target") == rows(old.calls, "caller", "raw", "target") and not same.edges.count() and not same.symbols.count()
    every = update.update(old, old.functions.select("file_path"), *frames(spark, [([], [])]))
    assert not every.snapshot.calls.count() and not every.snapshot.symbols.count() and every.symbols.filter("change = 'removed'").count() == 3


def test_changed_files(spark):
    table = lambda x: spark.createDataFrame(x, "path string, ast_hash string")
    got = update.changed_files(table([("a", "1"), ("b", "1"), ("c", "1"), ("e", None)]), table([("b", "1"), ("c", "2"), ("d", "1"), ("e", None)]))
    assert rows(got, "file_path", "change") == [("a", "removed"), ("c", "modified"), ("d", "added")]


def test_kept_calls_are_not_shuffled_for_a_few_changes(spark):
    n = 3000
    functions = spark.range(n).select(F.concat(F.lit("./f"), "id", F.lit(".go")).alias("file_path"), F.lit(0).alias("ordinal"), F.concat(F.lit("s"), "id").alias("name"), F.concat(F.lit("f"), "id", F.lit(".s"), "id").alias("qualified_name"), F.lit("h").alias("ast_hash"), F.lit(1).alias("line_start"), F.lit(2).alias("line_end"), F.lit("x").alias("signature"), F.lit(None).cast("string").alias("summary"), F.lit(None).cast("string").alias("receiver"), F.lit("public").alias("scope"))
    calls = functions.select("file_path", F.col("ordinal").alias("caller_ordinal"), F.col("qualified_name").alias("caller"), F.lit(0).alias("ordinal"), F.lit("s5").alias("raw"), F.lit(1).alias("line"), F.lit("[unresolved]").alias("target"))
    old = update.build(functions, calls)
    got = update.update(old, spark.createDataFrame([("./f7.go",)], "file_path string"), functions.filter("file_path = './f7.go'"), calls.limit(0))
    assert not got.probed.count() and got.snapshot.calls.count() == n - 1
    plan = got.snapshot.calls._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") >= 2
