"""Imports, their closure, and answers by scope against brute force."""

import math
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from lodestone.operators import scopes

FUNCTION = "file_path string, ordinal int, name string, qualified_name string, receiver string"


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


def test_directives_and_the_files_they_mean(spark):
    files = [
        ("./a/b/x.c", "c", '#include "y.h"\n  # include <sys/z.h>\n#include "../c/./w.h"\n#include "y.h"\n// #include "no.h"\n#include <gone.h>'),
        ("./a/b/y.h", "c", '#include "x.c"\n#include "y.h"'),
        ("./lib/sys/z.h", "c", ""),
        ("./kit/sys/z.h", "c", None),
        ("./a/c/w.h", "c", "int x;"),
        ("./src/main.rs", "rust", "mod one;\npub(crate) mod two ;\nmod inline { }\n"),
        ("./src/one.rs", "rust", "mod deep;"),
        ("./src/two/mod.rs", "rust", "mod deep;"),
        ("./src/one/deep.rs", "rust", ""),
        ("./src/two/deep.rs", "rust", ""),
        ("./cmd/m.go", "go", 'package m\nimport "fmt"\nimport (\n\tq "host/proj/util"\n\t"util"\n)\n'),
        ("./proj/util/u.go", "go", 'package util\nimport "cmd"\n'),
        ("./proj/util/v.go", "go", ""),
        ("./plain.txt", None, '#include "a"'),
        (None, "c", '#include "y.h"'),
    ]
    table = spark.createDataFrame(files, "path string, lang string, text string")
    found = scopes.imports(table)
    assert rows(found.filter("file_path like '%x.c'"), "raw") == [("../c/./w.h",), ("gone.h",), ("sys/z.h",), ("y.h",)]
    assert rows(found.filter("lang = 'go'"), "file_path", "raw") == [("./cmd/m.go", "fmt"), ("./cmd/m.go", "host/proj/util"), ("./cmd/m.go", "util"), ("./proj/util/u.go", "cmd")]
    assert rows(scopes.import_edges(found, table), "file_path", "dep") == sorted(
        [
            ("./a/b/x.c", "./a/b/y.h"),
            ("./a/b/x.c", "./a/c/w.h"),
            ("./a/b/x.c", "./kit/sys/z.h"),  # the first by path
            ("./a/b/y.h", "./a/b/x.c"),
            ("./src/main.rs", "./src/one.rs"),
            ("./src/main.rs", "./src/two/mod.rs"),
            ("./src/one.rs", "./src/one/deep.rs"),
            ("./src/two/mod.rs", "./src/two/deep.rs"),
            ("./cmd/m.go", "./proj/util/u.go"),  # by "util": "host/proj/util" ends no directory
            ("./cmd/m.go", "./proj/util/v.go"),
            ("./proj/util/u.go", "./cmd/m.go"),
        ]
    )
    assert not scopes.import_edges(found.limit(0), table).count() and not scopes.import_edges(found, table.limit(0)).count()


def test_paths(spark):
    paths = spark.createDataFrame([("./a/../b//c.h",), ("../x.c",), ("a",), ("",), (None,)], "p string")
    got = paths.select(scopes.normal_path("p"), scopes.ancestors(scopes.normal_path("p")), scopes.suffixes(scopes.normal_path("p")), scopes.directory(scopes.normal_path("p"))).collect()
    assert [tuple(r) for r in got] == [("b/c.h", ["", "b"], ["b/c.h", "c.h"], "b"), ("x.c", [""], ["x.c"], ""), ("a", [""], ["a"], ""), ("", [""], [""], ""), (None, None, None, None)]


def reached(edges):
    """All pairs with their depth, by breadth-first search."""
    out, ways = {}, {}
    for a, b in edges:
        ways.setdefault(a, set()).add(b)
    for start in ways:
        seen, queue = {start: 0}, deque([start])
        while queue:
            a = queue.popleft()
            for b in ways.get(a, ()):
                if b not in seen:
                    seen[b] = seen[a] + 1
                    queue.append(b)
        out |= {(start, b): d for b, d in seen.items() if d}
    return out


@pytest.mark.parametrize("seed", range(3))
def test_closure_against_breadth_first_search(spark, seed):
    rng = random.Random(seed)
    edges = [(f"f{rng.randint(0, 25)}", f"f{rng.randint(0, 25)}") for _ in range(rng.choice([18, 30, 45]))]
    table = spark.createDataFrame([*edges, *edges[:3], (None, "f1"), ("f1", None)], "file_path string, dep string")
    want = reached((a, b) for a, b in edges if a != b)
    assert rows(scopes.include_closure(table), "file_path", "dep", "depth") == sorted(((*k, d) for k, d in want.items()), key=str)
    assert rows(scopes.include_closure(table, 3), "file_path", "dep", "depth") == sorted(((*k, d) for k, d in want.items() if d <= 3), key=str)


def test_a_deep_chain_takes_few_rounds(spark, monkeypatch):
    n, cuts, cut = 300, [], scopes.cut
    monkeypatch.setattr(scopes, "cut", lambda df: cuts.append(1) or cut(df))
    chain = spark.range(n).select(F.format_string("f%d", "id").alias("file_path"), F.format_string("f%d", F.col("id") + 1).alias("dep"))
    got = scopes.include_closure(chain).agg(F.count("*"), F.max("depth")).first()
    assert tuple(got) == (n * (n + 1) // 2, n) and len(cuts) <= 2 + math.ceil(math.log2(n))
    assert not scopes.include_closure(chain.limit(0)).count()


def brute(asked, functions, closure):
    """Each asked text by looking at all definitions."""
    keys, firsts = set(), {}
    for path, ordinal, name, q, receiver in functions:
        parts = q.split(".")
        package = q if len(parts) == 1 else ".".join(parts[:-2] if len(parts) > 2 and parts[-2][:1].isupper() else parts[:-1])
        keys |= {(k, q, path, package) for k in (name, f"{receiver}.{name}" if receiver else name, q)}
        firsts[path] = min(firsts.get(path, (ordinal, q, package)), (ordinal, q, package))
    folders = lambda path: [p for p in path.split("/")[:-1] if p != "."]

    def shared(a, b):
        n = 0
        for x, y in zip(folders(a), folders(b)):
            if x != y:
                break
            n += 1
        return n

    out = set()
    for path, raw in asked:
        if path is None or raw is None:
            out.add((path, raw, "none", None, 0, None if raw is None else f"[external:{raw}]", None, "unresolved"))
            continue
        key = raw if raw.count(".") < 2 else ".".join(raw.split(".")[-2:])
        package = firsts[path][2] if path in firsts else None
        ranked = {}
        for k, q, file, pk in keys:
            if k == key:
                depth = closure.get((path, file))
                place = ("file", 0) if file == path else ("package", 0) if pk == package else ("include", 1) if depth == 1 else ("indirect", depth) if depth else ("elsewhere", -shared(path, file))
                ranked.setdefault((list(scopes.SCOPES).index(place[0]), place[1], place[0]), []).append((q, file))
        kind = {"printf": "libc"}.get(raw, "external")
        best = min(ranked, default=None)
        if kind == "libc" and (best is None or best[2] == "elsewhere"):
            out.add((path, raw, "standard", None, 1, f"[{kind}:{raw}]", None, "medium"))
        elif best is None:
            out.add((path, raw, "none", None, 0, f"[{kind}:{raw}]", None, "unresolved"))
        else:
            found, scope = ranked[best], best[2]
            sure = "low" if len(found) > 1 else "high" if scopes.SCOPES[scope] else "medium"
            out.add((path, raw, scope, best[1] if scope in ("include", "indirect") else None, len(found), *min(found), sure))
    return out


COLUMNS = ["file_path", "raw", "scope", "depth", "n_matches", "target", "target_file", "confidence"]


@pytest.mark.parametrize("seed", range(4))
def test_answers_against_brute_force(spark, seed):
    rng = random.Random(seed)
    paths = [f"./d{rng.randint(0, 2)}/e{rng.randint(0, 2)}/f{i}.c" for i in range(14)]
    names = ["aa", "bb", "cc", "dd", "ee", "printf"]
    functions = []
    for path in paths[:-1]:
        for i in range(rng.randint(0, 4)):
            name, receiver = rng.choice(names), rng.choice([None, None, "T"])
            functions.append((path, i, name, ".".join(filter(None, (f"p{rng.randint(0, 4)}", receiver, name))), receiver))
    closure = reached({(rng.choice(paths), rng.choice(paths)) for _ in range(12)})
    closure = {k: d for k, d in closure.items() if k[0] != k[1]}
    texts = [*names, "T.aa", "T.bb", "p1.aa", "p2.cc", "x.y.T.aa", "a.b.cc", "nothing", ".", ""]
    asked = [(p, t) for p in [*paths, "./lone/z.c"] for t in rng.sample(texts, 9)] + [(None, "aa"), (paths[0], None)]
    f = spark.createDataFrame(functions * 2, FUNCTION)
    c = spark.createDataFrame([(*k, d) for k, d in closure.items()] or [], "file_path string, dep string, depth int")
    got = scopes.answers_scoped(spark.createDataFrame(asked * 2, "file_path string, raw string"), f, c)
    got = {tuple(r) for r in got.select(COLUMNS).collect()}
    want = {x if x[1] is not None else (*x[:5], "[unresolved]", *x[6:]) for x in brute(asked, functions, closure)}
    assert got == want


def test_calls_keep_their_rows_and_columns(spark):
    f = spark.createDataFrame([("./a.c", 0, "go", "a.go", None), ("./b.c", 0, "go", "b.go", None)], FUNCTION)
    calls = spark.createDataFrame([("./a.c", "go", 1, "was"), ("./a.c", "go", 1, "was"), ("./c.c", "go", 2, "was"), (None, None, 3, "was")], "file_path string, raw string, n int, target string")
    none = spark.createDataFrame([], "file_path string, dep string, depth int")
    got = scopes.resolve_scoped(f, calls, none)
    assert rows(got, "n", "target", "confidence") == [(1, "a.go", "high"), (1, "a.go", "high"), (2, "a.go", "low"), (3, "[unresolved]", "unresolved")]
    assert rows(scopes.confidence_rates(got), "scope", "confidence", "n_calls") == [("elsewhere", "low", 1), ("file", "high", 2), ("none", "unresolved", 1)]
    assert rows(scopes.resolve_scoped(f.limit(0), calls, none), "n", "confidence") == [(n, "unresolved") for n in (1, 1, 2, 3)]
    assert not scopes.resolve_scoped(f, calls.limit(0), none).count()


def test_triangle_takes_the_smaller_side(spark):
    """A name that every file defines, asked by files with one include; rare names asked by a file that includes all."""
    n = 2000
    ids = spark.range(n)
    found = F.struct(F.lit("q").alias("target"), F.format_string("f%d", "id").alias("target_file"))
    hot = ids.select(F.lit("hot").alias("key"), F.format_string("f%d", "id").alias("dep"), F.lit(1).cast("long").alias("n"), found.alias("found"))
    rare = ids.select(F.format_string("r%d", "id").alias("key"), F.format_string("f%d", "id").alias("dep"), F.lit(1).cast("long").alias("n"), found.alias("found"))
    ones = ids.select(F.format_string("u%d", "id").alias("file_path"), F.format_string("f%d", "id").alias("dep"), F.lit(1).alias("depth"))
    every = ids.select(F.lit("main").alias("file_path"), F.format_string("f%d", "id").alias("dep"), F.lit(2).alias("depth"))
    asked = ids.select(F.format_string("u%d", "id").alias("file_path"), F.lit("hot").alias("key")).unionByName(ids.select(F.lit("main").alias("file_path"), F.format_string("r%d", "id").alias("key")))
    got = scopes.visible(asked, ones.unionByName(every), hot.unionByName(rare))
    assert got.count() == 2 * n and got.filter("n <> 1").count() == 0
    made = []

    def walk(node):  # the largest number of rows that any join of the run made
        for name, metric in ((m._1(), m._2()) for m in (lambda it: [it.next() for _ in iter(it.hasNext, False)])(node.metrics().iterator())):
            if name == "numOutputRows" and "Join" in node.nodeName():
                made.append(metric.value())
        for source in (node.children().iterator(),):
            while source.hasNext():
                walk(source.next())
        if "AdaptiveSparkPlan" in node.nodeName():
            walk(node.executedPlan())
        if "QueryStage" in node.nodeName():
            walk(node.plan())

    plan = got._jdf.queryExecution().executedPlan()
    got._jdf.queryExecution().toRdd().count()
    walk(plan)
    assert made and max(made) <= 2 * n
