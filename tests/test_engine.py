"""Resolution, graph, traces, search and summaries on small relations."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions import externals as ext
from lodestone.functions.names import line_slice, package_of
from lodestone.operators import graph, resolve, search, summarize, trace
from lodestone.schemas import CALL_SITES, FUNCTIONS, TYPES, VARIABLES


def functions(spark, rows):
    """Rows of (file, qualified name, name, receiver)."""
    full = [(f, i, n, q, f"h{i}", 10 * i + 1, 10 * i + 5, f"func {n}()", None, r, "public") for i, (f, q, n, r) in enumerate(rows)]
    return spark.createDataFrame(full, FUNCTIONS)


def sites(spark, rows):
    """Rows of (file, caller, raw[, target])."""
    full = [(r[0], 0, r[1], i, r[2], i + 1, r[3] if len(r) > 3 else "[unresolved]") for i, r in enumerate(rows)]
    return spark.createDataFrame(full, CALL_SITES)


def graph_of(spark, edges, names=None):
    nodes = spark.createDataFrame([(n,) for n in sorted(names or {x for e in edges for x in e})], "qualified_name string")
    return nodes, spark.createDataFrame(edges, "src string, dst string")


def test_packages(spark):
    rows = [("a/b.Run", "a/b"), ("main.Foo", "main"), ("pkg.Type.Method", "pkg"), ("pkg.low.x", "pkg.low"), ("geo::P::new", "geo::P::new"), ("a.Éa.x", "a"), (".x", ""), ("T.x", "T")]
    df = spark.createDataFrame(rows, "q string, want string").select("q", "want", package_of("q").alias("got"))
    assert [r for r in df.collect() if r.want != r.got] == []


def test_resolution_ladder(spark):
    fs = functions(spark, [("./a.go", "a.F", "F", None), ("./a.go", "a.T.M", "M", "T"), ("./b.go", "b.G", "G", None), ("./b.go", "b.Dup", "Dup", None), ("./c.go", "c.Dup", "Dup", None)])
    raws = ["F", "G", "Dup", "b.G", "T.M", "x.y.T.M", "x.G", "printf", "sys_read", "NULL", "a.q.z", "pr_info"]
    got = {r.raw: r.target for r in resolve.resolve_calls(fs, sites(spark, [("./a.go", "a.F", x) for x in raws])).collect()}
    assert got == {
        "F": "a.F",
        "G": "b.G",
        "Dup": "[external:Dup]",
        "b.G": "b.G",
        "T.M": "a.T.M",
        "x.y.T.M": "a.T.M",
        "x.G": "[external:x.G]",
        "printf": "[libc:printf]",
        "sys_read": "[syscall:sys_read]",
        "NULL": "[macro:NULL]",
        "a.q.z": "[external:a.q.z]",
        "pr_info": "[macro:pr_info]",
    }


def test_ambiguity_counts_definitions(spark):
    fs = functions(spark, [("./a.go", "a.F", "F", None), ("./b.go", "a.F", "F", None)])
    assert [(r.key, r.n) for r in resolve.ambiguous_keys(fs).collect()] == [("F", 2)]
    assert [r.n for r in resolve.duplicate_definitions(fs).collect()] == [2]
    assert resolve.definitions(fs).first().file_path == "./b.go"


def test_every_call_is_a_function_or_an_external(spark):
    fs = functions(spark, [("./a.go", "a.F", "F", None), ("./a.go", "a.G", "G", None)])
    done = resolve.resolve_calls(fs, sites(spark, [("./a.go", "a.F", x) for x in ("G", "G", "open", "open", "zz")]))
    stats = resolve.call_stats(done).first()
    outside = resolve.externals(done).collect()
    assert (stats.n_calls, stats.n_resolved) == (5, 2)
    assert stats.n_resolved + sum(r.references for r in outside) == stats.n_calls
    assert {r.name: r.kind for r in outside} == {"open": "syscall", "zz": "external"}
    assert stats.resolved_pct_compat == 100 and stats.resolution_rate == 40
    assert {r.qualified_name: r.called_by for r in resolve.called_by(fs, done).collect()} == {"a.F": [], "a.G": ["a.F"]}


def test_stats_of_nothing(spark):
    stats = resolve.call_stats(spark.createDataFrame([], CALL_SITES)).first()
    assert (stats.n_calls, stats.resolution_rate, stats.resolved_pct_compat) == (0, 100, 100)


def test_external_kinds(spark):
    rows = [("sys_openat", "syscall"), ("openat", "syscall"), ("strlen", "libc"), ("__assert_fail", "libc"), ("ALL_CAPS_1", "macro"), ("list_add", "macro"), ("__x", "macro"), ("foo", "external"), ("", "external")]
    got = ext.categorized(spark.createDataFrame(rows, "raw string, want string")).collect()
    assert [r for r in got if r.kind != r.want] == []
    known = ext.external_rows()
    assert len(known) == len({n for n, *_ in known}) == 370 and all(s for *_, s in known)


def tarjan(nodes, edges):
    """Components by a plain depth-first search."""
    out, index, low, stack, number = {}, {}, {}, [], [0]
    follow = {n: sorted(d for s, d in edges if s == n) for n in nodes}

    def visit(v):
        index[v] = low[v] = number[0]
        number[0] += 1
        stack.append(v)
        for w in follow[v]:
            if w not in index:
                visit(w)
                low[v] = min(low[v], low[w])
            elif w in stack:
                low[v] = min(low[v], index[w])
        if low[v] == index[v]:
            part = []
            while True:
                part.append(stack.pop())
                if part[-1] == v:
                    break
            out.update(dict.fromkeys(part, min(part)))

    for n in nodes:
        if n not in index:
            visit(n)
    return out


def levels_of(nodes, edges, scc):
    level = {}

    def get(c):
        if c not in level:
            level[c] = 0
            level[c] = max([get(scc[d]) + 1 for s, d in edges if scc[s] == c and scc[d] != c], default=0)
        return level[c]

    return {n: get(scc[n]) for n in nodes}


GRAPHS = [
    [("d", "b"), ("d", "c"), ("b", "a"), ("c", "a")],
    [("a", "b"), ("b", "c"), ("c", "d")],
    [("a", "b"), ("b", "a")],
    [("a", "b"), ("b", "a"), ("b", "c"), ("z", "y"), ("y", "x"), ("x", "w")],
    [("a", "a"), ("b", "a")],
    [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("f", "a"), ("e", "g")],
]


@pytest.mark.parametrize("edges", GRAPHS)
def test_rank(spark, edges):
    nodes, df = graph_of(spark, edges)
    names = [r[0] for r in nodes.collect()]
    scc = tarjan(names, edges)
    want = levels_of(names, edges, scc)
    got = graph.rank(nodes, df).collect()
    assert {r.qualified_name: r.scc_id for r in got} == scc
    assert {r.qualified_name: r.level for r in got} == want


def test_rank_of_random_graph(spark):
    rng = random.Random(4)
    names = [f"n{i:02}" for i in range(30)]
    edges = sorted({(rng.choice(names), rng.choice(names)) for _ in range(45)})
    nodes, df = graph_of(spark, edges, names)
    scc = tarjan(names, edges)
    want = levels_of(names, edges, scc)
    first = {r.qualified_name: (r.scc_id, r.level) for r in graph.rank(nodes, df).collect()}
    assert first == {n: (scc[n], want[n]) for n in names}
    assert all(first[s][1] > first[d][1] for s, d in edges if scc[s] != scc[d])


def test_rank_leaves_out_unknown_and_takes_nothing(spark):
    nodes, df = graph_of(spark, [("a", "zz"), ("a", "b")], ["a", "b"])
    assert {r.qualified_name: r.level for r in graph.rank(nodes, df).collect()} == {"a": 1, "b": 0}
    empty = spark.createDataFrame([], "qualified_name string")
    assert graph.rank(empty, df).count() == 0
    assert graph.reverse_edges(nodes, df).collect() == [("b", "a")]


@pytest.fixture
def traced(spark):
    fs = functions(spark, [("./a.go", "a.F", "F", None), ("./a.go", "a.G", "G", None), ("./a.go", "a.H", "H", None)])
    calls = sites(
        spark,
        [("./a.go", "a.F", "G", "a.G"), ("./a.go", "a.F", "G", "a.G"), ("./a.go", "a.F", "open", "[syscall:open]"), ("./a.go", "a.G", "F", "a.F"), ("./a.go", "a.G", "open", "[syscall:open]"), ("./a.go", "a.H", "F", "a.F"), ("./a.go", "a.H", "q", "[unresolved]")],
    )
    return fs, calls


def test_trace_forward(traced):
    fs, calls = traced
    said = ' : "system call open (file operations)"'
    lines = [r.line_text for r in trace.trace_forward(fs, calls, fs.filter("name = 'F'"), 2).orderBy("sort_path").collect()]
    assert lines == [
        "[0] a.F (./a.go:1-5)",
        "[1] - a.G (./a.go:11-15)",
        "[2] -- [cycle] a.F",
        "[2] -- [external] [syscall:open]" + said,
        "[1] - a.G (./a.go:11-15)",
        "[2] -- [cycle] a.F",
        "[2] -- [external] [syscall:open]",
        "[1] - [external] [syscall:open]",
    ]
    top = trace.trace_forward(fs, calls, fs.filter("name = 'H'"), 1).orderBy("sort_path").collect()
    assert [r.row_kind for r in top] == ["function", "function", "unresolved"]
    assert trace.trace_forward(fs, calls, fs.filter("name = 'H'"), 0).count() == 10


def test_trace_backward(traced):
    fs, calls = traced
    lines = [r.line_text for r in trace.trace_backward(fs, calls, fs.filter("name = 'G'"), 0).orderBy("sort_path").collect()]
    assert lines == ["a.G (./a.go:11-15)", "  └── a.F (./a.go:1-5)", "      ├── [cycle] a.G", "      └── a.H (./a.go:21-25)"]


def test_search(spark):
    fs = functions(spark, [("./a.go", "a.Run", "Run", None), ("./a.go", "a.T.Runner", "Runner", "T")])
    types = spark.createDataFrame([("./a.go", 0, "Run", "a.Run", "struct", 1, 2, None, [])], TYPES)
    variables = spark.createDataFrame([("./x.c", 0, "run", "x.run", "int", 3, 3, "public")], VARIABLES)
    assert {(r.qualified_name, r.match_rank) for r in search.find_functions(fs, "Run").collect()} == {("a.Run", 1), ("a.T.Runner", 2)}
    assert search.find_functions(fs, "").count() == 2
    found = search.find_symbols(fs, types, variables, "un")
    assert sorted(r.kind for r in found.collect()) == ["function", "function", "struct", "variable"]
    assert search.find_symbols(fs, types, variables, "un", "variable").count() == 1
    with pytest.raises(ValueError, match="unknown kind 'class'"):
        search.find_symbols(fs, types, variables, "un", "class")


@pytest.mark.parametrize(
    ("text", "start", "end", "want"), [("a\nb\nc\n", 1, 2, "a\nb"), ("a\r\nb\r\nc", 2, 9, "b\nc"), ("a", 2, 3, ""), ("", 1, 1, ""), ("a\n\n", 2, 2, ""), ("a\nb", 0, 1, "a")]
)
def test_line_slices(spark, text, start, end, want):
    assert spark.createDataFrame([(text,)], "t string").select(line_slice("t", F.lit(start), F.lit(end))).first()[0] == want


def test_carry_over_goes_by_hash_alone(spark):
    old = functions(spark, [("./a.go", "a.F", "F", None), ("./a.go", "a.G", "G", None)]).withColumn("summary", F.concat(F.lit("did "), "name"))
    new = functions(spark, [("./z.go", "z.Moved", "Moved", None)]).unionByName(functions(spark, [("./y.go", "y.New", "New", None)]).withColumn("ast_hash", F.lit("other")))
    new = new.unionByName(functions(spark, [("./x.go", "x.E", "E", None)]).withColumn("ast_hash", F.lit("")))
    got = {r.name: r.summary for r in summarize.preserve_summaries(new, old.unionByName(old.withColumn("ast_hash", F.lit("")))).collect()}
    assert got == {"Moved": "did F", "New": None, "E": None}


def test_prompts_and_answers():
    one = summarize.single_prompt("func F()", "x", [{"name": "g", "summary": "gets"}])
    assert '- g(): "gets"' in one and "Function: func F()\nBody:\nx" in one
    assert "It calls" not in summarize.single_prompt("func F()", "x", [])
    many = summarize.batch_prompt([{"signature": "a", "body": "b", "callee_context": []}] * 2)
    assert "=== Function 1 ===" in many and "=== Function 2 ===" in many
    assert summarize.parse_batch_response(3, "[1]: one \nx\n[3]:three\n[1]: late") == [("one", True), ("(failed to parse summary for function 2)", False), ("three", True)]


def test_summaries_go_up_the_levels(spark):
    fs = functions(spark, [("./a.go", "a.F", "F", None), ("./a.go", "a.G", "G", None), ("./a.go", "a.H", "H", None)])
    calls = sites(spark, [("./a.go", "a.F", "G", "a.G"), ("./a.go", "a.G", "H", "a.H")])
    sources = spark.createDataFrame([("./a.go", "go", "\n".join(f"line {i}" for i in range(1, 40)))], "path string, lang string, text string")
    ranks = graph.rank(fs.select("qualified_name"), graph.call_edges(calls))

    def say(prompt: str) -> str:
        if "func H" in prompt:
            raise RuntimeError("no answer")
        known = [x for x in prompt.split("\n") if x.startswith("- ")]
        return f"knows {len(known)}"

    done = {r.name: r.summary for r in summarize.summarize(fs, calls, sources, ranks, say).collect()}
    assert done == {"F": "knows 1", "G": "knows 0", "H": None}


def test_batches(spark):
    rows = spark.createDataFrame([(f"f{i}",) for i in range(95)], "qualified_name string")
    got = summarize.numbered(rows, 10, 3).collect()
    assert len({(r.batch, r.position) for r in got}) == 95
    assert max(r.position for r in got) == 10 and min(r.position for r in got) == 1
