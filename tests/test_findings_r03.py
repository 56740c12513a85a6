"""Small cases of what the review of round 3 found."""

import re

import numpy as np
from pyspark.sql import functions as F

from lodestone import session
from lodestone.operators import scopes, trace, update, vectors
from lodestone.plans import fixtures, queries
from lodestone.session import cut
from lodestone.sources import usages
from lodestone.sources.extract import lex, rust


def test_estimates_of_loops_stay_small(spark, capsys):
    """A loop of joins: Spark's estimate of a cut table is its size, not a product of products."""
    pointers = spark.range(50).select(F.col("id").alias("node"), (F.col("id") + 1).alias("next"))
    for _ in range(5):
        ahead = pointers.select(F.col("node").alias("next"), F.col("next").alias("then"))
        pointers = cut(pointers.join(ahead, "next").select("node", F.col("then").alias("next")))
    capsys.readouterr()
    pointers.explain("cost")
    estimate = re.search(r"sizeInBytes=([0-9.E+]+) (\w+)", capsys.readouterr().out)
    assert float(estimate[1]) < 1e4 and estimate[2] in ("B", "KiB")
    assert pointers.count() == 50 - 31


def test_cycles_are_counted_by_edge(spark):
    """The rows of a whole trace, at calls whose ways can't be written out one by one."""
    function = "qualified_name string, file_path string, ordinal int, line_start int, line_end int"
    functions = spark.createDataFrame([(q, f"./{i}.go", i, 1, 2) for i, q in enumerate("abcc")], function)
    edges = {("a", "b"): 3, ("b", "a"): 2, ("b", "c"): 2, ("c", "a"): 1, ("a", "a"): 2, ("c", "x"): 5, ("c", "[libc:close]"): 4}
    calls = [(s, i, d, d) for (s, d), n in edges.items() for i in range(n)]
    resolved = spark.createDataFrame(calls, "caller string, ordinal int, raw string, target string")
    for depth in (1, 2, 3, 0):
        rows = trace.trace_forward(functions, resolved, functions, depth).filter("row_kind = 'cycle'")
        want = {(r.root, r.node): r["count"] for r in rows.groupBy("root", "node").count().collect()}
        assert {(r.root, r.node): r.n for r in trace.cycle_counts(functions, resolved, functions, depth).collect()} == want
    many = spark.range(60_000).select(F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("caller"), F.col("id").cast("int").alias("ordinal"), F.lit("").alias("raw"), F.when(F.col("id") % 2 == 0, "b").otherwise("a").alias("target"))
    got = trace.cycle_counts(functions, many, functions.filter("qualified_name = 'a'"), 2).collect()
    assert [tuple(r) for r in got] == [("a", "a", 30_000**2)]


def test_what_has_no_text_has_no_target(spark, tmp_path, sf):
    """A call of the name of a file that has no functions: null in the SQL."""
    for name in ("nation", "lineitem", "customer"):
        spark.read.parquet(f"{sf}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    spark.read.parquet(f"{sf}/orders.parquet").filter("o_custkey % 3 <> 0").write.parquet(f"{tmp_path}/orders.parquet")
    rows = queries.resolve_scoped(spark, str(tmp_path))
    assert rows.filter("raw IS NULL").count() and not rows.filter("(raw IS NULL) <> (target IS NULL)").count()


def test_reading_rust_grows_with_the_text(monkeypatch):
    """Twice as many functions with a return type take twice the steps."""
    steps, is_ = [0], lex.Code.is_

    def counted(self, *args):
        steps[0] += 1
        return is_(self, *args)

    monkeypatch.setattr(lex.Code, "is_", counted)
    taken = []
    for n in (100, 200):
        steps[0] = 0
        found = rust.parse("".join(f"fn s{i}<T>() -> Vec<T> {{ go({i}) }}\n" for i in range(n)), "src/a.rs")
        assert len(found.functions) == n and found.functions[-1].signature == f"fn s{n - 1}() -> Vec<T>"
        taken.append(steps[0])
    assert taken[1] < 2.2 * taken[0]


def test_products_of_vectors_are_made_in_parts(monkeypatch):
    """Many queries against a batch of rows: equal rows, and no product above the bound."""
    rng = np.random.default_rng(5)
    rows = rng.normal(size=(500, 8))
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    ids, sizes, add, found = np.arange(500), [], vectors.Heap.add, []

    def counted(self, which, products, own):
        sizes.append(products.size)
        add(self, which, products, own)

    monkeypatch.setattr(vectors.Heap, "add", counted)
    for cells in (1 << 30, 3000):
        monkeypatch.setattr(vectors, "CELLS", cells)
        sizes.clear()
        heap = vectors.Heap(ids[:100], 10)
        heap.scan(np.arange(100), rows[:100], rows, ids)
        found.append(heap.batch().to_pydict())
    assert max(sizes) <= 3000 and found[0] == found[1]


def test_rounds_of_a_closure_shuffle_numbers(spark, monkeypatch):
    """No path is written in a round, a round has tasks for its rows, and answers by number are those by path."""
    written, tasks, cut_ = [], [], scopes.cut

    def recorded(df):
        written.append({f.dataType.simpleString() for f in df.schema})
        tasks.append(int(spark.conf.get("spark.sql.shuffle.partitions")))
        return cut_(df)

    monkeypatch.setattr(scopes, "cut", recorded)
    monkeypatch.setattr(session, "TASK_ROWS", 50)
    n = spark.conf.get("spark.sql.shuffle.partitions")
    name = lambda c: F.format_string("./d%d/f%d.c", F.col(c) % 3, c)
    edges = spark.range(60).select("id", F.explode(F.array(F.expr("id div 2"), F.expr("id div 3"))).alias("to")).select(name("id").alias("file_path"), name("to").alias("dep"))
    closure = cut_(scopes.include_closure(edges))
    assert set().union(*written) == {"bigint", "int"} and max(tasks) > int(n) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    nodes, numbers = scopes.numbered_closure(edges)
    functions = spark.range(60).select(name("id").alias("file_path"), F.col("id").cast("int").alias("ordinal"), F.format_string("g%d", F.col("id") % 20).alias("name"), F.format_string("p%d.g%d", "id", F.col("id") % 20).alias("qualified_name"), F.lit(None).cast("string").alias("receiver"))
    asked = spark.range(60).select(name("id").alias("file_path"), F.explode(F.array(*(F.format_string("g%d", (F.col("id") + k) % 25) for k in (1, 4, 9)))).alias("raw"))
    plain = {tuple(r) for r in scopes.answers_scoped(asked, functions, closure).collect()}
    assert {tuple(r) for r in scopes.answers_scoped(asked, functions, numbers, nodes).collect()} == plain
    assert {"include", "indirect", "elsewhere", "none"} <= {r[2] for r in plain}


def test_update_reads_and_makes_what_is_asked_for(spark, monkeypatch):
    """Calls of unchanged files go before the shuffle that numbers calls; edges and differences aren't made for counts."""
    calls = fixtures.call_sites(spark, "/root/testdata/sf0.001", True)
    plan = calls.filter(F.col("file_path").rlike(fixtures.CHANGED))._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and "RLIKE" not in plan[: plan.index("Window")] and "RLIKE" in plan
    assert "RLIKE" in plan[plan.index("Window") :]
    written, cut_ = [], update.cut
    monkeypatch.setattr(update, "cut", lambda df: written.append(df.columns) or cut_(df))
    queries.update_symbols(spark, "/root/testdata/sf0.001").collect()
    made = len(written)
    assert made == 5 and ["src", "dst", "was", "is"] not in written
    queries.update_calls(spark, "/root/testdata/sf0.001").collect()
    assert len(written) > made + 5 and ["src", "dst", "was", "is"] not in written


def test_usages_resolve_once(spark, tmp_path):
    """The resolved calls are made once, though they are counted, sampled and dealt out."""
    met = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def symbol(i):
        met.add(1)
        return f"s{i % 7}" if i % 5 else None

    number = F.col("id").cast("int")
    calls = spark.range(300).select(symbol.asNondeterministic()("id").alias("target"), F.lit("a").alias("file_path"), number.alias("line"), F.lit("c").alias("caller"), number.alias("ordinal"))
    usages.write_usages(calls, str(tmp_path / "u"), range_rows=50)
    assert met.value == 300
    assert sum(r.n_sites for r in usages.usage_counts(spark, str(tmp_path / "u")).collect()) == 240
