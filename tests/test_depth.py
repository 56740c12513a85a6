"""Components and levels of deep graphs, relevance, budgets and vector search."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import graph, relevance, vectors


def brute(nodes, edges):
    """(component, level) of every node by plain reachability."""
    out = {n: {b for a, b in edges if a == n and b in nodes and b != n} for n in nodes}
    reach = {}
    for n in nodes:
        seen, todo = {n}, [n]
        while todo:
            for x in out[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        reach[n] = seen
    comp = {n: min(m for m in reach[n] if n in reach[m]) for n in nodes}
    level, left = {}, set(comp.values())
    while left:
        for c in sorted(left):
            below = {comp[x] for n in nodes if comp[n] == c for x in out[n]} - {c}
            if below <= level.keys():
                level[c] = 1 + max((level[x] for x in below), default=-1)
                left.discard(c)
    return {n: (comp[n], level[comp[n]]) for n in nodes}


def ranked(spark, nodes, edges):
    frame = spark.createDataFrame([(n,) for n in nodes], "qualified_name string")
    return {r.qualified_name: (r.scc_id, r.level) for r in graph.rank(frame, spark.createDataFrame(edges, "src string, dst string")).collect()}


@pytest.mark.parametrize("seed,peels", [(1, 0), (2, 1), (3, 16)])
def test_random_graphs(spark, monkeypatch, seed, peels):
    monkeypatch.setattr(graph, "PEELS", peels)
    rng = random.Random(seed)
    nodes = [f"{rng.randint(0, 999)}x{i}" for i in range(24)]
    edges = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(rng.choice([20, 28, 40]))]
    assert ranked(spark, nodes, edges) == brute(nodes, edges)


def test_long_chains_and_cycles_take_few_rounds(spark, monkeypatch):
    """Ten thousand nodes in a row and in a ring, side by side."""
    n, rounds, cut = 10_000, [0], graph.cut

    def counted(df):
        rounds[0] += 1
        return cut(df)

    monkeypatch.setattr(graph, "PEELS", 1)  # doubling is what is looked at
    monkeypatch.setattr(graph, "cut", counted)
    names = [f"{i:05d}" for i in range(2 * n)]
    row, ring = names[:n], names[n:]
    random.Random(4).shuffle(row)
    edges = [*zip(row, row[1:]), *zip(ring, ring[1:] + ring[:1])]
    got = ranked(spark, names, edges)
    assert all(got[x] == (x, n - 1 - i) for i, x in enumerate(row)) and all(got[x] == (ring[0], 0) for x in ring)
    assert rounds[0] < 160


@pytest.mark.parametrize("seed", range(2))
def test_pagerank_against_power_iteration(spark, seed):
    rng, n = random.Random(seed), 30
    names = [f"f{i}" for i in range(n)]
    edges = {(rng.choice(names), rng.choice(names[:20] + ["elsewhere"])): rng.randint(1, 9) for _ in range(60)}
    frame = spark.createDataFrame([(a, b, k) for (a, b), k in edges.items() if a < "f25"], "src string, dst string, n long")
    got = {r.qualified_name: r.rank for r in relevance.pagerank(spark.createDataFrame([(x,) for x in names], "qualified_name string"), frame, tolerance=1e-11).collect()}
    w = np.zeros((n, n))
    for (a, b), k in edges.items():
        if a < "f25" and b in names:
            w[names.index(a), names.index(b)] += k
    total, r = w.sum(1), np.full(n, 1 / n)
    walk = np.divide(w, total[:, None], out=np.zeros((n, n)), where=total[:, None] > 0)
    for _ in range(400):
        r = 0.15 / n + 0.85 * (r @ walk + r[total == 0].sum() / n)
    assert max(abs(got[x] - r[i]) for i, x in enumerate(names)) < 1e-9 and sum(got.values()) == pytest.approx(1)
    assert relevance.pagerank(spark.createDataFrame([], "qualified_name string"), frame).count() == 0


def test_running_totals_have_no_single_window(spark):
    rows = spark.range(1000).select(F.col("id"), (F.col("id") * 7919 % 1000).alias("key"), (F.col("id") % 13).alias("cost"))
    got = relevance.running_total(rows, [F.desc("key")], "cost")
    total, want = 0, {}
    for r in sorted(rows.collect(), key=lambda r: -r.key):
        total += r.cost
        want[r.id] = total
    assert {r.id: r.total for r in got.collect()} == want
    assert {r.id for r in relevance.within_budget(rows, [F.desc("key")], "cost", 100).collect()} == {i for i, t in want.items() if t <= 100}


def test_budgeted_rows_are_a_tree(spark):
    rows = [("r", "f", len(p), list(p), rel, "x" * 40) for p, rel in [((), None), ((0,), 5), ((1,), 9), ((0, 0), 5), ((0, 1), 2), ((1, 0), 9), ((1, 0, 0), 1)]]
    frame = spark.createDataFrame(rows, "root string, root_file string, level int, sort_path array<int>, relevance long, line_text string")
    for budget, want in ((0, 0), (10, 1), (35, 3), (69, 6), (70, 7)):
        kept = [tuple(r.sort_path) for r in relevance.budgeted(frame, budget).collect()]
        assert len(kept) == want and all(p == () or p[:-1] in kept for p in kept)


def vector_rows(seed, n, width=16):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(size=width).round(3).tolist()) for i in range(n)]
    rows += [(n + i, rows[3][1]) for i in range(40)]  # copies: ties
    return rows + [(-1, None), (-2, []), (-3, [0.0] * width), (-4, [1.0] * 3), (None, rows[0][1]), (-5, [float("nan")] + [1.0] * (width - 1)), (-6, [None] + [1.0] * (width - 1))]


def brute_topk(rows, k):
    good = [(i, np.array(v)) for i, v in rows if i is not None and i >= 0]
    out = []
    for i, v in good:
        if i % 50 == 0:
            scores = sorted((-round(float(v @ w / np.linalg.norm(v) / np.linalg.norm(w)), 6), j) for j, w in good if j != i)[:k]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(scores, 1)]
    return out


@pytest.mark.parametrize("block", [4096, 3])
def test_exact_search_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "QUERY_BLOCK", block)
    rows = vector_rows(1, 400)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = vectors.search_exact(frame, frame.filter("vec_id % 50 = 0"), 7)
    assert sorted(map(tuple, got.collect())) == sorted(brute_topk(rows, 7))


def test_index_finds_nine_of_ten_and_all_with_every_list(spark, tmp_path):
    rows = vector_rows(2, 900)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    vectors.build_index(frame, str(tmp_path / "i"))
    assert spark.read.parquet(str(tmp_path / "i/lists")).count() == vectors.usable(frame).count()
    want = sorted(brute_topk(rows, 10))
    asked = frame.filter("vec_id % 50 = 0")
    some = {(r.query_id, r.neighbour) for r in vectors.search_index(spark, str(tmp_path / "i"), asked).collect()}
    assert len(some & {(q, j) for q, _, j, _ in want}) >= 0.9 * len(want)
    assert sorted(map(tuple, vectors.search_index(spark, str(tmp_path / "i"), asked, probed=1.0).collect())) == want
    one = vectors.search_index(spark, str(tmp_path / "i"), asked.limit(1), probed=0.01)
    assert re.search(r"PartitionFilters: \[[^]]*list#", one._jdf.queryExecution().toString())


def test_vectors_without_rows(spark, tmp_path):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vectors.search_exact(none, none).count() == 0
    vectors.build_index(none, str(tmp_path / "none"))
    assert vectors.search_index(spark, str(tmp_path / "none"), spark.createDataFrame([(0, [1.0])], none.schema)).count() == 0


def test_recall_on_supplied_vectors(spark):
    from lodestone.plans.queries import queries

    found = [{(r.query_id, r.neighbour) for r in queries()[q](spark, "/root/testdata/sf0.1").collect()} for q in ("cosine_topk", "cosine_index_topk")]
    assert len(found[0] & found[1]) >= 0.9 * len(found[0])
