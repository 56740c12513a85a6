"""Small cases of what the review of round 4 found."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import scopes
from lodestone.plans import fixtures, queries
from tests import test_scopes
from tests.test_scopes import reached, rows


def shuffled(spark):
    """Bytes that all shuffles of the session have written."""
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


def test_ways_over_common_files_are_not_shuffled(spark):
    """A header that all files include and that includes many: its ways are as many as the pairs."""
    n, m = 3000, 300
    up = spark.range(n).select(F.format_string("f%d", "id").alias("file_path"), F.lit("hub").alias("dep"))
    down = spark.range(m).select(F.lit("hub").alias("file_path"), F.format_string("h%d", "id").alias("dep"))
    before = shuffled(spark)
    nodes, pairs = scopes.numbered_closure(up.unionByName(down))
    assert pairs.count() == n * m + n + m and nodes.count() == n + m + 1
    assert shuffled(spark) - before < n * m * 2


@pytest.mark.parametrize("sent,task", [(1 << 20, 1 << 19), (2048, 1 << 19), (256, 1 << 19), (2048, 3)])
def test_closure_by_all_ways_of_sending(spark, monkeypatch, sent, task):
    """All ways sent, some, hardly any, and files with more pairs than a task has."""
    monkeypatch.setattr(scopes, "SENT_ROWS", sent)
    monkeypatch.setattr(scopes, "TASK_ROWS", task)
    rng = random.Random(sent + task)
    edges = {(f"f{a}", f"f{rng.randint(0, a)}") for a in range(60) for _ in range(2)} | {("f0", "f7"), ("f3", "f40")}
    table = spark.createDataFrame(list(edges), "file_path string, dep string")
    want = reached((a, b) for a, b in edges if a != b)
    assert rows(scopes.include_closure(table), "file_path", "dep", "depth") == sorted(((*k, d) for k, d in want.items()), key=str)


@pytest.mark.parametrize("few", [0, 5])
def test_paths_of_rare_files(spark, monkeypatch, few):
    """Names that aren't sent to all tasks meet their pairs in a shuffle."""
    monkeypatch.setattr(scopes, "FEW_ROWS", few)
    edges = [(f"f{a}", f"f{a // 2}") for a in range(1, 40)]
    table = spark.createDataFrame(edges, "file_path string, dep string")
    want = reached(edges)
    assert rows(scopes.include_closure(table), "file_path", "dep", "depth") == sorted(((*k, d) for k, d in want.items()), key=str)


@pytest.mark.parametrize("asked,task", [(0, 1 << 19), (8, 1 << 19), (1 << 16, 1)])
def test_answers_of_frequent_keys_and_wide_files(spark, monkeypatch, asked, task):
    """All keys, some keys or none go the way of frequent ones; a file's pairs are too many for a task."""
    for name, value in {"KEY_ASKED": asked, "KEY_DEFINED": asked, "TASK_ROWS": task}.items():
        monkeypatch.setattr(scopes, name, value)
    test_scopes.test_answers_against_brute_force(spark, 1)


def test_answers_shuffle_what_is_asked_but_not_its_candidates(spark):
    """Names with twenty definitions each, most of them in files that the asking file doesn't include."""
    n_files, n_names = 400, 1000
    path = lambda c: F.format_string("./d%d/e%d/f%d.c", F.col(c) % 5, F.col(c) % 25, c)
    ids = spark.range(n_files)
    edges = ids.select(path("id").alias("file_path"), "id", F.expr("id div 2").alias("to")).select("file_path", path("to").alias("dep"))
    nodes, closure = scopes.numbered_closure(edges)
    places = spark.range(n_names * 20).select(F.expr("(id * 7919) % 400").alias("file"), F.expr("id div 20").alias("name"))
    functions = places.select(path("file").alias("file_path"), F.col("name").cast("int").alias("ordinal"), F.format_string("g%d", "name").alias("name"), F.format_string("p%d.g%d", "file", "name").alias("qualified_name"), F.lit(None).cast("string").alias("receiver"))
    asked = ids.select(path("id").alias("file_path"), F.explode(F.expr("transform(sequence(1, 100), x -> concat('g', (id * 31 + x * 17) % 1000))")).alias("raw"))
    before = shuffled(spark)
    got = {r.scope for r in scopes.answers_scoped(asked, functions, closure, nodes).select("scope").distinct().collect()}
    assert {"include", "indirect", "elsewhere"} <= got
    assert shuffled(spark) - before < n_files * 100 * 200


def test_calls_of_modules_are_counted_once(spark, sf):
    """The counted texts are the calls; both queries read the line items once."""
    calls = fixtures.module_calls(spark, sf).groupBy("file_path", "raw").agg(F.count("*").alias("n_calls"))
    texts = fixtures.module_texts(spark, sf)
    assert sorted(map(tuple, texts.collect()), key=str) == sorted(map(tuple, calls.collect()), key=str)
    total = queries.confidence_rates(spark, sf).agg(F.sum("n_calls")).first()[0]
    assert total == fixtures.module_calls(spark, sf).count()
