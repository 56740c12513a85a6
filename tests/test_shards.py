"""Tables in shards: what is read, what is rewritten, and equality with a plain table."""

import os
import random

import pytest
from pyspark.sql import functions as F

from lodestone.schemas import FUNCTIONS
from lodestone.sources.shards import SHARD, Shards, SymbolStore


def rows(df, *columns):
    return sorted(map(tuple, df.select(*(columns or df.columns)).collect()), key=str)


def written(path):
    """When each shard's folder was written, by the names of its files."""
    return {d: sorted(f for f in os.listdir(f"{path}/{d}") if f.endswith(".parquet")) for d in os.listdir(path) if d.startswith(SHARD)}


def test_reads_are_pruned_and_updates_touch_their_shards(spark, tmp_path):
    table = Shards(str(tmp_path / "t"), "k", 16)
    data = spark.range(500).select(F.format_string("k%d", F.col("id") % 90).alias("k"), "id").unionByName(spark.createDataFrame([(None, -1)], "k string, id long"))
    table.write(data)
    kept = data.filter("k is not null")
    assert rows(table.read(spark)) == rows(kept)
    got = table.lookup(spark, ["k7", "k8", "none"])
    assert rows(got) == rows(kept.filter("k in ('k7', 'k8')")) and not table.lookup(spark, []).count()
    plan = got._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters: [") :].split("]")[0]
    assert SHARD in filters and "xxhash64" not in filters
    before = written(table.path)
    assert len(before) == 16  # each has its mark
    new = spark.createDataFrame([("k7", 1000), ("k7", 1000), ("fresh", 1)], "k string, id long")
    keys = spark.createDataFrame([("k7",), ("k8",), ("fresh",), (None,), ("k7",)], "key string")
    touched = table.replace(keys, new)
    after = written(table.path)
    assert {f"{SHARD}={s}" for s in touched} == {d for d in after if after[d] != before[d]} and len(touched) <= 3
    assert rows(table.read(spark)) == rows(kept.filter("k not in ('k7', 'k8')").unionByName(new))
    assert table.replace(keys.limit(0), new.limit(0)) == [] and written(table.path) == after
    # a shard that is emptied
    table.replace(table.read(spark).select("k").distinct(), new.limit(0))
    assert not table.read(spark).count() and len(written(table.path)) == 16


@pytest.mark.parametrize("seed", range(2))
def test_store_equals_a_plain_table_after_random_edits(spark, tmp_path, seed):
    rng, names = random.Random(seed), [f"f{i}" for i in range(9)]

    def version(f):
        out = []
        for i in range(rng.randint(0, 4)):
            name = rng.choice(names)
            out.append((f"./p{f}.go", i, name, f"p{f}.{name}", "h", 1, 2, f"func {name}({rng.randint(0, 9)})", None, None, "public"))
        return out

    tree = {f: version(f) for f in range(8)}
    frame = lambda t: spark.createDataFrame([r for v in t.values() for r in v], FUNCTIONS)
    store = SymbolStore(str(tmp_path / "s"), 8)
    store.write(frame(tree))
    for _ in range(2):
        edits = {f: version(f) for f in rng.sample(range(10), 3)} | {rng.randint(0, 7): []}
        tree |= edits
        store.update(spark.createDataFrame([(f"./p{f}.go",) for f in edits], "file_path string"), frame(edits))
        want = frame(tree)
        assert rows(store.functions.read(spark), *want.columns) == rows(want)
        listed = want.select(F.explode(F.array("name", "qualified_name")).alias("name"), "file_path").distinct()
        assert rows(store.names.read(spark), "name", "file_path") == rows(listed)
    for name in ["f1", "f2", "p3.f1", "none"]:
        assert rows(store.find(spark, name), *want.columns) == rows(want.filter((F.col("name") == name) | (F.col("qualified_name") == name)))


def test_an_empty_store(spark, tmp_path):
    store, none = SymbolStore(str(tmp_path / "s"), 4), spark.createDataFrame([], FUNCTIONS)
    store.write(none)
    assert not store.find(spark, "a").count() and not store.functions.read(spark).count()
    assert store.update(none.select("file_path"), none) == ([], [])
