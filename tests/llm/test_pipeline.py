import os
import subprocess
import sys
from pathlib import Path

import pytest

import corpus_pipeline
from lodestone.llm import common, queries

from .conftest import prose

ROOT = Path(__file__).resolve().parent.parent.parent


@pytest.fixture
def folder(spark, odd, tmp_path):
    """A small data folder: the odd rows, copies, junk, a leak, a shared line."""
    shared = "this shared line of some length stands in many documents of the corpus"
    base = prose(70, 400)
    near = base.split(" ")
    near[50], near[200] = "changed", "words"
    rows = [
        (40, base), (41, base), (42, " ".join(near)), (43, shared + "\n" + prose(71, 200)), (44, prose(72, 200) + "\n" + shared),
        (45, "JUNK!! " * 300), (46, prose(73, 80) + " " + prose(90, 40) + " " + prose(74, 80)), (47, "too short"),
    ]
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    more = spark.createDataFrame([(i, t, None, None, len(t)) for i, t in rows], docs.schema)
    docs.unionByName(more).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, prose(90, 40)), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_stages(spark, folder):
    docs = common.table(spark, folder, "documents")
    columns, left = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = common.materialise(stage(spark, docs, folder), name)
        left[name] = {r.doc_id: r for r in docs.collect()}
        if name != "sentencepiece":
            assert docs.columns == columns
    kept = {k: {i for i in v if i is not None} for k, v in left.items()}
    assert kept["quality_rules"] >= {40, 41, 42, 43, 44, 46} and not kept["quality_rules"] & {1, 2, 3, 7, 8, 45, 47}
    assert kept["line_dedup"] == kept["quality_rules"]
    assert "shared line" in left["line_dedup"][43].text and "shared line" not in left["line_dedup"][44].text
    assert kept["near_dedup"] & {40, 41, 42} == {40} and kept["near_dedup"] >= {43, 44, 46}
    assert kept["decontamination"] == kept["near_dedup"] - {46}
    assert kept["sentencepiece"] == kept["decontamination"]
    assert all(left["sentencepiece"][i].decoded == left["decontamination"][i].text for i in kept["sentencepiece"])
    rows = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in rows if r.doc_id is not None} == kept["sentencepiece"]


def test_empty_table(spark, folder, none):
    docs = none.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.count() == 0


def test_registry():
    numbers = {int(n[2:].split("_")[0]) for n in queries.queries()}
    assert numbers == set(range(1, 11)) and set(queries.oracle_sql()) <= set(queries.queries())


def test_the_rest_stands_without_this_subpackage(tmp_path):
    for name in os.listdir(ROOT):
        if name not in ("corpus_pipeline.py", "lodestone", ".git", "tests"):
            (tmp_path / name).symlink_to(ROOT / name)
    (tmp_path / "lodestone").mkdir()
    for name in os.listdir(ROOT / "lodestone"):
        if name not in ("llm", "__pycache__"):
            (tmp_path / "lodestone" / name).symlink_to(ROOT / "lodestone" / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'rank_levels' in q and not any(n.startswith('op') for n in q) and 'pipeline' not in q; assert set(e.oracle_sql()) == set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
