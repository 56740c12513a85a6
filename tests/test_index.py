"""Scan, stored index, command line, streaming, and the queries' SQL."""

import json

import duckdb
import pytest

from lodestone import cli
from lodestone.plans import pipeline, queries
from lodestone.sources import config, index_io, scan
from lodestone.streaming import extract_stream, source_stream

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture
def tree(tmp_path):
    files = {
        "_d/a.go": "package d\n\nfunc A() { B(); C() }\n\nfunc B() { A() }\n\nfunc C() { printf(1) }\n",
        "_d/a_test.go": "package d\nfunc T() {}\n",
        "vendor/v.go": "package v\nfunc V() {}\n",
        ".hid/h.go": "package h\nfunc H() {}\n",
        "src/lib.rs": "pub fn go() { add(1); }\n",
        "lib/x.c": "int add(int a) { return close(a); }\nstatic int v = 2;\n",
        "note.txt": "no",
    }
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "lib/bad.c").write_bytes(b"\xff\xfe")
    return tmp_path


def test_scan(spark, tree):
    good, bad = scan.scan_tree(spark, str(tree))
    assert sorted((r.path, r.lang) for r in good.collect()) == [("./_d/a.go", "go"), ("./lib/x.c", "c"), ("./src/lib.rs", "rust")]
    assert [r.path for r in bad.collect()] == ["./lib/bad.c"]
    assert scan.scan_tree(spark, str(tree / "none"))[0].count() == 0


def test_verbs(spark, tree, capsys):
    at = ["--root", str(tree)]
    assert cli.main([*at, "rank"]) == 1 and cli.main([*at, "trace", "A"]) == 1 and cli.main([*at, "source", "A"]) == 1
    assert cli.main([*at, "index"]) == 0
    capsys.readouterr()
    assert cli.main([*at, "trace", "d.A", "-d", "1"]) == 0
    assert capsys.readouterr().out.split("\n") == ["_d.A (./_d/a.go:3-3)", "  called by:", "  └── _d.B (./_d/a.go:5-5)", "", "[0] _d.A (./_d/a.go:3-3)", "[1] - _d.B (./_d/a.go:5-5)", "[1] - _d.C (./_d/a.go:7-7)", ""]
    assert cli.main([*at, "source", "add"]) == 0
    assert capsys.readouterr().out == "int add(int a) { return close(a); }\n"
    assert cli.main([*at, "source", "A", "-k", "nothing"]) == 1
    assert cli.main([*at, "source", "zzz"]) == 1
    assert cli.main([*at, "rank"]) == 0
    state = tree / config.STATE
    assert json.loads((state / "rank.json").read_text()) == {"levels": [["_d.C", "lib/x.add"], ["_d.A", "_d.B", "go"]]}
    document = json.loads((state / "index.json").read_text())
    a = document["files"]["./_d/a.go"]["functions"][0]
    assert a["called_by"] == ["_d.B"] and [c["target"] for c in a["calls"]] == ["_d.B", "_d.C"]
    assert document["externals"]["printf"]["kind"] == "libc"


def test_summaries_survive_a_new_index(spark, tree):
    state = config.init_state_dir(tree)
    (state / "config.toml").write_text("[features]\nsummaries = true\n")
    assert cli.index(spark, tree, lambda prompt: "said") == 0
    (tree / "lib/x.c").rename(tree / "lib/y.c")
    (state / "config.toml").write_text("")
    assert cli.index(spark, tree) == 0
    rows = index_io.load_index(spark, f"{state}/index")["functions"].collect()
    assert {r.qualified_name: r.summary for r in rows}["lib/y.add"] == "said"


def test_config(tmp_path):
    assert config.load_config(tmp_path) == config.Config()
    (tmp_path / "config.toml").write_text("debug = true\n[llm]\nbatch_size = 3\nodd = 1\n")
    read = config.load_config(tmp_path)
    assert (read.debug, read.llm.batch_size, read.llm.parallel) == (True, 3, 4)
    (tmp_path / "config.toml").write_text("= broken")
    assert config.load_config(tmp_path) == config.Config()
    assert config.git_head(tmp_path / "none") == ""


def test_missing_tables(spark, tmp_path):
    with pytest.raises(index_io.MissingIndex):
        index_io.load_index(spark, str(tmp_path / "no"))
    assert index_io.load_old_index(spark, str(tmp_path / "no"))["functions"].count() == 0
    assert index_io.write_rank_json(spark.createDataFrame([], "qualified_name string, scc_id string, level long"), tmp_path / "r.json") == 1
    assert json.loads((tmp_path / "r.json").read_text()) == {"levels": [[]]}


def test_stream(spark, tmp_path):
    spark.createDataFrame([("./a.go", "package a\nfunc F() {}\n"), ("./a_test.go", "package a"), ("./b.c", None)], "path string, text string").write.parquet(str(tmp_path / "in"))
    extract_stream(source_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(60)
    assert [r.path for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["./a.go"]


def test_index_of_nothing(spark):
    tables = pipeline.build_index(spark, spark.createDataFrame([], "path string, lang string, text string"))
    assert pipeline.stats(tables).first().n_calls == 0
    assert pipeline.ranks_of(tables).count() == 0


def value(v):
    return None if v is None or v != v else round(float(v), 6) if isinstance(v, float) else int(v) if hasattr(v, "__index__") else str(v)


def rows_of(frame):
    columns = sorted(frame.columns)
    return columns, sorted(repr([value(v) for v in r]) for r in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, sf, name):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = rows_of(queries.queries()[name](spark, sf).toPandas())
    assert got == rows_of(db.sql(queries.oracle_sql()[name]).df())


def test_every_query_has_sql():
    assert set(queries.queries()) == set(queries.oracle_sql())
