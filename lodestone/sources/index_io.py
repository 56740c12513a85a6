"""The stored index: tables first, and the JSON documents as a view of them."""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import levels
from ..operators.resolve import called_by
from ..schemas import INDEX_TABLES

VERSION = "0.1.0"


class MissingIndex(RuntimeError):
    """There is no index, or it can't be read."""


def index_meta(spark: SparkSession, commit: str = "") -> DataFrame:
    return spark.range(1).select(F.lit(VERSION).alias("version"), F.lit(commit).alias("commit"), F.current_timestamp().alias("indexed_at"))


def write_index(tables: dict[str, DataFrame], path: str) -> None:
    """Write every table of ``INDEX_TABLES`` under ``path``."""
    for name in INDEX_TABLES:
        tables[name].write.mode("overwrite").parquet(f"{path}/{name}")


def load_index(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of an index, with their declared schemas."""
    try:
        found = {name: spark.read.parquet(f"{path}/{name}") for name in INDEX_TABLES}
    except AnalysisException as e:
        raise MissingIndex(f"no index under {path}: run index first") from e
    for name, ddl in INDEX_TABLES.items():
        lacking = {c.split()[0] for c in ddl.split(", ")} - set(found[name].columns)
        if lacking:
            raise MissingIndex(f"{path}/{name} lacks {', '.join(sorted(lacking))}")
    return found


def load_old_index(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Like ``load_index``; empty tables instead of a failure."""
    try:
        return load_index(spark, path)
    except MissingIndex:
        return {name: spark.createDataFrame([], ddl) for name, ddl in INDEX_TABLES.items()}


def index_documents(tables: dict[str, DataFrame]) -> DataFrame:
    """``path, document``: each file with its functions, types and variables as JSON."""
    calls = tables["call_sites"].groupBy("file_path", F.col("caller_ordinal").alias("ordinal")).agg(
        F.array_sort(F.collect_list(F.struct("ordinal", "target", "raw", "line"))).alias("calls")
    )
    calls = calls.select("file_path", "ordinal", F.transform("calls", lambda x: F.struct(x["target"].alias("target"), x["raw"].alias("raw"), x["line"].alias("line"))).alias("calls"))
    functions = called_by(tables["functions"], tables["call_sites"]).join(calls, ["file_path", "ordinal"], "left")

    def nested(df: DataFrame, name: str) -> DataFrame:
        columns = [c for c in df.columns if c not in ("file_path", "ordinal")]
        rows = F.array_sort(F.collect_list(F.struct("ordinal", F.to_json(F.struct(*columns)).alias("x"))))
        return df.groupBy("file_path").agg(F.transform(rows, lambda r: r["x"]).alias(name))

    out = tables["files"]
    for name, df in (("functions", functions), ("types", tables["types"]), ("variables", tables["variables"])):
        out = out.join(nested(df, name).withColumnRenamed("file_path", "path"), "path", "left")
    listed = lambda c: F.concat(F.lit(f'"{c}":['), F.array_join(F.coalesce(F.col(c), F.array().cast("array<string>")), ","), F.lit("]"))
    body = F.concat(F.lit('{"ast_hash":"'), "ast_hash", F.lit('",'), listed("functions"), F.lit(","), listed("types"), F.lit(","), listed("variables"), F.lit("}"))
    return out.select("path", body.alias("document"))


def _written(path: Path, parts: Iterator[str]) -> None:
    with path.open("w", encoding="utf-8") as f:
        f.writelines(parts)


def write_index_json(tables: dict[str, DataFrame], path: str | Path) -> None:
    """One JSON document of the whole index, streamed file by file."""
    meta = tables["index_meta"].first()

    def parts() -> Iterator[str]:
        head = {"version": meta.version, "commit": meta.commit, "indexed_at": meta.indexed_at.isoformat()}
        yield json.dumps(head, indent=2)[:-2] + ',\n  "files": {'
        for i, row in enumerate(index_documents(tables).orderBy("path").toLocalIterator()):
            yield ("," if i else "") + f"\n    {json.dumps(row.path)}: {row.document}"
        yield '\n  },\n  "externals": {'
        for i, row in enumerate(tables["externals"].orderBy("name").toLocalIterator()):
            entry = {"kind": row.kind} | ({"summary": row.summary} if row.summary else {}) | {"references": row.references}
            yield ("," if i else "") + f"\n    {json.dumps(row.name)}: {json.dumps(entry)}"
        yield "\n  }\n}\n"

    _written(Path(path), parts())


def write_rank_json(ranks: DataFrame, path: str | Path) -> int:
    """``{"levels": [[...]]}``; returns how many levels there are.  Without any
    function there is one empty level."""
    n = 0

    def parts() -> Iterator[str]:
        nonlocal n
        yield '{\n  "levels": ['
        for n, row in enumerate(levels(ranks).orderBy("level").toLocalIterator(), 1):
            yield ("," if n > 1 else "") + "\n    " + json.dumps(row.functions)
        if not n:
            n = 1
            yield "\n    []"
        yield "\n  ]\n}\n"

    _written(Path(path), parts())
    return n
