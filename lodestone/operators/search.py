"""Symbol search and source slices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import line_slice
from ..schemas import SYMBOL_KINDS

MATCH = ["qualified_name", "file_path", "line_start", "line_end", "kind"]


def _matches(name: str):
    """The whole name, the simple name, or any part of the qualified name."""
    wanted = F.lit(name)
    return (F.col("qualified_name") == wanted) | (F.col("name") == wanted) | F.contains(F.col("qualified_name"), wanted)


def find_functions(functions: DataFrame, name: str) -> DataFrame:
    """Functions that ``name`` matches, with ``match_rank``: 0 for the qualified
    name, 1 for the simple name, 2 for a part."""
    rank = F.when(F.col("qualified_name") == name, 0).when(F.col("name") == name, 1).otherwise(2)
    return functions.filter(_matches(name)).withColumn("match_rank", rank)


def find_symbols(functions: DataFrame, types: DataFrame, variables: DataFrame, name: str, kind: str | None = None) -> DataFrame:
    """Functions, types and variables that ``name`` matches, of ``kind`` if given."""
    if kind is not None and kind not in SYMBOL_KINDS:
        raise ValueError(f"unknown kind {kind!r}: one of {', '.join(SYMBOL_KINDS)}")
    some = [
        functions.filter(_matches(name)).withColumn("kind", F.lit("function")).select(*MATCH),
        types.filter(_matches(name)).select(*MATCH),
        variables.filter(_matches(name)).withColumn("kind", F.lit("variable")).select(*MATCH),
    ]
    out = some[0].unionByName(some[1]).unionByName(some[2])
    return out if kind is None else out.filter(F.col("kind") == kind)


def with_source(matches: DataFrame, sources: DataFrame) -> DataFrame:
    """``matches`` with ``source``: their lines; empty where the file is gone."""
    texts = sources.select(F.col("path").alias("__path"), F.col("text").alias("__text"))
    met = matches.join(texts, F.col("file_path") == F.col("__path"), "left")
    return met.select(*matches.columns, F.coalesce(line_slice("__text", "line_start", "line_end"), F.lit("")).alias("source"))
