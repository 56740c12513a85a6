"""Symbols, variables and call sites of source files, one file to many rows.

No grammar package is used: each language has a tokeniser and a reader of its
top-level structure.  ``extract_file`` is plain Python; ``extract`` runs it in
Python workers over a ``sources`` relation, batch by batch.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...schemas import CALL_SITES, FUNCTIONS, TYPES, UNRESOLVED, VARIABLES
from . import c, go, rust
from .lex import Found

PARSERS = {"go": go.parse, "rust": rust.parse, "c": c.parse}
ROWS = "path string, functions string, types string, variables string, error string"


def extract_file(text: str, path: str, lang: str) -> Found:
    """All that one file defines."""
    return PARSERS[lang](text, path)


def extract(sources: DataFrame) -> DataFrame:
    """``path, functions, types, variables, error`` of ``sources(path, lang, text)``,
    the lists as JSON.  A file that can't be read at all has an error and no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, lang, text in zip(*(x.to_pylist() for x in batch.columns)):
                try:
                    found = extract_file(text or "", path, lang)
                    rows.append((path, *(json.dumps([asdict(x) for x in part]) for part in (found.functions, found.types, found.variables)), None))
                except (KeyError, RecursionError) as e:
                    rows.append((path, "[]", "[]", "[]", f"{type(e).__name__}: {e}"))
            columns = zip(*rows) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.string()) for x in columns], [x.split()[0] for x in ROWS.split(", ")])

    return sources.select("path", "lang", "text").mapInArrow(run, ROWS)


_FUNCTION = "struct<name: string, qualified_name: string, ast_hash: string, line_start: int, line_end: int, signature: string, receiver: string, scope: string, calls: array<struct<raw: string, line: int>>>"
_TYPE = "struct<name: string, qualified_name: string, kind: string, line_start: int, line_end: int>"
_VARIABLE = "struct<name: string, qualified_name: string, type_name: string, line_start: int, line_end: int, scope: string>"


def _exploded(extracted: DataFrame, column: str, kind: str) -> DataFrame:
    return extracted.select(F.col("path").alias("file_path"), F.posexplode(F.from_json(column, f"array<{kind}>")).alias("ordinal", "x")).select("file_path", F.col("ordinal").cast("int"), "x.*")


def _shaped(df: DataFrame, ddl: str) -> DataFrame:
    return df.select(*(F.col(c.split()[0]) for c in ddl.split(", ")))


def functions(extracted: DataFrame) -> DataFrame:
    rows = _exploded(extracted, "functions", _FUNCTION).withColumn("summary", F.lit(None).cast("string"))
    return _shaped(rows, FUNCTIONS)


def call_sites(extracted: DataFrame) -> DataFrame:
    rows = _exploded(extracted, "functions", _FUNCTION)
    rows = rows.select("file_path", F.col("ordinal").alias("caller_ordinal"), F.col("qualified_name").alias("caller"), F.posexplode("calls").alias("ordinal", "c"))
    return _shaped(rows.select("*", "c.raw", "c.line", F.lit(UNRESOLVED).alias("target")), CALL_SITES)


def types(extracted: DataFrame) -> DataFrame:
    rows = _exploded(extracted, "types", _TYPE).withColumn("summary", F.lit(None).cast("string"))
    return _shaped(rows.withColumn("methods", F.array().cast("array<string>")), TYPES)


def variables(extracted: DataFrame) -> DataFrame:
    return _shaped(_exploded(extracted, "variables", _VARIABLE), VARIABLES)


def rejects(extracted: DataFrame) -> DataFrame:
    return extracted.filter("error IS NOT NULL").select("path", "error")
