"""Whether an index is whole (extension): all rules in one pass over each table.

``validate`` marks every row with the rules that it breaks, counts them by
``Observation`` while the marked rows are written as a table of violations, and
needs no further job for the counts.  ``stale_files`` says what ``check`` asks.

Defined results: a null in a column that a rule reads breaks the rule, but for
receivers and summaries, which may be null.  Of repeated rows each counts.  Empty
tables break nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.names import is_internal
from ..schemas import EXTERNAL_KINDS, SCOPES, TYPE_KINDS
from .update import changed_files

VIOLATIONS = "table_name string, rule string, file_path string, item string"


def _lines() -> Column:
    return (F.col("line_start") >= 1) & (F.col("line_end") >= F.col("line_start"))


def _rules() -> dict[str, dict[str, Column]]:
    """What must hold for a row of each table; ``in_...`` come from ``_referred``."""
    external = F.concat(F.lit(r"^\[("), F.lit("|".join(EXTERNAL_KINDS)), F.lit(r"):"))
    named = (F.col("qualified_name") == F.col("name")) | F.endswith("qualified_name", F.concat(F.lit("."), "name")) | F.endswith("qualified_name", F.concat(F.lit("::"), "name"))
    return {
        "functions": {
            "lines_in_order": _lines(),
            "scope_known": F.col("scope").isin(*SCOPES),
            "name_ends_qualified_name": named,
            "hash_present": F.length("ast_hash") > 0,
            "file_listed": F.col("in_files"),
        },
        "types": {"lines_in_order": _lines(), "kind_known": F.col("kind").isin(*TYPE_KINDS), "file_listed": F.col("in_files")},
        "call_sites": {
            "line_positive": F.col("line") >= 1,
            "target_form": is_internal("target") | F.regexp_like("target", external) | (F.col("target") == "[unresolved]"),
            "target_exists": ~is_internal("target") | F.col("in_targets"),
            "caller_exists": F.col("in_callers"),
            "file_listed": F.col("in_files"),
        },
    }


#: The column that names a row in the table of violations.
ITEMS = {"functions": "qualified_name", "types": "qualified_name", "call_sites": "caller"}


def _referred(rows: DataFrame, column: str, names: DataFrame, flag: str) -> DataFrame:
    """``rows`` with whether ``column`` is one of the distinct ``names``."""
    keys = names.select(F.col(names.columns[0]).alias("__k")).filter("__k is not null").distinct().withColumn("__in", F.lit(True))
    return rows.join(keys, F.col(column) == F.col("__k"), "left").withColumn(flag, F.coalesce("__in", F.lit(False))).drop("__k", "__in")


@dataclass
class Validation:
    """Rows and broken rules counted by table and rule, and where the violations are."""

    n_rows: dict[str, int]
    broken: dict[tuple[str, str], int]
    path: str

    @property
    def valid(self) -> bool:
        return not any(self.broken.values())

    def violations(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(VIOLATIONS).parquet(self.path)


def validate(tables: dict[str, DataFrame], path: str) -> Validation:
    """Check ``tables`` (of ``INDEX_TABLES``; those that aren't given are left out) and
    write every violation under ``path``: one job, whatever the number of rules."""
    files = tables["files"].select("path")
    marked, seen = [], {}
    for name, rules in _rules().items():
        if name not in tables:
            continue
        rows = _referred(tables[name], "file_path", files, "in_files")
        if name == "call_sites":
            defined = tables["functions"].select("qualified_name")
            rows = _referred(_referred(rows, "target", defined, "in_targets"), "caller", defined, "in_callers")
        bad = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(rule)) for rule, ok in rules.items())))
        rows = rows.select("file_path", F.col(ITEMS[name]).alias("item"), bad.alias("bad"))
        seen[name] = Observation(f"{name}_rules")
        counts = [F.count_if(F.array_contains("bad", rule)).alias(rule) for rule in rules]
        rows = rows.observe(seen[name], F.count(F.lit(1)).alias("n_rows"), *counts)
        marked.append(rows.select(F.lit(name).alias("table_name"), F.explode("bad").alias("rule"), "file_path", "item"))
    every = marked[0]
    for rows in marked[1:]:
        every = every.unionByName(rows)
    every.write.mode("overwrite").parquet(path)
    got = {name: dict(o.get) for name, o in seen.items()}
    return Validation({n: m.pop("n_rows") for n, m in got.items()}, {(n, rule): k for n, m in got.items() for rule, k in m.items()}, path)


def stale_files(indexed: DataFrame, now: DataFrame) -> DataFrame:
    """``file_path, change`` of files that the index doesn't hold as they are; empty if it is current."""
    return changed_files(indexed, now)
