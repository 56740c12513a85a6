"""Resolution of call expressions to definitions, and what follows from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.externals import categorized
from ..functions.names import is_internal, last_two_parts, n_parts, package_of, percent
from ..schemas import UNRESOLVED


def symbol_keys(functions: DataFrame) -> DataFrame:
    """``key, n, qualified_name``: simple names, and ``Receiver.name`` of methods.

    ``n`` counts definitions, so a qualified name that is defined twice makes its
    keys ambiguous; ``qualified_name`` is the definition where ``n`` is 1.
    """
    simple = functions.select(F.col("name").alias("key"), "qualified_name")
    received = functions.filter("receiver is not null").select(F.concat_ws(".", "receiver", "name").alias("key"), "qualified_name")
    return simple.unionByName(received).groupBy("key").agg(F.count("*").alias("n"), F.min("qualified_name").alias("qualified_name"))


def ambiguous_keys(functions: DataFrame) -> DataFrame:
    return symbol_keys(functions).filter("n > 1").select("key", "n")


def file_packages(functions: DataFrame) -> DataFrame:
    """``file_path, package``: the package of each file's first function."""
    first = functions.groupBy("file_path").agg(F.min_by("qualified_name", "ordinal").alias("first"))
    return first.select("file_path", package_of("first").alias("package"))


def symbol_counts(functions: DataFrame) -> DataFrame:
    """``kind, name, qualified_name, n``: definitions behind each qualified name (``q``)
    and each key (``k``), counted, so that files can be added and taken away."""
    exact = functions.select(F.lit("q").alias("kind"), F.col("qualified_name").alias("name"), "qualified_name")
    simple = functions.select(F.lit("k").alias("kind"), "name", "qualified_name")
    received = functions.filter("receiver is not null").select(F.lit("k").alias("kind"), F.concat_ws(".", "receiver", "name").alias("name"), "qualified_name")
    return exact.unionByName(simple).unionByName(received).groupBy("kind", "name", "qualified_name").agg(F.count("*").alias("n"))


def lookups(counts: DataFrame) -> DataFrame:
    """``kind, name, found``: exact qualified names, and keys of one definition."""
    met = counts.groupBy("kind", "name").agg(F.sum("n").alias("n"), F.min("qualified_name").alias("found"))
    return met.filter("kind = 'q' OR n = 1").select("kind", "name", "found")


def probes(pairs: DataFrame) -> DataFrame:
    """``pairs(package, raw)`` with the ``rank, kind, name`` of each probe of a call."""
    one, two, own = n_parts("raw") == 1, n_parts("raw") == 2, F.concat_ws(".", "package", "raw")
    # with a file that has no function there is no package to look in
    own = F.when(F.col("package").isNotNull(), own)
    probe = lambda rank, kind, name: F.struct(F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), name.alias("name"))
    every = F.array(
        probe(1, "q", F.when(one, own).when(two, F.col("raw"))),
        probe(2, "q", F.when(two, own)),
        probe(3, "k", F.when(one | two, F.col("raw")).otherwise(last_two_parts("raw"))),
    )
    return pairs.select(*pairs.columns, F.explode(every).alias("p")).select(*pairs.columns, "p.*").filter("name is not null")


def asked_in(calls: DataFrame, packages: DataFrame) -> DataFrame:
    """``file_path, raw, package``: each text that a file calls, once."""
    return calls.select("file_path", "raw").distinct().join(packages, "file_path", "left").select("file_path", "raw", "package")


def answer_calls(calls: DataFrame, packages: DataFrame, found: DataFrame) -> DataFrame:
    """``calls`` with ``target`` and ``rule`` from ``packages`` and ``lookups``."""
    columns = [c for c in calls.columns if c not in ("target", "rule")]
    asked = asked_in(calls, packages)
    pairs = asked.select("package", "raw").distinct()
    hits = probes(pairs).join(found, ["kind", "name"])
    best = hits.groupBy("package", "raw").agg(F.min_by("found", "rank").alias("found"), F.min("rank").alias("rule"))
    answers = categorized(
        asked.alias("w")
        .join(best.alias("b"), F.col("w.package").eqNullSafe(F.col("b.package")) & (F.col("w.raw") == F.col("b.raw")), "left")
        .select("w.file_path", "w.raw", "found", "rule")
    )
    answers = answers.select(
        F.col("file_path").alias("__file"),
        F.col("raw").alias("__raw"),
        F.coalesce("found", F.concat(F.lit("["), "kind", F.lit(":"), "raw", F.lit("]"))).alias("target"),
        "rule",
    )
    met = calls.select(*columns).join(answers, F.col("file_path").eqNullSafe(F.col("__file")) & (F.col("raw") == F.col("__raw")), "left")
    return met.select(*columns, "target", "rule")


def resolve_calls(functions: DataFrame, call_sites: DataFrame) -> DataFrame:
    """``call_sites`` with ``target`` filled in and ``rule``, the probe that hit.

    A call's probes, the first hit counts:

    ========== ========================= ========================= ==================
    parts      exact qualified name      exact qualified name      key of one definition
    ========== ========================= ========================= ==================
    1          package.raw               --                        raw
    2          raw                       package.raw               raw
    3 and more --                        --                        last two parts
    ========== ========================= ========================= ==================

    Without a hit the target is ``[kind:raw]`` of the external symbol.  Probes
    depend on package and text alone, so they are answered once for each distinct
    pair.  Packages meet the distinct pairs of file and text (summed in the tasks
    first), so the calls themselves are shuffled once at most, to meet the answers.
    """
    return answer_calls(call_sites, file_packages(functions), lookups(symbol_counts(functions)))


def called_by(functions: DataFrame, resolved: DataFrame) -> DataFrame:
    """``functions`` with ``called_by``: their distinct callers in order."""
    callers = resolved.filter(is_internal("target")).groupBy(F.col("target").alias("__target")).agg(F.array_sort(F.collect_set("caller")).alias("called_by"))
    met = functions.join(callers, F.col("qualified_name") == F.col("__target"), "left")
    return met.select(*functions.columns, F.coalesce("called_by", F.array().cast("array<string>")).alias("called_by"))


def externals(resolved: DataFrame) -> DataFrame:
    """``name, kind, summary, references`` of every external call text."""
    counted = resolved.filter(~is_internal("target")).groupBy("raw").agg(F.count("*").alias("references"))
    return categorized(counted).select(F.col("raw").alias("name"), "kind", "summary", "references")


def call_stats(resolved: DataFrame) -> DataFrame:
    """Calls, those resolved, and two rates.

    ``resolved_pct_compat`` counts what isn't literally unresolved, as the format
    has it; ``resolution_rate`` counts targets that are functions.
    """
    hit = F.count_if(is_internal("target"))
    marked = F.count_if(F.col("target") != UNRESOLVED)
    return resolved.agg(
        F.count("*").alias("n_calls"),
        hit.alias("n_resolved"),
        percent(marked, F.count("*")).alias("resolved_pct_compat"),
        percent(hit, F.count("*")).alias("resolution_rate"),
    )


def index_stats(files: DataFrame, functions: DataFrame, types: DataFrame, resolved: DataFrame) -> DataFrame:
    """One row: files, functions, types, calls and the rates of ``call_stats``."""
    n = lambda df, name: df.agg(F.count("*").alias(name))
    # each side is one row
    return n(files, "n_files").crossJoin(n(functions, "n_functions")).crossJoin(n(types, "n_types")).crossJoin(call_stats(resolved))


def definitions(functions: DataFrame) -> DataFrame:
    """One row for each qualified name: of repeated ones the last by path and place."""
    order = Window.partitionBy("qualified_name").orderBy(F.desc("file_path"), F.desc("ordinal"))
    return functions.withColumn("__r", F.row_number().over(order)).filter("__r = 1").drop("__r")


def duplicate_definitions(functions: DataFrame) -> DataFrame:
    return functions.groupBy("qualified_name").agg(F.count("*").alias("n")).filter("n > 1")
