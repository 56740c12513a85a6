"""Bounded traversal of the call graph in both directions.

Rows come in levels; each level joins the rows that may go on with the calls.
``sort_path`` holds the place of every step, so ordering by it gives the printed
order.  A function on the path to itself ends the path and is marked a cycle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.externals import categorized
from ..functions.names import is_internal
from ..schemas import UNRESOLVED
from ..session import cut
from .resolve import definitions

ROW = ["root", "root_file", "level", "sort_path", "node", "row_kind", "file_path", "line_start", "line_end", "prefix", "is_last", "relevance"]
#: Levels that are planned as one job before rows are written out.
LAZY_LEVELS = 3


def _place(functions: DataFrame) -> DataFrame:
    return definitions(functions).select(
        F.col("qualified_name").alias("__q"), F.col("file_path").alias("__file"), F.col("line_start").alias("__start"), F.col("line_end").alias("__end")
    )


def _roots(roots: DataFrame) -> DataFrame:
    """Level 0; two definitions of one name are two roots."""
    return roots.select(
        F.col("qualified_name").alias("root"),
        F.col("file_path").alias("root_file"),
        F.lit(0).alias("level"),
        F.array().cast("array<int>").alias("sort_path"),
        F.col("qualified_name").alias("node"),
        F.lit("function").alias("row_kind"),
        "file_path",
        "line_start",
        "line_end",
        F.lit("  ").alias("prefix"),
        F.lit(True).alias("is_last"),
        F.array("qualified_name").alias("path"),
        F.lit(None).cast("long").alias("relevance"),
    )


def _expand(roots: DataFrame, steps: DataFrame, places: DataFrame, depth: int) -> DataFrame:
    """All levels; ``steps(from, place, to, last, weight)`` are the calls to follow.

    ``relevance`` is the least weight on the way to a row, so no row has more than
    the one above it.  Calls meet the places of what they call before the first level
    and are written out, so a level shuffles the rows that go on, and not what they make.
    """
    steps = steps.join(places, F.col("to") == F.col("__q"), "left")
    if depth != 1:
        steps = cut(steps)
    level = _roots(roots)
    rows, done = level, 0
    while depth == 0 or done < depth:
        met = level.filter("row_kind = 'function'").join(steps, F.col("node") == F.col("from"))
        known = F.col("__q").isNotNull()
        kind = (
            F.when(F.col("to") == UNRESOLVED, "unresolved")
            .when(known & F.array_contains("path", F.col("to")), "cycle")
            .when(known, "function")
            .otherwise("external")
        )
        shown = lambda c: F.when(kind == "function", F.col(c))  # noqa: B023, E731
        level = met.select(
            "root",
            "root_file",
            (F.col("level") + 1).alias("level"),
            F.concat("sort_path", F.array(F.col("place"))).alias("sort_path"),
            F.col("shown").alias("node"),
            kind.alias("row_kind"),
            shown("__file").alias("file_path"),
            shown("__start").alias("line_start"),
            shown("__end").alias("line_end"),
            F.concat("prefix", F.when(F.col("level") == 0, "").when(F.col("is_last"), "    ").otherwise("│   ")).alias("prefix"),
            F.col("last").alias("is_last"),
            F.concat("path", F.array("to")).alias("path"),
            F.least("relevance", "weight").alias("relevance"),
        )
        done += 1
        if depth == 0 or done % LAZY_LEVELS == 0:
            level = cut(level)
            if not level.limit(1).count():
                break
        rows = rows.unionByName(level)
    return rows.select(*ROW)


def trace_forward(functions: DataFrame, resolved: DataFrame, roots: DataFrame, depth: int = 2, weights: DataFrame | None = None) -> DataFrame:
    """What ``roots`` call, down to ``depth`` levels (0: all); a row for each call.

    ``row_kind`` is ``function``, ``cycle``, ``external`` or ``unresolved``;
    ``summary`` stands with the first mention of an external in a root's tree;
    ``line_text`` is the printed line.  With ``weights(target, weight)`` there is a
    column ``relevance``: the least weight of the calls on the way.
    """
    shown_too = [] if weights is None else ["relevance"]
    called = F.when(F.col("target") == UNRESOLVED, F.col("raw")).otherwise(F.col("target"))
    steps = resolved.select(F.col("caller").alias("from"), F.col("ordinal").alias("place"), F.col("target").alias("to"), called.alias("shown"), F.lit(False).alias("last"))
    if weights is None:
        steps = steps.withColumn("weight", F.lit(None).cast("long"))
    else:
        steps = steps.join(weights.select(F.col("target").alias("to"), F.col("weight").cast("long").alias("weight")), "to", "left")
    rows = _expand(roots, steps, _place(functions), depth)
    # only externals are numbered; rows without one aren't shuffled again
    rows = rows if depth == 0 else cut(rows)
    first = F.row_number().over(Window.partitionBy("root", "root_file", "node").orderBy("sort_path")) == 1
    external = F.col("row_kind") == "external"
    rows = rows.filter(external).withColumn("__first", first).unionByName(rows.filter(~external).withColumn("__first", F.lit(False)))
    bare = F.when(F.startswith("node", F.lit("[")), F.regexp_extract("node", r"^\[[a-z]+:(.*)\]$", 1))
    rows = rows.withColumn("__bare", F.coalesce(bare, F.substring_index("node", ".", -1)))
    said = categorized(rows.filter("__first").select("__bare").distinct(), "__bare").select(F.col("__bare").alias("__name"), "summary")
    met = rows.join(said, F.col("__first") & (F.col("__bare") == F.col("__name")), "left")
    return met.select("root", "root_file", "level", "sort_path", "node", "row_kind", "file_path", "line_start", "line_end", "summary", forward_line().alias("line_text"), *shown_too)


def cycle_counts(functions: DataFrame, resolved: DataFrame, roots: DataFrame, depth: int = 2) -> DataFrame:
    """``root, node, n``: the ``cycle`` rows that ``trace_forward`` has, counted.

    All calls from one function to another are one step with their number, and what
    is no function is no step, so the rows grow with the ways over distinct edges and
    not with the calls on them.  Depth 0 goes on until no way is left.
    """
    known = functions.select(F.col("qualified_name").alias("to")).distinct()
    steps = resolved.groupBy(F.col("caller").alias("from"), F.col("target").alias("to")).agg(F.count("*").alias("times"))
    steps = cut(steps.join(known, "to", "left_semi").select("from", "to", "times"))
    names = roots.groupBy(F.col("qualified_name").alias("root")).agg(F.count("*").alias("n"))
    level = names.select("root", F.col("root").alias("node"), F.array("root").alias("path"), "n")
    found, done = None, 0
    while depth == 0 or done < depth:
        met = level.join(steps, F.col("node") == F.col("from")).select("root", "to", "path", (F.col("n") * F.col("times")).alias("n"), F.array_contains("path", F.col("to")).alias("cycle"))
        done += 1
        if done != depth:
            met = cut(met)
        closed = met.filter("cycle").select("root", F.col("to").alias("node"), "n")
        found = closed if found is None else found.unionByName(closed)
        level = met.filter("NOT cycle").select("root", F.col("to").alias("node"), F.concat("path", F.array("to")).alias("path"), "n")
        if depth == 0 and level.isEmpty():
            break
    return found.groupBy("root", "node").agg(F.sum("n").alias("n"))


def _spot() -> Column:
    return F.concat(F.lit(" ("), "file_path", F.lit(":"), F.col("line_start").cast("string"), F.lit("-"), F.col("line_end").cast("string"), F.lit(")"))


def forward_line() -> Column:
    """``[level] ---- name (file:start-end)`` and its other kinds."""
    head = F.concat(F.lit("["), F.col("level").cast("string"), F.lit("] "), F.expr("repeat('-', level)"), F.when(F.col("level") > 0, " ").otherwise(""))
    said = F.coalesce(F.concat(F.lit(' : "'), "summary", F.lit('"')), F.lit(""))
    body = (
        F.when(F.col("row_kind") == "cycle", F.concat(F.lit("[cycle] "), "node"))
        .when(F.col("row_kind") == "unresolved", F.concat(F.lit("[unresolved] "), "node"))
        .when(F.col("row_kind") == "external", F.concat(F.lit("[external] "), "node", said))
        .otherwise(F.concat("node", _spot()))
    )
    return F.concat(head, body)


def trace_backward(functions: DataFrame, resolved: DataFrame, roots: DataFrame, depth: int = 2) -> DataFrame:
    """What calls ``roots``, each caller once, up to ``depth`` levels (0: all)."""
    callers = resolved.filter(is_internal("target")).select(F.col("target").alias("from"), F.col("caller").alias("to")).distinct()
    order = Window.partitionBy("from").orderBy("to")
    last = F.row_number().over(order) == F.count("*").over(Window.partitionBy("from"))
    steps = callers.select("from", (F.row_number().over(order) - 1).alias("place"), "to", F.col("to").alias("shown"), last.alias("last"), F.lit(None).cast("long").alias("weight"))
    rows = _expand(roots, steps, _place(functions), depth)
    return rows.select(*(c for c in ROW if c not in ("prefix", "is_last", "relevance")), backward_line().alias("line_text"))


def backward_line() -> Column:
    """A line of the callers' tree; the root's line has no mark."""
    joint = F.when(F.col("is_last"), "└── ").otherwise("├── ")
    body = (
        F.when(F.col("row_kind") == "cycle", F.concat(F.lit("[cycle] "), "node"))
        .when(F.col("row_kind") == "external", F.concat(F.lit("[external] "), "node"))
        .otherwise(F.concat("node", _spot()))
    )
    return F.when(F.col("level") == 0, F.concat("node", _spot())).otherwise(F.concat("prefix", joint, body))
