"""Keeping a resolved index up to date from the files that changed.

A snapshot holds definitions counted by name and key.  An update takes the counts
of gone definitions away and adds those of new ones, and so knows the names and
keys of which the answer changed: names that begin or cease to exist, keys that
begin or cease to have one definition.  Of the files that didn't change only calls
that ask for one of these are probed again; all others keep their targets.

What is compared or recounted are rows of changed files and names.  The large
tables are scanned for them: changed files, names and texts are broadcast while a
count shows them to be few (``session.few``), and meet the tables in a shuffle if
they are many.

Defined results: a file that is named as changed and has no new rows is gone; new
rows of a file that isn't named are an error of the caller and would be doubled.
Repeated definitions count as often as they occur.  An update with no changed file
returns equal tables.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import is_internal
from ..session import cut, few, hashed
from .resolve import answer_calls, asked_in, file_packages, lookups, probes, symbol_counts

COUNTED = ["kind", "name", "qualified_name"]


@dataclass
class Snapshot:
    """Functions, resolved calls, and ``symbol_counts`` of the functions."""

    functions: DataFrame
    calls: DataFrame
    symbols: DataFrame


def build(functions: DataFrame, call_sites: DataFrame) -> Snapshot:
    """A snapshot from scratch."""
    symbols = cut(symbol_counts(functions))
    with hashed(functions.sparkSession):
        calls = cut(answer_calls(call_sites, file_packages(functions), lookups(symbols)))
    return Snapshot(functions, calls, symbols)


def changed_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """``file_path, change`` of two tables of ``path, ast_hash``: added, removed, modified."""
    a, b = (df.select(F.col("path").alias("file_path"), F.col("ast_hash").alias(h)) for df, h in ((old, "a"), (new, "b")))
    met = a.withColumn("__a", F.lit(True)).join(b.withColumn("__b", F.lit(True)), "file_path", "full")
    change = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "modified")
    return met.select("file_path", change.alias("change")).filter("change is not null")


def _in(rows: DataFrame, files: DataFrame, how: str = "left_semi") -> DataFrame:
    return rows.join(files, "file_path", how)


def _signed(gone: DataFrame, come: DataFrame) -> DataFrame:
    """The rows of two tables with ``n`` -1 and 1."""
    return gone.withColumn("n", F.lit(-1)).unionByName(come.withColumn("n", F.lit(1)))


def symbol_diff(symbols: DataFrame, gone: DataFrame, come: DataFrame) -> DataFrame:
    """``qualified_name, change``: added, removed, or modified in signature or hash.

    ``symbols`` are the counts before; ``gone`` and ``come`` the functions of changed
    files.  A name that still has another definition isn't removed but modified.
    """
    columns = ["qualified_name", "signature", "ast_hash"]
    # equal definitions on both sides cancel out
    moved = _signed(gone.select(columns), come.select(columns)).groupBy(columns).agg(F.sum("n").alias("n")).filter("n <> 0")
    names = moved.groupBy("qualified_name").agg(F.sum("n").alias("delta"))
    before = symbols.filter("kind = 'q'").select("qualified_name", F.col("n").alias("before"))
    met = names.join(before, "qualified_name", "left").withColumn("before", F.coalesce("before", F.lit(0)))
    change = F.when(F.col("before") == 0, "added").when(F.col("before") + F.col("delta") == 0, "removed").otherwise("modified")
    return met.select("qualified_name", change.alias("change"))


def recounted(counts: DataFrame, delta: DataFrame) -> DataFrame:
    """``counts`` after ``delta``, both of ``COUNTED`` and ``n``; only touched rows are summed."""
    touched = few(delta.select(COUNTED))
    kept = counts.join(touched, COUNTED, "left_anti")
    again = counts.join(touched, COUNTED, "left_semi").unionByName(delta).groupBy(COUNTED).agg(F.sum("n").alias("n")).filter("n > 0")
    return kept.unionByName(again)


def changed_answers(before: DataFrame, after: DataFrame, delta: DataFrame) -> DataFrame:
    """``kind, name`` of what is found otherwise, or no longer, or now."""
    names = few(cut(delta.select("kind", "name").distinct()))
    a, b = (lookups(x.join(names, ["kind", "name"], "left_semi")).withColumnRenamed("found", c) for x, c in ((before, "a"), (after, "b")))
    return names.join(a, ["kind", "name"], "left").join(b, ["kind", "name"], "left").filter(~F.col("a").eqNullSafe(F.col("b"))).select("kind", "name")


def edges_delta(kept: DataFrame, gone: DataFrame, come: DataFrame) -> DataFrame:
    """``src, dst, change``: edges ``gained`` and ``lost``.

    ``gone`` and ``come`` are calls with their old and new targets, ``kept`` those
    that stay as they are; an edge with another call left isn't lost.
    """
    edge = lambda calls: calls.filter(is_internal("target")).select(F.col("caller").alias("src"), F.col("target").alias("dst"))
    sides = _signed(edge(gone), edge(come)).groupBy("src", "dst").agg(F.max(F.col("n") == -1).alias("was"), F.max(F.col("n") == 1).alias("is"))
    moved = few(cut(sides.filter("was <> is")))
    still = edge(kept).join(few(moved.select("src", "dst")), ["src", "dst"], "left_semi").distinct()
    change = F.when(F.col("is"), "gained").otherwise("lost")
    return moved.join(still, ["src", "dst"], "left_anti").select("src", "dst", change.alias("change"))


class Update:
    """An index after ``files(file_path)`` changed to ``functions`` and ``call_sites``.

    Every part is made when it is first asked for: the new ``snapshot``; ``counts``, its
    symbols alone; ``symbols(qualified_name, change)`` and ``edges(src, dst, change)``,
    what changed; and the kept calls that were ``probed`` again.
    """

    def __init__(self, old: Snapshot, files: DataFrame, functions: DataFrame, call_sites: DataFrame):
        self.old, self.functions, self.call_sites = old, functions, call_sites
        self.files = few(cut(files.select("file_path").distinct()))

    @cached_property
    def _delta(self) -> DataFrame:
        gone = symbol_counts(_in(self.old.functions, self.files)).withColumn("n", -F.col("n"))
        signed = gone.unionByName(symbol_counts(self.functions))
        return cut(signed.groupBy(COUNTED).agg(F.sum("n").alias("n")).filter("n <> 0"))

    @cached_property
    def counts(self) -> DataFrame:
        return cut(recounted(self.old.symbols, self._delta))

    @cached_property
    def _kept(self) -> DataFrame:
        return _in(self.old.calls, self.files, "left_anti")

    @cached_property
    def _now(self) -> DataFrame:
        kept = _in(self.old.functions, self.files, "left_anti")
        return kept.unionByName(self.functions.select(kept.columns))

    @cached_property
    def _asking(self) -> DataFrame:
        """``file_path, raw`` of the kept calls whose answer may be another."""
        answers = few(cut(changed_answers(self.old.symbols, self.counts, self._delta)))
        asking = probes(asked_in(self._kept, file_packages(self._now))).join(answers, ["kind", "name"], "left_semi")
        return few(cut(asking.select("file_path", "raw").distinct()))

    @cached_property
    def probed(self) -> DataFrame:
        return self._kept.join(self._asking, ["file_path", "raw"], "left_semi")

    @cached_property
    def _still(self) -> DataFrame:
        return self._kept.join(self._asking, ["file_path", "raw"], "left_anti")

    @cached_property
    def _new(self) -> DataFrame:
        calls = self.probed.unionByName(self.call_sites, allowMissingColumns=True)
        found = lookups(self.counts)
        with hashed(calls.sparkSession):
            return cut(answer_calls(calls, file_packages(self._now), found))

    @cached_property
    def snapshot(self) -> Snapshot:
        return Snapshot(self._now, self._still.unionByName(self._new.select(self._still.columns)), self.counts)

    @cached_property
    def symbols(self) -> DataFrame:
        return symbol_diff(self.old.symbols, _in(self.old.functions, self.files), self.functions)

    @cached_property
    def edges(self) -> DataFrame:
        gone = _in(self.old.calls, self.files).unionByName(self.probed)
        return edges_delta(self._still, gone, self._new)


def update(old: Snapshot, files: DataFrame, functions: DataFrame, call_sites: DataFrame) -> Update:
    """The snapshot after ``files(file_path)`` changed to ``functions`` and ``call_sites``."""
    return Update(old, files, functions, call_sites)
