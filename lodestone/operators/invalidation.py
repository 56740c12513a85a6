"""Summaries that no longer hold (extension), told by stamps stored beside them.

A function's stamp is its own hash and a sum of hashes of its callees' names and
signatures.  The sum doesn't depend on order, so tasks add up their parts first and
a function that calls very many needs no list of them.  A callee's stamp or hash
isn't part of it: a change of a signature reaches the direct callers and no further.

Defined results: repeated definitions go by the last one, repeated calls of one
callee count once, external targets don't count.  A function without a hash (null
or empty) is always stale.  A summary under a name that is gone is not kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import call_edges
from .resolve import definitions

STAMP = ["qualified_name", "own", "n_callees", "callees"]


def stamps(functions: DataFrame, resolved: DataFrame) -> DataFrame:
    """``qualified_name, own, n_callees, callees`` of every function."""
    last = definitions(functions)
    said = last.select(F.col("qualified_name").alias("dst"), F.xxhash64("qualified_name", "signature").cast("decimal(38,0)").alias("h"))
    sums = call_edges(resolved).join(said, "dst").groupBy("src").agg(F.count("*").alias("n"), F.sum("h").alias("sum"))
    met = last.select("qualified_name", F.coalesce("ast_hash", F.lit("")).alias("own")).join(sums, F.col("qualified_name") == F.col("src"), "left")
    zero = F.lit(0).cast("decimal(38,0)")
    return met.select("qualified_name", "own", F.coalesce("n", F.lit(0)).alias("n_callees"), F.coalesce(F.col("sum").cast("decimal(38,0)"), zero).alias("callees"))


def stamped(functions: DataFrame, resolved: DataFrame) -> DataFrame:
    """What is stored: the stamp and ``summary`` of every function that has one."""
    said = definitions(functions).filter("summary is not null").select("qualified_name", "summary")
    return stamps(functions, resolved).join(said, "qualified_name")


def stale(stored: DataFrame, now: DataFrame) -> DataFrame:
    """``qualified_name`` of the functions in ``now`` (stamps) without a stored summary that holds."""
    good = stored.filter("own <> ''").select(STAMP)
    return now.join(good, STAMP, "left_anti").select("qualified_name")


def stale_reasons(stored: DataFrame, now: DataFrame) -> DataFrame:
    """``qualified_name, reason``: ``new``, ``own``, ``callees`` or ``both`` for each stale one."""
    was = stored.select("qualified_name", F.struct(*STAMP[1:]).alias("was")).groupBy("qualified_name").agg(F.first("was").alias("was"))
    met = now.join(stale(stored, now), "qualified_name", "left_semi").join(was, "qualified_name", "left")
    own = (F.col("own") != F.col("was.own")) | (F.col("own") == "")
    other = (F.col("n_callees") != F.col("was.n_callees")) | (F.col("callees") != F.col("was.callees"))
    reason = F.when(F.col("was").isNull(), "new").when(own & other, "both").when(own, "own").otherwise("callees")
    return met.select("qualified_name", reason.alias("reason"))


def keep_summaries(functions: DataFrame, resolved: DataFrame, stored: DataFrame) -> DataFrame:
    """``functions`` with the stored ``summary`` where its stamp still holds, else null."""
    good = stored.filter("own <> ''").groupBy(STAMP).agg(F.min("summary").alias("__kept"))
    kept = stamps(functions, resolved).join(good, STAMP).select(F.col("qualified_name").alias("__q"), "__kept")
    met = functions.join(kept, F.col("qualified_name") == F.col("__q"), "left")
    return met.select(*(F.col("__kept").alias(c) if c == "summary" else F.col(c) for c in functions.columns))
