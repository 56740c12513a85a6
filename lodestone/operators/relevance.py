"""How much functions matter, and what of a result fits into a budget of tokens.

Defined results: a call weighs as often as it occurs; calls from or to what isn't
in the index have no part in ``pagerank``.  Without functions there are no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import is_internal
from ..session import cut
from .graph import known_edges

DAMPING = 0.85
#: Characters that count as one token.
TOKEN_CHARS = 4


def call_frequency(resolved: DataFrame) -> DataFrame:
    """``target, weight``: how often each target is called."""
    return resolved.groupBy("target").agg(F.count("*").alias("weight"))


def weighted_edges(resolved: DataFrame) -> DataFrame:
    """``src, dst, n``: edges with their number of calls."""
    return resolved.filter(is_internal("target")).groupBy(F.col("caller").alias("src"), F.col("target").alias("dst")).agg(F.count("*").alias("n"))


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = DAMPING, tolerance: float = 1e-9, most: int = 200) -> DataFrame:
    """``qualified_name, rank``: the share of a walk along ``edges(src, dst, n)``.

    The walk takes an edge by its weight, and with ``1 - damping`` any node; from a
    node without edges out it goes to any node.  Rounds end when all ranks together
    move by ``tolerance`` at most, or after ``most``.  A round is a join and a sum by
    node; the driver sees two sums.
    """
    nodes = cut(nodes.select(F.col("qualified_name").alias("node")).distinct())
    size = nodes.count()
    if not size:
        return nodes.select(F.col("node").alias("qualified_name"), F.lit(0.0).alias("rank"))
    inside = known_edges(nodes.withColumnRenamed("node", "qualified_name"), edges.select("src", "dst")).distinct()
    edges = edges.join(inside, ["src", "dst"], "left_semi")
    total = edges.groupBy("src").agg(F.sum("n").alias("total"))
    shares = cut(edges.join(total, "src").select("src", "dst", (F.col("n") / F.col("total")).alias("share")))
    ends = shares.select(F.col("src").alias("node")).distinct().withColumn("goes_on", F.lit(True))
    ranks = cut(nodes.join(ends, "node", "left").select("node", F.coalesce("goes_on", F.lit(False)).alias("goes_on"), F.lit(1.0 / size).alias("rank"), F.lit(1.0).alias("moved")))
    for _ in range(most):
        lost, moved = ranks.agg(F.sum(F.when(~F.col("goes_on"), F.col("rank")).otherwise(0.0)), F.sum("moved")).first()
        if moved <= tolerance:
            break
        got = shares.join(ranks.select(F.col("node").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        new = F.lit((1 - damping) / size) + F.lit(damping) * (F.coalesce("got", F.lit(0.0)) + F.lit(lost / size))
        ranks = cut(ranks.join(got, "node", "left").select("node", "goes_on", new.alias("rank"), F.abs(new - F.col("rank")).alias("moved")))
    return ranks.select(F.col("node").alias("qualified_name"), "rank")


def tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / TOKEN_CHARS)


def running_total(rows: DataFrame, order: list[Column], cost: str) -> DataFrame:
    """``rows`` with ``total``: the sum of ``cost`` up to each row in ``order``.

    Rows are dealt out by ranges of the order, summed within each range, and what
    the ranges before it hold is added: one row for each range, never all rows in
    one window.  ``order`` must tell all rows apart.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(rows.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("__part").agg(F.sum(cost).alias("__sum"))
    offsets = sums.select("__part", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"))  # a row for each range
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = dealt.withColumn("__own", F.sum(cost).over(inside)).join(F.broadcast(offsets), "__part")
    return met.select(*rows.columns, (F.col("__own") + F.col("__before")).alias("total"))


def within_budget(rows: DataFrame, order: list[Column], cost: str, budget: int) -> DataFrame:
    """The first ``rows`` in ``order`` whose ``total`` cost stays in ``budget``."""
    return running_total(rows, order, cost).filter(F.col("total") <= budget)


def budgeted(trace: DataFrame, budget: int) -> DataFrame:
    """The rows of a trace with ``relevance`` that fit into ``budget`` tokens.

    The least relevant rows go first, among equals the deepest.  No row is more
    relevant than the one above it, so whole branches go and what stays is a tree.
    """
    order = [F.desc_nulls_first("relevance"), F.asc("level"), F.asc("root"), F.asc("root_file"), F.asc("sort_path")]
    cost = trace.withColumn("__cost", tokens(F.col("line_text")))
    return within_budget(cost, order, "__cost", budget).drop("__cost")
