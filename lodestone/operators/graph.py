"""The call graph: edges, strongly connected components, dependency levels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import is_internal
from ..session import cut

#: Rounds of the cheapest kind, which shallow graphs end in.
PEELS = 16


def call_edges(resolved: DataFrame) -> DataFrame:
    """``src, dst``: distinct calls to functions of the index."""
    return resolved.filter(is_internal("target")).select(F.col("caller").alias("src"), F.col("target").alias("dst")).distinct()


def known_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges of which both ends are in ``nodes(qualified_name)``."""
    source, target = nodes.select(F.col("qualified_name").alias("src")), nodes.select(F.col("qualified_name").alias("dst"))
    return edges.join(source, "src", "left_semi").join(target, "dst", "left_semi").select("src", "dst")


def reverse_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return known_edges(nodes, edges).select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def out_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.count("*").alias("n_callees"))


def _peel(edges: DataFrame) -> tuple[list[DataFrame], DataFrame | None]:
    """Take away edges to nodes that call nothing, ``PEELS`` rounds at most.

    A node of level ``n`` calls something in the first ``n`` rounds and no longer.
    Returns the edges that each round began with, and those that are left, None
    without any: edges into cycles, and what is deeper than the rounds.
    """
    rounds, now = [], edges
    left = now.count()
    while left and len(rounds) < PEELS:
        then = cut(now.join(now.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        count = then.count()
        if count == left:
            break
        rounds.append(now)
        now, left = then, count
    return rounds, now if left else None


def _turned(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def _lone(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``node, next`` of nodes with one edge out, and ``node`` of those with several."""
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n"), F.min("dst").alias("next"))
    return out.filter("n = 1").select("node", "next"), out.filter("n > 1").select("node")


def _doubled(lone: DataFrame) -> tuple[list[DataFrame], DataFrame, DataFrame | None]:
    """Follow single edges out by doubling steps.

    Every round each ``node`` that still points at a lone one takes over what that
    one points at, so a path of ``n`` nodes is passed in ``log2(n)`` rounds.
    Returns the rounds' pointers ``node, next`` (2 ** k steps, as long as they stay
    among lone nodes), ``node, next`` with the first node that isn't lone, and
    ``node, label`` of closed loops, None without any.
    """
    total, rounds, ended, steps = lone.count(), [], None, 1
    names = lone.select(F.col("node").alias("next"), F.lit(True).alias("__on"))
    now = lone.withColumn("label", F.least("node", "next"))
    while True:
        met = cut(now.join(names, "next", "left").select("node", "next", "label", F.col("__on").isNotNull().alias("on")))
        open_, done = met.filter("on"), met.filter("NOT on").select("node", "next")
        ended = done if ended is None else ended.unionByName(done)
        left = open_.count()
        if not left or steps >= total:
            break
        rounds.append(open_.select("node", "next"))
        ahead = open_.select(F.col("node").alias("next"), F.col("next").alias("then"), F.col("label").alias("__label"))
        ahead = ahead.unionByName(ended.select(F.col("node").alias("next"), F.col("next").alias("then"), F.lit(None).cast("string").alias("__label")))
        now = open_.join(ahead, "next").select("node", F.col("then").alias("next"), F.least("label", "__label").alias("label"))
        steps *= 2
    if not left:
        return rounds, ended, None
    # after that many steps only the nodes of loops are pointed at, and a loop node has met its whole loop
    on = open_.select(F.col("next").alias("node")).distinct()
    return rounds, ended, open_.join(on, "node", "left_semi").select("node", "label")


def _labelled(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """``labels(node, label)`` with the least label that reaches each node by one edge more."""
    sent = edges.join(labels, F.col("src") == F.col("node")).select(F.col("dst").alias("node"), "label")
    return labels.unionByName(sent).groupBy("node").agg(F.min("label").alias("label"))


def _pivots(core: DataFrame) -> DataFrame:
    """``node, label`` of some components of a graph where every node has several edges.

    Every node takes the least label that reaches it; a node that keeps its own
    is a pivot, and what reaches it among nodes of its label is its component.
    """
    nodes = core.select(F.col("src").alias("node")).unionByName(core.select(F.col("dst").alias("node"))).distinct()
    labels, mark = cut(nodes.withColumn("label", F.col("node"))), None
    while True:
        labels = cut(_labelled(core, labels))
        now = labels.agg(F.sum(F.xxhash64("node", "label").cast("decimal(20,0)"))).first()[0]
        if now == mark:
            break
        mark = now
    alike = core.join(labels.withColumnRenamed("node", "src").withColumnRenamed("label", "a"), "src")
    alike = cut(alike.join(labels.withColumnRenamed("node", "dst").withColumnRenamed("label", "b"), "dst").filter("a = b").select("src", "dst", F.col("a").alias("label")))
    reached, size = labels.filter("node = label"), -1
    while True:
        back = alike.join(reached.select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("src").alias("node"), "label")
        reached = cut(reached.unionByName(back).distinct())
        count = reached.count()
        if count == size:
            return reached.select("node", "label")
        size = count


def cyclic_components(edges: DataFrame) -> DataFrame | None:
    """``node, scc_id`` of the nodes on cycles of two and more; None without any.

    A few rounds first take away what calls nothing, and what nothing calls.  Of the
    rest, nodes with one edge out are taken out of the graph together: what points at one
    points at the first node behind it that has several, or at nothing if the path
    ends or runs into a loop.  Loops are components; the rest, a graph of nodes with
    several edges, goes on until nothing is left.  Where no node can be taken out,
    components are sought by labels that spread edge by edge.  Nodes that were taken
    out belong to the component of the edge that enters their path, if both of its
    ends lie in one.  Rounds grow with the logarithm of paths and loops of single
    edges, and with the diameter of parts in which every node has several edges.
    """
    _, now = _peel(cut(edges.filter("src <> dst").select("src", "dst").distinct()))
    if now is not None:
        _, now = _peel(_turned(now))
    if now is None:
        return None
    now, found, passed = cut(_turned(now)), [], []
    left = now.count()
    while left:
        lone, several = (cut(x) for x in _lone(now))
        rounds, ends, loops = _doubled(lone)
        if loops is not None:
            found.append(cut(loops))
        entering = now.join(several.withColumnRenamed("node", "src"), "src", "left_semi")
        met = entering.join(ends.select(F.col("node").alias("dst"), F.col("next").alias("end")), "dst", "left").join(lone.select(F.col("node").alias("dst"), F.lit(True).alias("lone")), "dst", "left")
        met = met.select("src", "dst", F.when(F.col("lone"), F.col("end")).otherwise(F.col("dst")).alias("end"), F.coalesce("lone", F.lit(False)).alias("lone"))
        met = cut(met.join(several.withColumnRenamed("node", "end"), "end", "left_semi").select("src", "dst", "end", "lone"))
        passed.append((rounds, met.filter("lone").select("src", "dst", "end")))
        now = cut(met.select("src", F.col("end").alias("dst")).filter("src <> dst").distinct())
        count = now.count()
        if count == left:
            found.append(_pivots(now))
            gone = found[-1].select("node")
            now = cut(now.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"))
            count = now.count()
        left = count
    whole = None
    for x in found:
        whole = x if whole is None else whole.unionByName(x)
    for rounds, entries in reversed(passed):
        whole = _entered(whole, rounds, entries)
    if whole is None:
        return None
    whole = cut(whole)
    several = whole.groupBy("label").agg(F.count("*").alias("n"), F.min("node").alias("scc_id")).filter("n > 1")
    out = cut(whole.join(several, "label").select("node", "scc_id"))
    return out if out.limit(1).count() else None


def _entered(whole: DataFrame | None, rounds: list[DataFrame], entries: DataFrame) -> DataFrame | None:
    """``whole`` with the lone nodes on paths that lead from a component back into it."""
    own = entries.filter("src = end").select(F.col("src").alias("node")).distinct()
    known = own.withColumn("label", F.col("node"))
    if whole is not None:
        known = whole.unionByName(known.join(whole, "node", "left_anti"))
    a, b = known.select(F.col("node").alias("src"), "label"), known.select(F.col("node").alias("end"), F.col("label").alias("to"))
    marked = cut(entries.join(a, "src").join(b, "end").filter("label = to").select(F.col("dst").alias("node"), "label").distinct())
    if not marked.limit(1).count():
        return whole
    for pointers in reversed(rounds):
        ahead = marked.join(pointers, "node").select(F.col("next").alias("node"), "label")
        marked = cut(marked.unionByName(ahead).distinct())
    return cut(known.unionByName(marked).distinct())


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``qualified_name, scc_id`` of every node; ``scc_id`` is the least member."""
    nodes = nodes.select("qualified_name").distinct()
    cyclic = cyclic_components(known_edges(nodes, edges))
    if cyclic is None:
        return nodes.select("qualified_name", F.col("qualified_name").alias("scc_id"))
    met = nodes.join(cyclic, F.col("qualified_name") == F.col("node"), "left")
    return met.select("qualified_name", F.coalesce("scc_id", "qualified_name").alias("scc_id"))


def condensed(edges: DataFrame, scc: DataFrame) -> DataFrame:
    """Distinct edges between components."""
    source = scc.select(F.col("qualified_name").alias("src"), F.col("scc_id").alias("a"))
    target = scc.select(F.col("qualified_name").alias("dst"), F.col("scc_id").alias("b"))
    return edges.join(source, "src").join(target, "dst").filter("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()


def _composed(lone: DataFrame) -> DataFrame:
    """``node, base, far, end``: a lone node's level is the greater of ``base`` and
    ``far`` plus the level of ``end``, the first node behind it that isn't lone.

    ``lone(node, base, far, next)`` says so for the next node; two such steps make
    one, so each round doubles the way.
    """
    names, ended, now = lone.select(F.col("node").alias("next"), F.lit(True).alias("__on")), None, lone
    while True:
        met = cut(now.join(names, "next", "left").select("node", "base", "far", "next", F.col("__on").isNotNull().alias("on")))
        open_, done = met.filter("on").drop("on"), met.filter("NOT on").select("node", "base", "far", F.col("next").alias("end"))
        ended = done if ended is None else ended.unionByName(done)
        if not open_.limit(1).count():
            return ended
        ahead = open_.select(F.col("node").alias("next"), F.col("base").alias("b"), F.col("far").alias("f"), F.col("next").alias("then"))
        ahead = ahead.unionByName(ended.select(F.col("node").alias("next"), F.col("base").alias("b"), F.col("far").alias("f"), F.col("end").alias("then")))
        met = open_.join(ahead, "next")
        now = met.select("node", F.greatest("base", F.col("far") + F.col("b")).alias("base"), (F.col("far") + F.col("f")).alias("far"), F.col("then").alias("next"))


def dag_levels(edges: DataFrame) -> DataFrame:
    """``node, level`` of the nodes of an acyclic graph: the longest way to a node
    without edges out.

    The first levels are peeled off round by round; a node that is left lies above
    them by what ``_deep_levels`` says.
    """
    rounds, rest = _peel(cut(edges.select("src", "dst").distinct()))
    ends = edges.select(F.col("dst").alias("node"), F.lit(0).cast("long").alias("level"))
    for r in rounds:
        ends = ends.unionByName(r.select(F.col("src").alias("node"), F.lit(1).cast("long").alias("level")).distinct())
    levels_ = ends.groupBy("node").agg(F.sum("level").alias("level"))
    if rest is None:
        return levels_
    deep = _deep_levels(rest).select("node", (F.col("level") + len(rounds)).alias("level"))
    return deep.unionByName(levels_.join(deep, "node", "left_anti"))


def _deep_levels(edges: DataFrame) -> DataFrame:
    """``node, level``, in rounds that don't grow with the length of paths.

    A round takes out what has no edge left (its level is known), and all nodes with
    one edge left (their level is a function of another node's).  The edges of the
    others pass over these, keeping the longest of several ways.  Rounds grow with
    how deep nodes with several edges are nested.
    """
    one = F.lit(1).cast("long")
    now = cut(edges.select("src", "dst").distinct().withColumn("far", one))
    nodes = now.select(F.col("src").alias("node")).unionByName(now.select(F.col("dst").alias("node"))).distinct()
    bases, known, passed = cut(nodes.withColumn("base", one - 1)), None, []
    while bases.limit(1).count():
        out = now.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n"), F.min_by("dst", "far").alias("next"), F.max("far").alias("far"))
        state = cut(bases.join(out, "node", "left"))
        level = state.filter("n IS NULL").select("node", F.col("base").alias("level"))
        known = level if known is None else known.unionByName(level)
        lone = _composed(state.filter("n = 1").select("node", "base", "far", "next"))
        # the end of a lone node's way is known, or one of several edges
        ways = cut(lone.join(level.select(F.col("node").alias("end"), "level"), "end", "left").select("node", "base", "far", "end", "level"))
        over = ways.filter("level IS NULL")
        known = known.unionByName(ways.filter("level IS NOT NULL").select("node", F.greatest("base", F.col("far") + F.col("level")).alias("level")))
        passed.append(over.select("node", "base", "far", "end"))
        several = state.filter("n > 1").select("node", "base")
        mine = now.join(several.select(F.col("node").alias("src")), "src", "left_semi")
        sure = level.select(F.col("node").alias("dst"), F.col("level").alias("base"), F.lit(None).cast("long").alias("further"), F.lit(None).cast("string").alias("end"))
        sure = sure.unionByName(ways.select(F.col("node").alias("dst"), F.greatest("base", F.col("far") + F.coalesce("level", -F.col("far"))).alias("base"), F.when(F.col("level").isNull(), F.col("far")).alias("further"), F.when(F.col("level").isNull(), F.col("end")).alias("end")))
        met = cut(mine.join(sure, "dst", "left"))
        gained = met.filter("base IS NOT NULL").groupBy(F.col("src").alias("node")).agg(F.max(F.col("far") + F.col("base")).alias("more"))
        bases = cut(several.join(gained, "node", "left").select("node", F.greatest("base", F.coalesce("more", "base")).alias("base")))
        kept = met.filter("base IS NULL").select("src", "dst", "far")
        moved = met.filter("further IS NOT NULL").select("src", F.col("end").alias("dst"), (F.col("far") + F.col("further")).alias("far"))
        now = cut(kept.unionByName(moved).groupBy("src", "dst").agg(F.max("far").alias("far")))
    if known is None:
        return nodes.select("node", (one - 1).alias("level"))
    known = cut(known)
    for over in reversed(passed):
        if over.limit(1).count():
            met = over.join(known.select(F.col("node").alias("end"), "level"), "end")
            known = cut(known.unionByName(met.select("node", F.greatest("base", F.col("far") + F.col("level")).alias("level"))))
    return known


def rank(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``qualified_name, scc_id, level``: 0 for what calls nothing outside its
    component, else one more than the highest level it calls."""
    nodes = nodes.select("qualified_name").distinct()
    inner = cut(known_edges(nodes, edges).filter("src <> dst").distinct())
    cyclic = cyclic_components(inner)
    if cyclic is None:
        scc, dag = nodes.select("qualified_name", F.col("qualified_name").alias("scc_id")), inner
    else:
        met = nodes.join(cyclic, F.col("qualified_name") == F.col("node"), "left")
        scc = cut(met.select("qualified_name", F.coalesce("scc_id", "qualified_name").alias("scc_id")))
        dag = condensed(inner, scc)
    found = dag_levels(dag).select(F.col("node").alias("scc_id"), "level")
    return scc.join(found, "scc_id", "left").select("qualified_name", "scc_id", F.coalesce("level", F.lit(0)).cast("long").alias("level"))


def levels(ranks: DataFrame) -> DataFrame:
    """``level, functions``: the names of each level in order."""
    return ranks.groupBy("level").agg(F.array_sort(F.collect_list("qualified_name")).alias("functions"))


def rank_histogram(ranks: DataFrame) -> DataFrame:
    return ranks.groupBy("level").agg(F.count("*").alias("n_functions"))


def topology_stats(functions: DataFrame, edges: DataFrame, ranks: DataFrame) -> DataFrame:
    """One row: definitions, distinct and repeated ones, callers, ranked ones."""
    # each side is one row
    return (
        functions.agg(F.count("*").alias("n_definitions"), F.countDistinct("qualified_name").alias("n_functions"))
        .withColumn("n_repeated", F.col("n_definitions") - F.col("n_functions"))
        .crossJoin(edges.agg(F.countDistinct("src").alias("n_callers")))
        .crossJoin(ranks.agg(F.count("*").alias("n_ranked"), F.max("level").alias("top_level")))
    )
