"""Resolution by what a file can see (extension): imports, their closure, confidence.

``imports`` reads the directives of source texts, ``import_edges`` finds the files
they mean, ``include_closure`` what each file reaches, and ``resolve_scoped``
answers every text that a file calls from the nearest scope that defines it.
``numbered_closure`` keeps numbers of files in place of their paths.

Defined results: null texts and paths give no directive and no edge; a file never
includes itself; repeated directives count once; a definition that is repeated
within a file counts once, one that several files repeat counts for each of them.
Empty tables give empty tables.  Texts that nothing defines stay, as unresolved.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.externals import categorized
from ..functions.names import col, last_two_parts, n_parts, package_of
from ..schemas import UNRESOLVED
from ..session import FEW_BYTES, FEW_ROWS, TASK_ROWS, cut, dealt_for, numbered
from .resolve import file_packages

#: What a directive looks like in each language; the first group is what it names.
DIRECTIVES = {
    "c": r'(?m)^[ \t]*#[ \t]*include[ \t]*[<"]([^>"\n]+)[>"]',
    "go": r'(?m)^(?:import[ \t]+|[ \t]+)(?:[\w.]+[ \t]+)?"([^"\n]+)"[ \t\r]*$',
    "rust": r"(?m)^[ \t]*(?:pub(?:\([^)\n]*\))?[ \t]+)?mod[ \t]+(\w+)[ \t]*;",
}
#: Pairs of a closure that a round sends to all tasks at most.
SENT_ROWS = 1 << 20
#: Values that a sketch of frequent ones gives at most; rows that ask for a key, and
#: definitions of it, above which it is taken for frequent.
FREQUENT, KEY_ASKED, KEY_DEFINED = 1 << 12, 1 << 16, 1 << 10
#: Scopes from near to far, and whether a match in it is a direct dependency.
SCOPES = {"file": True, "package": True, "include": True, "indirect": False, "standard": False, "elsewhere": False, "none": False}


def normal_path(path: Column | str) -> Column:
    """A path without ``.`` and empty parts, and with ``..`` carried out."""
    up = lambda done: F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
    step = lambda done, part: F.when(part == "..", up(done)).when(part.isin("", "."), done).otherwise(F.array_append(done, part))
    return F.array_join(F.aggregate(F.split(col(path), "/"), F.array().cast("array<string>"), step), "/")


def directory(path: Column | str) -> Column:
    """The directory of a normal path; empty at the root."""
    return F.regexp_extract(col(path), r"^(.*)/[^/]*$", 1)


def ancestors(path: Column | str) -> Column:
    """The directories above a normal path, the root (empty) first."""
    parts = F.slice(F.split(col(path), "/"), F.lit(1), F.size(F.split(col(path), "/")) - 1)
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def suffixes(path: Column | str) -> Column:
    """A normal path and what is left of it without its first directories."""
    parts = F.split(col(path), "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, n, F.size(parts)), "/"))


def imports(files: DataFrame) -> DataFrame:
    """``file_path, lang, raw``: each directive of ``files(path, lang, text)``, once a file."""
    found = F.array().cast("array<string>")
    for lang, pattern in DIRECTIVES.items():
        found = F.when(F.col("lang") == lang, F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).otherwise(found)
    return files.select(F.col("path").alias("file_path"), "lang", F.explode(F.array_distinct(found)).alias("raw")).filter("file_path is not null")


def import_edges(directives: DataFrame, files: DataFrame) -> DataFrame:
    """``file_path, dep``: the files of ``files(path)`` that directives mean.

    C: the path from the file's own directory, else the file whose path ends with
    it (of several the first by path).  Rust: the module's file beside or below the
    file.  Go: every file of the directory whose path ends with the import (of
    several directories the first).  What names no file of the table has no edge.
    Endings are looked up in one row each, so a common file name meets one file.
    """
    paths = files.filter("path is not null").select("path", normal_path("path").alias("at")).distinct()
    here, own = normal_path("file_path"), directory(F.col("here"))
    asked = directives.select("file_path", "lang", "raw", here.alias("here")).withColumn("own", own)
    stem = F.regexp_extract("here", r"([^/]*?)(?:\.[^./]*)?$", 1)
    inner = F.when(stem.isin("mod", "lib", "main"), F.col("own")).otherwise(F.concat_ws("/", "own", stem))
    exact = F.when(F.col("lang") == "c", F.array(F.concat_ws("/", "own", "raw"))).when(
        F.col("lang") == "rust", F.array(F.concat(inner, F.lit("/"), "raw", F.lit(".rs")), F.concat(inner, F.lit("/"), "raw", F.lit("/mod.rs")))
    )
    asked = asked.withColumn("tries", F.transform(exact, normal_path))
    tried = asked.select("file_path", "lang", "raw", F.posexplode("tries").alias("rank", "at"))
    first = tried.join(paths, "at").groupBy("file_path", "lang", "raw").agg(F.min_by("path", "rank").alias("dep"))
    ended = paths.select(F.explode(suffixes("at")).alias("ending"), "path").groupBy("ending").agg(F.min("path").alias("dep"))
    # only what isn't found from the own directory is looked for by its ending
    left = asked.filter("lang = 'c'").join(first.select("file_path", "lang", "raw"), ["file_path", "lang", "raw"], "left_anti")
    second = left.withColumn("ending", normal_path("raw")).join(ended, "ending")
    homes = paths.select(directory("at").alias("home"), "path")
    named = homes.select("home").distinct().select(F.explode(suffixes("home")).alias("ending"), "home").groupBy("ending").agg(F.min("home").alias("home"))
    third = asked.filter("lang = 'go'").withColumn("ending", normal_path("raw")).join(named, "ending").join(homes, "home")
    every = first.select("file_path", "dep").unionByName(second.select("file_path", "dep")).unionByName(third.select("file_path", F.col("path").alias("dep")))
    return every.filter("file_path <> dep").distinct()


def numbered_closure(edges: DataFrame, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``path, node`` of the files of ``edges``, and ``file_path, dep, depth`` of
    ``include_closure`` with the files' numbers in place of their paths.

    Semi-naive, with spans that double: once all pairs up to ``span`` steps are known,
    those of exactly ``span`` steps are joined with all known ones, and only pairs that
    are new go on.  A pair farther away has a shortest way through such a pair, so
    depths are exact and the rounds are logarithmic in the longest.
    """
    direct = edges.filter("file_path is not null and dep is not null and file_path <> dep").select("file_path", "dep").distinct()
    nodes = numbered(direct.select(F.explode(F.array("file_path", "dep")).alias("path")), "node")
    of = lambda name: nodes.select(F.col("path").alias(name), F.col("node").alias(f"__{name}"))
    met = direct.join(of("file_path"), "file_path").join(of("dep"), "dep")
    found, span = [cut(met.select(F.col("__file_path").alias("file_path"), F.col("__dep").alias("dep"), F.lit(1).alias("depth")))], 1
    while most is None or span < most:
        ends = found[-1].filter(F.col("depth") == span).select("file_path", F.col("dep").alias("via"))
        if ends.isEmpty():
            break
        new = _farther(reduce(DataFrame.unionByName, found), ends, span, most)
        if new is None or new.isEmpty():
            break
        found.append(new)
        span *= 2
    return nodes, reduce(DataFrame.unionByName, found)


def _farther(known: DataFrame, ends: DataFrame, span: int, most: int | None) -> DataFrame | None:
    """The pairs of more than ``span`` steps, up to twice as many, written out; none if no way goes on.

    Most ways lead over few files.  What the most frequent of these reach, ``SENT_ROWS``
    pairs at most, is sent to all tasks, so their ways are made where the pairs of a file
    meet and aren't shuffled; ways over the others are.  The rows that a round will make
    are counted first, by the two degrees of each file in the middle, so that its tasks
    are many enough.
    """
    spark = known.sparkSession
    after = known.groupBy(F.col("file_path").alias("via")).agg(F.count("*").alias("after"))
    ways = after.join(ends.groupBy("via").agg(F.count("*").alias("before")), "via", "left").persist()
    often = F.floor(F.log2("before")).cast("int")
    short = F.col("after") <= SENT_ROWS >> 8
    sizes = ways.groupBy(often.alias("often")).agg(F.sum("after").alias("rows"), F.sum(F.when(short, F.col("after"))).alias("sent"), F.sum(F.col("before") * F.col("after")).alias("made"), F.max("after").alias("widest")).collect()
    made = sum(r.made or 0 for r in sizes)
    if not made:
        ways.unpersist()
        return None
    least, sent = _most_frequent([(r.often, r.sent or 0) for r in sizes if r.often is not None], SENT_ROWS)
    all_sent = sent == sum(r.rows for r in sizes if r.often is not None)
    hot = ways.filter(short & (often >= least)).select("via")
    onward = known.withColumnRenamed("file_path", "via").join(F.broadcast(hot), "via").select("via", F.col("dep").alias("__dep"), F.col("depth").alias("__depth")).persist()
    if all_sent:  # a known pair is needed where it goes on, and where it may be made again
        again = F.broadcast(onward.select(F.col("__dep").alias("dep"), F.lit(True).alias("again")).distinct())
        rows = known.join(again, "dep", "left").filter((F.col("depth") == span) | F.col("again")).select(known.columns)
    else:
        others = ends.join(F.broadcast(hot), "via", "left_anti")
        farther = known.select(F.col("file_path").alias("via"), "dep", (F.col("depth") + span).alias("depth"))
        rows = known.unionByName(others.join(farther, "via").filter("file_path <> dep").select(known.columns))
    most_rows = made + sum(r.rows for r in sizes)
    with dealt_for(spark, most_rows):
        if max(r.widest for r in sizes) <= TASK_ROWS:  # else one file's pairs are too many for one task
            rows = rows.repartition(-(-most_rows // TASK_ROWS), "file_path")
        goes = F.explode(F.when(F.col("depth") == span, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))).alias("goes")
        steps = rows.select("*", goes).withColumn("via", F.when(F.col("goes"), F.col("dep"))).join(F.broadcast(onward), "via", "left")
        pick = lambda on, here: F.when(F.col("goes"), on).otherwise(F.col(here)).alias(here)
        pairs = steps.select("file_path", pick(F.col("__dep"), "dep"), pick(F.col("__depth") + span, "depth")).filter("file_path <> dep")
        new = pairs.groupBy("file_path", "dep").agg(F.min("depth").alias("depth")).filter(F.col("depth") > span)
        if most is not None:
            new = new.filter(F.col("depth") <= most)
        # pairs of a file side by side compress well, here and in later shuffles
        new = cut(new.sortWithinPartitions("file_path", "depth"))
    ways.unpersist()
    onward.unpersist()
    return new


def _most_frequent(classes: list[tuple[int, int]], rows: int) -> tuple[int, int]:
    """Of ``(class, rows)`` the least class that can be taken with all above it within
    ``rows``, and the rows of these."""
    least, taken = max((c for c, _ in classes), default=0) + 1, 0
    for c, n in sorted(classes, reverse=True):
        if taken + n > rows:
            break
        least, taken = c, taken + n
    return least, taken


def include_closure(edges: DataFrame, most: int | None = None) -> DataFrame:
    """``file_path, dep, depth``: all files that each file reaches, and in how many steps.

    ``most`` bounds the depth where a caller wants only what is near.  Paths take the
    places of numbers last.  Those of the files that are reached most often, within
    ``session.few``, are sent to all tasks; pairs of other files are shuffled for them.
    """
    nodes, pairs = numbered_closure(edges, most)
    often = F.floor(F.log2("n")).cast("int")
    counted = cut(pairs.groupBy(F.col("dep").alias("node")).agg(F.count("*").alias("n")))
    sizes = counted.join(nodes, "node").groupBy(often.alias("often")).agg(F.count("*").alias("rows"), F.sum(F.octet_length("path")).alias("bytes")).collect()
    least = max(_most_frequent([(r.often, r.rows) for r in sizes], FEW_ROWS)[0], _most_frequent([(r.often, r.bytes) for r in sizes], FEW_BYTES)[0])
    hot = counted.filter(often >= least).select("node")
    names = F.broadcast(nodes.join(F.broadcast(hot), "node").select(F.col("node").alias("dep"), F.col("path").alias("__often")))
    hot = F.broadcast(hot.withColumnRenamed("node", "dep"))
    rare = _named(pairs.join(hot, "dep", "left_anti").withColumn("number", F.lit(None).cast("bigint")), nodes, "dep")
    rest = pairs.join(hot, "dep", "left_semi").withColumnRenamed("dep", "number").withColumn("dep", F.lit(None).cast("string"))
    rows = _named(rare.unionByName(rest), nodes, "file_path").join(names.withColumnRenamed("dep", "number"), "number", "left")
    return rows.select("file_path", F.coalesce("dep", "__often").alias("dep"), "depth")


def _named(rows: DataFrame, nodes: DataFrame, column: str) -> DataFrame:
    """``rows`` with the path of the file whose number stands in ``column``."""
    path = nodes.select(F.col("node").alias(column), F.col("path").alias("__path")).hint("shuffle_hash")
    return rows.join(path, column).drop(column).withColumnRenamed("__path", column)


def _counted(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.min("found").alias("found"))


def visible(asked: DataFrame, closure: DataFrame, defined: DataFrame) -> DataFrame:
    """``file_path, key, n, found, depth``: definitions in the nearest files that a file includes.

    ``asked(file_path, key)``, the closure and ``defined(key, dep, n, found)`` make a
    triangle.  Joining any two of them first can be far larger than the answer: a
    common name has a definition in every module, a main file includes everything.
    So each asked row is extended on its smaller side, by the files that define the
    key or by the files that the file includes, and the third table is then probed
    by both columns; no row makes more than the smaller of the two counts.  What is
    defined joins only the rows that are left.
    """
    n_files = defined.groupBy("key").agg(F.count("*").alias("n_files"))
    n_deps = closure.groupBy("file_path").agg(F.count("*").alias("n_deps"))
    sized = cut(asked.join(n_files, "key").join(n_deps, "file_path"))
    places = defined.select("key", "dep")
    by_key = sized.filter("n_files <= n_deps").select("file_path", "key").join(places, "key").join(closure, ["file_path", "dep"])
    by_file = sized.filter("n_files > n_deps").select("file_path", "key").join(closure, "file_path").join(places, ["key", "dep"])
    columns = ["file_path", "key", "dep", "depth"]
    hits = by_key.select(columns).unionByName(by_file.select(columns)).join(defined, ["key", "dep"])
    levels = hits.groupBy("file_path", "key", "depth").agg(F.sum("n").alias("n"), F.min("found").alias("found"))
    best = levels.groupBy("file_path", "key").agg(F.min_by(F.struct("n", "found", "depth"), "depth").alias("b"))
    return best.select("file_path", "key", "b.*")


def nearest(asked: DataFrame, keys: DataFrame) -> DataFrame:
    """``file_path, key, n, found``: definitions that share most directories with a file.

    Definitions are counted for each directory above them, so a name that is defined
    everywhere is one row at the root.
    """
    above = keys.select("key", "found", F.explode(ancestors(normal_path("found.target_file"))).alias("dir"))
    mine = asked.select("file_path", "key", F.posexplode(ancestors(normal_path("file_path"))).alias("shared", "dir"))
    met = mine.join(_counted(above, "key", "dir"), ["key", "dir"])
    return met.groupBy("file_path", "key").agg(F.max_by(F.struct("n", "found"), "shared").alias("b")).select("file_path", "key", "b.*")


def _frequent(rows: DataFrame, column: str, least: int) -> tuple[list[str], int]:
    """Values of ``column`` in more than ``least`` rows, as a sketch of bounded size finds
    them, and the number of rows.  It only decides where rows meet, not what comes out."""
    top, n = rows.agg(F.expr(f"approx_top_k({column}, {FREQUENT}, {FREQUENT << 4})"), F.count("*")).first()
    return [r["item"] for r in top or () if r["item"] is not None and r["count"] > least], n


def _hit(found: Column) -> Column:
    """``n, found`` of an array of definitions; null if it has none."""
    pairs = F.transform(found, lambda d: F.struct(d["target"].alias("target"), d["target_file"].alias("target_file")))
    return F.when(F.size(found) > 0, F.struct(F.size(found).cast("bigint").alias("n"), F.array_min(pairs).alias("found")))


def _matched(rows: DataFrame, defined: DataFrame, tasks: int) -> DataFrame:
    """``rows`` with ``file, package_hit, far`` and ``places``, by key: the definitions of a
    key are one row, a row of what is asked looks through them, and both sides are
    shuffled once.  ``far`` and ``places``, the included files that define the key, are
    left out where the file or its package defines it."""
    found = defined.select(F.explode("keys").alias("key"), F.struct("target", "target_file", "package", "home", "dep").alias("d"))
    packed = found.repartition(tasks, "key").groupBy("key").agg(F.collect_set("d").alias("found"))
    met = rows.repartition(tasks, "key").join(packed.hint("shuffle_hash"), "key", "left")
    value = lambda x, f: F.element_at(F.transform(F.array(x), f), 1)  # noqa: E731  (f of x, with x made once)
    n_dirs = F.size(F.split("home", "/")) - 1
    dirs = F.when(n_dirs > 0, F.transform(F.sequence(n_dirs, F.lit(1), F.lit(-1)), lambda n: F.concat(F.call_function("substring_index", F.col("home"), F.lit("/"), n), F.lit("/"))))

    def far(found):
        levels = F.filter(F.transform(dirs, lambda a: F.filter(found, lambda d: F.startswith(d["home"], a))), lambda level: F.size(level) > 0)
        return value(levels, lambda level: _hit(F.when(F.size(level) > 0, level[0]).otherwise(found)))

    def hits(found):
        own = F.struct(_hit(F.filter(found, lambda d: d["target_file"] == F.col("file_path"))).alias("file"), _hit(F.filter(found, lambda d: d["package"] == F.col("package"))).alias("package_hit"))
        places = F.array_distinct(F.filter(F.transform(found, lambda d: d["dep"]), lambda x: x.isNotNull()))
        left = lambda o, x: F.when(o["file"].isNull() & o["package_hit"].isNull(), x)
        return value(own, lambda o: F.struct(o["file"].alias("file"), o["package_hit"].alias("package_hit"), left(o, far(found)).alias("far"), left(o, places).alias("places")))

    return met.withColumn("hits", value(F.col("found"), hits)).select(*(c for c in rows.columns if c not in ("key", "package", "home")), "hits.*")


def _seen(asked: DataFrame, closure: DataFrame, defined: DataFrame, rows: int, widest: int) -> DataFrame:
    """``node, raw, seen(n, found), depth``: definitions in the nearest files that a file includes.

    ``asked(node, raw, places)`` is sent to where the files that ``node`` reaches meet,
    and its few places are probed there.
    """
    spark, name = asked.sparkSession, "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    pairs = closure.select(F.col("file_path").alias("node"), "dep", "depth")
    spark.conf.set(name, "false")
    try:
        with dealt_for(spark, rows):
            if widest <= TASK_ROWS:  # else the pairs of one file are too many for one task
                tasks = -(-rows // TASK_ROWS)
                asked, pairs = asked.repartition(tasks, "node"), pairs.repartition(tasks, "node")
            met = asked.select("node", "raw", F.explode("places").alias("dep")).join(pairs.hint("shuffle_hash"), ["node", "dep"])
            levels = met.groupBy("node", "raw", "depth").agg(F.collect_list("dep").alias("deps"))
            nearest_ = cut(levels.groupBy("node", "raw").agg(F.min("depth").alias("depth"), F.min_by("deps", "depth").alias("deps")))
    finally:
        spark.conf.set(name, before)
    each = nearest_.select("node", "raw", "depth", _key().alias("key"), F.explode("deps").alias("dep"))
    found = defined.filter("dep is not null").select(F.explode("keys").alias("key"), "dep", F.struct("target", "target_file").alias("found"))
    found = found.groupBy("key", "dep").agg(F.collect_set("found").alias("found"))
    hits = each.join(found, ["key", "dep"]).groupBy("node", "raw").agg(F.sum(F.size("found")).alias("n"), F.min(F.array_min("found")).alias("found"), F.min("depth").alias("depth"))
    return hits.select("node", "raw", F.struct("n", "found").alias("seen"), "depth")


def _matched_apart(rows: DataFrame, defined: DataFrame, closure: DataFrame) -> DataFrame:
    """``rows`` with ``file, package_hit, seen, depth, far``, for keys that are asked for or
    defined too often to meet in one task: what is defined is counted for each place."""
    found = F.struct("target", "target_file").alias("found")
    keys = cut(defined.select(F.explode("keys").alias("key"), found, "package", "dep").distinct())
    side = lambda df, name, *by: df.select(*by, F.struct("n", "found").alias(name))
    per_file = _counted(keys.withColumn("file_path", F.col("found.target_file")), "key", "file_path")
    wanted = rows.select("file_path", "key", "package", "node").distinct()
    near = wanted.join(side(per_file, "file", "key", "file_path"), ["key", "file_path"], "left")
    near = cut(near.join(side(_counted(keys, "key", "package"), "package_hit", "key", "package"), ["key", "package"], "left"))
    left = near.filter("file is null and package_hit is null")
    reached = visible(left.filter("node is not null").select(F.col("node").alias("file_path"), "key"), closure, _counted(keys.filter("dep is not null"), "key", "dep"))
    reached = reached.select(F.col("file_path").alias("node"), "key", F.struct("n", "found").alias("seen"), "depth")
    far = side(nearest(left.select("file_path", "key"), keys), "far", "file_path", "key")
    met = near.join(reached, ["node", "key"], "left").join(far, ["file_path", "key"], "left").drop("package", "node")
    return rows.drop("package", "home").join(met, ["file_path", "key"], "left")


def _key() -> Column:
    """What a text is looked up by: at most its last two parts."""
    return F.when(n_parts("raw") <= 2, F.col("raw")).otherwise(last_two_parts("raw"))


def answers_scoped(asked: DataFrame, functions: DataFrame, closure: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """``asked(file_path, raw)``, each once, with what ``answered`` adds."""
    return answered(cut(asked.select("file_path", "raw").distinct()), functions, closure, nodes)


def answered(asked: DataFrame, functions: DataFrame, closure: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """``asked(file_path, raw, ...)`` with ``scope, depth, n_matches, target, target_file, confidence``.

    The nearest scope that defines the text counts: the file, its package, a file
    that it includes, one that it reaches over others (``depth`` steps; the nearest
    first), the known external names, then the definitions elsewhere that share
    most directories with the file.  ``n_matches`` counts the definitions there; of
    several the first by qualified name and file is taken.  With ``nodes`` the closure
    has numbers of files (see ``numbered_closure``).  ``asked`` has each file and text
    once and is read several times, so it should be written out (``session.cut``).

    ========== ============================================================
    high       one match in the file, its package or a file it includes
    medium     one match farther away, or a known external name
    low        several matches
    unresolved no match
    ========== ============================================================

    What is asked is shuffled by file, by key, and by file again where a key has
    definitions in included files.  Keys that are asked for or defined very often
    go another way (``_matched_apart``), or nowhere if nothing defines them.
    """
    if nodes is None:
        nodes = cut(closure.select(F.explode(F.array("file_path", "dep")).alias("path")).distinct().withColumn("node", F.col("path")))
    degrees = closure.groupBy(F.col("file_path").alias("node")).agg(F.count("*").alias("n_deps"))
    n_pairs, widest = degrees.agg(F.sum("n_deps"), F.max("n_deps")).first()
    # every file that is reached is included by one
    included = nodes.join(closure.filter("depth = 1").select(F.col("dep").alias("node")).distinct(), "node", "left_semi")
    received = F.when(F.col("receiver").isNotNull(), F.concat_ws(".", "receiver", "name"))
    keys = F.array_distinct(F.array_compact(F.array("name", received, "qualified_name")))
    home = F.regexp_replace(directory(normal_path("file_path")), "(?<=.)$", "/")
    defined = functions.filter("file_path is not null and qualified_name is not null").select(keys.alias("keys"), F.col("qualified_name").alias("target"), F.col("file_path").alias("target_file"), package_of("qualified_name").alias("package"), home.alias("home"))
    defined = cut(defined.join(included.select(F.col("path").alias("target_file"), F.col("node").alias("dep")), "target_file", "left"))
    asked = asked.withColumn("key", _key())
    hot, n_asked = _frequent(asked, "key", KEY_ASKED)
    wide, n_keys = _frequent(defined.select(F.explode("keys").alias("key")), "key", KEY_DEFINED)
    apart = list({*hot, *wide})
    is_defined = [r.key for r in defined.select(F.explode("keys").alias("key")).filter(F.col("key").isin(apart)).distinct().collect()] if apart else []

    # the file's package and number
    files = file_packages(functions).filter("file_path is not null").join(nodes.withColumnRenamed("path", "file_path"), "file_path", "full").withColumn("home", home)
    can = F.col("file_path").isNotNull() & F.col("key").isNotNull()
    part = lambda where: asked.filter(can & where).join(files, "file_path", "left").withColumn("home", F.coalesce("home", home))
    others = asked.filter(~can | F.col("key").isin([k for k in apart if k not in is_defined])).drop("key")
    usual = defined.withColumn("keys", F.filter("keys", lambda k: ~k.isin(apart))).filter(F.size("keys") > 0) if apart else defined
    tasks = max(int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(n_asked + n_keys) // TASK_ROWS))
    near = cut(_matched(part(~F.col("key").isin(apart)), usual, tasks))
    probed = F.coalesce(F.col("node").isNotNull() & (F.size("places") > 0), F.lit(False))
    n_places = near.filter(probed).agg(F.sum(F.size("places"))).first()[0]
    rows = near.filter(~probed).drop("places", "node")
    if n_places and n_pairs:
        seen = _seen(near.filter(probed).select("node", "raw", "places"), closure, defined, n_pairs + n_places, widest)
        rows = rows.unionByName(near.filter(probed).drop("places").join(seen, ["node", "raw"], "left").drop("node"), allowMissingColumns=True)
    else:
        rows = rows.unionByName(near.filter(probed).drop("places", "node"))
    if is_defined:
        frequent = defined.withColumn("keys", F.filter("keys", lambda k: k.isin(is_defined))).filter(F.size("keys") > 0)
        met = _matched_apart(part(F.col("key").isin(is_defined)), frequent, closure)
        rows = rows.unionByName(met.drop("key", "node"), allowMissingColumns=True)
    rows = rows.unionByName(others, allowMissingColumns=True)
    none = F.lit(None).cast("struct<n:bigint,found:struct<target:string,target_file:string>>")
    for name, value in {"seen": none, "depth": F.lit(None).cast("int")}.items():
        rows = rows if name in rows.columns else rows.withColumn(name, value)
    rows = categorized(rows)
    scope = (
        F.when(F.col("file").isNotNull(), "file")
        .when(F.col("package_hit").isNotNull(), "package")
        .when(F.col("depth") == 1, "include")
        .when(F.col("depth") > 1, "indirect")
        .when(F.col("kind").isin("syscall", "libc"), "standard")
        .when(F.col("far").isNotNull(), "elsewhere")
        .otherwise("none")
    )
    rows = rows.withColumn("scope", scope)
    outside = F.col("scope").isin("standard", "none")
    hit = F.when(~outside, F.coalesce("file", "package_hit", "seen", "far"))
    n = F.when(F.col("scope") == "standard", F.lit(1)).otherwise(F.coalesce(hit["n"], F.lit(0))).cast("long")
    direct = F.col("scope").isin(*(name for name, is_direct in SCOPES.items() if is_direct))
    confidence = F.when(n == 0, "unresolved").when(n > 1, "low").when(direct, "high").otherwise("medium")
    external = F.coalesce(F.concat(F.lit("["), "kind", F.lit(":"), "raw", F.lit("]")), F.lit(UNRESOLVED))
    return rows.select(
        *(c for c in asked.columns if c != "key"),
        "scope",
        F.when(F.col("scope").isin("include", "indirect"), F.col("depth")).alias("depth"),
        n.alias("n_matches"),
        F.coalesce(hit["found"]["target"], external).alias("target"),
        hit["found"]["target_file"].alias("target_file"),
        confidence.alias("confidence"),
    )


def resolve_scoped(functions: DataFrame, call_sites: DataFrame, closure: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """``call_sites`` with what ``answers_scoped`` found; calls are shuffled once, to meet the answers."""
    found = answers_scoped(call_sites.select("file_path", "raw"), functions, closure, nodes)
    new = [c for c in found.columns if c not in ("file_path", "raw")]
    found = found.select(F.col("file_path").alias("__file"), F.col("raw").alias("__raw"), *new)
    calls = call_sites.select(*(c for c in call_sites.columns if c not in new))
    met = calls.join(found, F.col("file_path").eqNullSafe(F.col("__file")) & F.col("raw").eqNullSafe(F.col("__raw")), "left")
    return met.select(*calls.columns, *new)


def confidence_rates(resolved: DataFrame) -> DataFrame:
    """``scope, confidence, n_calls``: how calls were resolved; rows with ``n_calls`` stand for so many."""
    n = F.sum("n_calls") if "n_calls" in resolved.columns else F.count("*")
    return resolved.groupBy("scope", "confidence").agg(n.alias("n_calls"))
