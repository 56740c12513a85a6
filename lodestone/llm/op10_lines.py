"""Line deduplication by a segment-partition edit join.

Two lines are linked if at most ``t`` edits turn one into the other; ``t`` goes
by the shorter one's length (``THRESHOLDS``).  Links make classes of lines.

*Segments.*  A line of length ``L`` is split into ``t + 1`` even segments.  Of a
line within ``t`` edits at least one segment is left whole, shifted by no more
than the edits before it and the edits left behind it allow.  So every line is
indexed under its segments with ``L``, and probes, for each length from its own
down to ``t`` less, the substrings at those few places: 12 for two edits.  Keys
are made where lines are read; for each key the least and greatest line hash say
whether lines share it, and only lines that share one go on.

*Filter.*  The join's condition also compares a sketch: the counts of sixteen
common letters in one long.  An edit changes them by two in all at most, so the
sketch never rejects a link, and it rejects most pairs of a hot segment inside
the join; the pairs of a group that shares a segment are not handed on.

*Verification.*  Pairs that pass meet their texts, lose what they begin with in
common, and are compared by banded bit-parallel edit distance: for each number of
edits a bit vector over the ``2t + 1`` diagonals, advanced character by character.

Lines count by their text: equal lines are one from the start.  They are told
apart by a 64-bit hash (at ten billion distinct lines about three of them may
share one).  Everything is built-in functions; links become classes in
``components``.

Defined results: lines are what ``\\n`` separates; a line of white space alone is
no line; lines under ``THRESHOLDS``' least length are linked by equality only.
A null text has no lines.  Repeated rows are repeated; of equal places the class
begins at each.  A null ``doc_id`` sorts first.  Extra columns are ignored by
``line_classes`` and kept by ``strip_lines``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components
from .shingles import content_of, shingle_sets, similar

#: (least length, edits): lines from that length on.
THRESHOLDS = ((10, 1), (40, 2))
LETTERS = "etaoinshrdlucmwg"
#: A document of which duplicate lines make this share of the characters may be
#: a copy; it is compared with the document that most of them begin in.
COPY_SHARE = 0.5

def threshold(length: Column) -> Column:
    out = F.lit(0)
    for least, edits in THRESHOLDS:
        out = F.when(length >= least, F.lit(edits)).otherwise(out)
    return out


def probe_places(edits: int) -> list[tuple[int, int, int]]:
    """(length less, segment, shift) of every substring that is looked up."""
    out = []
    for less in range(edits + 1):
        for i in range(edits + 1):
            low, high = max(-i, less - (edits - i)), min(i, less + (edits - i))
            out += [(less, i, shift) for shift in range(low, high + 1)]
    return out


def _specs() -> Column:
    """An array of all places that are looked up; ``index`` marks a line's own segments."""
    rows = [(edits, *place) for _, edits in THRESHOLDS for place in probe_places(edits)]
    return F.array(*(F.struct(*(F.lit(x).alias(c) for x, c in zip((e, less, i, shift, not less and not shift), ("edits", "less", "segment", "shift", "index")))) for e, less, i, shift in rows))


def _keys(lines: DataFrame) -> DataFrame:
    """``key, h, index`` of ``lines(h, line)``: a row for each place that is looked
    up; a key is the hash of (length, segment number, substring).

    With four bytes for each character substrings are cut by place and not by
    counting characters, which is most of the work otherwise.
    """
    units = lines.select("h", F.encode("line", "UTF-32").alias("units"), F.length("line").alias("n")).filter(F.col("n") >= THRESHOLDS[0][0])
    at = units.select("h", "units", "n", F.explode(_specs()).alias("s")).filter(threshold(F.col("n") - F.col("s.less")) == F.col("s.edits"))
    length = F.col("n") - F.col("s.less")
    begin = F.expr("(n - s.less) * s.segment div (s.edits + 1)").cast("int")
    end = F.expr("(n - s.less) * (s.segment + 1) div (s.edits + 1)").cast("int")
    part = F.substr(F.col("units"), 4 * (begin + F.col("s.shift")) + 1, 4 * (end - begin))
    return at.select(F.xxhash64(length, F.col("s.edits"), F.col("s.segment"), part).alias("key"), "h", F.col("s.index").alias("index"))


def _sketch(line: Column) -> Column:
    """Counts of the letters modulo 16, four bits for each."""
    out = F.lit(0).cast("long")
    for i, letter in enumerate(LETTERS):
        count = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(letter), F.lit("")))
        out = out.bitwiseOR(F.shiftleft(count.bitwiseAND(15).cast("long"), 4 * i))
    return out


def _sketch_distance(a: Column, b: Column) -> Column:
    """No more than the sum of the counts' differences."""
    total = F.lit(0)
    for i in range(len(LETTERS)):
        part = lambda x: F.shiftrightunsigned(x, 4 * i).bitwiseAND(15)  # noqa: B023, E731
        total = total + F.abs((part(a) - part(b) + 24).bitwiseAND(15) - 8)
    return total


def _let(value: Column, body) -> Column:
    """``body`` of a value that is made once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def equal_head(a: Column, b: Column, most: int = 1 << 20) -> Column:
    """How many characters two texts begin with in common (``most`` at most)."""
    steps = F.array(*(F.lit(1 << k) for k in range(most.bit_length() - 2, -1, -1)))
    shorter = F.least(F.length(a), F.length(b))
    grow = lambda n, k: F.when((n + k <= shorter) & (F.substr(a, F.lit(1), n + k) == F.substr(b, F.lit(1), n + k)), n + k).otherwise(n)
    return F.aggregate(steps, F.lit(0), grow)


def edits_within(a: Column, b: Column, edits: int) -> Column:
    """Whether at most ``edits`` edits lie between two arrays of characters."""
    width = 2 * edits + 1
    full = (1 << width) - 1
    names = [f"r{e}" for e in range(edits + 1)]
    # bit d of r_e: the first j of a and the first j + d - edits of b are e edits apart at most
    pack = lambda rows: F.struct(*(r.alias(n) for r, n in zip(rows, names)))
    start = pack([F.lit(sum(1 << edits + d for d in range(e + 1))) for e in range(edits + 1)])

    def matches(j: Column) -> Column:
        def of(mine: Column) -> Column:
            out = F.lit(0)
            for d in range(width):
                there = j + (d - edits)
                out = out + F.when((there >= 0) & (F.get(b, F.greatest(there, F.lit(0))) == mine), F.lit(1 << d)).otherwise(F.lit(0))
            return out

        return _let(F.get(a, j), of)

    def rows(state: Column, match: Column, e: int, done: list[Column]) -> Column:
        row = state[names[e]].bitwiseAND(match)
        if e:
            less = state[names[e - 1]]
            row = row.bitwiseOR(less).bitwiseOR(F.shiftright(less, 1)).bitwiseOR(F.shiftleft(done[-1], 1)).bitwiseAND(full)
        return _let(row, lambda r: pack([*done, r]) if e == edits else rows(state, match, e + 1, [*done, r]))

    def step(state: Column, j: Column) -> Column:
        # once no diagonal is left there is nothing to advance
        return F.when(state[names[-1]] == 0, state).otherwise(_let(matches(j), lambda m: rows(state, m, 0, [])))

    last = F.aggregate(F.sequence(F.lit(0), F.size(a) - 1), start, step, lambda s: s[names[-1]])
    diagonal = F.size(b) - F.size(a) + edits
    return diagonal.between(0, width - 1) & (F.getbit(last, F.greatest(F.least(diagonal, F.lit(width - 1)), F.lit(0))) == 1)


def _occurrences(docs: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, line_no, h, line``: a row for each line."""
    lines = docs.select(*keys, F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.filter(F.col("line").rlike(r"[^\x20\x09-\x0D]")).select(*keys, F.col("line_no").cast("long"), F.xxhash64("line").alias("h"), "line")


def _candidates(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``u, v`` of lines with a common key and like sketches, and ``h, line, n,
    sketch`` of the lines that share a key with another one."""
    # for each key the least and the greatest line tell whether it has several:
    # sums of fixed size, made where lines are read, however common a line is
    keys = _keys(lines)
    met = keys.groupBy("key").agg(F.min("h").alias("low"), F.max("h").alias("high"), F.max("index").alias("indexed"))
    shared = common.materialise(met.filter("low < high and indexed").select("key"), "shared_keys")
    entries = keys.join(common.small(shared), "key", "left_semi").groupBy("key", "h").agg(F.max("index").alias("index"))
    entries = common.materialise(entries, "entries")
    wanted = common.materialise(entries.select("h").distinct(), "wanted")
    texts = lines.select("h", "line").join(common.small(wanted), "h", "left_semi").groupBy("h").agg(F.min("line").alias("line"))
    texts = common.materialise(texts.select("h", "line", F.length("line").alias("n"), _sketch(F.col("line")).alias("sketch")), "texts")
    entries = entries.join(texts.select("h", "sketch"), "h")
    end = lambda name: entries.select("key", "index", F.col("h").alias(name), F.col("sketch").alias(f"{name}_sketch"))
    a, b = end("a").drop("index"), end("b").filter("index").drop("index")
    most = max(edits for _, edits in THRESHOLDS)
    near = a.join(b, "key").filter((F.col("a") != F.col("b")) & (_sketch_distance(F.col("a_sketch"), F.col("b_sketch")) <= 2 * most))
    return near.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), texts


def line_links(lines: DataFrame) -> DataFrame:
    """``(u, v)``, u < v: the links among ``lines(h, line)``, each once."""
    pairs, texts = _candidates(lines)
    end = lambda name, text: texts.select(F.col("h").alias(name), F.col("line").alias(text), F.col("n").alias(f"{text}_n"), F.col("sketch").alias(f"{text}_s"))
    met = pairs.join(end("u", "x"), "u").join(end("v", "y"), "v")
    allowed = threshold(F.least("x_n", "y_n"))
    met = met.filter((F.abs(F.col("x_n") - F.col("y_n")) <= allowed) & (_sketch_distance(F.col("x_s"), F.col("y_s")) <= 2 * allowed))
    # what both begin with in common needs no edit; one character keeps the texts from being empty
    head = F.greatest(equal_head(F.col("x"), F.col("y")) - 1, F.lit(0))
    ends = lambda n: F.struct(F.split(F.substr("x", n + 1), "").alias("x"), F.split(F.substr("y", n + 1), "").alias("y"))
    # exploded, the arrays are made once; as plain expressions they would be made anew at every step
    chars = met.select("u", "v", allowed.alias("allowed"), F.explode(F.transform(F.array(head), ends)).alias("s"))
    close = F.lit(False)
    for _, edits in THRESHOLDS:
        close = F.when(F.col("allowed") == edits, edits_within(F.col("s.x"), F.col("s.y"), edits)).otherwise(close)
    return chars.filter(close).select("u", "v")


def _classed(lines: DataFrame, keys: list[str], more: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Places of lines with ``first``, where their class begins, and the columns
    ``more``; and the links."""
    links = common.materialise(line_links(lines), "line_links")
    labels = components(links)
    # places without texts are small; read again, they cost no second split of the texts
    places = common.materialise(lines.select(*keys, "line_no", "h", *more), "places")
    first = places.groupBy("h").agg(F.min(F.struct(*keys, "line_no")).alias("first"))
    # only linked lines take part in classes of several
    members = labels.join(first, F.col("node") == F.col("h")).select("h", "component", "first")
    begins = members.groupBy("component").agg(F.min("first").alias("class_first"))
    linked = members.join(begins, "component").select("h", "class_first")
    by_line = first.join(linked, "h", "left").select("h", F.coalesce("class_first", "first").alias("first"))
    return places.join(by_line, "h").select(*keys, "line_no", "h", *more, "first"), links


def line_classes(docs: DataFrame) -> DataFrame:
    """``doc_id, line_no, class_doc_id, class_line_no, n_links`` of every line.

    The class of a line is named by the first place it occurs at; ``n_links`` is
    the number of different lines that it is linked to.
    """
    common.shared_dir(docs.sparkSession)
    lines = _occurrences(common.texts_of(docs), ["doc_id"])
    classed, links = _classed(lines, ["doc_id"])
    ends = links.select(F.col("u").alias("h")).unionByName(links.select(F.col("v").alias("h")))
    degree = ends.groupBy("h").agg(F.count("*").alias("n_links"))
    return classed.join(degree, "h", "left").select(
        "doc_id",
        "line_no",
        F.col("first.doc_id").alias("class_doc_id"),
        F.col("first.line_no").alias("class_line_no"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def _repeats(classed: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, total, sources`` of each document with repeated lines: its characters
    and, by the document that repeated lines begin in, their characters, those to
    take out, and those to take out of a copy of that document."""
    own = F.struct("first.doc_id", "first.content").eqNullSafe(F.struct(*keys))
    classes = classed.repartition(*keys).groupBy(*keys, "first").agg(F.array_sort(F.collect_set("line_no")).alias("at"), F.max("n").alias("n"))
    again = F.slice("at", 2, F.size("at"))
    classes = classes.select(*keys, F.col("first.doc_id").alias("of"), F.col("first.content").alias("of_content"), own.alias("own"), (F.col("n") * F.size("at")).alias("n"), again.alias("again"), F.when(own, again).otherwise(F.col("at")).alias("gone"))
    by = classes.groupBy(*keys, "of", "of_content", "own").agg(F.sum("n").alias("total"), F.sum(F.when(F.size("gone") > 0, F.col("n")).otherwise(0)).alias("n"), F.flatten(F.collect_list("gone")).alias("gone"), F.flatten(F.collect_list("again")).alias("again"))
    source = F.when(F.size("gone") > 0, F.struct("n", "of", "of_content", "own", "gone", "again"))
    return by.groupBy(*keys).agg(F.sum("total").alias("total"), F.collect_list(source).alias("sources")).filter(F.size("sources") > 0)


def _gone(docs: DataFrame, classed: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, gone``: the lines to take out of each document.

    From a verified copy of a document go the lines that go from that one as well;
    the others stay, each once, so that both remain alike.
    """
    found = common.materialise(_repeats(classed, keys), "repeats")
    others = F.filter("sources", lambda s: ~s["own"])
    repeated = F.aggregate("sources", F.lit(0).cast("long"), lambda n, s: n + s["n"])
    best = F.when(repeated >= F.col("total") * COPY_SHARE, F.array_max(F.transform(others, lambda s: F.struct(s["n"], s["of_content"]))))
    found = found.withColumn("source", best["of_content"])
    pairs = found.filter("source is not null").select(F.col("content").alias("a"), F.col("source").alias("b")).distinct()
    sets = shingle_sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("content")))
    copies = similar(pairs, sets).select(F.col("a").alias("content"), F.col("b").alias("source"), F.lit(True).alias("copy"))
    met = found.join(copies, ["content", "source"], "left")
    out = F.transform("sources", lambda s: F.when(F.col("copy") & (s["of_content"] == F.col("source")), s["again"]).otherwise(s["gone"]))
    return met.select(*keys, F.flatten(out).alias("gone")).filter(F.size("gone") > 0)


def strip_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with every line taken out whose class begins at an earlier place.

    A copy keeps the lines that begin in its source, which document deduplication
    has to see: a document that duplicate lines make up by ``COPY_SHARE`` or more,
    and whose shingle similarity to the document that most of them begin in is 0.8
    or more.  ``n_chars``, if there is one, is counted anew where lines were taken
    out.
    """
    common.shared_dir(docs.sparkSession)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), content_of().alias("content"), "text")
    keys = ["doc_id", "content"]
    classed, _ = _classed(_occurrences(keyed, keys).withColumn("n", F.length("line")), keys, ("n",))
    id_, content, gone_at, text = (common.unused(docs, f"__llm_{x}") for x in ("id", "content", "gone", "text"))
    named = _gone(docs, classed, keys).select(F.col("doc_id").alias(id_), F.col("content").alias(content), F.col("gone").alias(gone_at))
    named = common.materialise(named, "gone")
    total = named.agg(F.sum(F.size(gone_at) + 2)).first()[0] or 0
    met = docs.join(F.broadcast(named) if total <= common.FEW else named, F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (content_of() == F.col(content)), "left")
    parts = F.split("text", "\n")
    kept = F.array_join(F.filter(parts, lambda _, i: ~F.array_contains(gone_at, i.cast("long"))), "\n")
    met = met.withColumn(text, F.when(F.col(gone_at).isNotNull(), kept))
    columns = []
    for c in docs.columns:
        if c == "text":
            columns.append(F.coalesce(text, "text").alias(c))
        elif c == "n_chars":
            columns.append(F.when(F.col(text).isNotNull(), F.length(text)).otherwise(F.col(c)).cast(docs.schema[c].dataType).alias(c))
        else:
            columns.append(F.col(c))
    return met.select(*columns)


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_classes(common.table(spark, sf_dir, "documents"))
