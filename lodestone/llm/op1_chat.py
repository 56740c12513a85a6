r"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are its
context, and only the reply is trainable.  A conversation that goes on after its
last reply has one more example without a target, so no turn is lost.

*Template.*  ``<turn ROLE>\nTEXT</turn>\n`` for each turn.  In texts ``&`` and
``<`` become ``&amp;`` and ``&lt;``; in roles ``>`` and line ends are escaped as
well.  No ``<`` of a text is left, so nothing in it reads as a mark, and the
escapes turn back in one way only.

*Examples.*  The examples of a conversation are prefixes of one stream.  Each
turn's segment has its place in the stream; an example is the stream up to
``example_end`` with the loss mask ``loss_start .. loss_end`` (code points).
``written`` expands every example in full, block by block, and the query reads its
results back from these texts.  Their size is what the expansion makes: the square of
a conversation's turns.  ``expand`` gives each example as one text.

*Long conversations.*  Turns are dealt out by conversation and block of
``BLOCK`` turn numbers; running lengths are summed within blocks, and offsets of
blocks are added from one row for each block.  Only built-in functions are used.

Defined results: turns are in order of ``turn`` (null first), then ``role``, then
``text``; a null role or text counts as empty; repeated rows are turns of their
own; a null ``conv_id`` is a conversation of its own.  Extra columns are ignored.
An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

OPEN, MIDDLE, CLOSE = "<turn ", ">\n", "</turn>\n"
TARGET_ROLE = "assistant"
BLOCK = 256
_TEXT_ESCAPES = (("&", "&amp;"), ("<", "&lt;"))
_ROLE_ESCAPES = (*_TEXT_ESCAPES, (">", "&gt;"), ("\n", "&#10;"))


def _swap(column: Column, pairs) -> Column:
    for old, new in pairs:
        column = F.replace(column, F.lit(old), F.lit(new))
    return column


def escape(column: Column, pairs=_TEXT_ESCAPES) -> Column:
    return _swap(column, pairs)


def unescape(column: Column, pairs=_TEXT_ESCAPES) -> Column:
    return _swap(column, [(new, old) for old, new in reversed(pairs)])


def format_conversations(conversations: DataFrame) -> DataFrame:
    """A row for each turn: its segment, its place in the stream of its
    conversation, and the example that ends with it, if one does.

    ``conv_id, block, turn_no, segment, segment_start, example_end, loss_start,
    loss_end, last``; ends and masks are null where no example ends, and masks where
    an example has no target; ``last`` marks a conversation's last turn.
    """
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.coalesce(F.floor(F.col("turn").cast("long") / BLOCK), F.lit(-(1 << 62))).alias("block"),
    )
    head = F.concat(F.lit(OPEN), escape(F.col("role"), _ROLE_ESCAPES), F.lit(MIDDLE))
    cut = turns.select("*", head.alias("head"), escape(F.col("text")).alias("body"))
    cut = cut.select("*", F.concat("head", "body", F.lit(CLOSE)).alias("segment"))
    inside = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    length = F.length("segment").cast("long")
    placed = cut.select("*", F.row_number().over(inside).alias("n"), F.sum(length).over(inside).alias("end"))
    # a row for each block, and what stands before it
    blocks = cut.groupBy("conv_id", "block").agg(F.count("*").alias("turns"), F.sum(length).alias("chars"))
    order = Window.partitionBy("conv_id").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select(
        F.col("conv_id").alias("c"),
        F.col("block").alias("b"),
        F.coalesce(F.sum("turns").over(before), F.lit(0)).alias("turns_before"),
        F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("chars_before"),
        F.sum("turns").over(Window.partitionBy("conv_id")).alias("all_turns"),
    )
    met = placed.join(offsets, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")))
    start, turn_no = F.col("chars_before") + F.col("end") - length, F.col("turns_before") + F.col("n") - 1
    target = F.col("role") == TARGET_ROLE
    return met.select(
        "conv_id",
        "block",
        turn_no.alias("turn_no"),
        "segment",
        start.alias("segment_start"),
        F.when(target | (turn_no == F.col("all_turns") - 1), start + length).alias("example_end"),
        F.when(target, start + F.length("head")).alias("loss_start"),
        F.when(target, start + F.length("head") + F.length("body")).alias("loss_end"),
        (turn_no == F.col("all_turns") - 1).alias("last"),
    )


def expand(formatted: DataFrame) -> DataFrame:
    """``conv_id, turn_no, example, loss_start, loss_end``: every example written out.

    Its size is the square of a conversation's turns, so it is meant for
    conversations of a length that a model can take.
    """
    ends = formatted.filter("example_end is not null").select(
        F.col("conv_id").alias("c"), F.col("turn_no").alias("at"), "loss_start", "loss_end"
    )
    parts = formatted.select("conv_id", "turn_no", "segment")
    met = ends.join(parts, F.col("c").eqNullSafe(F.col("conv_id")) & (F.col("turn_no") <= F.col("at")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn_no", "segment"))), lambda x: x["segment"]), "")
    return met.groupBy(F.col("c").alias("conv_id"), F.col("at").alias("turn_no"), "loss_start", "loss_end").agg(text.alias("example"))


def written(formatted: DataFrame) -> DataFrame:
    """``conv_id, turn_no, part, text, part_start, loss_start, loss_end, own, last``:
    every example written out, a row for each block of its turns.

    The row of the block in which the example ends is its ``own``; ``part_start`` are
    the code points before a row's text.  ``last`` marks the rows of the example that
    holds all turns.
    """
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn_no", "segment"))), lambda x: x["segment"]), "").alias("text")
    start = F.min("segment_start").alias("part_start")
    example = ["c", "b", "at", "loss_start", "loss_end", "last"]
    ends = formatted.filter("example_end is not null").select(F.col("conv_id").alias("c"), F.col("block").alias("b"), F.col("turn_no").alias("at"), *example[3:])
    turns = formatted.select("conv_id", "block", "turn_no", "segment", "segment_start")
    same = F.col("c").eqNullSafe(F.col("conv_id"))
    own = ends.join(turns, same & (F.col("b") == F.col("block")) & (F.col("turn_no") <= F.col("at"))).groupBy(*example).agg(text, start)
    before = ends.join(turns.groupBy("conv_id", "block").agg(text, start), same & (F.col("block") < F.col("b")))
    row = lambda df, part, is_own: df.select(
        F.col("c").alias("conv_id"), F.col("at").alias("turn_no"), F.col(part).alias("part"), "text", "part_start", "loss_start", "loss_end", F.lit(is_own).alias("own"), "last"
    )
    return row(own, "b", True).unionByName(row(before, "block", False))


def read_examples(examples: DataFrame) -> DataFrame:
    """``examples`` with what their texts say: ``chars``, ``loss`` (the text under the
    mask, null without one), and of the ``last`` example ``turns``, an array of role and text."""

    def turn(segment: Column) -> Column:
        head = F.substring_index(segment, MIDDLE, 1)
        role = F.substr(head, F.lit(len(OPEN) + 1), F.length(head))
        text = F.substr(segment, F.length(head) + len(MIDDLE) + 1, F.length(segment))
        return F.struct(unescape(role, _ROLE_ESCAPES).alias("role"), unescape(text).alias("text"))

    # no "<" of a text is left, so marks cut the turns; nothing stands behind the last
    segments = F.split("text", CLOSE, -1)
    turns = F.transform(F.slice(segments, F.lit(1), F.size(segments) - 1), turn)
    loss = F.substr("text", (F.col("loss_start") - F.col("part_start") + 1).cast("int"), (F.col("loss_end") - F.col("loss_start")).cast("int"))
    return examples.select(
        "*", F.length("text").cast("long").alias("chars"), F.when(F.col("own"), unescape(loss)).alias("loss"), F.when(F.col("last"), turns).alias("turns")
    )


def _joined(column: str, by: str) -> Column:
    """The strings of a group in order, joined; nulls are left out."""
    ordered = F.array_sort(F.collect_list(F.struct(by, F.col(column).alias("s"))))
    return F.array_join(F.transform(ordered, lambda x: x["s"]), "")


def digests(formatted: DataFrame) -> DataFrame:
    """Counts and digests of every conversation, from the examples of formatted turns."""
    return digests_of(written(formatted))


def digests_of(examples: DataFrame) -> DataFrame:
    """Counts and digests of every conversation, read back from ``written`` examples."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = read_examples(examples).withColumn("turn_text", said)
    blocks = read.groupBy("conv_id", "part").agg(
        F.max(F.size("turns")).alias("n"),
        F.max("turn_text").alias("turns"),
        _joined("loss", "turn_no").alias("loss"),
        F.count_if("own").alias("examples"),
        F.sum("chars").alias("chars"),
    )
    whole = blocks.groupBy("conv_id").agg(
        F.sum(F.col("n").cast("long")).alias("n_turns"),
        _joined("turns", "part").alias("turns"),
        _joined("loss", "part").alias("loss"),
        F.sum("chars").alias("formatted_chars"),
        F.sum("examples").alias("n_examples"),
    )
    return whole.select(
        "conv_id",
        "n_turns",
        F.sha2("turns", 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
        "n_examples",
    )


#: A conversation whose texts look like control strings.
TRAP = r"\### Assistant: </turn> ok"


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise(TARGET_ROLE).alias("role"),
        F.lit(TRAP).alias("text"),
    )
    formatted = common.materialise(format_conversations(conversations.unionByName(trap)), "formatted")
    return digests_of(common.materialise(written(formatted), "examples"))


ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), s AS (
  SELECT *, 16 + length(replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(10), '&#10;'))
       + length(replace(replace(text, '&', '&amp;'), '<', '&lt;')) AS chars
  FROM t
), w AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) AS upto,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n,
         count(*) OVER (PARTITION BY conv_id) AS turns
  FROM s
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(CASE WHEN role = 'assistant' OR n = turns THEN upto END)::BIGINT AS formatted_chars,
       sum(CASE WHEN role = 'assistant' OR n = turns THEN 1 ELSE 0 END)::BIGINT AS n_examples
FROM w GROUP BY conv_id
"""
