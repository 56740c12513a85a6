"""Column expressions over names, call texts and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def before_last_dot(c: Column | str) -> Column:
    """What stands before the last dot; the empty text without one."""
    return F.regexp_extract(col(c), r"(?s)^(.*)[.][^.]*$", 1)


def last_segment(c: Column | str) -> Column:
    """What stands behind the last dot; the whole text without one."""
    return F.substring_index(col(c), ".", -1)


def starts_upper(c: Column | str) -> Column:
    return col(c).rlike(r"^\p{Lu}")


def package_of(qualified: Column | str) -> Column:
    """A qualified name without its last part, and without a type before that.

    The part before the last one counts as a type if it starts with an upper-case
    character and isn't the first.  A name without dots is its own package.
    """
    q = col(qualified)
    outer = before_last_dot(q)
    typed = F.contains(outer, F.lit(".")) & starts_upper(last_segment(outer))
    return F.when(~F.contains(q, F.lit(".")), q).when(typed, before_last_dot(outer)).otherwise(outer)


def n_parts(raw: Column | str) -> Column:
    return F.size(F.split(col(raw), "[.]"))


def last_two_parts(raw: Column | str) -> Column:
    return F.substring_index(col(raw), ".", -2)


def is_internal(target: Column | str) -> Column:
    """Whether a call target names a function of the index."""
    return ~F.startswith(col(target), F.lit("["))


def without_dot_slash(path: Column | str) -> Column:
    return F.regexp_replace(col(path), r"^(?:\./)+", "")


def extension(path: Column | str) -> Column:
    return F.regexp_extract(col(path), r"[^/]\.([^./]+)$", 1)


def file_stem(path: Column | str) -> Column:
    return F.regexp_replace(F.substring_index(col(path), "/", -1), r"(?<=.)\.[^.]*$", "")


def language_of(path: Column | str) -> Column:
    """``go``, ``rust`` or ``c`` by the extension, else null."""
    e = extension(path)
    return F.when(e == "go", "go").when(e == "rs", "rust").when(e.isin("c", "h"), "c")


def text_hash(text: Column | str) -> Column:
    """A token for the equality of texts: 16 hexadecimal digits."""
    return F.lpad(F.lower(F.hex(F.xxhash64(col(text)))), 16, "0")


def lines_of(text: Column | str) -> Column:
    """The lines of a text; a line end at its end begins no further line."""
    parts = F.split(F.regexp_replace(col(text), r"\r?\n$", ""), "\r?\n")
    return F.when(col(text) == "", F.array().cast("array<string>")).otherwise(parts)


def line_slice(text: Column | str, start: Column | str, end: Column | str) -> Column:
    """Lines ``start`` to ``end`` (from 1, both included), as far as there are any."""
    lines = lines_of(text)
    first = F.greatest(col(start).cast("int"), F.lit(1))
    last = F.least(col(end).cast("int"), F.size(lines))
    return F.when(last < first, F.lit("")).otherwise(F.array_join(F.slice(lines, first, F.greatest(last - first + 1, F.lit(0))), "\n"))


def percent(part: Column, whole: Column) -> Column:
    """``100 * part / whole``; 100 of nothing."""
    return F.coalesce(F.try_divide(part * 100.0, whole), F.lit(100.0))
