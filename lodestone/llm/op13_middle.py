r"""Fill-in-middle transformation with a sparse checkpoint index.

A text is cut at two places between units (``[A-Za-z]+|[^A-Za-z]``) into prefix,
middle and suffix, which are put in another order between sentinels.

*Checkpoints.*  Counting the units is one pass over the text, block by block; it
records the byte and the code-point offset of every ``STEP``-th unit.  A cut is
found by a binary search among the checkpoints and a rescan of fewer than
``STEP`` units of the UTF-8 text from there, so both cuts cost the same however
long the text is, and the index is a small part of the text.

*Cuts and form* hang on the SHA-256 of the seed and ``doc_id`` alone, so a lost
task makes the same rows again.  A text that holds a sentinel stays as it is: in
all others the sentinels of the output are its only ones, since one can't begin
inside another, so ``restore`` finds the parts again.

Each row is transformed by itself: no shuffle, one pass over the texts.

Defined results: a null text counts as empty, and an empty text is ``plain`` with
no units.  Repeated rows are transformed alike; a null ``doc_id`` is hashed as an
empty one and stays null; extra columns are ignored.  An empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Units between two checkpoints, and code points counted at once.
STEP, BLOCK = 256, 1 << 20
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percent of texts that aren't left plain, and of those the suffix-first ones.
RATE, SUFFIX_FIRST = 90, 20
SEED = "1:"
#: A unit of UTF-8 text.
_UNIT = re.compile(rb"[A-Za-z]+|[^A-Za-z\x80-\xff]|[\xc0-\xff][\x80-\xbf]*")
_CONTINUED = bytes(range(0x80, 0xC0))
RESULT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


@dataclass
class Checkpoints:
    """``units`` in all, and the unit number, byte and code-point offset of every ``step``-th."""

    units: int
    numbers: list[int]
    byte_at: list[int]
    char_at: list[int]

    @classmethod
    def of(cls, data: bytes, step: int = STEP, block: int = BLOCK) -> Checkpoints:
        found = cls(0, [], [], [])
        inside, chars = False, 0
        for at in range(0, len(data), block):
            raw = np.frombuffer(data, np.uint8, min(block, len(data) - at), at)
            letter = ((raw | 32) - 97).astype(np.uint8) < 26
            after = np.empty_like(letter)
            after[0], after[1:], last = inside, letter[:-1], bool(letter[-1])
            lead = (raw & 0xC0) != 0x80
            starts = np.flatnonzero(lead & ~(letter & after))
            marked = starts[-found.units % step :: step]
            if len(marked):
                before = np.cumsum(lead) - 1
                found.numbers += range(found.units + -found.units % step, found.units + len(starts), step)
                found.byte_at += (marked + at).tolist()
                found.char_at += (before[marked] + chars).tolist()
            found.units, inside, chars = found.units + len(starts), last, chars + int(np.count_nonzero(lead))
        return found

    def place(self, data: bytes, unit: int) -> tuple[int, int]:
        """Byte and code-point offset of the end of the first ``unit`` units."""
        if not unit:
            return 0, 0
        # the last checkpoint at or before the last of these units
        k = bisect_right(self.numbers, unit - 1) - 1
        at = self.byte_at[k]
        last = next(islice(_UNIT.finditer(data, at), unit - 1 - self.numbers[k], None))
        return last.end(), self.char_at[k] + len(data[at : last.end()].translate(None, _CONTINUED))


def numbers_of(doc_id: int | None, seed: str = SEED) -> list[int]:
    """Four numbers of 32 bits for a document."""
    digest = sha256(f"{seed}{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4)]


def cut(doc_id: int | None, text: str | None, seed: str = SEED, step: int = STEP) -> tuple[int, str, int | None, int | None, str]:
    """Units, form, code points of prefix and of middle, output."""
    data = (text or "").encode()
    index = Checkpoints.of(data, step)
    h = numbers_of(doc_id, seed)
    if not data or h[2] % 100 >= RATE or any(x.encode() in data for x in (PREFIX, SUFFIX, MIDDLE)):
        return index.units, "plain", None, None, text or ""
    low, high = sorted(x % (index.units + 1) for x in h[:2])
    (a, a_chars), (b, b_chars) = index.place(data, low), index.place(data, high)
    prefix, middle, suffix = (x.decode() for x in (data[:a], data[a:b], data[b:]))
    if h[3] % 100 < SUFFIX_FIRST:
        form, output = "spm", f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    else:
        form, output = "psm", f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"
    return index.units, form, a_chars, b_chars - a_chars, output


def transform(docs: DataFrame, seed: str = SEED, step: int = STEP) -> DataFrame:
    """The columns of ``RESULT`` for every document."""
    common.tune(docs.sparkSession)
    names = [x.split()[0] for x in RESULT.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [cut(i, t, seed, step) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            columns = zip(*rows) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), k) for c, k in zip(columns, kinds))], names)

    return common.texts_of(docs).mapInArrow(run, RESULT)


def restore(output: str | Column = "output", form: str | Column = "form") -> Column:
    """The text that ``output`` was made of: prefix, middle and suffix in order."""
    output, form = (F.col(x) if isinstance(x, str) else x for x in (output, form))
    first, second = F.when(form == "spm", SUFFIX).otherwise(PREFIX), F.when(form == "spm", PREFIX).otherwise(SUFFIX)
    at, last = F.instr(output, second), F.instr(output, MIDDLE)
    one = F.substring(output, F.length(first) + 1, at - F.length(first) - 1)
    two = F.substring(output, at + F.length(second), last - at - F.length(second))
    middle = F.substring(output, last + len(MIDDLE), F.length(output))
    return F.when(form == "plain", output).when(form == "spm", F.concat(two, middle, one)).otherwise(F.concat(one, middle, two))


def op13_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cuts = transform(common.table(spark, sf_dir, "documents"))
    return cuts.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2(F.col("output"), 256).alias("output_sha256"),
        F.sha2(restore(), 256).alias("restored_sha256"),
    )


ORACLE = """
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), numbers AS (
  SELECT doc_id, t, u, len(u)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM units
), forms AS (
  SELECT doc_id, t, u, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM numbers
), parts AS (
  SELECT doc_id, t, n, form, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS s FROM forms
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN t ELSE p || m || s END) AS restored_sha256
FROM parts"""
