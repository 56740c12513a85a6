"""Benchmark decontamination by q-gram lemma filtering.

Texts are compared in a plain form: lower case, white space runs as one space.
A benchmark item is cut into overlapping segments of ``SEGMENT`` characters (a
shorter item is one segment).  A document is contaminated by an item where some
part of it lies within ``BUDGET`` edits per character of a segment.

*Filter.*  If a part of a text is within ``k`` edits of a segment of ``m``
characters, both share ``m + 1 - q - k*q`` q-grams (the q-gram lemma), on
diagonals of a band no wider than ``k``.  All q-grams of the documents are
hashed by vector operations and looked up among those of the items; hits are
counted in overlapping bands of ``2 * WIDTH`` diagonals, so every true match
falls whole into one band, and a band is retained where enough hits of one
segment lie close enough together.

*Verification.*  Retained regions are aligned with the segment: one end is
anchored at the first hit's diagonal, the edit distance of the segment to any
part of the region is found bit-parallel over the band's columns, and the region
counts if it stays within the budget.

*Short items.*  Items under ``SHORTEST`` characters count as whole words only: the
part must begin and end at borders of words.  They are cut into one piece more than
the budget has edits (two from 20 characters on), so one piece of a match is whole,
which is the lemma's least case; one automaton finds the pieces of all such items,
and the parts around a piece are aligned with the item.

*Size.*  Documents are never shuffled by text.  The items are collected in
blocks of ``BLOCK_CHARS`` characters at most and each block is looked up in all
documents, so what is sent to executors is bounded whatever the benchmark holds.

Defined results: null or empty texts and items match nothing.  Equal
items are reported each.  Repeated documents are reported each.  Extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

Q = 12
SEGMENT = 80
STEP = 40
#: Edits allowed for each character of a segment.
BUDGET = 0.05
#: Items from this length on may be found inside of words.
SHORTEST = 40
#: Half the diagonals of a band; not less than the edits of a segment.
WIDTH = 8
#: Most characters of benchmark items that one pass holds.
BLOCK_CHARS = 4_000_000
#: Characters of documents handled together.
CHUNK_CHARS = 1 << 21
#: Shared q-grams that are held at once.
MOST_HITS = 4_000_000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def plain(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_hashes(codes: np.ndarray, q: int = Q) -> np.ndarray:
    """A hash of the q characters that start at each place but the last q - 1."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = None
    power, have, block = int(_MULTIPLIER), 1, codes.astype(np.uint64) + np.uint64(1)
    left, at = q, 0
    while left:  # powers of two of the length, joined
        if left & 1:
            part = block[at : at + n]
            out = part.copy() if out is None else out * np.uint64(power) + part
            at += have
        left >>= 1
        if left:
            block = block[:-have] * np.uint64(power) + block[have:]
            have, power = 2 * have, power * power % (1 << 64)
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def within(segment: np.ndarray, region: np.ndarray, most: int) -> tuple[int, int]:
    """Least edits of the segment to a part of the region, and where that part ends.

    One bit for each segment character, one step for each region character; the
    region is no longer than the band allows, so this is the band's alignment.
    """
    m = len(segment)
    masks: dict[int, int] = {}
    for i, c in enumerate(segment.tolist()):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    vp, vn, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(region.tolist(), 1):
        eq = masks.get(c, 0)
        d0 = ((((eq & vp) + vp) ^ vp) | eq | vn) & full
        hp, hn = vn | (full & ~(d0 | vp)), d0 & vp
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        hp, hn = hp << 1 & full, hn << 1 & full
        vp, vn = hn | (full & ~(d0 | hp)), hp & d0
        if score < best:
            best, end = score, j
    return best, end


def distance(a: str, b: str) -> int:
    """The edit distance of two short texts."""
    if a == b:
        return 0
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, d in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (c != d))
    return row[-1]


def border(text: str, at: int) -> bool:
    """Whether no word goes on over this place of a text."""
    return not (0 < at < len(text) and text[at - 1].isalnum() and text[at].isalnum())


class Items:
    """The segments of a block of items, with an index of their q-grams."""

    def __init__(self, items: list[tuple[int, str]]):
        self.segments: list[np.ndarray] = []
        self.item: list[int] = []
        self.offset: list[int] = []
        hashes, owner, place = [], [], []
        short: dict[str, list[int]] = {}
        for item_id, text in items:
            codes = code_points(plain(text))
            if len(codes) < SHORTEST:
                if len(codes):
                    short.setdefault(plain(text), []).append(item_id)
                continue
            starts = list(range(0, max(len(codes) - SEGMENT, 0) + 1, STEP))
            if len(codes) > SEGMENT and starts[-1] + SEGMENT < len(codes):
                starts.append(len(codes) - SEGMENT)
            for start in starts:
                segment = codes[start : start + SEGMENT]
                h = gram_hashes(segment)
                hashes.append(h)
                owner.append(np.full(len(h), len(self.segments)))
                place.append(np.arange(len(h)))
                self.segments.append(segment)
                self.item.append(item_id)
                self.offset.append(start)
        self.short = ahocorasick.Automaton()
        pieces: dict[str, list[tuple[str, int, list[int]]]] = {}
        for text, ids in short.items():
            n = int(BUDGET * len(text)) + 1
            cuts = [len(text) * k // n for k in range(n + 1)]
            for begin, end in zip(cuts, cuts[1:]):
                pieces.setdefault(text[begin:end], []).append((text, begin, ids))
        for piece, of in pieces.items():
            self.short.add_word(piece, (len(piece), of))
        if short:
            self.short.make_automaton()
        size = [len(s) for s in self.segments]
        self.most = np.array([int(BUDGET * n) for n in size], np.int64)
        self.need = np.array([max(1, n + 1 - Q - k * Q) for n, k in zip(size, self.most)], np.int64)
        self.length = np.array(size, np.int64)
        if hashes:
            flat = np.concatenate(hashes)
            order = np.argsort(flat, kind="stable")
            self.hashes, self.owner, self.place = flat[order], np.concatenate(owner)[order], np.concatenate(place)[order]
        else:
            self.hashes, self.owner, self.place = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.unique, self.first, self.times = np.unique(self.hashes, return_index=True, return_counts=True)
        bits = max(16, int(np.ceil(np.log2(len(self.unique) + 1))) + 5)
        self.shift = np.uint64(64 - bits)
        self.sieve = np.zeros(1 << bits, bool)
        self.sieve[self.unique >> self.shift] = True

    def short_matches(self, text: str) -> dict[int, tuple[int, int, int]]:
        """``item -> (edits, begin, end)`` of the short items in a plain text, the closest each."""
        out: dict[int, tuple[int, int, int]] = {}
        if not len(self.short):
            return out
        for last, (size, of) in self.short.iter(text):
            first = last + 1 - size
            for item, offset, ids in of:
                most = int(BUDGET * len(item))
                low, high = max(0, first - offset - most), first - offset + len(item) + most
                if most and within(code_points(item), code_points(text[low:high]), most)[0] > most:
                    continue
                begins = [b for b in range(low, first - offset + most + 1) if border(text, b)]
                ends = [e for e in range(high - 2 * most, min(high, len(text)) + 1) if border(text, e)]
                place = min(((distance(item, text[b:e]), b, e) for b in begins for e in ends), default=(most + 1, 0, 0))
                if place[0] <= most:
                    for i in ids:
                        out[i] = min(out.get(i, place), place)
        return out

    def hits(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """(place in the text, segment, place in the segment) of shared q-grams;
        None if they are too many to be held at once."""
        h = gram_hashes(codes)
        at = np.flatnonzero(self.sieve[h >> self.shift])
        found = np.searchsorted(self.unique, h[at])
        found[found == len(self.unique)] = 0
        good = self.unique[found] == h[at] if len(self.unique) else np.zeros(len(at), bool)
        at, found = at[good], found[good]
        times = self.times[found]
        if times.sum() > MOST_HITS and len(codes) > 16 * SEGMENT:
            return None
        text = np.repeat(at, times)
        inner = np.arange(len(text)) - np.repeat(np.cumsum(times) - times, times)
        entry = np.repeat(self.first[found], times) + inner
        return text, self.owner[entry], self.place[entry]

    def _in_parts(self, codes: np.ndarray, starts: np.ndarray) -> dict[tuple[int, int], tuple[int, int, int]]:
        """``matches`` of two halves.  A single text's halves overlap by what a
        match can span, so none is lost."""
        out: dict[tuple[int, int], tuple[int, int, int]] = {}
        if len(starts) > 2:
            k = len(starts) // 2
            parts = [(0, starts[: k + 1], 0), (k, starts[k:], 0)]
        else:
            half, span = len(codes) // 2, 2 * (SEGMENT + 2 * WIDTH)
            parts = [(0, np.array([0, half + span]), 0), (0, np.array([half - span, len(codes)]), half - span)]
        for number, at, shift in parts:
            for (n, item), (edits, begin, end) in self.matches(codes[at[0] : at[-1]], at - at[0]).items():
                key = (number + n, item)
                if key not in out or edits < out[key][0]:
                    out[key] = (edits, begin + shift, end + shift)
        return out

    def matches(self, codes: np.ndarray, starts: np.ndarray) -> dict[tuple[int, int], tuple[int, int, int]]:
        """Of texts laid end to end, ``starts`` their beginnings (and the end):
        ``(text number, item) -> (edits, begin, end)`` of the closest segment."""
        found = self.hits(codes)
        if found is None:
            return self._in_parts(codes, starts)
        text, segment, place = found
        if not len(text):
            return {}
        number = np.searchsorted(starts, text, side="right") - 1
        # a q-gram over the border of two texts is no q-gram of either
        inside = text + Q <= starts[number + 1]
        text, segment, place, number = text[inside], segment[inside], place[inside], number[inside]
        diagonal = text - place + SEGMENT  # not negative
        band = diagonal // WIDTH
        # overlapping bands: a hit counts in the one it begins and the one before
        segment, text, place = (np.concatenate([x, x]) for x in (segment, text, place))
        band, number = np.concatenate([band, band - 1]), np.concatenate([number, number])
        order = np.lexsort((text, band, segment, number))
        number, segment, band, text, place = (x[order] for x in (number, segment, band, text, place))
        new = np.r_[True, (number[1:] != number[:-1]) | (segment[1:] != segment[:-1]) | (band[1:] != band[:-1])]
        first = np.flatnonzero(new)
        size = np.diff(np.r_[first, len(new)])
        retained = size >= self.need[segment[first]]
        out: dict[tuple[int, int], tuple[int, int, int]] = {}
        tried: set[tuple[int, int]] = set()
        for f in first[retained].tolist():
            s, n = int(segment[f]), int(number[f])
            key, most = (n, self.item[s]), int(self.most[s])
            if key in out and out[key][0] == 0:
                continue
            low = (int(band[f]) * WIDTH) - SEGMENT
            if (s, low) in tried:
                continue
            tried.add((s, low))
            begin = max(int(starts[n]), low - most)
            end = min(int(starts[n + 1]), low + 2 * WIDTH + int(self.length[s]) + most)
            edits, stop = within(self.segments[s], codes[begin:end], most)
            if edits <= most and (key not in out or edits < out[key][0]):
                stop += begin - int(starts[n])
                out[key] = (edits, max(0, stop - int(self.length[s])), stop)
        return out


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded size; one block at a time on the driver."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = -(-total // BLOCK_CHARS) or 1
    for k in range(parts):
        rows = items if parts == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k)
        yield [(r.item_id, r.text) for r in rows.collect()]


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[str]]]:
    """The plain texts of a batch in runs of a bounded number of characters."""
    run, chars, at = [], 0, 0
    for i, t in enumerate(batch.column(column).to_pylist()):
        run.append(plain(t))
        chars += len(run[-1])
        if chars >= CHUNK_CHARS:
            yield at, run
            run, chars, at = [], 0, i + 1
    if run:
        yield at, run


def _found(items: Items, texts: list[str]) -> dict[tuple[int, int], tuple[int, int, int]]:
    starts = np.r_[0, np.cumsum([len(t) for t in texts])]
    found = items.matches(code_points("".join(texts)), starts)
    for n, text in enumerate(texts):
        for item, place in items.short_matches(text).items():
            found[n, item] = place
    return found


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, edits, begin, end``: each item found in each document,
    with the closest segment's edits and its place in the document's plain form."""
    spark = docs.sparkSession
    common.tune(spark)
    texts = common.texts_of(docs)
    out = None
    for block in _blocks(benchmark):
        shared = spark.sparkContext.broadcast(block)  # BLOCK_CHARS at most

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = Items(shared.value)
            for batch in batches:
                rows = []
                for at, run_of in _texts(batch, 1):
                    for (n, item), place in _found(items, run_of).items():
                        rows.append((batch.column(0)[at + n].as_py(), item, *place))
                columns = zip(*rows) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], ["doc_id", "item_id", "edits", "begin", "end"])

        found = texts.mapInArrow(common.tidy(run), "doc_id long, item_id long, edits long, begin long, end long")
        out = found if out is None else out.unionByName(found)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no item is found, with all their columns."""
    spark = docs.sparkSession
    common.tune(spark)
    at = docs.columns.index("text")
    for block in _blocks(benchmark):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = Items(shared.value)
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for first, run_of in _texts(batch, at):
                    for n, _ in _found(items, run_of):
                        keep[first + n] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(common.tidy(run), docs.schema)
    return docs


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
