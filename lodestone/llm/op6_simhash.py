"""SimHash near-duplicate detection with pigeonring filtering.

*Fingerprints.*  A text is lower-cased (A-Z), cut into words, and its shingles
(with repeats) are hashed by XXH64.  A fingerprint bit is one where over half
the hashes have it.  Wider fingerprints take further 64 bits from mixed hashes.

*Candidates.*  The bits are segments on a ring.  If two fingerprints differ in
at most ``t`` bits of ``m`` segments, then from some segment on every chain of
``l`` consecutive segments differs in at most ``l*t/m`` bits.

``EXACT`` (64 bits, ``t = 4``, seven segments) loses no link: the first segment
of the chain is equal and of the two behind it at most one bit differs, so one of
these is equal as well.  Each fingerprint is dealt out under 14 keys of 18 bits
and more: its start segment with the next, and with the one after the next.

``WIDE`` (128 bits, ``t = 32``) is for shingle similarities of 0.8 and more.  Two
such texts differ in up to 15 % of the bits, and a segment of ``b`` bits is equal
with probability ``0.85 ** b`` only: keys of segments are either too short for a
large corpus or miss.  Keys are min-wise there: ``BANDS`` keys, each the hash of
the least of ``ROWS`` permutations of the shingles.  Texts of similarity 0.8 share
one in 99.8 % of cases, unlike ones hardly ever, whatever the size of the corpus;
the chains are then sought from every segment.

Within a key, pairs whose chain from there leaves its budgets are dropped before
the full Hamming check.

*Hot keys.*  Equal fingerprints are one entry from the start.  Keys are met as
sorted runs.  A large run is explored from pivots: what a pivot reaches leaves
the open set and becomes a pivot itself, so a group of near copies ends after a
few pivots and gives a spanning tree of links and not all pairs.  No link
between components is lost and nothing is capped.  Where links are verified
afterwards, a large run is first compared with few pivots; then each of its texts
that verified links don't connect with the run's main group is compared with the
near texts of other groups, in rounds: the nearest, the next eight, the next 64, until
every near pair of the run is either connected or verified.  So most runs end after a
round or two, and none loses a link.

*Sketches.*  In these rounds pairs also meet by a sketch of 1024 bits, each the parity
of the distinct shingles that fall on it.  Two sketches differ in no more bits than
their sets in shingles, so no pair of similarity ``LEAST`` is rejected; of texts of some
hundred words it leaves hardly any other.  Nearest is what differs least for its size.

*Verification.*  Links of the pipeline are compared by their true shingles before
they make groups; fingerprints alone drop nothing but equal texts.

*Components.*  Links are between fingerprints' least documents; see
``components``.

Defined results: texts without words (null and empty ones too) have fingerprint
zero and link like any other.  Documents with a null ``doc_id`` get a
fingerprint and a null component, and link nothing.  Repeated rows are repeated
in the result.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .components import components
from .shingles import LEAST, content_of, shingle_sets, similar

SEED = 42
SHINGLE_WORDS = 4
#: Runs up to this size are compared pair by pair.
SMALL_RUN = 64
#: Min-wise keys of a text and the permutations in each.
BANDS, ROWS = 12, 4
#: The keys whose links are verified before the others are asked.
FIRST_BANDS = 4
#: Runs of min-wise keys up to this size are compared pair by pair at once.
MIDDLE_RUN = 64
#: Bits of a sketch of parities.
SKETCH = 1024
#: How many times as many partners the next round of a large run asks for.
GROWTH = 8
#: Rows of sorted keys that are handled together.
CHUNK = 1 << 16


@dataclass(frozen=True)
class Ring:
    """How fingerprints are compared.

    ``words`` of 64 bits, the segments of each, the most bits that may differ and the
    chain's length.
    """

    words: int
    widths: tuple[int, ...]
    max_bits: int
    chain: int

    @property
    def segments(self) -> list[tuple[int, int, int]]:
        """(word, first bit, width) around the ring."""
        return [(w, sum(self.widths[:i]), width) for w in range(self.words) for i, width in enumerate(self.widths)]

    @property
    def columns(self) -> list[str]:
        return [f"fp{w}" for w in range(self.words)]


EXACT = Ring(words=1, widths=(9, 9, 9, 9, 9, 9, 10), max_bits=4, chain=7)
WIDE = Ring(words=2, widths=(8,) * 8, max_bits=32, chain=4)


def _mixed(hashes: np.ndarray, word: int) -> np.ndarray:
    """The hashes for a further word of a fingerprint (splitmix64)."""
    if not word:
        return hashes
    x = hashes + np.uint64(word * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str, words_each: int = SHINGLE_WORDS) -> np.ndarray:
    """XXH64 of each shingle of a text, repeats included; none without words."""
    tokens = text.encode().lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    joined = b" ".join(tokens)
    n = len(tokens) - words_each + 1
    digest = xxhash.xxh64_intdigest
    if n < 2:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = (np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens))) + np.arange(len(tokens))).tolist()
    starts = [0, *(e + 1 for e in ends[: n - 1])]
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[words_each - 1 :])], np.uint64)


def of_hashes(hashes: np.ndarray, words: int = 1) -> np.ndarray:
    """The SimHash of shingle hashes in words of 64 bits; 0 without any."""
    total = np.zeros((words, 64), np.int64)
    for at in range(0, len(hashes), 1 << 16):  # long texts in parts
        part = hashes[at : at + (1 << 16)].astype("<u8")
        for w in range(words):
            bits = np.unpackbits(_mixed(part, w).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            total[w] += bits.sum(0, dtype=np.int64)
    return np.packbits(2 * total > len(hashes), axis=1, bitorder="little").view("<u8")[:, 0]


def fingerprint(text: str, words_each: int = SHINGLE_WORDS, words: int = 1) -> np.ndarray:
    """The SimHash of a text in words of 64 bits; 0 without words."""
    return of_hashes(shingle_hashes(text, words_each), words)


_PERMUTED = _mixed(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64), 1).reshape(2, -1, 1)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """The min-wise keys of shingle hashes; texts without words share theirs."""
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(hashes), 1 << 12):
        part = hashes[None, at : at + (1 << 12)]
        least = np.minimum(least, (part * (_PERMUTED[0] | np.uint64(1)) + _PERMUTED[1]).min(1))
    rows = least.reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)
    for i in range(ROWS):
        key = _mixed(key ^ rows[:, i], i + 1)
    return key.view(np.int64)


def parities(hashes: np.ndarray) -> tuple[int, bytes]:
    """How many distinct shingles there are, and the parities of those on each bit."""
    distinct = np.unique(hashes)
    on = np.bincount((distinct & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH)
    return len(distinct), np.packbits(on.astype(np.uint8) & 1).tobytes()


def fingerprints(docs: DataFrame, words_each: int = SHINGLE_WORDS, ring: Ring = EXACT) -> DataFrame:
    """``doc_id`` and the fingerprint's words as signed longs."""
    common.tune(docs.sparkSession)
    names, words = ["doc_id", *ring.columns], ring.words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, words_each, words) for t in batch.column(1).to_pylist()], np.uint64).reshape(-1, words)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(fps[:, w].view(np.int64)) for w in range(words))], names)

    return common.texts_of(docs).mapInArrow(run, ", ".join(f"{n} long" for n in names))


def ring_keys(fps: DataFrame, ring: Ring) -> DataFrame:
    """``key, node`` and the words: each fingerprint under its keys, a start segment
    with one of the next two (which holds for budgets under 2/3 bit a segment)."""
    segments = [F.shiftrightunsigned(f"fp{w}", first).bitwiseAND(F.lit((1 << width) - 1)) for w, first, width in ring.segments]
    m, keys = len(segments), []
    for i in range(m):
        for second in (1, 2):
            key = F.lit((2 * i + second - 1) << 40).cast("long") + F.shiftleft(segments[i], 20)
            keys.append(key + segments[(i + second) % m])
    return fps.select(F.explode(F.array(*keys)).alias("key"), "node", *ring.columns)


def _near(ring: Ring, start: np.ndarray, one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Which pairs keep the budgets of their chain and, in all, ``max_bits``."""
    m, segments = len(ring.segments), ring.segments
    word, mask = np.array([s[0] for s in segments]), np.array([((1 << s[2]) - 1) << s[1] for s in segments], np.uint64)
    left, total = np.arange(len(one)), np.zeros(len(one), np.int64)
    for length in range(1, ring.chain + 1):
        at = (start[left] + length - 1) % m
        difference = one[left, word[at]] ^ other[left, word[at]]
        total = total + np.bitwise_count(difference & mask[at])
        fits = total * m <= length * ring.max_bits
        left, total = left[fits], total[fits]
    whole = np.bitwise_count(one[left] ^ other[left]).sum(1, dtype=np.int64)
    out = np.zeros(len(one), bool)
    out[left[whole <= ring.max_bits]] = True
    return out


def _links_of_run(ring: Ring, start: int, fp: np.ndarray, node: np.ndarray) -> tuple[list, list]:
    """A spanning forest of the links within one large run."""
    one, other = [], []
    while len(fp):
        queue = [(fp[0], node[0])]
        fp, node = fp[1:], node[1:]
        while queue and len(fp):
            pivot, at = queue.pop()
            near = _near(ring, np.full(len(fp), start), fp, np.broadcast_to(pivot, fp.shape))
            if near.any():
                reached = node[near]
                one += [at] * len(reached)
                other += reached.tolist()
                queue += zip(fp[near], reached)
                fp, node = fp[~near], node[~near]
    return one, other


def _links(ring: Ring, key: np.ndarray, fp: np.ndarray, node: np.ndarray, small_run: int | None = None) -> tuple[list, list]:
    """Links among complete runs of equal keys: all of runs up to ``small_run``."""
    small_run = SMALL_RUN if small_run is None else small_run
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[first, len(key)])
    one, other = [], []
    for k in np.flatnonzero(size > small_run):
        part = slice(first[k], first[k] + size[k])
        a, b = _links_of_run(ring, int(key[first[k]] >> 41), fp[part], node[part])
        one += a
        other += b
    small = np.repeat(size, size)
    small = (small > 1) & (small <= small_run)
    key, fp, node = key[small], fp[small], node[small]
    at, shift = np.arange(len(key)), 1
    while len(at := at[at + shift < len(key)]):
        at = at[key[at] == key[at + shift]]
        near = at[_near(ring, key[at] >> 41, fp[at], fp[at + shift])]
        one += node[near].tolist()
        other += node[near + shift].tolist()
        shift += 1
    return one, other


def _forest(one: list, other: list) -> tuple[list, list]:
    """The links that join two trees as they come."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p] if p in parent else p
        return x

    kept: tuple[list, list] = ([], [])
    for a, b in zip(one, other):
        if (ra := root(a)) != (rb := root(b)):
            parent[max(ra, rb)] = min(ra, rb)
            kept[0].append(a)
            kept[1].append(b)
    return kept


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Columns of whole runs of equal keys, some ``CHUNK`` rows at a time: the
    beginnings of the runs, and the columns."""
    waiting: list[list[np.ndarray]] = []
    rows, limit = 0, CHUNK

    def cut_at(end: int | None) -> tuple[np.ndarray, list[np.ndarray]]:
        nonlocal waiting, rows
        columns = [np.concatenate(x) for x in zip(*waiting)]
        end = int(np.searchsorted(columns[0], columns[0][-1])) if end is None else end
        waiting, rows = [[c[end:] for c in columns]], len(columns[0]) - end
        columns = [c[:end] for c in columns]
        return np.flatnonzero(np.r_[True, columns[0][1:] != columns[0][:-1]]) if end else np.empty(0, np.int64), columns

    for batch in batches:
        if batch.num_rows:
            waiting.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            rows += batch.num_rows
            if rows >= limit:
                yield cut_at(None)
                limit = max(CHUNK, 2 * rows)  # a run that is still growing
    if rows:
        yield cut_at(rows)


def links(fps: DataFrame, ring: Ring = EXACT) -> DataFrame:
    """``(u, v)``: nodes whose fingerprints are near, as forests that together
    connect what all such pairs connect.  ``fps(node, words)`` is distinct."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for first, (key, node, *fp) in _runs(batches):
            if len(first):
                one, other = _forest(*_links(ring, key, np.stack(fp, axis=1).view(np.uint64), node))
                yield pa.RecordBatch.from_arrays([pa.array(one, pa.int64()), pa.array(other, pa.int64())], ["u", "v"])

    return ring_keys(fps, ring).repartition("key").sortWithinPartitions("key").mapInArrow(run, "u long, v long")


def grouped(docs: DataFrame, words_each: int = SHINGLE_WORDS, ring: Ring = EXACT) -> DataFrame:
    """``doc_id``, the fingerprint's words and ``component_id`` of every document."""
    common.shared_dir(docs.sparkSession)
    all_fps = common.materialise(fingerprints(docs, words_each, ring), "fingerprints")
    fps = all_fps.filter("doc_id is not null").groupBy(*ring.columns).agg(F.min("doc_id").alias("node"))
    fps = common.materialise(fps, "distinct_fingerprints")
    found = components(links(fps, ring))
    labelled = fps.join(found, "node", "left").select(*ring.columns, F.coalesce("component", "node").alias("component"))
    met = all_fps.join(labelled, ring.columns, "left")
    return met.select("doc_id", *ring.columns, F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``fingerprint``, ``component_id`` of every document."""
    return grouped(docs).select("doc_id", F.lpad(F.lower(F.hex("fp0")), 16, "0").alias("fingerprint"), "component_id")


def _entries(docs: DataFrame, words_each: int, ring: Ring) -> DataFrame:
    """``content``, the fingerprint's words, ``keys``, and ``size`` and ``sketch`` of the
    distinct shingles of ``docs(content, text)``."""
    common.tune(docs.sparkSession)
    names = ["content", *ring.columns, "size", "keys", "sketch"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [shingle_hashes(t, words_each) for t in batch.column(1).to_pylist()]
            fps = np.array([of_hashes(h, ring.words) for h in hashes], np.uint64).reshape(-1, ring.words).view(np.int64)
            keys = np.array([band_keys(h) for h in hashes], np.int64).reshape(-1, BANDS)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32)), pa.array(keys.ravel()))
            sizes, sketches = zip(*map(parities, hashes)) if hashes else ((), ())
            own = [pa.array(sizes, pa.int64()), lists, pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(fps[:, w]) for w in range(ring.words)), *own], names)

    return docs.mapInArrow(common.tidy(run), ", ".join(f"{n} long" for n in names[:-2]) + ", keys array<long>, sketch binary")


def near_all(ring: Ring, one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Which pairs of fingerprints (words of whole bytes as segments) have a chain
    that keeps its budgets, from any segment on, and ``max_bits`` in all."""
    apart = np.bitwise_count((one ^ other).view(np.uint8)).reshape(len(one), 8 * ring.words)
    m, total = 8 * ring.words, apart.astype(np.int16)
    fits = total * m <= ring.max_bits
    for length in range(2, ring.chain + 1):
        total = total + np.roll(apart, 1 - length, axis=1)
        fits &= total * m <= length * ring.max_bits
    out = fits.any(1)
    out[out] = apart[out].sum(1, dtype=np.int64) <= ring.max_bits
    return out


def _stars(ring: Ring, fp: np.ndarray, node: np.ndarray) -> tuple[list, list]:
    """Pairs of the nodes of a run with the first that is near: few pivots, not all pairs."""
    one, other = [], []
    while len(fp) > 1:
        near = near_all(ring, np.repeat(fp[:1], len(fp) - 1, axis=0), fp[1:])
        one += [node[0]] * int(near.sum())
        other += node[1:][near].tolist()
        fp, node = fp[1:][~near], node[1:][~near]
    return one, other


def may_be_similar(size: np.ndarray, sketch: np.ndarray, other_size: int, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which sets can have similarity ``LEAST`` with another one, and how far apart the
    sketches are for their sizes."""
    apart = np.bitwise_count(sketch ^ other).sum(1, dtype=np.int64) / np.maximum(size + other_size, 1)
    return apart <= (1 - LEAST) / (1 + LEAST) + 1e-9, apart


def _outside(ring: Ring, fp: np.ndarray, label: np.ndarray, size: np.ndarray, sketch: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each place of a large run outside the commonest label, with the places before it
    that are near, of another label and may be similar, the nearest first.

    The run is put in order of its labels, the commonest first, so of every pair of
    unlike labels one end has the other among its places.  The order hangs on the
    arguments alone.
    """
    for i in range(int(np.unique(label, return_counts=True)[1].max()), len(fp)):
        other = np.flatnonzero(label[:i] != label[i])
        fits, apart = may_be_similar(size[other], sketch[other], size[i], sketch[i])
        other, apart = other[fits], apart[fits]
        near = near_all(ring, fp[other], np.repeat(fp[i : i + 1], len(other), axis=0))
        if near.any():
            yield i, other[near][np.argsort(apart[near], kind="stable")]


def _by_label(label: np.ndarray) -> np.ndarray:
    """The order of a run by its labels, the commonest first."""
    _, place, size = np.unique(label, return_inverse=True, return_counts=True)
    return np.lexsort((place, -size[place]))


def _between(ring: Ring, fp: np.ndarray, node: np.ndarray, label: np.ndarray) -> tuple[list, list]:
    """Pairs of a large run's nodes with the nearest near node of another label, for
    all nodes but those of the commonest label: no more pairs than nodes."""
    order = _by_label(label)
    fp, node, label = fp[order], node[order], label[order]
    # fingerprints stand for the sketches: sets of that size may all be similar
    pairs = [(int(node[i]), int(node[near[0]])) for i, near in _outside(ring, fp, label, np.full(len(fp), 1 << 20), fp)]
    return [a for a, _ in pairs], [b for _, b in pairs]


def _batch(one: list, other: list, keys: list) -> pa.RecordBatch:
    """Rows of pairs, and rows of keys."""
    columns = (one + [None] * len(keys), other + [None] * len(keys), [None] * len(one) + keys)
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["a", "b", "key"])


def _by_runs(rows: DataFrame, run: common.Run) -> DataFrame:
    return rows.repartition("key").sortWithinPartitions("key", "node").mapInArrow(common.tidy(run), "a long, b long, key long")


def _pairs(rows: DataFrame, ring: Ring, middle_run: int, stars: bool) -> DataFrame:
    """``a, b`` of near pairs within runs of ``rows(key, node, label, words)`` that
    ``label`` doesn't connect: all of runs up to ``middle_run``.  Of larger runs there
    are ``stars`` at most, and a row with the ``key``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for first, (key, node, label, *fp) in _runs(batches):
            fp, size = np.stack(fp, axis=1).view(np.uint64), np.diff(np.r_[first, len(key)])
            one, other, large = [], [], np.flatnonzero(size > middle_run)
            for k in large if stars else ():
                part = slice(first[k], first[k] + size[k])
                a, b = _stars(ring, fp[part], node[part])
                one, other = one + a, other + b
            keys = key[first[large]].tolist()
            small = np.repeat((size > 1) & (size <= middle_run), size)
            key, fp, node, label = key[small], fp[small], node[small], label[small]
            at, shift = np.arange(len(key)), 1
            while len(at := at[at + shift < len(key)]):
                at = at[key[at] == key[at + shift]]
                apart = at[label[at] != label[at + shift]]
                near = apart[near_all(ring, fp[apart], fp[apart + shift])]
                one += node[near].tolist()
                other += node[near + shift].tolist()
                shift += 1
            yield _batch(one, other, keys)

    return _by_runs(rows, run)


def _asked(rows: DataFrame, ring: Ring, low: int, high: int) -> DataFrame:
    """``a, b`` of near pairs within large runs of ``rows(key, node, label, now, size,
    sketch, words)`` that neither ``label`` nor ``now`` connects: the partners ``low`` to
    ``high`` of each node, the nearest first; a row with the ``key`` tells that the run
    has more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for first, (key, node, label, now, size, sketch, *fp) in _runs(batches):
            fp = np.stack(fp, axis=1).view(np.uint64)
            sketch = np.frombuffer(b"".join(sketch), np.uint64).reshape(-1, SKETCH // 64)
            for begin, end in zip(first, np.r_[first[1:], len(key)]):
                order, more = begin + _by_label(label[begin:end]), False
                nodes, nows = node[order], now[order]
                one, other = [], []
                for i, near in _outside(ring, fp[order], label[order], size[order], sketch[order]):
                    open_ = nows[near] != nows[i]
                    more = more or bool(open_[high:].any())
                    asked = nodes[near[low:high][open_[low:high]]]
                    one += [int(nodes[i])] * len(asked)
                    other += asked.tolist()
                    if len(one) >= CHUNK:
                        yield _batch(one, other, [])
                        one, other = [], []
                yield _batch(one, other, [int(key[begin])] if more else [])

    return _by_runs(rows, run)


def _groups(docs: DataFrame, entries: DataFrame, words_each: int, ring: Ring, middle_run: int) -> DataFrame:
    """``node, component`` of the ``entries(content, keys, size, sketch, words)`` that
    verified links connect; ``component`` is a node of the group.

    The first keys give links that are verified; then all keys are asked for pairs
    that these don't connect yet, so a group isn't compared anew under each key.
    Large runs are asked in rounds: for the nearest partner of each node outside the
    run's main group, the next eight, the next 64, and so on, as long as a run has
    near pairs that the links so far don't connect.  A round's links meet the groups
    of the last one, not all links so far.
    """
    node = F.col("content").alias("node")

    def verified(found: DataFrame, name: str) -> DataFrame:
        pairs = found.filter("a is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        pairs = common.materialise(pairs, f"{name}_pairs")
        sets = shingle_sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("content")), words_each)
        return common.materialise(similar(pairs, sets).select(F.col("a").alias("u"), F.col("b").alias("v")), f"{name}_links")

    def labelled(rows: DataFrame, groups: DataFrame, name: str) -> DataFrame:
        labels = common.small(groups.select("node", F.col("component").alias(name)))
        return rows.join(labels, "node", "left").withColumn(name, F.coalesce(name, "node"))

    keys = lambda found: found.filter("key is not null").select("key")
    under = lambda keys, rows, *more: rows.select(F.explode(keys).alias("key"), "node", "label", *more, *ring.columns)
    rows = entries.select("keys", node, F.col("content").alias("label"), *ring.columns)
    found = common.materialise(_pairs(under(F.slice("keys", 1, FIRST_BANDS), rows), ring, middle_run, True), "found")
    groups = common.materialise(components(verified(found, "first")), "components")
    known = common.materialise(labelled(entries.select("keys", node, "size", "sketch", *ring.columns), groups, "label"), "labelled")
    rest = common.materialise(_pairs(under(F.slice("keys", FIRST_BANDS + 1, BANDS), known), ring, middle_run, False), "found")
    large, found, rows = keys(found).unionByName(keys(rest)), rest, known.withColumn("now", F.col("label"))
    low, high = 0, 1
    while True:
        if more := bool(large.limit(1).count()):
            asked = under(F.col("keys"), rows, "now", "size", "sketch").join(common.small(large), "key", "left_semi")
            asked = common.materialise(_asked(asked, ring, low, high), "asked")
            found = asked if found is None else found.unionByName(asked)
            large, low, high = keys(asked), high, 1 + GROWTH * high
            more = bool(large.limit(1).count())
        new = verified(found, "more")
        if new.limit(1).count():
            stars = groups.select(F.col("node").alias("u"), F.col("component").alias("v"))
            groups = common.materialise(components(stars.unionByName(new)), "components")
        if not more:
            return groups
        found, rows = None, labelled(known, groups, "now")


def keep_one(docs: DataFrame, words_each: int = 5, ring: Ring = WIDE, middle_run: int = MIDDLE_RUN) -> DataFrame:
    """``docs`` with one document of each group of near copies, with all columns.

    Near copies are texts of shingle similarity 0.8 and more; they and what they
    link make a group.  Fingerprints propose pairs, and each is verified by its
    shingles before it links.  Of a group the least id stays, of equal texts too.
    Rows without ``doc_id`` stay; of rows that repeat an id and a text one stays;
    rows that repeat an id with another text are documents of their own.
    """
    common.shared_dir(docs.sparkSession)
    known = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), content_of().alias("content"))
    ids = common.materialise(known.groupBy("id", "content").agg(F.count("*").alias("times")), "ids")
    texts = docs.filter("doc_id is not null").select(content_of().alias("content"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    entries = _entries(texts, words_each, ring)
    entries = common.materialise(entries.groupBy("content").agg(*(F.first(c).alias(c) for c in (*ring.columns, "size", "keys", "sketch"))), "fingerprints")
    groups = _groups(docs, entries, words_each, ring, middle_run)
    named = ids.join(groups, F.col("content") == F.col("node"), "left").select("id", "content", "times", F.coalesce("component", "content").alias("group"))
    named = common.materialise(named, "named")
    least = named.groupBy("group").agg(F.min(F.struct("id", "content")).alias("stays"))
    marked = named.join(least, "group").select("id", "content", "times", (F.struct("id", "content") == F.col("stays")).alias("first"))
    id_, content, stays, number = (common.unused(docs, f"__llm_{x}") for x in ("id", "content", "stays", "copy"))
    marks = marked.filter("not first or times > 1").select(F.col("id").alias(id_), F.col("content").alias(content), F.col("first").alias(stays))
    marks = common.small(common.materialise(marks, "marks"))
    same = (F.col("doc_id").cast("long") == F.col(id_)) & (content_of() == F.col(content))
    repeated = docs.join(marks.filter(stays), same)  # rows that repeat an id and a text that stays
    copy = Window.partitionBy(id_, content).orderBy(F.lit(0))
    once = repeated.withColumn(number, F.row_number().over(copy)).filter(F.col(number) == 1)
    return docs.join(marks, same, "left_anti").unionByName(once.select(*docs.columns))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"))
