"""Content-addressed store of token ids.

A document's ids (with the end id) are cut into chunks where a rolling hash of
the last 32 ids meets a mask, so equal passages give equal chunks wherever they
stand.  The store is a folder of four tables:

``chunks``    ``doc_id``, ``row``, ``seq``, ``digest`` (SHA-256, first 16 bytes),
              ``n``, ``payload``: a row for each chunk of each document; the
              payload, ids as little-endian integers of the least width that
              holds the vocabulary, stands in one row of each digest;
``recipes``   ``doc_id``, ``part``, ``place``, ``local_start``, ``n_tokens``,
              ``digests`` (the chunks in order), ``root`` (Merkle root of the
              digests), in ascending ``doc_id`` order: part after part, sorted
              within the part;
``parts``     ids before each part;
``manifest``  Merkle nodes over the document roots: one for each ``FAN``
              documents of a part, one for each part, one for the store.

Texts are encoded in one pass.  Payloads become unique on the map side first and
then meet under their digest; repeats without one are dealt out by document, so
a passage that a third of the corpus shares costs one payload for each task.
Reading verifies every chunk against its digest, every document against its root
and all recipes against the manifest; checksums of documents are combined from those of chunks, so payloads are
not shuffled again.

Words are encoded once for each worker: the vocabulary drops white space and
never merges across it, so a text's ids are those of its words.

Defined results: a null text counts as empty and has the end id only.  Documents
are ordered by ``doc_id``, null first; repeated ids by Merkle root.  Extra
columns are ignored.  An empty table gives an empty store.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
END_ID = 1
MIN_CHUNK, MAX_CHUNK, CUT_BITS = 128, 4096, 9
DIGEST_BYTES = 16
#: Documents or nodes under one Merkle node of the manifest.
FAN = 1024
#: Words of one generation of a worker's store.
CACHE_WORDS = 800_000
#: Words that go to the library at once.
PART_WORDS = 4000
#: White space as the vocabulary's own pattern has it, and nothing else.
_SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
_ODD = re.compile("[\x1c-\x1f]")
#: ASCII letters and signs behind them that neither join nor compose with letters.
_SIGNED = re.compile(r"([A-Za-z\xdf-\xf6\xf8-\xff]+)([!#$%&*+,\-./:;=?@^_`|~]+)")
#: Kinds of the Latin-1 characters: letters and digits, white space, full stop and
#: comma, the separators that only Python takes for white space, and the rest.
_KINDS = bytes(
    ord("a" if c.isalnum() else "!" if "\x1c" <= c <= "\x1f" else " " if c.isspace() else "." if c in ".," else "#") for c in map(chr, range(256))
)
PIECE_ROW = "doc_id long, row long, seq int, digest binary, n int, payload binary"
PIECE_NAMES = [x.split()[0] for x in PIECE_ROW.split(", ")]
RECIPE_ROW = "doc_id long, n_tokens long, digests binary, root binary"


class WordIds:
    """The ids of texts, word by word, by the tokenizers library."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(vocabulary)
        self.kind = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        special = [(i, t) for i, t in self.library.get_added_tokens_decoder().items() if t.special and not t.normalized]
        self.marks = [t.content for _, t in special]
        self.mark_id, self.mark = (special[0][0], special[0][1].content) if special else (None, None)
        ends = [i for t, i in self.library.get_vocab().items() if t.endswith("</w>")]
        self.is_end = np.zeros(1 << 8 * self.kind.itemsize if self.kind.itemsize == 2 else max(ends) + 2, bool)
        self.is_end[ends] = True
        self.words = common.Cache(self._encode, CACHE_WORDS)

    def _encode(self, words: list[str]) -> list[bytes]:
        """The ids of each word, many words in one call of the library."""
        letters = [w for w in words if w.isalpha()]
        if len(letters) == len(words):
            return self._in_parts(words, self._encode_letters)
        out = dict(zip(letters, self._in_parts(letters, self._encode_letters)))
        others = [w for w in words if not w.isalpha()]
        # letters with signs behind them are two words of the vocabulary's pattern
        split = {w: m.groups() for w in others if (m := _SIGNED.fullmatch(w))}
        out.update(zip(rest := [w for w in others if w not in split], self._in_parts(rest, self._encode_others)))
        stems = list({x for x, _ in split.values()}.difference(out))
        out.update(zip(stems, self._in_parts(stems, self._encode_letters)))
        signs = list({x for _, x in split.values()}.difference(out))
        out.update(zip(signs, self._in_parts(signs, self._encode_others)))
        out.update((w, out[stem] + out[sign]) for w, (stem, sign) in split.items())
        return list(map(out.__getitem__, words))

    @staticmethod
    def _in_parts(words: list[str], encode) -> list[bytes]:
        return [x for at in range(0, len(words), PART_WORDS) for x in encode(words[at : at + PART_WORDS])]

    def _split(self, ids: np.ndarray, ends: np.ndarray, gap: int = 0) -> list[bytes]:
        """The ids of each word, from where it ends; ``gap`` ids stand between two."""
        data, width = ids.tobytes(), self.kind.itemsize
        starts = np.r_[0, ends[:-1] + gap] * width
        return [data[a:b] for a, b in zip(starts.tolist(), (ends * width).tolist())]

    def _encode_letters(self, words: list[str]) -> list[bytes]:
        """Words of letters: each ends with the one end-of-word piece it has."""
        ids = np.array(self.library.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, self.kind)
        ends = np.flatnonzero(self.is_end[ids]) + 1
        return self._split(ids, ends) if len(ends) == len(words) else self._encode_others(words)

    def _encode_others(self, words: list[str]) -> list[bytes]:
        """Any words, with a special token between them: the library cuts a text
        there before anything else."""
        if self.mark is None or any(m in w for w in words for m in self.marks):
            return [np.array(x.ids, self.kind).tobytes() for x in self.library.encode_batch_fast(words, add_special_tokens=False)]
        ids = np.array(self.library.encode_batch_fast([self.mark.join(words)], add_special_tokens=False)[0].ids, self.kind)
        return self._split(ids, np.r_[np.flatnonzero(ids == self.mark_id), len(ids)], 1)

    @staticmethod
    def units(text: str) -> list[str]:
        """The units of a text: its words.

        In texts of Latin-1 characters lower case and composition go by single
        characters.  There lower case is taken here, and a full stop or comma
        stands apart from a letter or digit before it, as in the vocabulary's
        pattern: fewer units for the same ids.
        """
        try:
            kinds = text.encode("latin-1").translate(_KINDS)
        except UnicodeEncodeError:
            return [w for w in _SPACE.split(text) if w] if _ODD.search(text) else text.split()
        if b"!" in kinds:
            return [w for w in _SPACE.split(text) if w]
        text = text.lower()
        if b"#." not in kinds and b".." not in kinds:
            text = text.replace(".", " .").replace(",", " ,")
        return text.split()

    def encoded(self, texts: list[str]) -> list[bytes]:
        return self.words.joined(list(map(self.units, texts)))

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(x, self.kind) for x in self.encoded(texts)]


_word_ids: dict[str, WordIds] = {}


def word_ids(vocabulary: str) -> WordIds:
    if vocabulary not in _word_ids:
        _word_ids[vocabulary] = WordIds(vocabulary)
    return _word_ids[vocabulary]


def _gear(ids: np.ndarray) -> np.ndarray:
    """A pseudo-random 64-bit number for each id (splitmix64)."""
    x = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_GEARS = _gear(np.arange(1 << 16))


def rolling_hash(ids: np.ndarray) -> np.ndarray:
    """At each place the hash of the 32 ids that end there."""
    h = _GEARS[ids] if ids.dtype.itemsize == 2 else _gear(ids)
    for k in (1, 2, 4, 8, 16):
        h[k:] += h[:-k].copy() << np.uint64(k)
    return h


def marks(ids: np.ndarray) -> np.ndarray:
    """Places behind which the rolling hash meets the mask."""
    # the top bits hang on all 32 ids of the window
    return np.flatnonzero(rolling_hash(ids) >> np.uint64(64 - CUT_BITS) == 0) + 1


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of one document's ids."""
    return _cuts(len(ids), marks(ids).tolist() if len(ids) > MIN_CHUNK else [])


def _cuts(n: int, places: list[int]) -> list[int]:
    """Ends of the chunks of ``n`` ids with marks at ``places``."""
    out, at = [], 0
    if n > MIN_CHUNK:
        for place in places:
            while place - at > MAX_CHUNK:
                at += MAX_CHUNK
                out.append(at)
            if place - at >= MIN_CHUNK and n - place >= 1:
                at = place
                out.append(at)
        while n - at > MAX_CHUNK:
            at += MAX_CHUNK
            out.append(at)
    return [*out, n]


def cuts_of(ids: np.ndarray, ends: np.ndarray) -> list[list[int]]:
    """``cuts`` of documents laid end to end.  Only at a document's first places do the
    32 ids reach back into another, and no chunk of under ``MIN_CHUNK`` ids ends there."""
    places, starts = marks(ids), np.r_[0, ends[:-1]]
    last = np.searchsorted(places, ends, "right")
    first = np.r_[0, last[:-1]]
    return [_cuts(b - a, (places[i:j] - a).tolist()) for a, b, i, j in zip(starts.tolist(), ends.tolist(), first.tolist(), last.tolist())]


def digest_of(payload: bytes) -> bytes:
    return hashlib.sha256(payload).digest()[:DIGEST_BYTES]


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary hash tree; an odd node moves up alone."""
    level = [hashlib.sha256(b"\0" + x).digest() for x in leaves] or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + b"".join(level[i : i + 2])).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def _document_chunks(texts: list[str], vocabulary: str, end_id: int) -> Iterator[tuple[int, list[tuple[int, bytes]]]]:
    """(ids, [(ids in chunk, payload)]) for each text."""
    words = word_ids(vocabulary)
    end, width = np.array([end_id], words.kind).tobytes(), words.kind.itemsize
    documents = [x + end for x in words.encoded(texts)]
    sizes = [len(x) // width for x in documents]
    if not documents:
        return
    for n, data, ends in zip(sizes, documents, cuts_of(np.frombuffer(b"".join(documents), words.kind), np.cumsum(sizes))):
        yield n, [(b - a, data[a * width : b * width]) for a, b in zip([0, *ends[:-1]], ends)]


def _pieces(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """A row for each chunk of each document; ``payload`` only with the first
    that the task meets.  ``row`` tells documents apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[bytes] = set()
        row = (TaskContext.get().partitionId() << 40) - 1
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            encoded = _document_chunks(batch.column(1).to_pylist(), vocabulary, end_id)
            for doc_id, (_, chunks) in zip(batch.column(0).to_pylist(), encoded):
                row += 1
                for seq, (n, payload) in enumerate(chunks):
                    digest = digest_of(payload)
                    known = digest in sent
                    sent.add(digest)
                    for column, value in zip(out, (doc_id, row, seq, digest, n, None if known else payload)):
                        column.append(value)
            if len(sent) > 500_000:
                sent.clear()
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], PIECE_NAMES)

    return docs.mapInArrow(run, PIECE_ROW)


def _stored_once(pieces: DataFrame) -> DataFrame:
    """``pieces`` with one payload for each digest.  Rows with a payload meet under
    their digest; the others, however many, are dealt out by document."""
    place = F.when(F.col("payload").isNotNull(), F.xxhash64("digest")).otherwise(F.xxhash64("row", "seq"))
    dealt = pieces.withColumn("place", place).repartition("place")
    alike = Window.partitionBy("place", "digest").orderBy(F.col("payload").isNull(), "row", "seq")
    first = F.row_number().over(alike) == 1
    return dealt.select("doc_id", "row", "seq", "digest", "n", F.when(first, F.col("payload")).alias("payload"))


def _flat(lists: pa.ListArray) -> tuple[list[int], pa.StructArray]:
    """Where the lists of a column end, and their items laid end to end."""
    ends = np.cumsum(lists.value_lengths().to_numpy()).tolist()
    return ends, lists.flatten()


def _recipes(chunks: DataFrame) -> DataFrame:
    """The recipe of each document from the rows of its chunks."""
    whole = chunks.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.sum("n").alias("n_tokens"),
        F.array_sort(F.collect_list(F.struct("seq", "digest"))).alias("chunks"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, flat = _flat(batch.column(2))
            digests = flat.field("digest").to_pylist()
            leaves = [digests[a:b] for a, b in zip([0, *ends[:-1]], ends)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([b"".join(x) for x in leaves], pa.binary()), pa.array([merkle(x) for x in leaves], pa.binary())],
                ["doc_id", "n_tokens", "digests", "root"],
            )

    return whole.select("doc_id", "n_tokens", "chunks").mapInArrow(run, RECIPE_ROW)


def _in_order(recipes: DataFrame) -> DataFrame:
    """Recipes dealt out by ``doc_id`` range, with part, place and start in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place, start = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            n = batch.column(1).to_numpy()
            starts = start + np.cumsum(n) - n
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(n), part, np.int32)), pa.array(place + np.arange(len(n))), pa.array(starts)],
                [*batch.schema.names, "part", "place", "local_start"],
            )
            place, start = place + len(n), start + int(n.sum())

    order = [F.col("doc_id").asc_nulls_first(), F.col("root").asc()]
    ordered = recipes.repartitionByRange(*order).sortWithinPartitions(*order)
    return ordered.mapInArrow(run, RECIPE_ROW + ", part int, place long, local_start long")


def _nodes(leaves: DataFrame, *keys: str) -> DataFrame:
    """Merkle nodes over ``root`` in ``place`` order within ``keys``."""
    inside = F.transform(F.array_sort(F.collect_list(F.struct("place", "root"))), lambda x: F.hex(x["root"]))
    return leaves.groupBy(*keys).agg(F.unhex(F.sha2(F.concat_ws("", inside), 256)).alias("root"))


def manifest(recipes: DataFrame) -> DataFrame:
    """``level, part, place, root``: nodes of ``FAN`` documents, of parts, of the store."""
    low = _nodes(recipes.select("part", F.expr(f"place div {FAN}").alias("node"), "place", "root"), "part", "node")
    low = low.select(F.lit(0).alias("level"), "part", F.col("node").alias("place"), "root")
    parts = _nodes(low, "part").select(F.lit(1).alias("level"), "part", F.col("part").cast("long").alias("place"), "root")
    top = _nodes(parts, "level").select(F.lit(2).alias("level"), F.lit(-1).alias("part"), F.lit(0).cast("long").alias("place"), "root")
    return low.unionByName(parts).unionByName(top)


def write_store(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> None:
    """Encode every text of ``docs`` into a store at ``path``."""
    spark = docs.sparkSession
    common.tune(spark)
    texts = common.texts_of(docs)
    _stored_once(_pieces(texts, vocabulary, end_id)).write.parquet(f"{path}/chunks")
    # written first: dealing out by range asks for its rows twice
    made = common.materialise(_recipes(spark.read.schema(PIECE_ROW).parquet(f"{path}/chunks")), "recipes")
    _in_order(made).write.parquet(f"{path}/recipes")
    recipes = spark.read.parquet(f"{path}/recipes")
    totals = recipes.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row for each part
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")).write.parquet(f"{path}/parts")
    manifest(recipes).write.parquet(f"{path}/manifest")


_POLY = 0xEDB88320


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials modulo that of CRC-32, bits reflected."""
    out = np.zeros_like(a)
    for bit in range(31, -1, -1):
        out ^= np.where(a >> np.uint32(bit) & np.uint32(1), b, np.uint32(0))
        b = b >> np.uint32(1) ^ np.where(b & np.uint32(1), np.uint32(_POLY), np.uint32(0))
    return out


def joined_crcs(crcs: np.ndarray, sizes: np.ndarray, ends: list[int]) -> np.ndarray:
    """CRC-32 of each document from those of its parts and their bytes: a part's
    counts times ``x`` to the bits that follow it, and these are added up."""
    last = np.asarray(ends, np.int64)
    upto = np.cumsum(sizes.astype(np.int64))
    after = np.repeat(upto[last - 1], np.diff(np.r_[0, last])) - upto
    power, square = np.full(len(crcs), 1 << 31, np.uint32), np.full(1, 1 << 23, np.uint32)  # x^0 and x^8
    while after.any():
        odd = after & 1 == 1
        power[odd] = _times(power[odd], np.broadcast_to(square, int(odd.sum())))
        square, after = _times(square, square), after >> 1
    return np.bitwise_xor.reduceat(_times(power, crcs.astype(np.uint32)), np.r_[0, last[:-1]])


def _chunk_sums(chunks: DataFrame, wide: bool) -> DataFrame:
    """``digest, n, crc`` of chunks as read, verified against their digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = "<u4" if wide else "<u2"
        for batch in batches:
            n, crc = [], []
            for digest, length, payload in zip(*(c.to_pylist() for c in batch.columns)):
                ids = np.frombuffer(payload, kind)
                if digest_of(payload) != digest or len(ids) != length:
                    raise ValueError(f"chunk {digest.hex()} doesn't match its digest")
                n.append(length)
                crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32()), pa.array(crc, pa.int64())], ["digest", "n", "crc"])

    return chunks.filter("payload is not null").select("digest", "n", "payload").mapInArrow(run, "digest binary, n int, crc long")


def read_sums(spark: SparkSession, path: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files.

    A chunk, document or manifest that doesn't match its digest, root or nodes ends
    the run.
    """
    common.tune(spark)
    recipes = spark.read.parquet(f"{path}/recipes")
    node = ["level", "part", "place", "root"]
    kept, made = spark.read.parquet(f"{path}/manifest").select(node), manifest(recipes).select(node)
    # one row for FAN documents
    odd = kept.withColumn("side", F.lit(1)).unionByName(made.withColumn("side", F.lit(-1))).groupBy(node).agg(F.sum("side").alias("side")).filter("side <> 0")
    if odd.limit(1).count():
        raise ValueError(f"the manifest of {path} doesn't match its recipes")
    wide = word_ids(vocabulary).kind.itemsize == 4
    sums = _chunk_sums(spark.read.parquet(f"{path}/chunks"), wide)
    at = F.col("at")
    used = recipes.select(
        "part", "place", "root", "n_tokens", F.posexplode(F.expr(f"transform(sequence(0, length(digests) div {DIGEST_BYTES} - 1), i -> substring(digests, i * {DIGEST_BYTES} + 1, {DIGEST_BYTES}))")).alias("at", "digest")
    )
    met = used.join(sums, "digest", "left")
    whole = met.groupBy("part", "place").agg(
        F.first("root").alias("root"), F.first("n_tokens").alias("n_tokens"), F.array_sort(F.collect_list(F.struct(at, "digest", F.col("n").cast("long").alias("n"), "crc"))).alias("chunks")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ends, flat = _flat(batch.column(4))
            digests, n, crc = flat.field("digest").to_pylist(), flat.field("n"), flat.field("crc")
            whole_documents = np.add.reduceat(n.fill_null(-1 << 40).to_numpy(), np.r_[0, ends[:-1]]) == batch.column(3).to_numpy()
            for root, good, a, b in zip(batch.column(2).to_pylist(), whole_documents, [0, *ends[:-1]], ends):
                if not good or merkle(digests[a:b]) != root:
                    raise ValueError(f"document of root {root.hex()} can't be rebuilt")
            out = joined_crcs(crc.to_numpy(), 4 * n.to_numpy(), ends)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out.astype(np.int64))], ["part", "place", "ids_crc32"])

    checked = whole.mapInArrow(run, "part int, place long, ids_crc32 long")
    parts = spark.read.parquet(f"{path}/parts")
    starts = recipes.join(F.broadcast(parts), "part")  # a row for each written part
    return starts.join(checked, ["part", "place"]).select(
        "doc_id", (F.col("offset") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32"
    )


def read_ids(spark: SparkSession, path: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id`` and ``ids`` of every document, rebuilt from the chunks."""
    common.tune(spark)
    recipes, chunks = spark.read.parquet(f"{path}/recipes"), spark.read.parquet(f"{path}/chunks").filter("payload is not null").select("digest", "payload")
    used = recipes.select(
        "doc_id", "part", "place", F.posexplode(F.expr(f"transform(sequence(0, length(digests) div {DIGEST_BYTES} - 1), i -> substring(digests, i * {DIGEST_BYTES} + 1, {DIGEST_BYTES}))")).alias("at", "digest")
    )
    whole = used.join(chunks, "digest").groupBy("part", "place").agg(
        F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("at", "payload"))).alias("chunks")
    )
    kind = word_ids(vocabulary).kind

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(b"".join(c["payload"] for c in x), kind).astype(np.int32) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return whole.select("doc_id", "chunks").mapInArrow(run, "doc_id long, ids array<int>")


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.scratch_path(spark, "token_store")
    write_store(common.table(spark, sf_dir, "documents"), path)
    return read_sums(spark, path)
