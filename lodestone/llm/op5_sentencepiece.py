"""SentencePiece encoding and decoding by vectorised merge rounds.

A text is cut into units at the word mark (a run of marks and the word behind
it).  No vocabulary piece has a mark behind another character, so no merge ever
crosses a unit and units can be encoded apart, once each.  The units that a
worker hasn't met are encoded together:

* all their characters lie in one flat symbol array, with the unit of each;
* a round looks up the rank of every adjacent pair, takes the least rank of
  each unit (a segmented minimum) and merges its leftmost pair, in all units at
  once.  Further places of the same rank in a unit are merged in the same round
  when no pair that arises on the way has a rank as good; else they wait;
* merged symbols are compacted, units without a mergeable pair leave the array,
  and rounds go on until none is left.

Characters outside the vocabulary become byte pieces.  Decoding joins the bytes
of the pieces and drops the one space that encoding puts in front.

Defined results: a null text counts as empty; an empty text has only the begin
and end ids and decodes to the empty text.  Repeated rows give repeated rows; a
null ``doc_id`` stays null.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MODEL = public_tokenizers.path("piece_bpe_32k.model")
MARK = "▁"
_UNITS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
#: Units of one generation of a worker's store.
CACHE_UNITS = 150_000
#: Characters of texts that are encoded together.
RUN_CHARS = 1 << 20
_NO_RANK = np.int32(2**31 - 1)
#: Symbols of characters that no piece holds start here.
_FOREIGN = 1 << 21


class Encoder:
    """Encodes and decodes with the pieces of a SentencePiece BPE model."""

    def __init__(self, model: str = MODEL, cache_units: int = CACHE_UNITS):
        sp = self.library = sentencepiece.SentencePieceProcessor(model_file=model)
        self.bos, self.eos = sp.bos_id(), sp.eos_id()
        size = sp.get_piece_size()
        self.table: list[bytes] = []
        self.byte_ids = np.zeros(256, np.int64)
        pieces: dict[str, tuple[int, float]] = {}
        for i in range(size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value] = i
                self.table.append(bytes([value]))
            elif sp.is_control(i):
                self.table.append(b"")
            elif sp.is_unknown(i):
                self.table.append(" ⁇ ".encode())
            else:
                pieces[piece] = (i, sp.get_score(i))
                self.table.append(piece.replace(MARK, " ").encode())
        self.is_byte = np.zeros(size, bool)
        self.is_byte[self.byte_ids] = True
        self.marked = {i for p, (i, _) in pieces.items() if p[0] == MARK}
        assert not any(MARK in p.lstrip(MARK) or "\n" in p for p in pieces), "a piece crosses a unit"
        self._build_pairs(pieces, size)
        self.words = common.Cache(self._encode_marked, cache_units)
        self.others = common.Cache(self._encode_parts, cache_units)

    def _build_pairs(self, pieces: dict[str, tuple[int, float]], size: int) -> None:
        order = {s: r for r, s in enumerate(sorted({s for _, s in pieces.values()}, reverse=True))}
        symbols = {p: i for p, (i, _) in pieces.items()}
        for p in pieces:  # single characters that only occur inside pieces
            for c in p:
                symbols.setdefault(c, len(symbols) + size)
        self.vocabulary = size
        self.outside = {i: c for c, i in symbols.items() if i >= size}
        self.of_char = np.arange(0x110000, dtype=np.int64) + _FOREIGN
        for p, i in symbols.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        self.width = 1 << 23
        pairs = [
            (symbols[p[:k]] * self.width + symbols[p[k:]], order[score], i)
            for p, (i, score) in pieces.items()
            for k in range(1, len(p))
            if p[:k] in symbols and p[k:] in symbols
        ]
        pairs.sort()
        self.pair_keys = np.array([x[0] for x in pairs], np.int64)
        self.pair_rank = np.array([x[1] for x in pairs] + [_NO_RANK], np.int32)
        self.pair_into = np.array([x[2] for x in pairs] + [-1], np.int64)

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and resulting symbol of each pair."""
        key = left * self.width + right
        at = np.searchsorted(self.pair_keys, key)
        at[at == len(self.pair_keys)] = 0
        at[self.pair_keys[at] != key] = len(self.pair_keys)
        return self.pair_rank[at], self.pair_into[at]

    def _ranks(self, symbol: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the pair that starts at each place; the last place has none."""
        rank = np.full(len(symbol), _NO_RANK, np.int32)
        into = np.full(len(symbol), -1, np.int64)
        if len(symbol) > 1:
            r, m = self._look_up(symbol[:-1], symbol[1:])
            r[unit[:-1] != unit[1:]] = _NO_RANK
            rank[:-1], into[:-1] = r, m
        return rank, into

    def _rank_again(self, symbol, unit, rank, into, merged) -> None:
        """New ranks of the pairs on either side of merged symbols."""
        at = np.concatenate([merged, merged[merged > 0] - 1])
        last = at == len(symbol) - 1
        rank[at[last]] = _NO_RANK
        at = at[~last]
        r, m = self._look_up(symbol[at], symbol[at + 1])
        r[unit[at] != unit[at + 1]] = _NO_RANK
        rank[at], into[at] = r, m

    def merge_rounds(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The final symbols of all units, and the unit of each, in order."""
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        symbol = self.of_char[np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)]
        unit = np.repeat(np.arange(len(units)), lengths)
        ready: list[tuple[np.ndarray, np.ndarray]] = []
        rank, into = self._ranks(symbol, unit)
        while len(symbol):
            first = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
            size = np.diff(np.r_[first, len(unit)])
            least = np.minimum.reduceat(rank, first)
            live = np.repeat(least != _NO_RANK, size)
            if not live.all():
                ready.append((unit[~live], symbol[~live]))
                symbol, unit, rank, into = symbol[live], unit[live], rank[live], into[live]
                size, least = size[least != _NO_RANK], least[least != _NO_RANK]
                if not len(symbol):
                    break
            place = np.flatnonzero(rank == np.repeat(least, size))
            # of places in a row only every other one can be merged
            fresh = np.r_[True, (place[1:] != place[:-1] + 1) | (unit[place[1:]] != unit[place[:-1]])]
            run = np.maximum.accumulate(np.where(fresh, np.arange(len(place)), 0))
            place = place[(np.arange(len(place)) - run) % 2 == 0]
            leading = np.r_[True, unit[place[1:]] != unit[place[:-1]]]
            if not leading.all():
                place = self._hold_back(symbol, unit, rank, into, place, leading)
            symbol[place] = into[place]
            keep = np.ones(len(symbol), bool)
            keep[place + 1] = False
            symbol, unit, rank, into = symbol[keep], unit[keep], rank[keep], into[keep]
            self._rank_again(symbol, unit, rank, into, place - np.arange(len(place)))
        if not ready:
            return symbol, unit
        unit, symbol = np.concatenate([x[0] for x in ready]), np.concatenate([x[1] for x in ready])
        order = np.argsort(unit, kind="stable")
        return symbol[order], unit[order]

    def _hold_back(self, symbol, unit, rank, into, place, leading) -> np.ndarray:
        """``place`` without the later places of units where a merge on the way
        gives rise to a pair of a rank as good as the one being merged."""
        merged = symbol.copy()
        merged[place] = into[place]
        bad = np.zeros(len(place), bool)
        after = np.minimum(place + 2, len(symbol) - 1)
        inside = (place + 2 < len(symbol)) & (unit[after] == unit[place])
        for right in (symbol[after], merged[after]):
            r, _ = self._look_up(into[place], right)
            bad |= inside & (r <= rank[place])
        before = np.maximum(place - 1, 0)
        inside = (place > 0) & (unit[before] == unit[place])
        r, _ = self._look_up(symbol[before], into[place])
        bad |= inside & (r <= rank[place])
        number = np.cumsum(leading) - 1
        held = np.bincount(number, bad) > 0
        return place[leading | ~held[number]]

    def _encode_new(self, units: list[str]) -> list[bytes]:
        """The little-endian 32-bit ids of each unit, as bytes."""
        symbol, unit = self.merge_rounds(units)
        foreign = np.flatnonzero(symbol >= self.vocabulary)
        if len(foreign):  # byte pieces
            chars = [chr(s - _FOREIGN) if s >= _FOREIGN else self.outside[s] for s in symbol[foreign].tolist()]
            encoded = [c.encode() for c in chars]
            times = np.ones(len(symbol), np.int64)
            times[foreign] = [len(e) for e in encoded]
            ends = np.cumsum(times)
            symbol, unit = np.repeat(symbol, times), np.repeat(unit, times)
            values = np.frombuffer(b"".join(encoded), np.uint8)
            spread = np.repeat(ends[foreign] - times[foreign], times[foreign])
            offset = np.arange(len(values)) - np.repeat(np.cumsum(times[foreign]) - times[foreign], times[foreign])
            symbol[spread + offset] = self.byte_ids[values]
        data = symbol.astype("<u4").tobytes()
        ends = np.cumsum(np.bincount(unit, minlength=len(units))) * 4
        return [data[a:b] for a, b in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist())]

    def _encode_marked(self, keys: list[str]) -> list[bytes]:
        """Units of words that stand behind one mark, or behind a line end."""
        return self._encode_parts([k if k[:1] == "\n" else MARK + k for k in keys])

    def _encode_parts(self, units: list[str]) -> list[bytes]:
        step = 50_000
        return [x for at in range(0, len(units), step) for x in self._encode_new(units[at : at + step])]

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text without begin and end, as little-endian bytes.

        Texts are cut into units in runs of ``RUN_CHARS``, since units take many times
        the memory of their texts.
        """
        out: list[bytes] = []
        run, chars = 0, 0
        for i, t in enumerate(texts, 1):
            chars += len(t)
            if chars >= RUN_CHARS or i == len(texts):
                out += self._ids_of_run(texts[run:i])
                run, chars = i, 0
        return out

    def _ids_of_run(self, texts: list[str]) -> list[bytes]:
        plain: list[list[str]] = []
        raw: list[list[str]] = []
        odd: list[bool] = []
        for t in texts:
            odd.append(t[:1] == " " or "  " in t or MARK in t)
            if odd[-1]:
                raw.append(_UNITS.findall(MARK + t.replace(" ", MARK)))
            else:
                # a line end is in no piece, so a unit may also start there
                plain.append(t.replace("\n", " \n").split(" ") if t else [])
        one, other = iter(self.words.joined(plain)), iter(self.others.joined(raw))
        return [next(other) if x else next(one) for x in odd]

    def forget(self) -> None:
        """Let the units go that are stored for texts to come."""
        self.words.clear()
        self.others.clear()

    def encode(self, text: str) -> list[int]:
        return [self.bos, *np.frombuffer(self.ids([text])[0], "<u4").tolist(), self.eos]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; the marks become spaces and the first is dropped."""
        values = ids.tolist()
        shown = [i for i in values if i not in (self.bos, self.eos)]
        data = b"".join(map(self.table.__getitem__, shown))
        if shown and shown[0] in self.marked:
            data = data[1:]
        try:
            return data.decode()
        except UnicodeDecodeError:  # byte pieces that are no character: the library's replacements
            return self.library.decode(values)


_encoders: dict[str, Encoder] = {}


def encoder(model: str = MODEL) -> Encoder:
    """One encoder for each worker process."""
    if model not in _encoders:
        _encoders[model] = Encoder(model)
    return _encoders[model]


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """``doc_id``, ``ids`` (with begin and end) and the text they decode to."""
    common.tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model)
        edge = [np.array([x], "<u4").tobytes() for x in (enc.bos, enc.eos)]
        for batch in batches:
            ids = [np.frombuffer(edge[0] + x + edge[1], "<u4") for x in enc.ids(batch.column(1).to_pylist())]
            offsets = np.r_[0, np.cumsum([len(x) for x in ids])].astype(np.int32)
            flat = np.concatenate(ids).astype(np.int32) if ids else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array([enc.decode(x) for x in ids], pa.string())],
                ["doc_id", "ids", "decoded"],
            )

    return common.texts_of(docs).mapInArrow(common.tidy(run, lambda: encoder(model).forget()), "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """The count and digests of what ``encode`` gives, without handing the ids on."""
    common.tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model)
        edge = [np.array([x], "<u4").tobytes() for x in (enc.bos, enc.eos)]
        for batch in batches:
            ids = [edge[0] + x + edge[1] for x in enc.ids(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                    pa.array([hashlib.sha256(enc.decode(np.frombuffer(x, "<u4")).encode()).hexdigest() for x in ids]),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return common.texts_of(docs).mapInArrow(common.tidy(run, lambda: encoder(model).forget()), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(common.table(spark, sf_dir, "documents"))
