"""SentencePiece encoding and decoding by vectorised merge rounds.

A text gets a leading space mark and its spaces become marks. No piece has a mark behind another letter,
so a run of marks with what follows is a unit of its own; line feeds stand in no piece and cut units too.
The distinct units of a group of rows lie as flat symbol arrays. Every round finds each unit's best pair
(highest score, leftmost of equals) and merges it, all units at once; then the arrays are compacted and
units without a pair leave. One merge a round in each unit is the library's order exactly. Units of over
LONG symbols go through a heap in the same order instead, so that a text without spaces costs n log n.

Letters outside the vocabulary become their UTF-8 bytes' pieces. A null or empty text has no ids and
decodes to an empty text. Repeated rows get equal results: a group encodes each of its texts once.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from scriptorium.llm.common import chunks, ship

MARK = "▁"
UNIT = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
LONG = 256
#: Units kept between groups of rows, and bytes of text in a group.
KEPT_UNITS, GROUP_BYTES = 150_000, 3_000_000
NONE = np.iinfo(np.int32).max
SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol buffer."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        if key & 7 == 0:
            value, at = _varint(data, at)
            yield key >> 3, value
        else:
            n, at = (8, at) if key & 7 == 1 else (4, at) if key & 7 == 5 else _varint(data, at)
            yield key >> 3, data[at : at + n]
            at += n


class PieceModel:
    """A byte-pair model with byte fallback, from the library's model file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.data = f.read()
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        scores: list[float] = []
        for number, value in _fields(self.data):
            if number == 1:
                own = dict(_fields(value))
                self.pieces.append(own[1].decode())
                scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                self.kinds.append(own.get(3, 1))
        self.size = len(self.pieces)
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] == 1}
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.kinds[i] == 6}
        self.numbers = [str(i) for i in range(self.size)]
        self.shown = [p.replace(MARK, " ") if k == 1 else None if k == 6 else "" for p, k in zip(self.pieces, self.kinds, strict=True)]
        self.letters = np.full(0x110000, -1, np.int32) - np.arange(0x110000, dtype=np.int32)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.letters[ord(p)] = i
        assert all(MARK not in p.lstrip(MARK) and "\n" not in p for p in self.ids), "units would not be independent"
        order = sorted({scores[i] for i in self.ids.values()}, reverse=True)
        place = {s: r for r, s in enumerate(order)}
        pairs = sorted(
            (self.ids[p[:k]] * self.size + self.ids[p[k:]], i) for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids
        )
        self.keys = np.array([k for k, _ in pairs], np.int64)
        self.merged = np.array([i for _, i in pairs], np.int32)
        self.ranks = np.array([place[scores[i]] for _, i in pairs], np.int32)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (NONE: no piece) and the piece it makes. Symbols below 0 are letters without a piece."""
        keys = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        good = (self.keys[at] == keys) & (left >= 0) & (right >= 0)
        return np.where(good, self.ranks[at], NONE).astype(np.int32), self.merged[at]

    def rounds(self, units: list[str]) -> list[list[int]]:
        """Symbols of each unit after all merges."""
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        points = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)
        sym, unit = self.letters[points], np.repeat(np.arange(len(units)), lengths)
        done_sym, done_unit = [], []
        rank = np.full(len(sym), NONE, np.int32)
        made = np.zeros(len(sym), np.int32)
        inner = np.flatnonzero(unit[:-1] == unit[1:])
        rank[inner], made[inner] = self.look_up(sym[inner], sym[inner + 1])
        while len(sym):
            first = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1])))
            counts = np.diff(np.append(first, len(sym)))
            best = np.minimum.reduceat(rank, first)
            over = best == NONE
            if over.any():
                gone = np.repeat(over, counts)
                done_sym.append(sym[gone])
                done_unit.append(unit[gone])
                stay = ~gone
                sym, unit, rank, made, best, counts = sym[stay], unit[stay], rank[stay], made[stay], best[~over], counts[~over]
                if not len(sym):
                    break
            at = np.flatnonzero(rank == np.repeat(best, counts))
            at = at[np.concatenate(([True], unit[at[1:]] != unit[at[:-1]]))]  # the leftmost of each unit
            sym[at] = made[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            rank[at + 1] = rank[at] = NONE
            new = at - np.arange(len(at))
            sym, unit, rank, made = sym[keep], unit[keep], rank[keep], made[keep]
            beside = np.zeros(len(sym) + 1, bool)
            beside[new] = beside[new - 1] = True  # before the first comes the last of the array, which is no symbol
            near = np.flatnonzero(beside[: len(sym) - 1])
            inside = near[unit[near] == unit[near + 1]]
            rank[near] = NONE
            rank[inside], made[inside] = self.look_up(sym[inside], sym[inside + 1])
        sym, unit = np.concatenate(done_sym), np.concatenate(done_unit)
        flat = sym[np.argsort(unit, kind="stable")].tolist()
        ends = np.cumsum(np.bincount(unit, minlength=len(units))).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def long(self, text: str) -> list[int]:
        """Symbols of one long unit, by a heap of pairs."""
        sym = [self.ids.get(c, -1 - ord(c)) for c in text]
        before, after = list(range(-1, len(sym) - 1)), [*range(1, len(sym)), -1]
        table = self.__dict__.setdefault("table", dict(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.merged.tolist(), strict=True), strict=True)))
        heap: list[tuple[int, int, int, int, int]] = []

        def push(i: int) -> None:
            if i >= 0 and (j := after[i]) >= 0 and sym[i] >= 0 and sym[j] >= 0 and (hit := table.get(sym[i] * self.size + sym[j])):
                heapq.heappush(heap, (hit[0], i, sym[i], sym[j], hit[1]))

        for i in range(len(sym)):
            push(i)
        while heap:
            _, i, a, b, piece = heapq.heappop(heap)
            j = after[i]
            if sym[i] != a or j < 0 or sym[j] != b:
                continue
            sym[i], sym[j] = piece, -(2**31)
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            push(before[i])
            push(i)
        return [s for s in sym if s != -(2**31)]

    def spelled(self, symbols: list[int]) -> list[int]:
        """Ids of symbols: letters without a piece become their bytes' pieces."""
        if not symbols or min(symbols) >= 0:
            return symbols
        return [i for s in symbols for i in ((s,) if s >= 0 else (self.bytes[b] for b in chr(-1 - s).encode()))]

    def encode_units(self, units: list[str]) -> list[list[int]]:
        short = [k for k, u in enumerate(units) if len(u) <= LONG]
        if len(short) == len(units):
            return list(map(self.spelled, self.rounds(units))) if units else []
        out: list[list[int]] = [[] for _ in units]
        if short:
            for k, symbols in zip(short, self.rounds([units[k] for k in short]), strict=True):
                out[k] = self.spelled(symbols)
        for k, u in enumerate(units):
            if len(u) > LONG:
                out[k] = self.spelled(self.long(u))
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids with its leading space; bytes that are no UTF-8 become U+FFFD."""
        shown = list(map(self.shown.__getitem__, ids))
        if None not in shown:
            return "".join(shown)
        out, run = [], bytearray()
        for i, piece in zip(ids, shown, strict=True):
            if piece is None:
                run.append(int(self.pieces[i][3:5], 16))
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run.clear()
            out.append(piece)
        if run:
            out.append(run.decode("utf-8", "replace"))
        return "".join(out)


def units_of(text: str | None) -> list[str]:
    return UNIT.findall(MARK + text.replace(" ", MARK)) if text else []


class Encoder:
    """Encodes groups of texts; remembers the first KEPT_UNITS units, so memory stays bounded."""

    def __init__(self, path: str):
        self.model, self.kept, self.passing = PieceModel(path), {}, []

    def encode(self, texts: list[str | None]) -> tuple[list[list[str]], dict[str, tuple[int, str, str]]]:
        """Units of each text, and for each unit (number of ids, ids joined by commas, decoded text); the dict holds until the next call."""
        for u in self.passing:
            del self.kept[u]
        full = len(self.kept) >= KEPT_UNITS
        split = [units_of(t) for t in texts]
        new = list(set().union(*split) - self.kept.keys())
        number, model = self.model.numbers.__getitem__, self.model
        if new:
            self.kept.update((u, (len(ids), ",".join(map(number, ids)), model.decode(ids))) for u, ids in zip(new, model.encode_units(new), strict=True))
        self.passing = [u for u in new if full or len(u) > 64]
        return split, self.kept


def encode(docs: DataFrame, model_path: str, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row of docs."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model_path)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for rows in chunks(batches, group_bytes):
            texts = list(dict.fromkeys(r["text"] for r in rows))  # copies, as a mix repeats them, are encoded once
            split, known = encoder.encode(texts)
            done: dict[str | None, tuple[int, str, str]] = {}
            for text, units in zip(texts, split, strict=True):
                counts, ids, shown = zip(*map(known.__getitem__, units), strict=True) if units else ((), (), ())
                done[text] = sum(counts), sha(",".join(ids)), sha("".join(shown)[1:])
            out = [[r["doc_id"] for r in rows], *map(list, zip(*(done[r["text"]] for r in rows), strict=True))]
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
