"""Media columns: FLAC.

The decoder takes the frames of many streams as lanes of numpy arrays: step i reads the i-th Rice
residual of every lane and adds its linear prediction, so a step costs a few array operations however
many lanes there are. Headers' CRC-8, frames' CRC-16 and the stream's MD5 are verified. A block of PCM is
a row with the offset of its first sample and the byte offset of its frame in the stream, both of which
the stream's seek table holds too. Streams whose seek table doesn't name each frame are decoded frame by
frame. Mono streams of up to 16 bits are read, with constant, verbatim, fixed and LPC subframes, Rice
partitions of any order, 4 and 5 bit parameters, escaped partitions and wasted bits.

The encoder makes the media column: 8-bit mono in blocks of 576 samples, each by the cheapest of
constant, verbatim, fixed predictors of order 0 to 2 and an LPC predictor of order 4.

A null stream has no blocks; a damaged one raises ValueError. Payloads of null and empty texts are one
block of bytes 255. Long texts are handled in groups of frames, so memory doesn't follow their length.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from scriptorium.llm.common import chunks, ship

BLOCK, PAD = 576, 255
GROUP_BYTES = 2_000_000
LPC_ORDER, PRECISION = 4, 8
#: Fixed predictors as coefficients of earlier samples.
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


def _crc_table(polynomial: int, width: int) -> np.ndarray:
    top, mask = 1 << (width - 1), (1 << width) - 1
    out = []
    for byte in range(256):
        crc = byte << (width - 8)
        for _ in range(8):
            crc = (crc << 1 ^ polynomial if crc & top else crc << 1) & mask
        out.append(crc)
    return np.array(out, np.int64)


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)
CRC8_LIST = CRC8.tolist()
#: Leading zeros of 16-bit numbers.
ZEROS = np.concatenate(([16], 15 - np.floor(np.log2(np.arange(1, 65536))))).astype(np.int64)


def crc8(data: bytes) -> int:
    crc = 0
    for b in data:
        crc = CRC8_LIST[crc ^ b]
    return crc


def crc16(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """CRC-16 of data[first:last] for each lane."""
    crc, size = np.zeros(len(first), np.int64), last - first
    order = np.argsort(-size, kind="stable")
    at, size, live = first[order], size[order], len(first)
    for k in range(int(size.max(initial=0))):
        while size[live - 1] <= k:
            live -= 1
        c = crc[:live]
        crc[:live] = (c << 8 & 0xFFFF) ^ CRC16[(c >> 8) ^ data[at[:live] + k]]
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _number(n: int) -> bytes:
    """A frame number in the format's extended UTF-8."""
    if n < 128:
        return bytes([n])
    size = next(k for k in range(2, 8) if n < 1 << (5 * k + 1))
    tail = [0x80 | n >> 6 * k & 63 for k in range(size - 1)][::-1]
    return bytes([(0xFF << (8 - size) & 0xFF) | n >> 6 * (size - 1), *tail])


# ---------------------------------------------------------------- encoding


def _lpc(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised coefficients and shift of each row's predictor, by Levinson's recursion on all rows at once."""
    n = x.shape[1]
    y = x.astype(np.float64)
    r = np.stack([np.einsum("ij,ij->i", y[:, k:], y[:, : n - k]) for k in range(LPC_ORDER + 1)], axis=1)
    error, a = np.maximum(r[:, 0], 1e-9), np.zeros((len(x), LPC_ORDER))
    for k in range(LPC_ORDER):
        turn = (r[:, k + 1] - (a[:, :k] * r[:, k:0:-1]).sum(axis=1)) / error
        a[:, :k] -= turn[:, None] * a[:, :k][:, ::-1]
        a[:, k] = turn
        error = np.maximum(error * (1 - turn * turn), 1e-9)
    most = np.maximum(np.abs(a).max(axis=1), 1e-9)
    shift = np.clip(PRECISION - 2 - np.floor(np.log2(most)).astype(np.int64), 0, 14)
    half = 1 << (PRECISION - 1)
    return np.clip(np.rint(a * (1 << shift)[:, None]), -half, half - 1).astype(np.int64), shift


def _residual(x: np.ndarray, coefs: np.ndarray, shift: np.ndarray | int) -> np.ndarray:
    """x minus its prediction; the first columns, the warm-up, are 0."""
    m = coefs.shape[1]
    out = np.zeros(x.shape, np.int32)
    guess = np.zeros((len(x), x.shape[1] - m), np.int64 if m > 2 else np.int32)
    for j in range(m):
        guess += coefs[:, j : j + 1].astype(guess.dtype) * x[:, m - 1 - j : x.shape[1] - 1 - j]
    out[:, m:] = x[:, m:] - (guess >> (np.asarray(shift).reshape(-1, 1) if m else 0))
    return out


class _Bits:
    """Fields of bits, added up into 32-bit words."""

    def __init__(self, n_bytes: int):
        self.sum = np.zeros(n_bytes // 4 + 2)

    def put(self, value: np.ndarray, end: np.ndarray) -> None:
        """value (under 2**20) in the bits before end."""
        last = end - 1
        word = last >> 5
        x = value.astype(np.uint64) << (31 - (last & 31)).astype(np.uint64)
        self.sum += np.bincount(word, (x & np.uint64(0xFFFFFFFF)).astype(np.float64), len(self.sum))
        high = x >> np.uint64(32)
        over = np.flatnonzero(high)
        self.sum += np.bincount(word[over] - 1, high[over].astype(np.float64), len(self.sum))

    def bytes(self) -> np.ndarray:
        return self.sum.astype(np.uint64).astype(">u4").view(np.uint8)


def encode_frames(pcm: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frames of rows of BLOCK signed 8-bit samples: all their bytes, and where each begins and the last ends."""
    x = pcm.astype(np.int32)
    f, n = x.shape
    lpc, shift = _lpc(x)
    tries = [_residual(x, np.tile(np.array(c, np.int32).reshape(1, -1), (f, 1)), 0) for c in FIXED[:3]] + [_residual(x, lpc, shift)]
    orders = np.array([0, 1, 2, LPC_ORDER])
    sums = np.stack([np.abs(t).sum(axis=1) for t in tries], axis=1)
    kind = sums.argmin(axis=1)
    order = orders[kind]
    r = np.choose(kind[:, None], tries)
    u = (r << 1) ^ (r >> 31)
    coded = np.arange(n)[None, :] >= order[:, None]
    ks = np.arange(0, 8)
    cost = np.stack([((u >> k) * coded).sum(axis=1) + (n - order) * (k + 1) for k in ks], axis=1)
    k = cost.argmin(axis=1)
    body = 8 + order * 8 + np.where(kind == 3, 9 + order * PRECISION, 0) + 10 + cost.min(axis=1)
    constant = (x == x[:, :1]).all(axis=1)
    verbatim = ~constant & (body >= 8 + 8 * n)
    rice = ~constant & ~verbatim
    body = np.where(constant, 16, np.where(verbatim, 8 + 8 * n, body))
    heads = [b"\xff\xf8\x24\x02" + _number(int(i)) for i in numbers]
    heads = [h + bytes([crc8(h)]) for h in heads]
    head = np.fromiter(map(len, heads), np.int64, f)
    size = head + (body + 7) // 8 + 2
    first = np.concatenate(([0], np.cumsum(size)))
    bits = _Bits(int(first[-1]))
    at = (first[:-1] + head) * 8
    kinds = np.where(constant, 0, np.where(verbatim, 1, np.where(kind == 3, 32 + LPC_ORDER - 1, 8 + order)))
    bits.put(kinds << 1, at + 8)
    at = at + 8
    byte = x & 255
    if constant.any():
        bits.put(byte[constant, 0], at[constant] + 8)
    if verbatim.any():
        bits.put(byte[verbatim].ravel(), (at[verbatim][:, None] + 8 * np.arange(1, n + 1)).ravel())
    for j in range(LPC_ORDER):
        if (w := rice & (order > j)).any():
            bits.put(byte[w, j], at[w] + 8 * (j + 1))
    at = at + 8 * order
    if (w := rice & (kind == 3)).any():
        bits.put((PRECISION - 1) << 5 | shift[w], at[w] + 9)
        for j in range(LPC_ORDER):
            bits.put(lpc[w, j] & ((1 << PRECISION) - 1), at[w] + 9 + PRECISION * (j + 1))
    at = at + np.where(kind == 3, 9 + order * PRECISION, 0)
    if rice.any():
        bits.put(k[rice], at[rice] + 10)
        kk, uu, mask = k[rice][:, None], u[rice], coded[rice]
        length = np.where(mask, (uu >> kk) + 1 + kk, 0)
        end = (at[rice] + 10)[:, None] + np.cumsum(length, axis=1)
        bits.put(((1 << kk) | (uu & ((1 << kk) - 1)))[mask], end[mask])
    data = bits.bytes().copy()
    joined = np.frombuffer(b"".join(heads), np.uint8)
    inner = np.arange(len(joined)) - np.repeat(np.cumsum(head) - head, head)
    data[np.repeat(first[:-1], head) + inner] = joined
    crc = crc16(data, first[:-1], first[1:] - 2)
    data[first[1:] - 2], data[first[1:] - 1] = crc >> 8, crc & 255
    return data, first


def stream_header(pcm: bytes, n_samples: int, offsets: list[int], sizes: list[int]) -> bytes:
    """The marker, STREAMINFO and a seek table with a point for each frame."""
    info = BLOCK.to_bytes(2, "big") * 2 + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big")
    info += (8000 << 44 | 0 << 41 | 7 << 36 | n_samples).to_bytes(8, "big") + hashlib.md5(pcm).digest()
    points = np.zeros(len(offsets), np.dtype([("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")]))
    points["sample"], points["offset"], points["n"] = np.arange(len(offsets)) * BLOCK, offsets, BLOCK
    table = points.tobytes()
    return b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(table).to_bytes(3, "big") + table


def payload_of(text: str | None) -> bytes:
    data = (text or "").encode()
    return data + bytes([PAD]) * (-len(data) % BLOCK or (0 if data else BLOCK))


def encode_streams(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream for each payload of whole blocks."""
    pcm = np.frombuffer(b"".join(payloads), np.uint8) ^ 128
    frames = pcm.view(np.int8).reshape(-1, BLOCK)
    counts = np.array([len(p) // BLOCK for p in payloads])
    numbers = np.arange(len(frames)) - np.repeat(np.cumsum(counts) - counts, counts)
    step = 2 * GROUP_BYTES // BLOCK  # frames at a time
    parts, first = [], [np.zeros(1, np.int64)]
    for k in range(0, len(frames), step):
        data, at = encode_frames(frames[k : k + step], numbers[k : k + step])
        parts.append(data[: at[-1]].tobytes())
        first.append(at[1:] + first[-1][-1])
    data, first, out, k = b"".join(parts), np.concatenate(first), [], 0
    for n in counts.tolist():
        at = first[k : k + n + 1]
        out.append(stream_header(pcm[k * BLOCK : (k + n) * BLOCK].tobytes(), n * BLOCK, (at[:-1] - at[0]).tolist(), np.diff(at).tolist()) + data[at[0] : at[-1]])
        k += n
    return out


# ---------------------------------------------------------------- decoding


class Stream:
    """Metadata of a stream: where frames begin, sample size, number of samples, MD5, and the seek table."""

    def __init__(self, data: bytes):
        if data[:4] != b"fLaC":
            raise ValueError("no FLAC stream")
        at, last, self.points = 4, False, []
        while not last:
            last, kind, size = data[at] >> 7, data[at] & 127, int.from_bytes(data[at + 1 : at + 4], "big")
            body = data[at + 4 : at + 4 + size]
            if kind == 0:
                rest = int.from_bytes(body[10:18], "big")
                self.bits, self.samples, self.md5 = (rest >> 36 & 31) + 1, rest & (1 << 36) - 1, body[18:34]
                if rest >> 41 & 7:
                    raise ValueError("only mono streams are read")
            elif kind == 3:
                points = np.frombuffer(body, np.dtype([("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")]))
                self.points = [(int(p["sample"]), int(p["offset"]), int(p["n"])) for p in points if p["sample"] != 2**64 - 1]
            at += 4 + size
        self.first = at

    def frames(self) -> list[int] | None:
        """Where each frame begins, if the seek table has them all."""
        at = 0
        for sample, _, n in self.points:
            if sample != at:
                return None
            at += n
        return [self.first + p[1] for p in self.points] if at == self.samples else None


class _Reader:
    def __init__(self, data: bytes, at: int):
        self.data, self.at = data, at * 8

    def take(self, n: int) -> int:
        a, b = self.at >> 3, (self.at + n + 7) >> 3
        self.at += n
        return int.from_bytes(self.data[a:b], "big") >> (b * 8 - self.at) & (1 << n) - 1

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v - (1 << n) if n and v >> (n - 1) else v


class _Lanes:
    """Frames with residuals, as they are found; then all of them at once."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []

    def run(self, data: np.ndarray, samples: list) -> dict[int, int]:
        """Fill samples[frame] and return the bit at which each frame's residuals end."""
        if not self.rows:
            return {}
        frame, n, order, at, shift, method, parts, warm, coefs = zip(*self.rows, strict=True)
        f, most, m = len(frame), max(n), max(max(order), 1)
        n, order, at, shift, parts = (np.array(v, np.int64) for v in (n, order, at, shift, parts))
        width = np.where(np.array(method) == 0, 4, 5)
        c, out = np.zeros((m, f), np.int64), np.zeros((most, f), np.int64)
        for k, (w, q) in enumerate(zip(warm, coefs, strict=True)):
            out[: len(w), k] = w
            c[: len(q), k] = q
        padded = np.concatenate((data, np.zeros(-len(data) % 4 + 16, np.uint8)))
        words = padded.view(">u4").astype(np.uint64)
        window = words[:-1] << np.uint64(32) | words[1:]

        def peek(pos: np.ndarray) -> np.ndarray:
            """At least 33 bits from pos on, at the top."""
            if len(pos) and int(pos.max()) >> 5 >= len(window):
                raise ValueError("the stream ends within a frame")
            return window[pos >> 5] << (pos & 31).astype(np.uint64)

        def bits(pos: np.ndarray, size: np.ndarray) -> np.ndarray:
            return np.where(size > 0, peek(pos) >> (64 - np.maximum(size, 1)).astype(np.uint64), np.uint64(0)).astype(np.int64)

        part = n >> parts
        param, raw = np.zeros(f, np.int64), np.full(f, -1, np.int64)
        any_raw, plain = False, bool((n == most).all())
        for i in range(most):
            lanes = slice(None) if plain and i >= m else np.flatnonzero((i >= order) & (i < n))
            if not plain or i <= m or (i % part[0] == 0 and bool((parts == parts[0]).all())) or bool((parts != parts[0]).any()):
                chosen = np.arange(f) if isinstance(lanes, slice) else lanes
                new = chosen[(i % part[chosen] == 0) | (i == order[chosen])]
                if len(new):
                    param[new] = bits(at[new], width[new])
                    at[new] += width[new]
                    escaped = new[param[new] == (1 << width[new]) - 1]
                    raw[new] = -1
                    if len(escaped):
                        raw[escaped] = bits(at[escaped], np.full(len(escaped), 5))
                        at[escaped] += 5
                    any_raw = bool((raw >= 0).any())
            if not isinstance(lanes, slice) and not len(lanes):
                continue
            pos, p = at[lanes], param[lanes]
            top = peek(pos)
            q = ZEROS[(top >> np.uint64(48)).astype(np.int64)]
            if any_raw:
                q = np.where(raw[lanes] >= 0, 0, q)
            late = np.flatnonzero(q == 16)
            while len(late):
                zeros = ZEROS[(peek(pos[late] + q[late]) >> np.uint64(48)).astype(np.int64)]
                q[late] += zeros
                late = late[zeros == 16]
            pos2 = pos + q + 1
            low = bits(pos2, p)
            u = q << p | low
            r = (u >> 1) ^ -(u & 1)
            pos2 = pos2 + p
            if any_raw and (own := raw[lanes] >= 0).any():
                size = np.where(own, raw[lanes], 0)
                v = bits(pos, size)
                v = np.where((size > 0) & (v >> np.maximum(size - 1, 0) > 0), v - (1 << size), v)
                r, pos2 = np.where(own, v, r), np.where(own, pos + size, pos2)
            at[lanes] = pos2
            guess = 0
            for j in range(min(m, i)):
                guess = guess + c[j, lanes] * out[i - 1 - j, lanes]
            out[i, lanes] = r + (guess >> shift[lanes] if i else 0)
        for k, number in enumerate(frame):
            samples[number] = out[: n[k], k]
        return dict(zip(frame, at.tolist(), strict=True))


def decode_frames(data: bytes, starts: list[int], bits: int) -> tuple[list[np.ndarray], list[int], list[int]]:
    """Samples of the frames that begin at starts, their numbers, and the byte at which each ends. Checksums are verified."""
    samples: list = [None] * len(starts)
    numbers, ends, wasted, lanes, sure = [], [0] * len(starts), [0] * len(starts), _Lanes(), {}
    for k, at in enumerate(starts):
        if data[at : at + 2] != b"\xff\xf8" and data[at : at + 2] != b"\xff\xf9":
            raise ValueError("no frame where one should begin")
        block, rate, size = data[at + 2] >> 4, data[at + 2] & 15, data[at + 3] >> 1 & 7
        if data[at + 3] >> 4:
            raise ValueError("only mono streams are read")
        lead = data[at + 4]
        more = 0 if lead < 128 else 8 - (lead ^ 255).bit_length() - 1
        number = lead if not more else lead & (1 << 6 - more) - 1
        for b in data[at + 5 : at + 5 + more]:
            number = number << 6 | b & 63
        p = at + 5 + more
        n = 192 if block == 1 else 576 << block - 2 if 2 <= block <= 5 else 256 << max(block - 8, 0)
        if block in (6, 7):
            n = int.from_bytes(data[p : p + block - 5], "big") + 1
            p += block - 5
        p += {12: 1, 13: 2, 14: 2}.get(rate, 0)
        if crc8(data[at:p]) != data[p]:
            raise ValueError("a frame header's CRC-8 is wrong")
        depth = {1: 8, 2: 12, 4: 16}.get(size, bits)
        read = _Reader(data, p + 1)
        kind, waste = read.take(7), read.take(1)
        if waste:
            waste = 1
            while not read.take(1):
                waste += 1
        depth -= waste
        wasted[k] = waste
        numbers.append(number)
        if kind == 0:
            samples[k] = np.full(n, read.signed(depth), np.int64)
            sure[k] = read.at
        elif kind == 1:
            if depth == 8 and not read.at & 7:
                samples[k] = np.frombuffer(data, np.int8, n, read.at >> 3).astype(np.int64)
                read.at += 8 * n
            else:
                samples[k] = np.array([read.signed(depth) for _ in range(n)], np.int64)
            sure[k] = read.at
        elif 8 <= kind <= 12 or kind >= 32:
            order = kind - 8 if kind <= 12 else kind - 31
            warm, shift, coefs = [read.signed(depth) for _ in range(order)], 0, FIXED[order] if kind <= 12 else ()
            if kind >= 32:
                precision = read.take(4) + 1
                shift = read.take(5)
                coefs = [read.signed(precision) for _ in range(order)]
            method, parts = read.take(2), read.take(4)
            if method > 1:
                raise ValueError("unknown residual coding")
            lanes.rows.append((k, n, order, read.at, shift, method, parts, warm, coefs))
        else:
            raise ValueError("unknown kind of subframe")
    array = np.frombuffer(data, np.uint8)
    for k, at in (sure | lanes.run(array, samples)).items():
        ends[k] = (at + 7) // 8 + 2
        if wasted[k]:
            samples[k] = samples[k] << wasted[k]
    last = np.array(ends, np.int64)
    if len(last) and int(last.max()) > len(array):
        raise ValueError("the stream ends within a frame")
    if (crc16(array, np.array(starts, np.int64), last - 2) != (array[last - 2].astype(np.int64) << 8 | array[last - 1])).any():
        raise ValueError("a frame's CRC-16 is wrong")
    return samples, numbers, ends


def decode_streams(streams: list[bytes]) -> list[list[tuple[int, int, np.ndarray]]]:
    """For each stream its blocks: (first sample, byte offset of the frame in the stream, samples)."""
    infos, base, where, owner, out = [Stream(s) for s in streams], 0, [], [], [[] for _ in streams]
    data = b"".join(streams)
    for k, (s, info) in enumerate(zip(streams, infos, strict=True)):
        starts = info.frames()
        if starts is None:
            at, sample = info.first, 0
            while at < len(s) and (not info.samples or sample < info.samples):
                (block,), _, (end,) = decode_frames(s, [at], info.bits)
                out[k].append((sample, at, block))
                at, sample = end, sample + len(block)
        else:
            where += [base + a for a in starts]
            owner += [(k, base)] * len(starts)
        base += len(s)
    step = 2 * GROUP_BYTES // BLOCK
    for g in range(0, len(where), step):
        samples, _, _ = decode_frames(data, where[g : g + step], infos[owner[g][0]].bits)
        for (k, first), at, block in zip(owner[g : g + step], where[g : g + step], samples, strict=True):
            sample = out[k][-1][0] + len(out[k][-1][2]) if out[k] else 0
            out[k].append((sample, at - first, block))
    for info, blocks in zip(infos, out, strict=True):
        kind = np.int8 if info.bits <= 8 else np.dtype("<i2")
        if any(info.md5) and hashlib.md5(b"".join(b[2].astype(kind).tobytes() for b in blocks)).digest() != info.md5:
            raise ValueError("the stream's MD5 is wrong")
    return out


def feature(pcm: np.ndarray) -> str:
    """Mean, root mean square, zero crossings and peak of a stream's samples."""
    x = pcm.astype(np.int64)
    crossings = int(((x[1:] < 0) != (x[:-1] < 0)).sum())
    return f"mean={x.mean():.4f};rms={np.sqrt((x * x).mean()):.4f};zc={crossings};peak={int(np.abs(x).max())}"


# ---------------------------------------------------------------- columns


def encode_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): the texts' padded UTF-8 as FLAC streams."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in chunks(batches, GROUP_BYTES):
            media = encode_streams([payload_of(r["text"]) for r in rows])
            size = [len((r["text"] or "").encode()) for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array([r["doc_id"] for r in rows], pa.int64()), pa.array(size, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_bytes bigint, media binary")


def pcm_blocks(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """(key, block, first_sample, n_samples, frame_offset, pcm): the blocks of each stream; pcm holds signed little-endian samples."""
    ship(media.sparkSession)
    kind = dict(media.dtypes)[key]
    names = [key, "block", "first_sample", "n_samples", "frame_offset", "pcm"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in chunks(batches, GROUP_BYTES, column):
            rows = [r for r in rows if r[column] is not None]
            streams = [r[column] for r in rows]
            out: list[tuple] = []
            for r, s, blocks in zip(rows, streams, decode_streams(streams), strict=True):
                to = np.int8 if Stream(s).bits <= 8 else np.dtype("<i2")
                out += [(r[key], i, sample, len(x), at, x.astype(to).tobytes()) for i, (sample, at, x) in enumerate(blocks)]
            yield pa.RecordBatch.from_pylist([dict(zip(names, o, strict=True)) for o in out], schema=schema)

    import pyspark.sql.pandas.types as types
    from pyspark.sql.types import _parse_datatype_string

    said = f"{key} {kind}, block int, first_sample bigint, n_samples bigint, frame_offset bigint, pcm binary"
    schema = types.to_arrow_schema(_parse_datatype_string(said))
    return media.select(key, column).mapInArrow(run, said)


def read_back(media: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) from encode_texts' rows."""
    ship(media.sparkSession)
    columns = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    names = [c.split()[0] for c in columns.split(", ")]
    kinds = [pa.int64() if c.endswith("bigint") else pa.string() for c in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in chunks(batches, GROUP_BYTES, "media"):
            out: list[tuple] = []
            for r, blocks in zip(rows, decode_streams([r["media"] for r in rows]), strict=True):
                pcm = np.concatenate([b[2] for b in blocks]).astype(np.int8)
                payload = (pcm.view(np.uint8) ^ 128).tobytes()
                digest = hashlib.sha256(payload).hexdigest()
                out.append((r["doc_id"], r["n_bytes"], len(payload), digest, zlib.crc32(payload[-32:]), len(r["media"]), hashlib.sha256(r["media"]).hexdigest(), feature(pcm)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return media.mapInArrow(run, columns)
