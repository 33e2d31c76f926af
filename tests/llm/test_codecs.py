import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from scriptorium.llm import flac, spiece, tokencount

MODEL = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "", " ", "  a  b ", "▁x y", "a\nb", "é\U0001f600 漢字かな", "<s>hi</s>", "a\x00b\tc", "the  quick\n\n brown fox " * 30, "aaaaaaaaaab" * 60, "x" * 700 + " y", "ÄÖÜß straße",
    "▁▁ ▁", "\n", "a" * 300 + "é" * 10, "hello world", " \n ", "1234567890" * 40, "   " * 100 + "end",
]


def test_units_encode_as_the_library_does():
    library, own = sentencepiece.SentencePieceProcessor(model_file=MODEL), spiece.Encoder(MODEL)
    for group in (TEXTS, TEXTS[::-1]):
        split, known = own.encode(group)
        for text, units in zip(group, split, strict=True):
            ids = library.encode(text)
            assert ",".join(known[u][1] for u in units) == ",".join(map(str, ids)), text
            assert sum(known[u][0] for u in units) == len(ids)
            assert "".join(known[u][2] for u in units)[1:] == library.decode(ids)


def test_random_texts_encode_as_the_library_does():
    rng = np.random.default_rng(1)
    library, own = sentencepiece.SentencePieceProcessor(model_file=MODEL), spiece.Encoder(MODEL)
    letters = list("etaoinshrdlu  \n.éßñ") + ["▁", "ā", "\U0001f680"]
    texts = ["".join(rng.choice(letters, rng.integers(1, 400))) for _ in range(300)]
    split, known = own.encode(texts)
    assert [",".join(known[u][1] for u in us) for us in split] == [",".join(map(str, i)) for i in library.encode(texts)]


def test_copies_in_a_group_are_encoded_once_and_kept_units_stay_bounded(spark, monkeypatch):
    own, seen = spiece.Encoder(MODEL), []
    monkeypatch.setattr(spiece, "KEPT_UNITS", 3)
    for text in ("a b c d", "e f " + "g" * 90, "a e h", "a f " + "g" * 90):
        split, known = own.encode([text])
        assert [known[u][2] for u in split[0]] == [u.replace("▁", " ") for u in split[0]]
        assert len(own.kept) <= 4 + len(split[0]) and all(len(u) <= 64 or u in split[0] for u in own.kept)

    class Counted(spiece.Encoder):
        def encode(self, texts):
            seen.extend(texts)
            return super().encode(texts)

    monkeypatch.setattr(spiece, "Encoder", Counted)
    rows = [(k // 2, "some text %d" % (k // 4) if k // 4 else None) for k in range(40)]

    class Frame:  # runs the plan's function here, on one partition
        sparkSession = spark

        def select(self, *_):
            return self

        def mapInArrow(self, run, schema):
            return [r for b in run([pa.RecordBatch.from_pylist([{"doc_id": i, "text": t} for i, t in rows])]) for r in b.to_pylist()]

    got = spiece.encode(Frame(), MODEL)
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert len(seen) == 10 and [(r["doc_id"], r["n_tokens"]) for r in got] == [(i, len(library.encode(t or ""))) for i, t in rows]


@pytest.mark.parametrize("text", [None, "", "a", "b" * 575, "c" * 576, "d" * 577, "été " * 900, "\x00\x7f" * 2000, "".join(map(chr, range(32, 900)))])
def test_flac_round_trip(text):
    payload = flac.payload_of(text)
    assert payload.startswith((text or "").encode()) and len(payload) % 576 == 0 and payload
    (media,) = flac.encode_streams([payload])
    (blocks,) = flac.decode_streams([media])
    assert (np.concatenate([b[2] for b in blocks]).astype(np.int8).view(np.uint8) ^ 128).tobytes() == payload
    assert [b[0] for b in blocks] == list(range(0, len(payload), 576))


def test_flac_of_noise_and_of_many_streams_and_without_seek_table():
    rng = np.random.default_rng(2)
    walk = np.cumsum(rng.integers(-3, 4, 576 * 40)).astype(np.int8).tobytes()
    payloads = [rng.bytes(576 * 9), walk, bytes(576), flac.payload_of("word " * 5000), np.where(rng.random(5760) < 0.01, 255, 3).astype(np.uint8).tobytes()]
    streams = flac.encode_streams(payloads)
    for payload, blocks in zip(payloads, flac.decode_streams(streams), strict=True):
        assert (np.concatenate([b[2] for b in blocks]).astype(np.int8).view(np.uint8) ^ 128).tobytes() == payload
    bare = streams[1][:4] + b"\x80" + streams[1][5:42] + streams[1][flac.Stream(streams[1]).first :]
    assert len(flac.decode_streams([bare])[0]) == 40
    for at in (flac.Stream(streams[1]).first + 5, len(streams[1]) - 40):
        hurt = bytearray(streams[1])
        hurt[at] ^= 4
        with pytest.raises(ValueError):
            flac.decode_streams([bytes(hurt)])


def test_flac_partitions_escapes_and_rice2():
    """A stream made bit by bit: a block of 16 samples, order 1, two partitions, one of them raw."""
    samples = [5, 7, 4, 4, 9, 1, 0, -3, 2, 2, -8, 7, 0, 0, 1, -1]
    residual = [b - a for a, b in zip(samples, samples[1:], strict=False)]
    bits = "00010010" + f"{samples[0] & 255:08b}" + "01" + "0001" + "00010"
    for r in residual[:7]:
        u = r * 2 if r >= 0 else -2 * r - 1
        bits += "0" * (u >> 2) + "1" + f"{u & 3:02b}"
    bits += "11111" + "00110" + "".join(f"{r & 63:06b}" for r in residual[7:])
    head = b"\xff\xf8\x64\x02\x00\x0f"
    head += bytes([flac.crc8(head)])
    frame = head + int(bits + "0" * (-len(bits) % 8), 2).to_bytes((len(bits) + 7) // 8, "big")
    crc = flac.crc16(np.frombuffer(frame, np.uint8), np.array([0]), np.array([len(frame)]))[0]
    info = b"\x00\x10\x00\x10" + bytes(6) + (8000 << 44 | 7 << 36 | 16).to_bytes(8, "big") + hashlib.md5(np.array(samples, np.int8).tobytes()).digest()
    stream = b"fLaC\x80" + len(info).to_bytes(3, "big") + info + frame + int(crc).to_bytes(2, "big")
    assert flac.decode_streams([stream])[0][0][2].tolist() == samples


@pytest.mark.parametrize("rule", tokencount.RULES)
def test_token_attribution_against_brute_force(rule):
    lengths = tokencount.Lengths(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    for text in TEXTS:
        sizes = [len(lengths.encoding.decode_single_token_bytes(t)) for t in lengths.encoding.encode_ordinary(text)]
        assert lengths.of(text).tolist() == sizes
        data = text.encode()
        ends = [i + 1 for i, b in enumerate(data) if b == 10]
        ends += [] if ends and ends[-1] == len(data) else [len(data)]
        line = [sum(e <= i for e in ends) for i in range(len(data))]
        own, at = [], 0
        for s in sizes:
            lines = line[at : at + s]
            own.append({"start": lines[0], "end": lines[-1], "most": max(lines, key=lambda x: (lines.count(x), -x))}[rule])
            at += s
        assert tokencount.attribute(np.cumsum(np.array(sizes, int)), np.array(ends), rule)[0].tolist() == own
