"""Substring dedup by prefix-partitioned suffix trees.

A window is a node of depth WINDOW: a string of so many words that starts at several places; all its leaves but
the first go. Suffixes start at anchors only, which every window has, and two passes keep those that are shuffled few.

1. Every document reports its anchors: of the GRAM-word grams in each window the one with the least hash, the leftmost
   of equals. Equal windows have equal anchors at equal offsets, so windows whose anchor occurs once in the corpus are
   unique; only the others are candidates. Words that make up over 1/FREQUENT of a group of rows are reported too.
2. An anchor that repeats is a suffix of the text; with it go the words before and behind it that its windows reach
   (12 on either side at most). Its prefix runs up to its first word that isn't frequent (at most FREQUENT words are,
   so the set is bounded) or to the anchor's end, variable in length; a prefix's suffixes go to one partition, in order.
   There they are cut at anchors into groups that fit memory. A group is sorted by words to the right and, from the
   anchor leftwards, by words to the left; longest common prefixes of neighbours give the internal nodes of both trees.
   The windows at an offset are equal where they are under one node of the right tree and one of the left tree whose
   depths add up to WINDOW: those are the deep nodes, and their later leaves are reported.
   An anchor with more rows than fit (over GROUP_ROWS, or one in 2^20 of all words, so at most 2^20 anchors) is
   extended to whole windows: a prefix of WINDOW words is a node itself and is read as a stream, of any length.

Within a group of rows equal suffixes with their surroundings, equal windows and equal texts are settled on the spot,
and one of them is sent on, so a passage that a third of all documents share is a row for each group of rows.
A text that equals one with a smaller doc_id is resolved by its digest: if it holds a window, all its words go.
Words are compared by 64-bit hashes, whole windows of extended anchors by 128 bits.

Words are runs of bytes other than ASCII white space. A null text has no words. Rows with equal doc_id are
the same document: equal places in them don't count as earlier; their texts are told apart by a 64-bit hash, tag.
A null doc_id is before all others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import chunks, heavy_keys, salted_join, ship, stored

WINDOW, GRAM = 20, 8
#: A word is frequent if it makes up over one in so many words.
FREQUENT = 4096
GROUP_BYTES = 4_000_000
#: Rows of an anchor from which it is extended to whole windows; rows of a group of subtrees; words on either side of an anchor.
GROUP_ROWS, TREE_ROWS, SIDE = 2_000, 20_000, WINDOW - GRAM
KEPT_WORDS = 400_000
LOWEST = -(2**63)
#: In place of an anchor's least and largest offset: the row is a whole window.
WHOLE = 255
MIX = np.uint64(0x9E3779B97F4A7C15)


def _odd(n: int, seed: int) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(f"{seed}:{k}".encode()) | 1 for k in range(n)], np.uint64)


FACTORS = [_odd(WINDOW, s) for s in (1, 2)]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * MIX
    return x ^ x >> np.uint64(29)


def rolling(words: np.ndarray, n: int, factors: np.ndarray) -> np.ndarray:
    """A hash of each n consecutive words' hashes."""
    size = len(words) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    total = words[:size] * factors[0]
    for k in range(1, n):
        total += words[k : k + size] * factors[k]
    return mixed(total)


class Words:
    """Hashes of words, remembered up to KEPT_WORDS."""

    def __init__(self) -> None:
        self.kept: dict[bytes, int] = {}

    def of(self, words: list[bytes]) -> np.ndarray:
        kept, digest = self.kept, xxhash.xxh3_64_intdigest
        out = list(map(kept.get, words))
        if None in out:
            if len(kept) > KEPT_WORDS:
                kept.clear()
            for k, h in enumerate(out):
                if h is None:
                    out[k] = kept[words[k]] = digest(words[k])
        return np.array(out, np.uint64)


def split(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def anchors(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all grams, and of each window the index of its anchor."""
    grams = rolling(hashes, GRAM, FACTORS[0])
    if len(hashes) < WINDOW:
        return grams, np.zeros(0, np.int64)
    at, width = np.arange(len(grams)), 1
    better = lambda a, b: np.where(grams[a] <= grams[b], a, b)
    while width * 2 <= SIDE + 1:
        at = better(at[: len(at) - width], at[width:])
        width *= 2
    rest, size = SIDE + 1 - width, len(hashes) - WINDOW + 1
    return grams, better(at[:size], at[rest : rest + size]) if rest else at[:size]


def digest_of(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def sha_of(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _tag():
    """A hash that tells texts of equal doc_id apart."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _long(x) -> pa.Array:
    return pa.array(np.asarray(x, np.uint64).view(np.int64)) if len(x) else pa.array([], pa.int64())


#: Rows of the first pass by kind: d a document (key: half its digest; payload: digest; n: words; sha: of all words), a an anchor that its group of
#: rows has once (key), r one that it has more often (key) and p a document's anchors of that sort (payload), w a frequent word (key, n).
FIRST = "kind string, key bigint, doc_id bigint, tag bigint, n bigint, payload binary, sha string, copy boolean"


def _first_pass(docs: DataFrame) -> DataFrame:
    ship(docs.sparkSession)
    names = [c.split()[0] for c in FIRST.split(", ")]

    def table(kind: str, key, doc_id=None, tag=None, n=None, payload=None, sha=None, copy=None) -> pa.RecordBatch:
        size = len(key)
        none = lambda x, t: pa.array([None] * size, t) if x is None else x if isinstance(x, pa.Array) else pa.array(x, t)
        return pa.RecordBatch.from_arrays(
            [pa.array([kind] * size), key, none(doc_id, pa.int64()), none(tag, pa.int64()), none(n, pa.int64()), none(payload, pa.binary()), none(sha, pa.string()), none(copy, pa.bool_())], names=names
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for rows in chunks(batches, GROUP_BYTES):
            ids, tags = [r["doc_id"] for r in rows], [r["tag"] for r in rows]
            digests, texts, least, hashed = [], [], {}, {}
            for i, r in zip(ids, rows, strict=True):
                words = split(r["text"])
                d = digest_of(words)
                digests.append((d, len(words), sha_of(words)))
                least[d] = min(i, least.get(d, i))
                if d not in hashed:
                    hashed[d] = known.of(words)
                texts.append(d)
            copy = [i > least[d] for i, d in zip(ids, texts, strict=True)]
            yield table("d", _long([int.from_bytes(d[:8], "little") for d in texts]), ids, tags, [x[1] for x in digests], texts, [x[2] for x in digests], copy)
            values, owner, grams = [], [], []
            for k, (d, c) in enumerate(zip(texts, copy, strict=True)):
                if not c and len(hashed[d]) >= WINDOW:
                    g, at = anchors(hashed[d])
                    grams.append(g)
                    own = g[at[np.concatenate(([True], at[1:] != at[:-1]))]]
                    values.append(own)
                    owner.append(np.full(len(own), k))
            if values:
                value, own = np.concatenate(values), np.concatenate(owner)
                every = np.sort(np.concatenate(grams))
                once = ~np.isin(value, every[1:][every[1:] == every[:-1]])
                many = np.array(ids, np.int64), np.array(tags, np.int64)
                yield table("a", _long(value[once]), many[0][own[once]], many[1][own[once]])
                more, of = value[~once], own[~once]
                if len(more):
                    gram, times = np.unique(more, return_counts=True)
                    yield table("r", _long(gram), None, None, times)
                    cuts = np.flatnonzero(np.diff(of)) + 1
                    docs_of = of[np.concatenate(([0], cuts))]
                    lists = [np.unique(x).tobytes() for x in np.split(more, cuts)]
                    yield table("p", _long([int.from_bytes(texts[k][:8], "little") for k in docs_of]), many[0][docs_of], many[1][docs_of], None, lists)
            every = np.concatenate([hashed[d] for d in texts]) if texts else np.zeros(0, np.uint64)
            if len(every):
                word, times = np.unique(every, return_counts=True)
                often = times * FREQUENT > len(every)
                yield table("w", _long(word[often]), None, None, times[often])

    return docs.select("doc_id", "tag", "text").mapInArrow(run, FIRST)


def _repeated(first: DataFrame, most: int) -> tuple[DataFrame, list[int]]:
    """(doc_id, tag, payload): lists of anchors of documents that occur elsewhere too; and the anchors with over most rows."""
    blocks = _blocks(first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 5
        found: list[list[np.ndarray]] = []
        large: list[int] = []

        def settle(rows: list[np.ndarray]) -> int:
            """Report rows whose key has several; how many the last key has."""
            key, doc, tag, n, told = rows
            start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            total = np.add.reduceat(n, start)
            large.extend(key[start][total > most].tolist())
            many = np.repeat(total > 1, np.diff(np.append(start, len(key)))) & (told > 0)
            if many.any():
                found.append([doc[many], tag[many], key[many]])
            return int(total[-1])

        def out() -> Iterator[pa.RecordBatch]:
            if found:
                yield _blobs(*(np.concatenate(x) for x in zip(*found, strict=True)), blocks)
            if large:
                keys = sorted(set(large))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([None] * len(keys), pa.binary())], names=["block", "payload"])
            found.clear()
            large.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            now = [np.concatenate((a, batch.column(c).to_numpy())) for a, c in zip(held, ("key", "doc_id", "tag", "n", "told"), strict=True)]
            cut = int(np.searchsorted(now[0], now[0][-1]))
            if cut:
                settle([x[:cut] for x in now])
            held = [x[cut:] for x in now]
            if len(held[0]) > 4096:  # a long run of one key: what was seen of it becomes one row that isn't told
                held = [np.array([x], np.int64) for x in (held[0][-1], 0, 0, settle(held), 0)]
            if sum(len(f[0]) for f in found) > 2_000_000:
                yield from out()
        if len(held[0]):
            settle(held)
        yield from out()

    # A row r stands for several occurrences whose documents know of it.
    rows = first.where("kind in ('a', 'r')").select("key", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("doc_id", "tag")), F.coalesce("n", F.lit(1)).alias("n"), (F.col("kind") == "a").cast("long").alias("told"))
    told = stored(rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "block bigint, payload binary"), "repeated")
    large = [r["block"] for r in told.where("payload is null").select("block").distinct().collect()]  # 2^20 at most
    return _gathered(told.where("payload is not null"), np.int64), large


def _blobs(doc: np.ndarray, tag: np.ndarray, value: np.ndarray, blocks: int) -> pa.RecordBatch:
    """(block, payload): values by document, the documents dealt over blocks; a payload holds documents, tags, counts, then values."""
    block = (mixed(doc.view(np.uint64) ^ np.uint64(77)) % np.uint64(blocks)).astype(np.int64)
    order = np.lexsort((value, tag, doc, block))
    block, doc, tag, value = block[order], doc[order], tag[order], value[order]
    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]) | (block[1:] != block[:-1])))
    keep = new | np.concatenate(([True], value[1:] != value[:-1]))
    block, doc, tag, value, new = block[keep], doc[keep], tag[keep], value[keep], new[keep]
    names, out = [], []
    for part in np.split(np.arange(len(block)), np.flatnonzero(np.diff(block)) + 1):
        at = part[new[part]]
        count = np.diff(np.append(at, part[-1] + 1))
        names.append(int(block[part[0]]))
        out.append(np.array([len(at)], np.int64).tobytes() + doc[at].tobytes() + tag[at].tobytes() + count.astype(np.int64).tobytes() + value[part].tobytes())
    return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(out, pa.binary())], names=["block", "payload"])


def _gathered(blobs: DataFrame, kind: type) -> DataFrame:
    """(doc_id, tag, payload): one row a document, from the blobs of all partitions, a block of documents at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(parts: list[bytes]) -> Iterator[pa.RecordBatch]:
            columns: list[list[np.ndarray]] = [[], [], []]
            for data in parts:
                n = int(np.frombuffer(data, np.int64, 1)[0])
                head = np.frombuffer(data, np.int64, 3 * n, 8).reshape(3, n)
                for c, x in zip(columns, (np.repeat(head[0], head[2]), np.repeat(head[1], head[2]), np.frombuffer(data, kind, -1, 8 + 24 * n)), strict=True):
                    c.append(x)
            doc, tag, value = (np.concatenate(c) for c in columns)
            order = np.lexsort((value, tag, doc))
            doc, tag, value = doc[order], tag[order], value[order]
            cuts = np.flatnonzero((doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])) + 1
            first = np.concatenate(([0], cuts))
            lists = [np.unique(x).tobytes() for x in np.split(value, cuts)]
            yield pa.RecordBatch.from_arrays([pa.array(doc[first]), pa.array(tag[first]), pa.array(lists, pa.binary())], names=["doc_id", "tag", "payload"])

        block, held = None, []
        for batch in batches:
            for b, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if b != block and held:
                    yield from told(held)
                    held = []
                block = b
                held.append(data)
        if held:
            yield from told(held)

    return blobs.repartition("block").sortWithinPartitions("block").mapInArrow(run, "doc_id bigint, tag bigint, payload binary")


def _blocks(df: DataFrame) -> int:
    return max(32, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _prefix_key(words: np.ndarray, at: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The prefix group of the suffixes that start at at: a hash of their words up to the first that isn't frequent, GRAM at most."""
    rare = frequent[np.minimum(np.searchsorted(frequent, words), len(frequent) - 1)] != words if len(frequent) else np.ones(len(words), bool)
    key, live = np.zeros(len(at), np.uint64), np.arange(len(at))
    for k in range(GRAM):
        word = at[live] + k
        key[live] = mixed(key[live] + words[word] * FACTORS[1][k])
        live = live[~rare[word]]
        if not len(live):
            break
    return key


#: place: of a suffix 65536 * the anchor's place + 256 * the least + the largest offset of its windows from it; of a whole window the start and WHOLE twice.
#: gram: the anchor, or half the window's hash (its other half is the prefix). payload: the words' hashes before and behind the anchor.
SECOND = "prefix bigint, gram bigint, doc_id bigint, tag bigint, place bigint, payload binary"


def _suffixes(docs: DataFrame, frequent: list[int], large: list[int]) -> DataFrame:
    """From rows (doc_id, tag, text, payload: anchors that repeat): suffixes, the first of its sort in its group of rows; and without place, starts of windows that are known to go (doc_id: block)."""
    ship(docs.sparkSession)
    blocks = _blocks(docs)
    often, extended = (np.sort(np.array(x, np.int64).view(np.uint64)) for x in (frequent, large))
    names = [c.split()[0] for c in SECOND.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for rows in chunks(batches, GROUP_BYTES):
            seen: dict[tuple, tuple[int, int]] = {}
            out: list[list] = [[], [], [], [], [], []]
            gone: list[list] = [[], [], []]
            for r in sorted(rows, key=lambda r: r["doc_id"]):  # the first of equals is met first
                h, doc, tag = known.of(split(r["text"])), r["doc_id"], r["tag"]
                grams, at = anchors(h)
                if not len(at):
                    continue
                starts = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
                ends, at = np.append(starts[1:], len(at)), at[starts]
                own = np.flatnonzero(np.isin(grams[at], np.frombuffer(r["payload"], np.uint64)))
                if not len(own):
                    continue
                starts, ends, at = starts[own], ends[own], at[own]
                key, gram, data = _prefix_key(h, at, often).view(np.int64), grams[at].view(np.int64), h.tobytes()
                wide = np.isin(grams[at], extended)
                for p, a, b, prefix, g, w in zip(at.tolist(), starts.tolist(), ends.tolist(), key.tolist(), gram.tolist(), wide.tolist(), strict=True):
                    if w:
                        part = h[a : b - 1 + WINDOW]
                        units = [(x, y, None, k, WHOLE * 257, k, k + 1) for x, y, k in zip(*(rolling(part, WINDOW, f).view(np.int64).tolist() for f in FACTORS[::-1]), range(a, b), strict=True)]
                    else:
                        units = [(prefix, g, data[8 * a : 8 * p] + data[8 * (p + GRAM) : 8 * (b - 1 + WINDOW)], p, (p - b + 1) * 256 + p - a, a, b)]
                    for x, y, words, k, offsets, first, end in units:
                        before = seen.setdefault((x, y, offsets, words), (doc, k))
                        if before == (doc, k):
                            for column, v in zip(out, (x, y, doc, tag, k << 16 | offsets, words), strict=True):
                                column.append(v)
                        else:
                            for column, v in zip(gone, (doc, tag, range(first, end)), strict=True):
                                column.append(v)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary() if n == "payload" else pa.int64()) for x, n in zip(out, names, strict=True)], names=names)
            if gone[0]:
                often_of = np.array([len(x) for x in gone[2]])
                value = np.concatenate([np.arange(x.start, x.stop, dtype=np.int32) for x in gone[2]])
                sure = _blobs(np.repeat(np.array(gone[0], np.int64), often_of), np.repeat(np.array(gone[1], np.int64), often_of), value, blocks)
                n, none = sure.num_rows, lambda m: pa.array([None] * m, pa.int64())
                spread = _long(mixed(sure.column("block").to_numpy().view(np.uint64)))
                yield pa.RecordBatch.from_arrays([spread, none(n), sure.column("block"), none(n), none(n), sure.column("payload")], names=names)

    return docs.select("doc_id", "tag", "text", "payload").mapInArrow(run, SECOND)


def _common(gram: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in order of gram and words, and how many words each row has in common with the one before it (-1: another gram)."""
    order = np.lexsort((*words.T[::-1], gram))
    same = np.cumprod(words[order][1:] == words[order][:-1], axis=1, dtype=np.int8).sum(axis=1)
    return order, np.concatenate(([-1], np.where(gram[order][1:] == gram[order][:-1], same, -1)))


def _later(rows: dict[str, np.ndarray], left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, start) of each window of the suffixes that starts earlier elsewhere. left, right: words from the anchor leftwards and behind it."""
    size = len(rows["gram"])
    right_order, right_common = _common(rows["gram"], right)
    left_order, left_common = _common(rows["gram"], left)
    out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    right_node, left_node = np.empty(size, np.int64), np.empty(size, np.int64)
    for offset in range(SIDE + 1):
        own = np.flatnonzero((rows["least"] <= offset) & (offset <= rows["most"]))
        if len(own) < 2:
            continue
        right_node[right_order] = np.cumsum(right_common < SIDE - offset)
        left_node[left_order] = np.cumsum(left_common < offset)
        node, doc, start = right_node[own] * (size + 1) + left_node[own], rows["doc_id"][own], rows["at"][own] - offset
        order = np.lexsort((start, doc, node))
        new = np.concatenate(([True], node[order][1:] != node[order][:-1]))
        lead = order[np.maximum.accumulate(np.where(new, np.arange(len(own)), 0))]
        later = order[(doc[order] != doc[lead]) | (start[order] != start[lead])]
        out[0].append(own[later])
        out[1].append(start[later])
    return np.concatenate(out[0]), np.concatenate(out[1])


def _sides(payload: pa.Array, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words before (from the anchor leftwards) and behind the anchor, SIDE columns each; what a payload doesn't hold is 0."""
    data = np.frombuffer(b"".join(payload.to_pylist()), np.uint64)
    before, behind = most, SIDE - least
    first = np.cumsum(before + behind) - before - behind
    column = np.arange(SIDE)[None, :]
    none = np.append(data, np.uint64(0))
    left = none[np.where(column < before[:, None], (first + before)[:, None] - 1 - column, len(data))]
    return left, none[np.where(column < behind[:, None], (first + before)[:, None] + column, len(data))]


def _later_leaves(suffixes: DataFrame) -> DataFrame:
    """(doc_id, tag, payload): starts of windows that start earlier elsewhere, from the subtrees of each prefix."""
    blocks = _blocks(suffixes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, size = None, [], 0
        found: list[list[np.ndarray]] = []

        def grown(x: pa.RecordBatch) -> None:
            rows = {c: x.column(c).to_numpy() for c in ("gram", "doc_id", "tag", "place")}
            rows |= {"at": rows["place"] >> 16, "least": rows["place"] >> 8 & 255, "most": rows["place"] & 255}
            row, start = _later(rows, *_sides(x.column("payload"), rows["least"], rows["most"]))
            if len(row):
                found.append([rows["doc_id"][row], rows["tag"][row], start.astype(np.int32)])

        def streamed(x: pa.RecordBatch) -> None:
            nonlocal last
            prefix, gram, doc, tag, place = (x.column(c).to_numpy() for c in ("prefix", "gram", "doc_id", "tag", "place"))
            new = np.concatenate(([True], (prefix[1:] != prefix[:-1]) | (gram[1:] != gram[:-1])))
            if last is not None and last[:2] == (prefix[0], gram[0]):
                new[0] = False
            start = np.maximum.accumulate(np.where(new, np.arange(len(new)), -1))
            lead_doc = np.where(start >= 0, doc[start], last[2] if last else 0)
            lead_at = np.where(start >= 0, place[start] >> 16, last[3] if last else 0)
            later = (doc != lead_doc) | (place >> 16 != lead_at)
            if later.any():
                found.append([doc[later], tag[later], (place[later] >> 16).astype(np.int32)])
            last = (prefix[-1], gram[-1], lead_doc[-1], lead_at[-1])

        def out() -> pa.RecordBatch:
            told = _blobs(*(np.concatenate(x) for x in zip(*found, strict=True)), blocks)
            found.clear()
            return told

        for batch in batches:
            place = batch.column("place")
            known = batch.filter(place.is_null())
            if known.num_rows:
                yield pa.RecordBatch.from_arrays([known.column("doc_id"), known.column("payload")], names=["block", "payload"])
            whole = pa.compute.equal(pa.compute.bit_wise_and(place, WHOLE * 257), WHOLE * 257)
            windows, leaves = batch.filter(whole), batch.filter(pa.compute.invert(whole))
            if windows.num_rows:
                streamed(windows)
            if leaves.num_rows:
                held.append(leaves)
                size += leaves.num_rows
                if size >= TREE_ROWS and held[0].column("gram")[0] != leaves.column("gram")[-1]:
                    x = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    gram = x.column("gram").to_numpy()
                    cut = int(np.flatnonzero(gram != gram[-1])[-1]) + 1
                    grown(x.slice(0, cut))
                    held, size = [x.slice(cut)], len(gram) - cut
            if sum(len(f[0]) for f in found) > 1_000_000:
                yield out()
        if size:
            grown(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
        if found:
            yield out()

    ordered = suffixes.repartition("prefix").sortWithinPartitions("prefix", "gram", "doc_id", "place")
    return _gathered(ordered.mapInArrow(run, "block bigint, payload binary"), np.int32)


def _cut(docs: DataFrame, out_text: bool) -> DataFrame:
    """(doc_id, tag, n_words, n_removed, kept_sha256 or kept_text) from rows (doc_id, tag, text, payload: starts of windows to remove)."""
    ship(docs.sparkSession)
    last = "kept_text string" if out_text else "kept_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in chunks(batches, GROUP_BYTES):
            out: list[list] = [[], [], [], [], []]
            for r in rows:
                words = split(r["text"])
                n = len(words)
                edge = np.zeros(n + WINDOW + 1, np.int32)
                at = np.frombuffer(r["payload"], np.int32)
                at = at[at + WINDOW <= n]
                edge[at] += 1
                edge[at + WINDOW] -= 1
                stay = np.cumsum(edge[:n]) == 0
                kept = [words[k] for k in np.flatnonzero(stay)]
                for column, x in zip(out, (r["doc_id"], r["tag"], n, n - len(kept), b" ".join(kept).decode() if out_text else sha_of(kept)), strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64()), pa.array(out[4], pa.string())], names=["doc_id", "tag", "n_words", "n_removed", last.split()[0]])

    return docs.select("doc_id", "tag", "text", "payload").mapInArrow(run, f"doc_id bigint, tag bigint, n_words bigint, n_removed bigint, {last}")


def plan(docs: DataFrame, out_text: bool = False) -> tuple[DataFrame, DataFrame]:
    """Documents and cuts.

    Documents: (doc_id, tag, n_words, sha, copy) of every row; copy: its words are those of a text with a smaller id.
    Cuts: (doc_id, tag, n_words, n_removed, kept_sha256 or kept_text) of the documents that lose some words but aren't copies.
    """
    docs = docs.select(F.coalesce("doc_id", F.lit(LOWEST)).alias("doc_id"), _tag().alias("tag"), "text")
    first = stored(_first_pass(docs), "anchors")
    rows = first.where("kind = 'd'").select("doc_id", "tag", F.col("payload").alias("digest"), F.col("n").alias("n_words"), "sha", "copy")
    least = rows.groupBy("digest").agg(F.min(F.when(~F.col("copy"), F.col("doc_id"))).alias("_least"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    least, number = stored(least, "least"), rows.count()
    later = F.col("copy") | F.coalesce(F.col("doc_id") > F.col("_least"), F.lit(False))
    marked = salted_join(rows, least.drop("_n"), "digest", heavy_keys(least, "digest", "_n", number), F.col("doc_id"), "left")
    every = stored(marked.select("doc_id", "tag", "n_words", "sha", later.alias("copy")), "texts")
    total = every.agg(F.sum("n_words")).first()[0] or 0
    words = first.where("kind = 'w'").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") * FREQUENT > total)
    frequent = [r["key"] for r in words.collect()]  # FREQUENT at most
    repeated, large = _repeated(first, max(GROUP_ROWS, total >> 20))
    anchored = repeated.union(first.where("kind = 'p'").select("doc_id", "tag", "payload"))
    joined = F.unhex(F.array_join(F.transform(F.collect_list("payload"), lambda p: F.hex(p)), ""))
    lists = anchored.groupBy("doc_id", "tag").agg(joined.alias("payload"))
    originals = every.where(f"not copy and n_words >= {WINDOW}").select("doc_id", "tag").distinct()
    chosen = lists.join(originals, ["doc_id", "tag"])
    gone = _later_leaves(_suffixes(docs.join(chosen, ["doc_id", "tag"]), frequent, large))
    return every, _cut(docs.join(gone, ["doc_id", "tag"]), out_text)


def dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row of docs."""
    every, cuts = plan(docs)
    cuts = cuts.select("doc_id", "tag", F.col("n_removed").alias("_n"), F.col("kept_sha256").alias("_sha")).dropDuplicates(["doc_id", "tag"])
    whole = F.col("copy") & (F.col("n_words") >= WINDOW)
    empty = hashlib.sha256(b"").hexdigest()
    return every.join(cuts, ["doc_id", "tag"], "left").select(
        F.nullif("doc_id", F.lit(LOWEST)).alias("doc_id"),
        "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("_n", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, empty).otherwise(F.coalesce("_sha", "sha")).alias("kept_sha256"),
    )


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs without the repeated passages: a text that loses words becomes the others joined by spaces, with n_chars to match; other texts stay as they are. Columns of docs."""
    every, cuts = plan(docs, True)
    whole = every.where(F.col("copy") & (F.col("n_words") >= WINDOW)).select("doc_id", "tag", F.lit("").alias("_text"))
    new = cuts.where("n_removed > 0").select("doc_id", "tag", F.col("kept_text").alias("_text")).union(whole).dropDuplicates(["doc_id", "tag"])
    columns = docs.columns
    rows = docs.select(F.struct(*columns).alias("_row"), F.coalesce("doc_id", F.lit(LOWEST)).alias("doc_id"), _tag().alias("tag"))
    joined = rows.join(stored(new, "cuts"), ["doc_id", "tag"], "left")
    fresh = {"text": F.col("_text"), "n_chars": F.length("_text").cast("long")}
    return joined.select(*((F.when(F.col("_text").isNotNull(), fresh[c]).otherwise(F.col("_row")[c]) if c in fresh else F.col("_row")[c]).alias(c) for c in columns))
