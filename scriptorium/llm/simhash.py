"""SimHash near-duplicates by anchor-point covering.

The 64 bits fall into groups of 23, 23 and 18; two fingerprints with at most 4 differing bits differ in
at most one bit of some group. The anchors of a group are the words of the perfect binary Golay code: each
23-bit word (the third group is padded with zeros) lies within the covering radius 3 of exactly one
anchor, its home. A fingerprint goes to every anchor within radius plus threshold, 3 + 1: its home and, at
distance 3, five more. Whatever is within one bit of it has its home among them, so each linked pair
meets at an anchor and no pair is lost. About 16 rows a distinct fingerprint are shuffled.

Equal fingerprints are one node. An anchor with over HOT rows is cut into blocks, and every two blocks
meet in a cell of their own; only the sizes of the 12,288 anchors are read to know which. A cell reports
a spanning star of each of its components, never all pairs; components over all cells come from large-star
and small-star rounds, each written to the shared folder.

A text without words has fingerprint zero, which links like any other; null texts have no words. A null
doc_id counts after all others: a component of nulls has component_id null. Repeated rows repeat.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import chunks, heavy_keys, salted_join, ship, stored

SHINGLE, BITS, SEED = 4, 4, 42
#: Rows of an anchor from which it is cut into blocks of that size.
HOT = 16_000
#: Sizes up to which a cell is compared as one matrix.
MATRIX = 1500
GROUP_BYTES = 2_000_000
#: Generator polynomial of the binary Golay code; first bit and width of each group of bits.
GOLAY, GROUPS = 0b110001110101, ((0, 23), (23, 23), (46, 18))


def fingerprint_bits(hashes: np.ndarray) -> int:
    """A signed long whose bits are those set in over half the hashes."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    major = 2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)
    return int(np.packbits(major, bitorder="little").view(np.int64)[0])


def fingerprint(text: str | None) -> int:
    words = (text or "").encode().lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    first, last = [0, *(ends[: n - SHINGLE] + 1).tolist()], ends[SHINGLE - 1 :].tolist()
    h = xxhash.xxh64_intdigest
    hashes = [h(joined, SEED)] if n < SHINGLE else [h(joined[a:b], SEED) for a, b in zip(first, last, strict=True)]
    return fingerprint_bits(np.array(hashes, np.uint64))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed long."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in chunks(batches, GROUP_BYTES):
            fps = [fingerprint(r["text"]) for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array([r["doc_id"] for r in rows], pa.int64()), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, fp bigint")


class Anchors:
    """Anchors of fingerprints: group * 4096 + the upper 12 bits of a code word."""

    def __init__(self) -> None:
        def remainder(word: int) -> int:
            for k in range(22, 10, -1):
                if word >> k & 1:
                    word ^= GOLAY << (k - 11)
            return word

        self.part = [np.array([remainder(b << s & 0x7FFFFF) for b in range(256)], np.int64) for s in (0, 8, 16)]
        one = [remainder(1 << k) for k in range(23)]
        near: list[list[int]] = [[] for _ in range(2048)]
        for weight in range(5):  # radius plus threshold
            for places in combinations(range(23), weight):
                rest = 0
                for k in places:
                    rest ^= one[k]
                near[rest].append(sum(1 << k for k in places))
        self.near = np.full((2048, max(map(len, near))), -1, np.int64)
        for k, x in enumerate(near):
            self.near[k, : len(x)] = x

    def of(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(anchor, index of the fingerprint), all of them."""
        anchors, index = [], []
        for g, (first, width) in enumerate(GROUPS):
            word = (fps.view(np.uint64) >> np.uint64(first)).astype(np.int64) & ((1 << width) - 1)
            rest = self.part[0][word & 255] ^ self.part[1][word >> 8 & 255] ^ self.part[2][word >> 16 & 127]
            errors = self.near[rest]
            row, column = np.nonzero(errors >= 0)
            anchors.append(((word[row] ^ errors[row, column]) >> 11) + g * 4096)
            index.append(row)
        return np.concatenate(anchors), np.concatenate(index)


def stars(fps: np.ndarray, bits: int = BITS) -> list[tuple[int, int]]:
    """(least member, other member) for each component of more than one among distinct fingerprints."""
    x = fps.view(np.uint64)
    out: list[tuple[int, int]] = []
    if len(x) <= MATRIX:
        near = np.bitwise_count(x[:, None] ^ x[None, :]) <= bits
        linked = np.flatnonzero(near.sum(axis=1) > 1)
        seen = np.zeros(len(x), bool)
        for s in linked:
            if not seen[s]:
                members = near[s].copy()
                edge = members.copy()
                while edge.any():
                    edge = near[edge].any(axis=0) & ~members
                    members |= edge
                seen |= members
                own = fps[members]
                out += [(int(own.min()), int(f)) for f in own if f != own.min()]
        return out
    left = np.arange(len(x))  # not reached so far
    while len(left):
        members, todo = [left[0]], [left[0]]
        left = left[1:]
        while todo and len(left):
            hit = np.bitwise_count(x[left] ^ x[todo.pop()]) <= bits
            if hit.any():
                members += (new := left[hit].tolist())
                todo += new
                left = left[~hit]
        if len(members) > 1:
            own = fps[members]
            out += [(int(own.min()), int(f)) for f in own if f != own.min()]
    return out


def links(nodes: DataFrame, hot: int = HOT) -> DataFrame:
    """(u, v): spanning stars, over all cells, of distinct fingerprints fp with at most BITS differing bits."""
    ship(nodes.sparkSession)

    def placed(sizes: dict[int, int]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            anchors = Anchors()
            for batch in batches:
                fps = batch.column("fp").to_numpy()
                anchor, index = anchors.of(fps)
                cell, fp = anchor << 40, fps[index]
                if sizes:
                    blocks = np.array([sizes.get(a, 1) for a in range(3 * 4096)])[anchor]
                    block = (fp.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % blocks
                    often = np.repeat(np.arange(len(cell)), blocks)
                    other = np.arange(len(often)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                    low, high = np.minimum(block[often], other), np.maximum(block[often], other)
                    cell, fp = cell[often] | low << 20 | high, fp[often]
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(fp)], names=["cell", "fp"])

        return nodes.select("fp").mapInArrow(run, "cell bigint, fp bigint")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["u", "v"])

        cells, fps = [], []
        for batch in batches:
            cell, fp = batch.column("cell").to_numpy(), batch.column("fp").to_numpy()
            cells.append(cell)
            fps.append(fp)
            if cells[0][0] == cell[-1]:
                continue
            c, f = np.concatenate(cells), np.concatenate(fps)
            cut = int(np.searchsorted(c, c[-1]))
            edges = [e for part in np.split(f[:cut], np.flatnonzero(np.diff(c[:cut])) + 1) if len(part) > 1 for e in stars(part)]
            cells, fps = [c[cut:]], [f[cut:]]
            if edges:
                yield told(edges)
        if cells:
            c, f = np.concatenate(cells), np.concatenate(fps)
            if edges := [e for part in np.split(f, np.flatnonzero(np.diff(c)) + 1) if len(part) > 1 for e in stars(part)]:
                yield told(edges)

    count = placed({}).groupBy((F.shiftright("cell", 40)).alias("anchor")).count().where(F.col("count") > hot).collect()  # 12,288 rows at most
    sizes = {int(r["anchor"]): -(-r["count"] // hot) for r in count}
    return placed(sizes).repartition("cell").sortWithinPartitions("cell").mapInArrow(compare, "u bigint, v bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(v, u): each node v of the edges (u, v) but the least of its component, with that least node u."""
    state = None
    edges = stored(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct(), "links")
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("u"), "v").where("u <> v").distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v")
        turned = small.where("u <> m").select(F.col("m").alias("u"), F.col("u").alias("v")).union(small.select(F.col("m").alias("u"), "v")).distinct()
        edges = stored(turned, "links")
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == now:
            return edges
        state = now


def near_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) of every row of docs."""
    prints = stored(fingerprints(docs), "fingerprints")
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "nodes")
    roots = components(links(nodes))
    own = roots.select(F.col("v").alias("fp"), F.col("u").alias("root")).union(roots.select(F.col("u").alias("fp"), F.col("u").alias("root")).distinct())
    linked = own.join(nodes.drop("n"), "fp")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    named = linked.join(least, "root").select("fp", "component_id")
    every = nodes.drop("n").join(named, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return salted_join(prints, every, "fp", heavy_keys(nodes, "fp", "n", prints.count()), F.col("doc_id")).select("doc_id", "fp", "component_id")


