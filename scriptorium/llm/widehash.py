"""SimHash near-duplicates of the corpus stage: five-word shingles, Jaccard similarity of 0.8 or more.

The method is that of simhash.py, anchor-point covering by the Golay code, with a wider fingerprint: pairs of
similarity 0.8 differ in some 15 % of the bits, so 64 bits and 4 differences would lose nearly all of them. Here
a set of distinct shingles has 256 bits, of which GROUPS groups of 23 have anchors; a fingerprint goes to all
anchors within radius plus threshold, 3 + 1, of each group (58 rows a distinct set). Two sets of similarity 0.8
share no anchor with probability 4e-5 (1e-3 for sets of four and five shingles).

Within an anchor two sets are candidates if their bits differ in at most NEAR places (NEAR_SMALL for small sets).
A cell tells a minimum spanning forest of its candidates, never all pairs; each told link is checked on the whole
shingle sets. Where a check fails, the components at both ends may still hold similar sets that the forest passed over
(a path of the forest between two such sets leaves its component by a failed link). Members of these components meet
once more at their rarest shingles: of size - ceil(0.8 size) + 1 of them, in order of frequency, two similar sets share
one. Those that are candidates, in different components and within the bound of their parity bits are checked as well,
so every candidate of 0.8 is linked. A set's parity bits tell of each of PARITY buckets of hashes whether an odd number
of shingles is in it: two sets have at least as many shingles not in common as these bits differ, and similar ones have
at most a ninth of both sizes. Sets of over some 3,000 shingles fill the buckets, so the bound rules none of them out.

Texts with equal shingle sets are one node. Words are runs of bytes other than ASCII white space, lower-cased A-Z.
A text of under five words is one shingle; texts without words, null ones too, are equal to each other. Rows are
told apart by doc_id and text: rows of one id with different texts are judged each for itself, a null id comes last.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import chunks, heavy_keys, salted_join, ship, stored
from scriptorium.llm.simhash import GROUP_BYTES, Anchors, components

SHINGLE, LANES, GROUPS, WIDTH = 5, 4, 11, 23
#: The least similarity of a link, as a fraction.
SIMILAR = (4, 5)
#: Most differing bits of candidates, for sets of at least SMALL shingles and for smaller ones.
NEAR, NEAR_SMALL, SMALL = 60, 76, 16
#: Rows of an anchor from which it is cut into blocks of that size; rows compared at once.
HOT, BLOCK = 65_536, 512
#: Buckets of a set's parity bits; pairs whose bits are compared at once.
PARITY, PAIRS = 1024, 65_536
MIX = np.uint64(0x9E3779B97F4A7C15)
LANE = [f"f{k}" for k in range(LANES)]


class Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def mixed(x: np.ndarray, y: np.ndarray | np.uint64) -> np.ndarray:
    x = (x ^ y) * MIX
    return x ^ x >> np.uint64(29)


def shingles(text: str | None, hashes: dict) -> np.ndarray:
    """Hashes of the distinct shingles, ascending."""
    words = (text or "").encode().lower().split()
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    k = min(len(w), SHINGLE)
    x = np.full(len(w) - k + 1, k, np.uint64)
    for j in range(k):
        x = mixed(x, w[j : j + len(x)])
    return np.unique(x)


def fingerprint(shingle: np.ndarray) -> np.ndarray:
    """LANES longs: the bits set in over half of the shingles' hashes."""
    total = np.zeros(64 * LANES, np.int64)
    for k in range(0, len(shingle), 4096):
        part = shingle[k : k + 4096]
        h = np.stack([mixed(mixed(part, np.uint64(lane + 1)), np.uint64(77)) for lane in range(LANES)], axis=1)
        total += np.unpackbits(h.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return np.packbits(2 * total > len(shingle), bitorder="little").view(np.int64)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return SIMILAR[1] * both >= SIMILAR[0] * (len(a) + len(b) - both)


def parity(shingle: np.ndarray) -> np.ndarray:
    """PARITY bits: whether an odd number of the shingles is in each bucket."""
    counts = np.bincount((shingle % np.uint64(PARITY)).astype(np.int64), minlength=PARITY)
    return np.packbits(counts & 1, bitorder="little")


def may_be_similar(odd: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """False for pairs of rows whose parity bits differ in too many places for two similar sets."""
    out = np.empty(len(i), bool)
    for k in range(0, len(i), PAIRS):
        a, b = i[k : k + PAIRS], j[k : k + PAIRS]
        apart = np.bitwise_count(odd[a] ^ odd[b]).sum(axis=1, dtype=np.int64)
        out[k : k + PAIRS] = sum(SIMILAR) * apart <= (SIMILAR[1] - SIMILAR[0]) * (size[a] + size[b])
    return out


def text_key() -> Column:
    return F.xxhash64("text")


def prints_of(docs: DataFrame) -> DataFrame:
    """(doc_id, key, node, size, f0 to f3) of every row: hashes of the text and of its shingle set, shingles, fingerprint."""
    ship(docs.sparkSession)
    names = ["doc_id", "key", "node", "size", *LANE]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in chunks(batches, GROUP_BYTES):
            hashes = Hashes()
            sets = [shingles(r["text"], hashes) for r in rows]
            node = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            prints = np.stack([fingerprint(s) for s in sets])
            columns = [pa.array([r[c] for r in rows], pa.int64()) for c in ("doc_id", "key")]
            columns += [pa.array(node), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(prints[:, k]) for k in range(LANES))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select("doc_id", text_key().alias("key"), "text").mapInArrow(run, ", ".join(f"{c} bigint" for c in names))


def anchors_of(prints: np.ndarray, anchors: Anchors) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, row) of all anchors of each fingerprint; an anchor is group * 4096 and the upper 12 bits of a code word."""
    bits = np.unpackbits(prints.view(np.uint8).reshape(len(prints), -1), axis=1, bitorder="little")
    value = 1 << np.arange(WIDTH, dtype=np.int64)
    found, index = [], []
    for g in range(GROUPS):
        word = bits[:, g * WIDTH : (g + 1) * WIDTH] @ value
        rest = anchors.part[0][word & 255] ^ anchors.part[1][word >> 8 & 255] ^ anchors.part[2][word >> 16 & 127]
        errors = anchors.near[rest]
        row, column = np.nonzero(errors >= 0)
        found.append(((word[row] ^ errors[row, column]) >> 11) + g * 4096)
        index.append(row)
    return np.concatenate(found), np.concatenate(index)


def placed(nodes: DataFrame, hot: int = HOT) -> DataFrame:
    """(cell, and the columns of nodes): every node at each of its anchors; an anchor of over hot rows is cut into blocks, every two of which meet in a cell."""
    ship(nodes.sparkSession)
    names = nodes.columns

    def run_with(sizes: dict[int, int], whole: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            anchors = Anchors()
            for batch in batches:
                if not batch.num_rows:
                    continue
                columns = {c: batch.column(c).to_numpy() for c in names}
                anchor, index = anchors_of(np.ascontiguousarray(np.stack([columns[c] for c in LANE], axis=1)), anchors)
                cell = anchor << 40
                if sizes:
                    blocks = np.array([sizes.get(a, 1) for a in range(GROUPS * 4096)])[anchor]
                    block = (mixed(columns["node"][index].view(np.uint64), np.uint64(5)) >> np.uint64(33)).astype(np.int64) % blocks
                    often = np.repeat(np.arange(len(cell)), blocks)
                    other = np.arange(len(often)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                    low, high = np.minimum(block[often], other), np.maximum(block[often], other)
                    cell, index = cell[often] | low << 20 | high, index[often]
                yield pa.RecordBatch.from_arrays([pa.array(cell), *(pa.array(columns[c][index]) for c in names)] if whole else [pa.array(cell)], names=["cell", *names] if whole else ["cell"])

        return run

    rows = nodes.mapInArrow(run_with({}, False), "cell bigint")
    count = rows.groupBy(F.shiftright("cell", 40).alias("anchor")).count().where(F.col("count") > hot).collect()  # GROUPS * 4096 rows at most
    sizes = {int(r["anchor"]): -(-r["count"] // hot) for r in count}
    return nodes.mapInArrow(run_with(sizes, True), ", ".join(f"{c} bigint" for c in ["cell", *names]))


def candidates(prints: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, differing bits) of candidate pairs i < j among the rows of a cell, by blocks."""
    x = prints.view(np.uint64)
    for k in range(0, len(x), BLOCK):
        part = x[k : k + BLOCK]
        first = np.bitwise_count(part[:, None, 0] ^ x[None, k:, 0]) <= 32
        i, j = np.nonzero(first)
        own = i < j
        i, j = i[own] + k, j[own] + k
        if not len(i):
            continue
        low, high = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
        own = SIMILAR[1] * low >= SIMILAR[0] * high
        i, j, low = i[own], j[own], low[own]
        bits = np.bitwise_count(x[i] ^ x[j]).sum(axis=1, dtype=np.int64)
        own = bits <= np.where(low < SMALL, NEAR_SMALL, NEAR)
        yield i[own], j[own], bits[own]


def forest(n: int, i: np.ndarray, j: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Indices of the links of a minimum spanning forest; order ranks the links, all different."""
    label, chosen = np.arange(n), []
    live = np.arange(len(i))
    while len(live):
        a, b = label[i[live]], label[j[live]]
        live = live[a != b]
        if not len(live):
            break
        a, b = label[i[live]], label[j[live]]
        best = np.full(n, len(i), np.int64)
        np.minimum.at(best, a, order[live])
        np.minimum.at(best, b, order[live])
        wins = live[(best[a] == order[live]) | (best[b] == order[live])]
        chosen.append(wins)
        u, v = label[i[wins]], label[j[wins]]
        root = np.arange(n)
        while True:
            low = np.minimum(root[u], root[v])
            np.minimum.at(root, u, low)
            np.minimum.at(root, v, low)
            root = root[root]
            if (root[u] == root[v]).all():
                break
        while (root != root[root]).any():
            root = root[root]
        label = root[label]
    return np.concatenate(chosen) if chosen else np.zeros(0, np.int64)


def spanning(node: np.ndarray, prints: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(u, v), u < v: a minimum spanning forest of a cell's candidates. Memory follows the rows, not the pairs."""
    held = [np.zeros(0, np.int64)] * 3
    count = 0

    def reduced() -> list[np.ndarray]:
        i, j, bits = (np.concatenate(x) if isinstance(x, list) else x for x in held)
        low, high = np.minimum(node[i], node[j]), np.maximum(node[i], node[j])
        order = np.empty(len(i), np.int64)
        order[np.lexsort((high, low, bits))] = np.arange(len(i))
        keep = forest(len(node), i, j, order)
        return [i[keep], j[keep], bits[keep]]

    for found in candidates(prints, size):
        held = [np.concatenate((a, b)) for a, b in zip(held, found, strict=True)]
        count += len(found[0])
        if len(held[0]) > 4 * len(node) + 1_000_000:
            held = reduced()
    i, j, _ = reduced()
    return np.minimum(node[i], node[j]), np.maximum(node[i], node[j])


def compared(rows: DataFrame, crossing: bool = False) -> DataFrame:
    """(u, v): links told by cells, from rows (cell, node, size, f0 to f3; crossing: root and parity too): a spanning forest of each, or the candidates of different roots that may be similar."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows < 20_000 or held[0].column("cell")[0] == batch.column("cell")[-1]:
                continue
            x = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            cell = x.column("cell").to_numpy()
            cut = int(np.searchsorted(cell, cell[-1]))
            yield {c: x.column(c).to_numpy(zero_copy_only=False)[:cut] for c in x.schema.names}
            held, rows = [x.slice(cut)], len(cell) - cut
        if held:
            x = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            yield {c: x.column(c).to_numpy(zero_copy_only=False) for c in x.schema.names}

    def told(u: list[np.ndarray], v: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in cells(batches):
            prints = np.ascontiguousarray(np.stack([x[c] for c in LANE], axis=1))
            u, v = [], []
            for part in np.split(np.arange(len(x["cell"])), np.flatnonzero(np.diff(x["cell"])) + 1):
                if len(part) < 2:
                    continue
                node, size = x["node"][part], x["size"][part]
                if not crossing:
                    a, b = spanning(node, prints[part], size)
                    u.append(a)
                    v.append(b)
                    continue
                root = x["root"][part]
                if (root == root[0]).all():
                    continue
                odd = np.frombuffer(b"".join(x["parity"][part]), np.uint64).reshape(len(part), -1)
                for i, j, _ in candidates(prints[part], size):
                    own = root[i] != root[j]
                    i, j = i[own], j[own]
                    own = may_be_similar(odd, size, i, j)
                    u.append(np.minimum(node[i[own]], node[j[own]]))
                    v.append(np.maximum(node[i[own]], node[j[own]]))
                    if len(u[-1]) > 100_000:
                        yield told(u, v)
                        u, v = [], []
            if u:
                yield told(u, v)

    return rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "u bigint, v bigint").distinct()


def by_rarest(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(cell, and the columns of members, and parity): members at those of their rarest shingles that two similar sets must share; a shingle that no other member has is no cell."""

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, data in zip(batch.column("node").to_pylist(), batch.column("shingles").to_pylist(), strict=True):
                own = np.frombuffer(data, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), node, np.int64)), pa.array(own)], names=["node", "cell"])

    every = sets.join(members.select("node"), "node", "left_semi").mapInArrow(single, "node bigint, cell bigint")
    shared = every.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    listed = every.join(shared, "cell").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "cell"))).alias("x"))  # a text's shingles
    more, least = SIMILAR[1], SIMILAR[0]
    length = F.col("size") - F.ceil(F.col("size") * least / more) + 1 - (F.col("size") - F.size("x"))  # shingles without company come first
    chosen = members.join(listed, "node").where(length > 0).join(sets.select("node", "parity"), "node")
    columns = [*members.columns, "parity"]
    return chosen.select(F.explode(F.slice("x", F.lit(1), length.cast("int"))).alias("x"), *columns).select("x.cell", *columns)


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, shingles, parity) of the wanted (node, key), once each."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in chunks(batches, GROUP_BYTES):
            hashes = Hashes()
            sets = [shingles(r["text"], hashes) for r in rows]
            columns = [pa.array([r["node"] for r in rows], pa.int64()), *(pa.array([f(x).tobytes() for x in sets], pa.binary()) for f in (np.asarray, parity))]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "shingles", "parity"])

    texts = docs.select(text_key().alias("key"), "text").join(wanted, "key").dropDuplicates(["node"]).select("node", "text")
    return texts.mapInArrow(run, "node bigint, shingles binary, parity binary")


def checked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (u, v) that are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(c).to_pylist() for c in ("a", "b"))
            near = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(a, b, strict=True)]
            yield batch.select(["u", "v"]).filter(pa.array(near, pa.bool_()))

    both = pairs.join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("b")), "v")
    both = both.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("a")), "u")
    return both.select("u", "v", "a", "b").mapInArrow(run, "u bigint, v bigint")


def named_roots(links: DataFrame) -> DataFrame:
    """(node, root) of each node with a link."""
    found = components(links)
    return found.select(F.col("v").alias("node"), F.col("u").alias("root")).union(found.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())


def roots(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, root) of each node that is linked to another."""
    told = stored(compared(placed(nodes.select("node", "size", *LANE))), "told")
    members = told.select(F.col("u").alias("node")).union(told.select(F.col("v").alias("node"))).distinct()
    met = stored(nodes.join(members, "node"), "met")
    sets = stored(sets_of(docs, met.select("node", "key")), "sets")
    links = stored(checked(told, sets), "near")
    named = named_roots(links)
    rest = stored(met.join(named, "node", "left").select("node", "size", *LANE, F.coalesce("root", "node").alias("root")), "rooted")
    end = lambda c: rest.select(F.col("node").alias(c), F.col("root").alias("root_" + c))
    failed = told.join(end("u"), "u").join(end("v"), "v").where("root_u <> root_v")
    apart = failed.select(F.explode(F.array("root_u", "root_v")).alias("root")).distinct()
    more = stored(checked(compared(by_rarest(rest.join(apart, "root", "left_semi"), sets), crossing=True), sets), "near")
    return named if more.isEmpty() else named_roots(links.union(more))


def near_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, key, root) of every row: rows of one root are linked, by a chain of links of 0.8 or more."""
    prints = stored(prints_of(docs), "prints")
    same = [F.first(c).alias(c) for c in ("size", *LANE)]
    nodes = stored(prints.groupBy("node").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("n"), *same), "nodes")
    heavy = heavy_keys(nodes, "node", "n", prints.count())
    named = roots(docs, nodes.drop("n"))
    return salted_join(prints.select("doc_id", "key", "node"), named, "node", heavy, F.col("key") + F.coalesce("doc_id", F.lit(0)), "left").select("doc_id", "key", F.coalesce("root", "node").alias("root"))


def keep_first(docs: DataFrame) -> DataFrame:
    """Of each group of linked rows the smallest by doc_id (null last) and hash of the text, once. Columns of docs."""
    groups = stored(near_rows(docs), "groups")
    first = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")).alias("first"), F.count(F.lit(1)).alias("n"))
    first = stored(first, "first")
    heavy = heavy_keys(first, "root", "n", groups.count())
    is_first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("key") == F.col("first.key"))
    of = lambda rows: rows.select(F.col("doc_id").alias("_of"), F.col("key").alias("_of_key"))
    same = F.col("doc_id").eqNullSafe(F.col("_of")) & (text_key() == F.col("_of_key"))
    gone = salted_join(groups, first.drop("n"), "root", heavy, F.col("key") + F.coalesce("doc_id", F.lit(0))).where(~is_first).select("doc_id", "key").distinct()
    left = docs.join(of(gone), same, "left_anti")
    again = stored(of(groups.groupBy("doc_id", "key").count().where("count > 1")), "repeated")
    if again.isEmpty():
        return left
    repeated = left.join(again, same, "left_semi").withColumn("_key", text_key()).dropDuplicates(["doc_id", "_key"]).select(docs.columns)
    return left.join(again, same, "left_anti").union(repeated)
