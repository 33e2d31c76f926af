"""LM scoring by a hierarchical Pitman-Yor model.

A token's context is the whole word before it, or the start of the text; every context has a restaurant of its own.
All restaurants have one parent, the unigram restaurant, whose own parent is uniform over the vocabulary and one
unknown word. The seating matters to predictions only by the number of tables a word has in each restaurant. Given
the rest, that number is drawn from its conditional, the Chinese restaurant process summed over seatings by
generalised Stirling numbers: a Gibbs sweep draws it for every word and context, then for every word in the parent.
For dishes of over EXACT customers the same law is drawn from its saddle point, which is off by a few percent at
EXACT and less beyond.
Discounts are estimated from the pairs and the words that occur once and twice; concentrations make the seating of
the last round most probable. Predictions are averaged over the last SAMPLES sweeps, with the totals of these very
seatings: probabilities of all words in a context add up to one.

The seating of a word depends on other words only through the restaurants' totals, and a single customer has a table
of its own whatever is drawn: a context has as many tables as customers, less what its repeated pairs save. So only
pairs that repeat are dealt by word for the sweeps, with the totals that their contexts had in the last round, and
only what they save is summed by context.

1. A group of rows tells each bucket its distinct words and pairs, once each: words by their hash, pairs by that of
   their context. Contexts that a look at one row in LOOK shows to be frequent are dealt by the word that follows;
   there are at most FREQUENT of them, and the look decides only where rows go. Buckets are as many as the tokens
   looked at ask for. A bucket adds up and keeps, for each group, where its words and pairs are.
2. Two rounds of sweeps by word: what the first come to is what the second see.
3. A bucket answers each group in the order in which it asked, with whole numbers. The group's places (row, context
   and word of each pair) meet the answers, and rows are summed up there. For that the docs are read a second time
   in the same groups: docs that aren't plain files are stored first, and groups that differ are an error.

A word's repeated pairs are held at once in step 2, some 100 bytes each.
Tokens are runs of bytes other than ASCII white space, lower-cased A-Z, then one end. A null text has only
the end; a null doc_id's text for the training split is empty. Repeated rows count repeatedly and score
alike. Without training rows every word is as unknown as any other. Words are told apart by 64-bit hashes. Draws
come from hashes of word, context and sweep: reruns agree.
"""

from __future__ import annotations

import functools
import gc
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import chunks, ship, stored

#: Numbers that draws know contexts by (and that one process, Totals, has restaurants for); every context has a restaurant of its own.
CONTEXTS = 1 << 22
#: One row in so many is looked at for contexts to deal by their words; tokens for each bucket of words and pairs.
LOOK, BUCKET_TOKENS = 64, 2_000_000
#: Concentration of restaurants in the first round.
STRENGTH = 20.0
#: Concentrations tried.
STRENGTHS = tuple(10.0 ** (k / 4) for k in range(-4, 21))
BURN_IN, SAMPLES, EXACT, FREQUENT = 3, 3, 64, 4096
HELD_OUT = (7, 2)
GROUP_BYTES, GROUP_ROWS = 16_000_000, 60_000
END = b"\n"
#: The context of a text's first token, among hashes of words.
START = 0
SUMS = {"known": np.dtype("<u4"), "base": np.dtype("<f8"), "score": np.dtype("<f8")}


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % HELD_OUT[0] == HELD_OUT[1]


def uniform(*parts: np.ndarray | int) -> np.ndarray:
    """Numbers in (0, 1) from a hash of the parts."""
    x = np.uint64(0x243F6A8885A308D3)
    for p in parts:
        x = (x ^ (p.astype(np.uint64) if isinstance(p, np.ndarray) else np.uint64(p))) * np.uint64(0x9E3779B97F4A7C15)
        x = x ^ x >> np.uint64(29)
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ x >> np.uint64(32)
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


def stirling(discount: float, most: int) -> np.ndarray:
    """Logarithms of generalised Stirling numbers: [customers, tables]."""
    out = np.full((most + 1, most + 2), -np.inf)
    out[1, 1] = 0.0
    for n in range(1, most):
        t = np.arange(1, n + 2)
        stay = out[n, t] + np.log(np.maximum(n - t * discount, 1e-300))
        out[n + 1, t] = np.logaddexp(out[n, t - 1], stay)
    return out


@functools.cache
def exact_law(discount: float) -> np.ndarray:
    return stirling(discount, EXACT)


def discount_of(once: float, twice: float) -> float:
    """The usual estimate of a discount from the numbers of pairs that occur once and twice."""
    return round(min(0.95, max(0.1, once / (once + 2 * twice))), 3) if once else 0.5


def draw_tables(n: np.ndarray, weight: np.ndarray | float, discount: float, u: np.ndarray) -> np.ndarray:
    """Tables of dishes with n customers, where a new table has weight (one for all or each its own) against n - discount * tables for the others."""
    tables = np.ones(len(n), np.int64)
    table, heavy, alike = exact_law(discount), np.log(weight), np.ndim(weight) == 0
    order = np.argsort(n, kind="stable")
    cuts = _runs(n[order])
    for own in np.split(order, cuts[1:]):
        k = int(n[own[0]]) if len(own) else 1
        if k == 1 or k > EXACT:
            continue
        t = np.arange(1, k + 1)
        if alike:
            p = table[k, 1 : k + 1] + t * heavy
            p = np.cumsum(np.exp(p - p.max()))
            tables[own] = 1 + np.searchsorted(p, u[own] * p[-1])
        else:
            p = table[k, 1 : k + 1][None, :] + t[None, :] * heavy[own][:, None]
            p = np.cumsum(np.exp(p - p.max(axis=1, keepdims=True)), axis=1)
            tables[own] = 1 + (p < (u[own] * p[:, -1])[:, None]).sum(axis=1)
    own = np.flatnonzero(n > EXACT)
    if len(own):
        tables[own] = many_tables(n[own], np.full(len(own), weight) if alike else weight[own], discount, u[own])
    return tables


def many_tables(n: np.ndarray, weight: np.ndarray, discount: float, u: np.ndarray) -> np.ndarray:
    """Tables of dishes with many customers, from the law's saddle point.

    The law's generating function is exp(weight * f(x)), f(x) = (1 - (1 - x) ** discount) / discount. With x where
    weight * x * f'(x) = n, tables beyond the first follow a Poisson law of mean weight * f(x) while that is small
    against n, and a normal one around it, narrower, where it isn't. What is left out is of order n ** -discount.
    """
    low, high = np.full(len(n), -700.0), np.full(len(n), -1e-12)  # logarithm of 1 - x
    for _ in range(60):
        y = (low + high) / 2
        above = np.log(weight) + np.log(-np.expm1(y)) + (discount - 1.0) * y > np.log(n)
        low, high = np.where(above, y, low), np.where(above, high, y)
    y = np.exp((low + high) / 2)
    x, f, slope = 1.0 - y, (1.0 - y**discount) / discount, y ** (discount - 1.0)
    mean, g = weight * f, x * slope / f
    growth = slope / f * (1.0 + (1.0 - discount) * x / y - g)  # g'(x)
    spread = mean / (1.0 + slope / f * g / np.maximum(growth, 1e-300))
    again = uniform((u * 2.0**53).astype(np.int64), 7)
    normal = np.round(mean + np.sqrt(spread) * np.sqrt(-2.0 * np.log(u)) * np.cos(2.0 * np.pi * again))
    few = (mean < 30.0) | (spread > 0.9 * mean)
    return np.clip(np.where(few, 1.0 + poisson(mean, u), normal), 1, n).astype(np.int64)


def poisson(mean: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Draws by inversion; a rounded normal beyond a mean of 30."""
    out, p = np.zeros(len(mean)), np.exp(-np.minimum(mean, 30.0))
    below, k = p.copy(), 0
    live = np.flatnonzero((u > below) & (mean < 30.0))
    while len(live) and k < 200:
        k += 1
        p[live] *= mean[live] / k
        below[live] += p[live]
        out[live] = k
        live = live[u[live] > below[live]]
    large = np.flatnonzero(mean >= 30.0)
    if len(large):
        normal = np.sqrt(-2.0 * np.log(u[large])) * np.cos(2.0 * np.pi * uniform((u[large] * 2.0**53).astype(np.int64), 7))
        out[large] = np.maximum(np.round(mean[large] + np.sqrt(mean[large]) * normal), 0.0)
    return out


def best_strength(discount: float, customers: np.ndarray, tables: np.ndarray) -> float:
    """The concentration under which the seating of restaurants with these customers and tables is most probable."""
    some = customers > 0
    pairs = list(zip(customers[some].tolist(), tables[some].tolist(), strict=True))
    up = math.lgamma
    worth = lambda a: sum(up(a / discount + t) - up(a / discount + 1) - up(a + c) + up(a + 1) for c, t in pairs)
    return max(STRENGTHS, key=worth) if pairs else STRENGTH


class Rates:
    """What all words share: tokens and words, discounts, concentrations, and by sample all tables of contexts and those of the parent."""

    def __init__(self, words: int, tokens: int, discounts: tuple[float, float], every: np.ndarray, parent: np.ndarray, strength: float = STRENGTH, parent_strength: float = STRENGTH):
        self.words, self.tokens, (self.discount, self.parent_discount) = words, tokens, discounts
        self.every, self.parent, self.strength, self.parent_strength = every, parent, strength, parent_strength

    def unknown(self, s: int) -> float:
        """The parent's probability of a word without customers."""
        d, a = self.parent_discount, self.parent_strength
        return (a + d * self.parent[s]) / (self.words + 1) / (a + self.every[s])

    def in_parent(self, s: int, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        d, a = self.parent_discount, self.parent_strength
        return (customers - d * tables) / (a + self.every[s]) + self.unknown(s)

    def mixed(self, n: np.ndarray | int, tables: np.ndarray | int, parent: np.ndarray, customers: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Probability of a word with n customers at tables in a context with customers at own tables."""
        d, a = self.discount, self.strength
        return (n - d * tables + (a + d * own) * parent) / (a + customers)


class Totals(Rates):
    """Rates, with the customers and tables of every context: for one process that holds all."""

    def __init__(self, words: int, tokens: int, customers: np.ndarray, discounts: tuple[float, float], tables: np.ndarray | None = None, parent: np.ndarray | None = None):
        self.customers, self.contexts = customers.astype(np.float64), len(customers)
        self.tables = np.tile(0.5 * self.customers, (SAMPLES, 1)) if tables is None else tables.astype(np.float64)
        every = self.tables.sum(axis=1)
        super().__init__(words, tokens, discounts, every, np.full(SAMPLES, 0.5 * every[0]) if parent is None else parent.astype(np.float64))
        if tables is not None:
            self.strength = best_strength(self.discount, self.customers, tables.mean(axis=0))
            self.parent_strength = best_strength(self.parent_discount, every, parent)

    def in_context(self, s: int, context: np.ndarray, n: np.ndarray | int, tables: np.ndarray | int, parent: np.ndarray) -> np.ndarray:
        return self.mixed(n, tables, parent, self.customers[context], self.tables[s][context])


def sweeps(key: np.ndarray, singles: np.ndarray, of: np.ndarray, context: np.ndarray, n: np.ndarray, own: np.ndarray, rates: Rates) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each sample the tables of pairs, and customers and tables of words in the parent.

    key: hashes of words; singles: how many pairs of a word have one customer, who has a table of its own whatever
    is drawn; of, context, n: word, number of the context and customers of the other pairs; own: tables of their contexts by sample.
    """
    size, hashes = len(key), key[of]
    customers, above = singles + 2 * np.bincount(of, minlength=size), np.ones(size, np.int64)
    d, a = rates.discount, rates.strength
    for sweep in range(BURN_IN + SAMPLES):
        s = max(0, sweep - BURN_IN)
        p = rates.in_parent(s, customers, above)
        t = draw_tables(n, (a + d * own[s]) * p[of], d, uniform(hashes, context, sweep))
        customers = singles + np.bincount(of, t, size)
        again = rates.parent_strength + rates.parent_discount * rates.parent[s]
        above, more = np.ones(size, np.int64), np.flatnonzero(customers > 1)
        above[more] = draw_tables(customers[more].astype(np.int64), again / (rates.words + 1), rates.parent_discount, uniform(key[more], 999, sweep))
        if sweep >= BURN_IN:
            yield t, customers, above


class Seating:
    """The sweeps of some words, in one process. word: index of each pair's word, ascending; key: hashes of the words; totals: those that the sweeps see; after: those of the sweeps' own seatings."""

    def __init__(self, key: np.ndarray, word: np.ndarray, context: np.ndarray, n: np.ndarray, totals: Totals, after: Totals | None = None):
        self.word, self.context, self.n, self.totals = word, context.astype(np.int64), n.astype(np.int64), after or totals
        self.tables, self.parents = [], []
        many = np.flatnonzero(self.n > 1)
        singles = np.bincount(word[self.n == 1], minlength=len(key))
        for t, customers, above in sweeps(key, singles, word[many], self.context[many], self.n[many], totals.tables[:, self.context[many]], totals):
            self.tables.append(np.ones(len(self.n), np.int64))
            self.tables[-1][many] = t
            self.parents.append((customers, above))

    def probability(self, word: np.ndarray, context: np.ndarray) -> np.ndarray:
        """Averaged predictive probability of words (indices; -1: unknown) in contexts."""
        pairs = self.word * self.totals.contexts + self.context
        wanted = word * self.totals.contexts + context
        at = np.minimum(np.searchsorted(pairs, wanted), max(len(pairs) - 1, 0))
        hit = (pairs[at] == wanted) if len(pairs) else np.zeros(len(word), bool)
        total = np.zeros(len(word))
        for s, t in enumerate(self.tables):
            p = self.totals.in_parent(s, *self.parents[s])
            parent = np.where(word >= 0, p[word] if len(p) else 0.0, self.totals.unknown(s))
            n, own = (np.where(hit, x[at] if len(pairs) else 0, 0) for x in (self.n, t))
            total += self.totals.in_context(s, context, n, own, parent)
        return total / SAMPLES


class _Index(dict):
    def __missing__(self, key: bytes) -> int:
        self[key] = value = len(self)
        return value


class Group:
    """Tokens of a group of rows: index of word, context, and row; key: hashes of words."""

    def __init__(self, texts: list[str | None], contexts: int):
        index, tokens, self.sizes = _Index(), [], []
        for text in texts:
            words = (text or "").encode().lower().split()
            words.append(END)
            tokens.append(np.fromiter(map(index.__getitem__, words), np.int32, len(words)))
            self.sizes.append(len(words))
        self.token = np.concatenate(tokens) if tokens else np.zeros(0, np.int32)
        hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in index], np.uint64)
        self.key = hashes.view(np.int64)
        kind = ((hashes >> np.uint64(20)) % np.uint64(contexts - 1)).astype(np.int64) + 1
        self.row = np.repeat(np.arange(len(texts)), self.sizes)
        self.context = np.zeros(len(self.token), np.int64)
        if len(self.token):
            self.context[1:] = kind[self.token[:-1]]
            self.context[np.cumsum([0, *self.sizes[:-1]])] = 0


def _runs(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.zeros(0, np.int64)


def _batched(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The rows in batches of at least rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def packed(*arrays: np.ndarray) -> bytes:
    """Whole numbers of at least 0, each array in as few bytes an item as its largest needs; first bytes of all items, then second ones. Hashes stay as they are, others are deflated."""
    out = []
    for x in arrays:
        most = int(x.max()) if len(x) else 0
        width = next(w for w in (1, 2, 4, 8) if most < 1 << 8 * w)
        data = np.ascontiguousarray(x.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T).tobytes()
        if width < 8:
            data = zlib.compress(data, 1)
        out += [np.array([len(x) << 4 | width, len(data)], np.int64).tobytes(), data]
    return b"".join(out)


def unpacked(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        head, size = np.frombuffer(data, np.int64, 2, at).tolist()
        width, own = head & 15, data[at + 16 : at + 16 + size]
        planes = np.frombuffer(zlib.decompress(own) if width < 8 else own, np.uint8).reshape(width, head >> 4)
        out.append(np.ascontiguousarray(planes.T).view(f"<u{width}").reshape(-1))
        at += 16 + size
    return out


def steps(x: np.ndarray) -> np.ndarray:
    """Differences of neighbours, as numbers of at least 0."""
    d = np.diff(x.astype(np.int64), prepend=0)
    return np.where(d < 0, -2 * d - 1, 2 * d)


def stepped(d: np.ndarray) -> np.ndarray:
    d = d.astype(np.int64)
    return np.cumsum(d >> 1 ^ -(d & 1))


def bucket_of(x: np.ndarray, bits: int) -> np.ndarray:
    return (x >> np.uint64(64 - bits)).astype(np.int64)


def context_number(key: np.ndarray) -> np.ndarray:
    """What draws know a context by."""
    return np.where(key == START, 0, (key >> np.uint64(20)) % np.uint64(CONTEXTS - 1) + np.uint64(1)).astype(np.int64)


class Asked:
    """Distinct words and pairs of a group of rows, in the order in which buckets hear and answer.

    Words: key and home, by home. Pairs: word u (its place; the number of words at the start of a text) followed by w, by bucket, those of dealt contexts
    behind the others; size: tokens of each pair, row: their rows.
    """

    def __init__(self, texts: list[str | None], dealt: np.ndarray, bits: int):
        g = Group(texts, CONTEXTS)
        del g.context, g.row
        self.sizes, key = g.sizes, g.key.view(np.uint64)
        home = bucket_of(key, bits)
        order = np.argsort(key)  # by bucket, too
        self.key, self.home, place = key[order], home[order], np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        code = place[g.token]
        del g.token
        before = np.concatenate((code[:1], code[:-1]))
        before[np.cumsum([0, *g.sizes[:-1]])] = len(key)
        before *= len(key)
        code += before
        del before
        order = np.argsort(code, kind="stable").astype(np.int32)
        code = code[order]
        first = _runs(code)
        size, code = np.diff(np.append(first, len(order))), code[first]
        u, w = code // len(key), code % len(key)
        self.context = np.append(self.key, np.uint64(START))
        at = np.minimum(np.searchsorted(dealt, self.context), len(dealt) - 1)
        self.dealt_at = np.where(dealt[at] == self.context, at, -1)
        parts = self.dealt_at[u] >= 0
        bucket = np.append(self.home, 0)[u]
        bucket[parts] = bucket_of(self.context[u[parts]] * np.uint64(0xBF58476D1CE4E5B9) ^ self.key[w[parts]], bits)
        by = np.argsort(bucket * 2 + parts, kind="stable")
        self.u, self.w, self.size, self.bucket, self.parts = u[by], w[by], size[by], bucket[by], parts[by]
        at = np.repeat((first[by] - np.cumsum(self.size) + self.size).astype(np.int32), self.size)
        at += np.arange(len(order), dtype=np.int32)
        self.row = np.repeat(np.arange(len(texts), dtype=np.uint16), g.sizes)[order[at]]

    def number(self, number: int) -> int:
        """A name of the group that tells whether the same rows came again."""
        return xxhash.xxh3_64_intdigest(self.key.tobytes() + self.row.tobytes(), number & 0xFFFFFFFFFFFFFFFF) >> 1

    def blobs(self, train: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """(bucket, keys of words and of dealt contexts, how many pairs each has, training tokens of words, w and training tokens of pairs)."""
        n = np.add.reduceat(train[self.row].astype(np.int64), np.cumsum(self.size) - self.size)
        words = np.bincount(self.w, n, len(self.key)).astype(np.int64)
        for b in np.union1d(self.home, self.bucket).tolist():
            a, z = np.searchsorted(self.home, (b, b + 1))
            p, q = np.searchsorted(self.bucket, (b, b + 1))
            m = p + int((~self.parts[p:q]).sum())
            of = self.u[m:q]
            first = _runs(of)
            counts = np.concatenate((np.bincount(self.u[p:m] - a, minlength=z - a), np.diff(np.append(first, len(of)))))
            yield b, packed(self.key[a:z], self.context[of[first]], counts, words[a:z], self.key[self.w[p:q]], n[p:q])


def groups(batches: Iterator[pa.RecordBatch], dealt: np.ndarray, bits: int) -> Iterator[tuple[int, list[dict], Asked]]:
    number = TaskContext.get().partitionId() << 32
    for whole in chunks(batches, GROUP_BYTES):
        for k in range(0, len(whole), GROUP_ROWS):
            rows = whole[k : k + GROUP_ROWS]
            asked = Asked([r["text"] for r in rows], dealt, bits)
            yield asked.number(number), rows, asked
            number += 1


def look(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Words that have over one in FREQUENT tokens of the rows looked at, at most FREQUENT of them, with the start and the end; and bits of the number of buckets. Only where rows go depends on them."""

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in chunks(batches, GROUP_BYTES):
            g = Group([r["text"] for r in rows], CONTEXTS)
            n = np.bincount(g.token, minlength=len(g.key))
            often = n * FREQUENT > len(g.token)
            key, times = np.append(g.key[often], 0), np.append(n[often], len(g.token))  # the start stands for all tokens
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(times.astype(np.int64))], names=["word", "n"])

    looked = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(LOOK)) == 0).select("text").mapInArrow(seen, "word bigint, n bigint")
    found = looked.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(FREQUENT + 1).collect()
    tokens = max((r["n"] for r in found), default=0)
    end = np.array([xxhash.xxh3_64_intdigest(END)], np.uint64)
    dealt = np.array([r["word"] for r in found if r["n"] * FREQUENT > tokens], np.int64).view(np.uint64)
    return np.unique(np.concatenate((dealt, end, np.array([START], np.uint64)))), max(5, (tokens * LOOK // BUCKET_TOKENS).bit_length())


#: What buckets tell, by kind: 0 words of several tokens and dealt ones (hashes, tokens); 1 pairs that repeat, from their bucket src to their word's (hashes of context and word, customers, those of the
#: context, 0 if it is dealt); 2 numbers of a bucket (words, tokens, words that occur once and twice); 3 (pairs that do, words that occur once and aren't told);
#: 4 of a bucket's pairs that repeat what sums by context need; 5 what groups asked; 6 a dealt word (hash, tokens); 7 customers less tables of pairs, from the word's bucket src back, in order;
#: 8 words' customers and tables in the parent; 9 sums of these; 10 customers less tables of pairs' contexts, from the pairs' bucket src to the word's; 11 those of a dealt context (hash); 12 worth of concentration src.
TOLD = "kind int, bucket int, src int, v1 bigint, v2 bigint, v3 bigint, v4 bigint, v5 bigint, v6 bigint, worth double, blob binary"


def _told(kind: int, bucket: int = 0, src: int = 0, values: tuple = (), worth: float = 0.0, blob: bytes | None = None) -> list:
    return [kind, bucket, src, *map(int, values), *[0] * (6 - len(values)), worth, blob]


def _table(rows: list[list]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "binary": pa.binary()}
    names, types = zip(*(c.split() for c in TOLD.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(x, kinds[t]) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=list(names))


def _buckets(batches: Iterator[pa.RecordBatch], by: str = "bucket") -> Iterator[tuple[int, list[dict]]]:
    """Rows that follow each other with one bucket."""
    bucket, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row[by] != bucket and held:
                yield bucket, held
                held = []
            bucket = row[by]
            held.append(row)
    if held:
        yield bucket, held


def _by_bucket(rows: DataFrame, fn) -> DataFrame:
    """Messages that fn makes of each bucket's, which come by kind and source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, held in _buckets(batches):
            out = fn(bucket, held)
            for k in range(0, len(out), 256):
                yield _table(out[k : k + 256])

    return rows.select("kind", "bucket", "src", "blob").repartition("bucket").sortWithinPartitions("bucket", "kind", "src").mapInArrow(run, TOLD)


def _signed(key: np.ndarray) -> list[int]:
    return key.view(np.int64).tolist()


def _parts(place: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Of each number in place where it stands, ascending."""
    order = np.argsort(place, kind="stable")
    first = _runs(place[order])
    for k, own in zip(place[order[first]].tolist(), np.split(order, first[1:]), strict=False):
        yield k, own


def _met(asked: DataFrame, dealt: np.ndarray, bits: int) -> DataFrame:
    """Counts of words and pairs from what all groups say, and where each finds them (kinds 0 to 6)."""

    def settle(bucket: int, said: list[dict]) -> list[list]:
        rows = [unpacked(r["blob"]) for r in said]
        key, at = np.unique(np.concatenate([r[0] for r in rows]).astype(np.uint64), return_inverse=True)
        parts, part_at = np.unique(np.concatenate([r[1] for r in rows]).astype(np.uint64), return_inverse=True)
        words = np.bincount(at, np.concatenate([r[3] for r in rows]), len(key)).astype(np.int64)
        at, part_at = (np.split(x, np.cumsum([len(r[k]) for r in rows])[:-1]) for k, x in enumerate((at, part_at)))
        u = np.concatenate([np.repeat(np.concatenate((x, y + len(key))), r[2]) for x, y, r in zip(at, part_at, rows, strict=True)])
        w = np.concatenate([r[4] for r in rows]).astype(np.uint64)
        n = np.concatenate([r[5] for r in rows]).astype(np.int64)
        order = np.lexsort((w, u))
        u, w, n = u[order], w[order], n[order]
        first = np.flatnonzero(np.concatenate(([True], (u[1:] != u[:-1]) | (w[1:] != w[:-1])))) if len(u) else np.zeros(0, np.int64)
        total = np.add.reduceat(n, first) if len(first) else n
        many = total > 1
        told = np.where(many, np.cumsum(many) + 1, total)  # 0 and 1: that many; k + 2: the bucket's pair k
        back = np.empty(len(order), np.int64)
        back[order] = np.repeat(told, np.diff(np.append(first, len(order))))
        u, w, times = u[first][many], w[first][many], total[many]
        to, often = bucket_of(w, bits), np.flatnonzero((words > 1) | (words > 0) & np.isin(key, dealt))
        blob = [key, words, often, u, times, to, np.array([r["grp"] for r in said], np.uint64)]
        for x, own in zip(at, np.split(back, np.cumsum([len(r[4]) for r in rows])[:-1]), strict=True):
            blob += [steps(x), np.minimum(own, 2), steps(own[own > 1] - 2)]
        out = [_told(0, bucket, blob=packed(key[often], words[often]))] if len(often) else []
        names, c = np.append(key, parts)[u], np.append(words, np.zeros(len(parts), np.int64))[u]
        out += [_told(1, k, bucket, blob=packed(names[own], w[own], times[own], c[own])) for k, own in _parts(to)]
        out += [_told(2, bucket, values=((words > 0).sum(), words.sum(), (words == 1).sum(), (words == 2).sum()))]
        out += [_told(3, bucket, values=((total == 1).sum(), (total == 2).sum(), (words > 0).sum() - len(often)))]
        out += [_told(4, bucket, blob=packed(words * ~np.isin(key, dealt), parts, u, to)), _told(5, bucket, blob=packed(*blob))]
        some = np.flatnonzero(np.isin(key, dealt))
        return out + [_told(6, bucket, values=x) for x in zip(_signed(key[some]), words[some].tolist(), strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, said in _buckets(batches):
            out = settle(bucket, said)
            for k in range(0, len(out), 256):
                yield _table(out[k : k + 256])

    return asked.repartition("bucket").sortWithinPartitions("bucket", "grp").mapInArrow(run, TOLD)


def _seated(met: DataFrame, replies: DataFrame | None, rates: Rates, contexts: Contexts) -> DataFrame:
    """The sweeps of all words (kinds 7 to 9); replies: of the round before, None in the first."""

    def settle(bucket: int, rows: list[dict]) -> list[list]:
        blobs = {kind: [unpacked(r["blob"]) for r in rows if r["kind"] == kind] for kind in (0, 1, 10)}
        ((key, n),) = blobs[0]
        u, w, times, c = (np.concatenate([b[k] for b in blobs[1]]) if blobs[1] else np.zeros(0, np.uint64) for k in range(4))
        u, w, times, c = u.astype(np.uint64), w.astype(np.uint64), times.astype(np.int64), c.astype(np.float64)
        own = np.tile(0.5 * c, (SAMPLES, 1))
        if again and len(u):
            own = c - np.stack([np.concatenate([b[s] for b in blobs[10]]) for s in range(SAMPLES)])
        parts = np.flatnonzero(c == 0)
        own[:, parts] = contexts.tables[:, np.searchsorted(contexts.key, u[parts])]
        key = key.astype(np.uint64)
        of = np.searchsorted(key, w)
        singles = n.astype(np.int64) - np.bincount(of, times, len(key)).astype(np.int64)
        got = list(sweeps(key.view(np.int64), singles, of, context_number(u), times, own, rates))
        customers, above = [x[1].astype(np.int64) for x in got], [x[2].astype(np.int64) for x in got]
        out = [_told(9, bucket, values=[x.sum() for x in customers + above]), _told(8, bucket, blob=packed(*customers, *above))]
        ends = np.cumsum([0, *(len(b[0]) for b in blobs[1])]).tolist()
        sources = [r["src"] for r in rows if r["kind"] == 1]
        return out + [_told(7, src, bucket, blob=packed(*((times - x[0])[a:z] for x in got))) for src, a, z in zip(sources, ends[:-1], ends[1:], strict=True)]

    rows, again = met.where("kind in (0, 1)"), replies is not None
    return _by_bucket(rows.unionAll(replies.where("kind = 10")) if again else rows, settle)


def _less(rows: list[dict], to: np.ndarray) -> np.ndarray:
    """Customers less tables of a bucket's pairs, by sample, from the words' buckets; to: which each pair went to."""
    x, at = np.zeros((SAMPLES, len(to)), np.int64), dict(_parts(to))
    for r in rows:
        if r["kind"] == 7:
            x[:, at[r["src"]]] = unpacked(r["blob"])
    return x


def _summed(met: DataFrame, seated: DataFrame, discount: float, last: bool) -> DataFrame:
    """Sums by context (kinds 10 to 12; after the last round no replies, kind 10)."""

    def settle(bucket: int, rows: list[dict]) -> list[list]:
        c, parts, u, to = unpacked(next(r["blob"] for r in rows if r["kind"] == 4))
        c, u, x = c.astype(np.int64), u.astype(np.int64), _less(rows, to.astype(np.int64))
        less = np.stack([np.bincount(u, v, len(c) + len(parts)).astype(np.int64) for v in x])
        out = [_told(11, bucket, values=v) for v in zip(_signed(parts.astype(np.uint64)), *less[:, len(c) :].tolist(), strict=True)]
        less[:, len(c) :] = 0
        if not last:
            out += [_told(10, k, bucket, blob=packed(*less[:, u[own]])) for k, own in _parts(to.astype(np.int64))]
        some = np.flatnonzero(c > 0)
        alike, times = np.unique(np.stack((c[some], less[:, some].sum(axis=0))), axis=1, return_counts=True)
        customers = alike[0].astype(np.float64)
        return out + [_told(12, src=k, worth=v) for k, v in enumerate(worth(discount, customers, customers - alike[1] / SAMPLES, times).tolist())]

    return _by_bucket(met.where("kind = 4").unionAll(seated.where("kind = 7")), settle)


class Contexts:
    """Dealt contexts (FREQUENT and two at most): keys, customers, and tables by sample."""

    def __init__(self, key: np.ndarray, customers: np.ndarray, less: dict[int, list[int]] | None = None):
        self.key, self.customers = key, customers.astype(np.float64)
        self.tables = np.tile(0.5 * self.customers, (SAMPLES, 1))
        if less is not None:
            self.tables = self.customers - np.array([less.get(k, [0] * SAMPLES) for k in key.view(np.int64).tolist()], np.float64).T


def worth(discount: float, customers: np.ndarray, tables: np.ndarray, times: np.ndarray) -> np.ndarray:
    """For each concentration tried, how probable the seating of restaurants with these customers and tables is (its logarithm)."""
    up = lambda x: np.fromiter(map(math.lgamma, x.tolist()), np.float64, len(x))
    return np.array([(times * (up(a / discount + tables) - math.lgamma(a / discount + 1) - up(a + customers) + math.lgamma(a + 1))).sum() for a in STRENGTHS])


def _round(seated: DataFrame, summed: DataFrame, rates: Rates, contexts: Contexts, single: int) -> tuple[Rates, Contexts]:
    """Rates and contexts that a round of sweeps comes to. single: words that occur once and aren't told."""
    sums = seated.where("kind = 9").agg(*(F.coalesce(F.sum(f"v{k}"), F.lit(0)) for k in range(1, 7))).first()
    every, parent = (np.array(x, np.float64) + single for x in (sums[:SAMPLES], sums[SAMPLES:]))
    of_dealt = summed.where("kind = 11").groupBy("v1").agg(*(F.sum(f"v{k}").alias(f"v{k}") for k in (2, 3, 4))).collect()
    now = Contexts(contexts.key, contexts.customers, {r["v1"]: [r["v2"], r["v3"], r["v4"]] for r in of_dealt})
    some = now.customers > 0
    total = worth(rates.discount, now.customers[some], now.tables.mean(axis=0)[some], np.ones(int(some.sum())))
    for r in summed.where("kind = 12").groupBy("src").agg(F.sum("worth").alias("worth")).collect():
        total[r["src"]] += r["worth"]
    strength = STRENGTHS[int(np.argmax(total))] if rates.tokens else STRENGTH
    return Rates(rates.words, rates.tokens, (rates.discount, rates.parent_discount), every, parent, strength, best_strength(rates.parent_discount, every, parent)), now


def _freed(spark) -> None:
    """Shuffle files of steps whose results are stored may go: Spark's cleaner removes those that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


ANSWER = "grp bigint, bucket int, blob binary"


def _answers(met: DataFrame, seated: DataFrame) -> DataFrame:
    """To each group, in the order in which it asked: of words n, n less customers, tables in the parent and n less tables as a context; of pairs 0, 1 or 2 for several, and of the latter n and n less tables."""

    def settle(rows: list[dict]) -> Iterator[tuple[int, bytes]]:
        key, n, often, u, times, to, number, *rest = unpacked(next(r["blob"] for r in rows if r["kind"] == 5))
        n, times, x = n.astype(np.int64), times.astype(np.int64), _less(rows, to.astype(np.int64))
        customers, above = np.tile(n, (SAMPLES, 1)), np.tile(np.minimum(n, 1), (SAMPLES, 1))
        for r in rows:
            if r["kind"] == 8:
                got = unpacked(r["blob"])
                customers[:, often], above[:, often] = got[:SAMPLES], got[SAMPLES:]
        less = [np.bincount(u, v, len(key))[: len(key)].astype(np.int64) for v in x]
        planes = [n, *(n - customers), *above, *less]
        for k, g in enumerate(_signed(number.astype(np.uint64))):
            at, kind, own = stepped(rest[3 * k]), rest[3 * k + 1], stepped(rest[3 * k + 2])
            yield g, packed(*(p[at] for p in planes), kind, times[own], *(v[own] for v in x))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _buckets(batches):
            for g, blob in settle(rows):
                yield pa.RecordBatch.from_arrays([pa.array([g], pa.int64()), pa.array([bucket], pa.int32()), pa.array([blob], pa.binary())], names=["grp", "bucket", "blob"])

    rows = met.where("kind = 5").unionAll(seated.where("kind in (7, 8)")).select("kind", "bucket", "src", "blob")
    return rows.repartition("bucket").sortWithinPartitions("bucket", "kind", "src").mapInArrow(run, ANSWER)


class Sums:
    """What a task's words contribute to documents, only of documents that have some of them: at most as much as their places."""

    #: Entries held.
    MOST = 1_500_000

    def __init__(self):
        self.index, self.groups, self.parts, self.size = {}, [], [], 0

    def add(self, group: np.ndarray, size: np.ndarray, doc: np.ndarray, *values: np.ndarray) -> None:
        """values at documents doc; of each of the groups size of them stand in a row."""
        names, back = np.unique(group, return_inverse=True)
        for g in names.tolist():
            if g not in self.index:
                self.index[g] = len(self.groups)
                self.groups.append(g)
        at = np.array([self.index[g] for g in names.tolist()], np.int64)
        self.parts.append(self.summed((np.repeat(at[back], size) << 16) + doc, values))
        self.size += len(self.parts[-1][0])

    @staticmethod
    def summed(key: np.ndarray, values) -> tuple[np.ndarray, list[np.ndarray]]:
        order = np.argsort(key, kind="stable")
        first = _runs(key[order])
        return key[order[first]], [np.add.reduceat(v[order], first) if len(first) else v for v in values]

    def full(self) -> bool:
        """Whether it's time to tell: more than half of MOST is left when entries of a document are put together."""
        if self.size <= self.MOST:
            return False
        self.parts = [self.summed(np.concatenate([k for k, _ in self.parts]), [np.concatenate(x) for x in zip(*(v for _, v in self.parts), strict=True)])]
        self.size = len(self.parts[0][0])
        return 2 * self.size > self.MOST

    def told(self) -> pa.RecordBatch:
        """(grp, kind, sums): of each group the number of a document less that of the one before, then the values, all documents in a row."""
        out: list[bytes] = []
        groups = []
        if self.parts:
            key, values = self.summed(np.concatenate([k for k, _ in self.parts]), [np.concatenate(x) for x in zip(*(v for _, v in self.parts), strict=True)])
            cuts = _runs(key >> 16)
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(key)], strict=False):
                groups.append(self.groups[int(key[a]) >> 16])
                out.append(b"".join([np.diff(key[a:b] & 0xFFFF, prepend=0).astype("<u2").tobytes(), *(v[a:b].astype(t).tobytes() for v, t in zip(values, SUMS.values(), strict=True))]))
        self.__init__()
        return pa.RecordBatch.from_arrays([pa.array(groups, pa.int64()), pa.array([1] * len(groups), pa.int32()), pa.array(out, pa.binary())], names=["grp", "kind", "sums"])

    @staticmethod
    def into(doc: np.ndarray, data: bytes) -> None:
        """Adds what told says of a group to its documents."""
        n = len(data) // (2 + sum(t.itemsize for t in SUMS.values()))
        at, offset = np.cumsum(np.frombuffer(data, "<u2", n).astype(np.int64)), 2 * n
        for c, t in SUMS.items():
            doc[c][at] += np.frombuffer(data, t, n, offset).astype(doc[c].dtype)
            offset += n * t.itemsize


def steady(docs: DataFrame) -> DataFrame:
    """docs whose rows come in the same groups whenever they are read: files as they are, else a stored copy."""
    plan = docs._jdf.queryExecution().optimizedPlan().toString()
    same = all(line.strip(" +-:").startswith(("Project", "Filter", "Relation")) for line in plan.splitlines() if line.strip())
    return docs if same else stored(docs, "docs")


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of docs."""
    spark = docs.sparkSession
    ship(spark)
    docs = steady(docs.select("doc_id", "text"))
    dealt, bits = look(docs)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, rows, asked in groups(batches, dealt, bits):
            said = list(asked.blobs(np.array([not held_out(r["doc_id"]) for r in rows])))
            for k in range(0, len(said), 64):
                buckets, blobs = zip(*said[k : k + 64], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([number] * len(buckets), pa.int64()), pa.array(buckets, pa.int32()), pa.array(blobs, pa.binary())], names=["grp", "bucket", "blob"])

    met = stored(_met(docs.mapInArrow(ask, ANSWER), dealt, bits), "met")
    _freed(spark)
    numbers = {r["kind"]: r for r in met.where("kind in (2, 3)").groupBy("kind").agg(*(F.sum(c).alias(c) for c in ("v1", "v2", "v3", "v4"))).collect()}
    words, tokens, once, twice = (numbers[2][c] for c in ("v1", "v2", "v3", "v4")) if numbers else (0, 0, 0, 0)
    pairs_once, pairs_twice, single = (numbers[3][c] for c in ("v1", "v2", "v3")) if numbers else (0, 0, 0)
    rates = Rates(words, tokens, (discount_of(pairs_once, pairs_twice), discount_of(once, twice)), np.full(SAMPLES, 0.5 * tokens), np.full(SAMPLES, 0.25 * tokens))
    found = {r["v1"]: r["v2"] for r in met.where("kind = 6").collect()}  # dealt ones
    end = int(np.array([xxhash.xxh3_64_intdigest(END)], np.uint64).view(np.int64)[0])
    found[START] = found.pop(end, 0)  # as many starts as ends; an end is no context
    contexts = Contexts(dealt, np.array([found.get(k, 0) for k in dealt.view(np.int64).tolist()]))

    replies = None
    for last in (False, True):
        seated = stored(_seated(met, replies, rates, contexts), "seated")
        _freed(spark)
        replies = stored(_summed(met, seated, rates.discount, last), "summed")
        rates, contexts = _round(seated, replies, rates, contexts, single)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, rows, asked in groups(batches, dealt, bits):
            ids = np.array([r["doc_id"] or 0 for r in rows], np.int64).view(np.uint64)
            dealt_at = np.flatnonzero(asked.dealt_at >= 0)
            blob = packed(ids, np.array([r["doc_id"] is None for r in rows]), np.array(asked.sizes), dealt_at, asked.dealt_at[dealt_at], steps(asked.u), asked.size, asked.row, asked.w)
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([-1], pa.int32()), pa.array([blob], pa.binary())], names=["grp", "bucket", "blob"])

    def settle(data: bytes, answers: list[bytes]) -> pa.RecordBatch:
        ids, null, sizes, dealt_at, which, u, size, row, w = unpacked(data)
        ids, row, size = ids.astype(np.uint64).view(np.int64), row.astype(np.int64), size.astype(np.int64)
        u, w = stepped(u), w.astype(np.int64)
        got = [np.concatenate(x).astype(np.int64) for x in zip(*map(unpacked, answers), strict=True)]
        n, kind = got[0], got[10]
        assert len(kind) == len(w), "rows came in other groups than before"
        customers = np.append(n, 0).astype(np.float64)
        customers[dealt_at] = contexts.customers[which]
        times, many, out = np.minimum(kind, 1), np.flatnonzero(kind == 2), np.zeros(len(w))
        times[many] = got[11]
        for s in range(SAMPLES):
            p = np.where(n > 0, rates.in_parent(s, n - got[1 + s], got[4 + s]), rates.unknown(s))
            own = np.append(n - got[7 + s], 0).astype(np.float64)
            own[dealt_at] = contexts.tables[s][which]
            t = np.minimum(kind, 1)
            t[many] = got[11] - got[12 + s]
            out += rates.mixed(times, t, p[w], customers[u], own[u])
        summed = lambda x: np.bincount(row, np.repeat(x, size), len(ids))
        tokens, base = sizes.astype(np.int64), summed(np.log10(n + 1.0)[w])
        ids = [None if z else int(i) for i, z in zip(ids, null, strict=True)]
        columns = [pa.array(ids, pa.int64()), pa.array([held_out(i) for i in ids]), pa.array(tokens), pa.array(summed((n > 0)[w]).astype(np.int64)), pa.array(np.full(len(ids), rates.tokens, np.int64)), pa.array(base - tokens * np.log10(rates.tokens + rates.words + 1.0)), pa.array(summed(np.log10(out / SAMPLES)))]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = None, []
        for batch in batches:
            for g, _, data in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if g != number and held:
                    yield settle(held[0], held[1:])
                    held = []
                number = g
                held.append(data)
        if held:
            yield settle(held[0], held[1:])

    out = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return docs.mapInArrow(places, ANSWER).union(_answers(met, seated)).repartition("grp").sortWithinPartitions("grp", "bucket").mapInArrow(finish, out)


def perplexity(scores: DataFrame, held: bool = True) -> DataFrame:
    """One row: tokens, perplexity of the model and of the unigram base over held-out (or training) documents."""
    per_token = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scores.where(F.col("held_out") == held).agg(F.sum("n_tokens").alias("n_tokens"), per_token("score").alias("perplexity"), per_token("base_score").alias("base_perplexity"))
