"""Resampling pair by pair: bootstrap, sign flips, jackknife and permutation over edit triples.

A triple is (id, ev, eb, len): edits of a variant and of its baseline, and reference characters, of one paragraph.
Bootstrap draws give each pair a Poisson weight of mean 1 from a hash of seed, draw and id; given its size such a draw
is a sample of pairs with replacement. Sign flips read a bit of such a hash. Nothing is joined or collected for a draw:
a pair makes its weights where it is, in Arrow batches, and a task adds them up as a product of matrices: `draws` rows a
group and task are shuffled, and no row is made for a pair and draw.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from hashlib import md5
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

#: Below which number of 32 bits a Poisson draw of mean 1 is 0, 1, 2, ...
LIMITS = tuple(int(2**32 * sum(math.exp(-1) / math.factorial(k) for k in range(n + 1))) for n in range(10))


#: Numbers in a matrix of weights at once, and groups whose sums a task holds.
CELLS, GROUPS = 2_000_000, 2_000


def poisson(digests: np.ndarray) -> np.ndarray:
    """(pairs, lots, 16) bytes as weights of four draws a lot."""
    u = digests.view(">u4").reshape(len(digests), -1).astype(np.int64)
    return np.searchsorted(np.array(LIMITS), u, side="right").astype(np.float64)


def signs(digests: np.ndarray) -> np.ndarray:
    """The same as 1 or -1 of 32 draws a lot: hexadecimal digits that are even or odd."""
    digits = np.stack([digests >> 4, digests], -1).reshape(len(digests), -1) & 1
    return 1.0 - 2.0 * digits


def _drawn(rows: DataFrame, by: tuple[str, ...], values: tuple[str, ...], seed: str, key: str, draws: int, per: int, weigh: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(by, draw, values, n): sums of weighted values and of weights, by group and draw; draw -1 has them without weights. A digest of seed, lot and key gives per weights."""
    lots, columns = -(-draws // per), [*values, "n"]
    heads = [f"{seed}|{g}" for g in range(lots)]
    chunk = max(1, CELLS // (lots * per))

    def weights(keys: np.ndarray) -> np.ndarray:
        tails = ["" if k is None else f"|{k}" for k in keys]
        digests = b"".join(md5((h + t).encode()).digest() for t in tails for h in heads)
        return weigh(np.frombuffer(digests, np.uint8).reshape(len(keys), lots, 16))[:, :draws]

    def told(sums: dict[tuple, np.ndarray]) -> pd.DataFrame:
        frames = []
        for group, total in sums.items():
            frame = pd.DataFrame(total.T, columns=columns)
            frame.insert(0, "draw", np.arange(-1, draws))
            for k, c in enumerate(by):
                frame.insert(k, c, pd.Series([group[k]] * (draws + 1), dtype=object))
            frames.append(frame)
        return pd.concat(frames, ignore_index=True)

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            keys = batch["_key"].to_numpy(object)
            groups = list(zip(*(batch[c].astype(object).where(batch[c].notna(), None) for c in by), strict=True)) if by else [()] * len(batch)
            cells = np.column_stack([*(batch[c].to_numpy(np.float64) for c in values), np.ones(len(batch))])
            places: dict = {}
            codes = np.fromiter((places.setdefault(k, len(places)) for k in keys), np.int64, len(keys))
            order = np.argsort(codes, kind="stable")
            for low in range(0, len(places), chunk):
                own = order[np.searchsorted(codes[order], low) : np.searchsorted(codes[order], low + chunk)]
                w = weights(list(places)[low : low + chunk])
                names: dict[tuple, int] = {}
                of = np.fromiter((names.setdefault(groups[i], len(names)) for i in own), np.int64, len(own))
                dense = np.zeros((len(names), len(columns), len(w)))
                for k in range(len(columns)):
                    np.add.at(dense[:, k], (of, codes[own] - low), cells[own, k])
                got = dense.reshape(-1, len(w)) @ w
                whole = np.concatenate([dense.sum(-1, keepdims=True), got.reshape(len(names), len(columns), -1)], -1)
                for group, k in names.items():
                    add = np.rint(whole[k]).astype(np.int64)
                    sums[group] = sums[group] + add if group in sums else add
            if len(sums) > GROUPS:
                yield told(sums)
                sums = {}
        if sums:
            yield told(sums)

    fields = [rows.schema[c] for c in by] + [StructField(c, LongType()) for c in ("draw", *columns)]
    sent = rows.select(*by, F.col(key).cast("string").alias("_key"), *(F.col(c).cast("long").alias(c) for c in values))
    return sent.mapInPandas(summed, StructType(fields)).groupBy(*by, "draw").agg(*(F.sum(c).alias(c) for c in columns))


def _ratio(a: Column, n: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), n.cast("double")), F.lit(0.0))


def bootstrap(triples: DataFrame, *by: str, draws: int = 1000, seed: str = "42", key: str = "id") -> DataFrame:
    """(by, draw, cer_v, cer_b, delta) of pairs drawn with replacement; pairs without reference characters don't count."""
    sums = _drawn(triples.where("len > 0"), by, ("ev", "eb", "len"), seed, key, draws, 4, poisson).where("draw >= 0 and n > 0")
    cer_v, cer_b = _ratio(F.col("ev"), F.col("len")), _ratio(F.col("eb"), F.col("len"))
    return sums.select(*by, "draw", cer_v.alias("cer_v"), cer_b.alias("cer_b"), (cer_v - cer_b).alias("delta"))


def sign_flips(triples: DataFrame, *by: str, draws: int = 10_000, seed: str = "7", key: str = "id") -> DataFrame:
    """(by, n, delta, p, critical): two-sided test, one added above and below; critical is the null's absolute delta at place int(.95 draws)."""
    kept = triples.where("len > 0").select(*by, key, (F.col("ev") - F.col("eb")).alias("_d"), "len")
    counted = _drawn(kept, by, ("_d", "len"), seed, key, draws, 32, signs)
    own = Window.partitionBy(*by)
    first = lambda c: F.max(F.when(F.col("draw") == -1, F.col(c))).over(own)
    rows = counted.select(*by, "draw", first("n").alias("n"), "_d", first("_d").alias("_o"), first("len").alias("_len"))
    null = F.when(F.col("draw") >= 0, F.abs(F.col("_d")))
    listed = rows.groupBy(*by).agg(
        F.max("n").alias("n"), F.first("_o").alias("_o"), F.first("_len").alias("_len"), F.sum(F.when((F.col("draw") >= 0) & (F.abs("_d") >= F.abs("_o")), 1).otherwise(0)).alias("_x"), F.sort_array(F.collect_list(null)).alias("_null")
    )
    size = F.size("_null")
    return listed.select(
        *by, "n", _ratio(F.col("_o"), F.col("_len")).alias("delta"), ((F.col("_x") + 1) / (size + 1)).alias("p"), _ratio(F.get("_null", F.floor(size * 0.95).cast("int")), F.col("_len")).alias("critical")
    )


def sign_p(drawn: DataFrame, observed: DataFrame, *by: str) -> DataFrame:
    """(by, delta, p): share of draws whose delta has not the observed one's sign, one added above and below."""
    joined = drawn.select(*by, F.col("delta").alias("_x")).join(observed.select(*by, "delta"), list(by))
    return joined.groupBy(*by).agg(F.first("delta").alias("delta"), ((F.sum(F.when(F.col("_x") * F.col("delta") <= 0, 1).otherwise(0)) + 1) / (F.count(F.lit(1)) + 1)).alias("p"))


def observed(triples: DataFrame, *by: str) -> DataFrame:
    """(by, n, cer_v, cer_b, delta) of all pairs with reference characters."""
    sums = triples.where("len > 0").groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(c) for c in ("ev", "eb", "len")))
    cer_v, cer_b = _ratio(F.col("ev"), F.col("len")), _ratio(F.col("eb"), F.col("len"))
    return sums.select(*by, "n", cer_v.alias("cer_v"), cer_b.alias("cer_b"), (cer_v - cer_b).alias("delta"))


def bca(triples: DataFrame, draws: int = 2000, seed: str = "42", level: float = 0.95) -> tuple[float, float, float]:
    """(delta, lo, hi) by the bias-corrected and accelerated rule: draws of pairs, and the jackknife that leaves out one pair at a time, summed where the pairs are."""
    rows = triples.where("len > 0").select("id", "ev", "eb", "len").persist(StorageLevel.DISK_ONLY)  # four passes
    try:
        v, b, size, n = rows.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("ev", "eb", "len")), F.count(F.lit(1))).first()
        if not n:
            return 0.0, float("nan"), float("nan")
        seen = (v - b) / size
        left = _ratio(F.lit(v - b) - F.col("ev") + F.col("eb"), F.lit(size) - F.col("len"))
        mean = rows.agg(F.avg(left)).first()[0]
        two, three = rows.agg(F.sum(F.pow(F.lit(mean) - left, 2)), F.sum(F.pow(F.lit(mean) - left, 3))).first()
        drawn = sorted(r["delta"] for r in bootstrap(rows, draws=draws, seed=seed).select("delta").collect())  # `draws` numbers
    finally:
        rows.unpersist()
    a = three / (6 * two**1.5) if two else 0.0
    normal = NormalDist()
    z0 = normal.inv_cdf(min(max(sum(d < seen for d in drawn) / len(drawn), 1 / len(drawn)), 1 - 1 / len(drawn)))

    def at(q: float) -> float:
        z = z0 + normal.inv_cdf(q)
        k = normal.cdf(z0 + z / (1 - a * z)) * (len(drawn) - 1)
        low = int(k)
        return drawn[low] + (k - low) * (drawn[min(low + 1, len(drawn) - 1)] - drawn[low])

    return seen, at((1 - level) / 2), at((1 + level) / 2)


def shuffle_test(pairs: DataFrame, edits, draws: int = 1000, seed: str = "0", key: str = "id") -> DataFrame:
    """(observed, p, null_mean, null_min): rates when hypotheses are dealt to references anew, from rows (id, ref, hyp); p counts rates at most the observed one.

    edits(ref, hyp) gives a pair's edits. In each draw references are numbered by id and hypotheses by a hash; equal numbers meet, draws run side by side.
    """
    rows = pairs.where(F.length("ref") > 0)
    each = F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw")
    refs = rows.select(key, "ref", each).select("draw", "ref", F.row_number().over(Window.partitionBy("draw").orderBy(key)).alias("_at"))
    order = F.md5(F.concat_ws("|", F.lit(seed), F.col("draw").cast("string"), F.col(key).cast("string")))
    hyps = rows.select(key, "hyp", each).select("draw", "hyp", F.row_number().over(Window.partitionBy("draw").orderBy(order, key)).alias("_at"))
    null = refs.join(hyps, ["draw", "_at"]).groupBy("draw").agg((F.sum(edits(F.col("ref"), F.col("hyp"))) / F.sum(F.length("ref"))).alias("_c"))
    seen = rows.select(F.lit(-1).alias("draw"), "ref", "hyp").groupBy("draw").agg((F.sum(edits(F.col("ref"), F.col("hyp"))) / F.sum(F.length("ref"))).alias("_c"))
    both = seen.union(null).select("draw", "_c", F.max(F.when(F.col("draw") == -1, F.col("_c"))).over(Window.partitionBy()).alias("_o"))
    drawn = F.when(F.col("draw") >= 0, F.col("_c"))
    return both.agg(
        F.first("_o").alias("observed"), ((F.sum(F.when(drawn <= F.col("_o"), 1).otherwise(0)) + 1) / (F.count(drawn) + 1)).alias("p"), F.avg(drawn).alias("null_mean"), F.min(drawn).alias("null_min")
    )


def fold_summary(triples: DataFrame, k: int = 5, seed: str = "13", key: str = "id") -> DataFrame:
    """(mean, std): mean and sample deviation of the rates of k folds; folds are dealt by a hash of the id, so that an id is in one fold; folds without rows don't count."""
    fold = F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string"))), 1, 8), 16, 10).cast("long"), F.lit(k)).alias("fold")
    rates = triples.where("len > 0").groupBy(fold).agg(_ratio(F.sum("ev"), F.sum("len")).alias("c"))
    return rates.agg(F.avg("c").alias("mean"), F.coalesce(F.stddev_samp("c"), F.lit(0.0)).alias("std"))
