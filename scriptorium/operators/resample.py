"""Resampling of edit triples: bootstrap, sign flips, cross-validation, false-discovery control, verdicts.

A triple is (ed_a, ed_b, len): edits of two systems and reference characters of one paragraph. Draws come
from hashes of seed, draw and slot, so results don't depend on partitions. At any size the paragraphs are
first summed into at most BLOCKS blocks by a hash of their id; blocks are resampled. Each draw is then a
row that reads one array of at most BLOCKS structs: what is repeated is bounded, and draws run in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCKS = 256


def number(*parts: Column | str | int) -> Column:
    """A number below 2**32 from the MD5 of the parts."""
    text = F.concat_ws("|", *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def blocks(triples: DataFrame, *by: str, key: str = "id") -> DataFrame:
    """(by, block, ev, eb, len): sums of triples by group and block."""
    block = F.pmod(number("block", F.col(key)), F.lit(BLOCKS)).alias("block")
    return triples.groupBy(*by, block).agg(F.sum("ev").alias("ev"), F.sum("eb").alias("eb"), F.sum("len").alias("len"))


def _listed(summed: DataFrame, by: tuple[str, ...]) -> DataFrame:
    return summed.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("block", "ev", "eb", "len"))).alias("all"))


def _drawn(summed: DataFrame, by: tuple[str, ...], draws: int) -> DataFrame:
    return _listed(summed, by).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).repartition(*by, "draw")


def _ratio(a: Column, n: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), n.cast("double")), F.lit(0.0))


def bootstrap(summed: DataFrame, *by: str, draws: int = 1000, seed: str = "42") -> DataFrame:
    """(by, draw, cer_v, cer_b, delta): rates of both systems over blocks drawn with replacement."""
    n = F.size("all")
    picked = F.transform(F.sequence(F.lit(0), n - 1), lambda s: F.get("all", F.pmod(number(seed, F.col("draw"), s), n).cast("int")))
    zero = F.struct(*(F.lit(0).cast("long").alias(c) for c in ("ev", "eb", "len")))
    total = F.aggregate(picked, zero, lambda a, x: F.struct(*((a[c] + x[c]).alias(c) for c in ("ev", "eb", "len"))))
    rows = _drawn(summed, by, draws).select(*by, "draw", total.alias("t"))
    cer_v, cer_b = _ratio(F.col("t.ev"), F.col("t.len")), _ratio(F.col("t.eb"), F.col("t.len"))
    return rows.select(*by, "draw", cer_v.alias("cer_v"), cer_b.alias("cer_b"), (cer_v - cer_b).alias("delta"))


def interval(drawn: DataFrame, *by: str, value: str = "delta") -> DataFrame:
    """(by, lo, hi): linear 2.5 and 97.5 percentiles."""
    return drawn.groupBy(*by).agg(F.percentile(value, 0.025).alias("lo"), F.percentile(value, 0.975).alias("hi"))


def index_interval(drawn: DataFrame, *by: str, value: str = "delta") -> DataFrame:
    """(by, lo, hi) by the floor-index rule: places int(.025 n) and int(.975 n) in order."""
    listed = drawn.groupBy(*by).agg(F.sort_array(F.collect_list(value)).alias("x"))
    at = lambda q: F.get("x", F.floor(q * F.size("x")).cast("int"))
    return listed.select(*by, at(0.025).alias("lo"), at(0.975).alias("hi"))


def sign_flips(summed: DataFrame, *by: str, draws: int = 1000, seed: str = "7") -> DataFrame:
    """(by, delta, p): two-sided, with one added above and below: each block's systems change places by a hash's lowest bit."""
    zero = F.struct(F.lit(0).cast("long").alias("d"), F.lit(0).cast("long").alias("len"))
    flip = lambda x: F.when(F.pmod(number(seed, F.col("draw"), x.block), F.lit(2)) == 0, x.ev - x.eb).otherwise(x.eb - x.ev)
    total = F.aggregate("all", zero, lambda a, x: F.struct((a.d + flip(x)).alias("d"), (a["len"] + x["len"]).alias("len")))
    seen = F.aggregate("all", zero, lambda a, x: F.struct((a.d + x.ev - x.eb).alias("d"), (a["len"] + x["len"]).alias("len")))
    rows = _drawn(summed, by, draws).select(*by, total.alias("t"), seen.alias("o"))
    extreme = F.sum(F.when(F.abs(F.col("t.d")) >= F.abs(F.col("o.d")), 1).otherwise(0))
    observed = F.first(_ratio(F.col("o.d"), F.col("o.len")))
    return rows.groupBy(*by).agg(observed.alias("delta"), ((extreme + 1) / (F.count(F.lit(1)) + 1)).alias("p"))


def folds(triples: DataFrame, k: int = 5, seed: str = "13", key: str = "id") -> DataFrame:
    """(fold, n, cer): groups by a hash of the id, so all rows of an id are in one fold. Folds without rows don't show."""
    fold = F.pmod(number(seed, F.col(key)), F.lit(k)).alias("fold")
    return triples.groupBy(fold).agg(F.count(F.lit(1)).alias("n"), _ratio(F.sum("ev"), F.sum("len")).alias("cer"))


def benjamini_hochberg(tests: DataFrame, p: str = "p", order: str = "name", alpha: float = 0.05) -> DataFrame:
    """tests with rank and significant: all up to the largest rank whose p is at most rank/m * alpha. One row a test: a handful."""
    by = Window.orderBy(p, order)
    everything = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = tests.withColumn("rank", F.row_number().over(by)).withColumn("_m", F.count(F.lit(1)).over(everything))
    last = F.max(F.when(F.col(p) <= F.col("rank") * F.lit(alpha) / F.col("_m"), F.col("rank"))).over(everything)
    return ranked.withColumn("significant", F.coalesce(F.col("rank") <= last, F.lit(False))).drop("_m")


def verdict(lo: Column, hi: Column) -> Column:
    return F.when((lo <= 0) & (hi >= 0), "INSIDE NOISE").when(hi < 0, "KEEP").otherwise("DROP")


def bca(summed: DataFrame, draws: int = 2000, seed: str = "42") -> tuple[float, float, float]:
    """(delta, lo, hi) by the bias-corrected and accelerated rule, from the draws and the blocks' jackknife; both are bounded, so the last step is plain Python."""
    from statistics import NormalDist

    rows = summed.select("ev", "eb", "len").collect()  # BLOCKS at most
    totals = [sum(r[c] for r in rows) for c in ("ev", "eb", "len")]
    rate = lambda v, b, n: (v - b) / n if n else 0.0
    seen = rate(*totals)
    drawn = sorted(r["delta"] for r in bootstrap(summed, draws=draws, seed=seed).select("delta").collect())  # `draws` numbers
    if not drawn:
        return seen, float("nan"), float("nan")
    normal = NormalDist()
    share = min(max(sum(d < seen for d in drawn) / len(drawn), 1 / len(drawn)), 1 - 1 / len(drawn))
    jack = [rate(*(t - r[c] for t, c in zip(totals, ("ev", "eb", "len"), strict=True))) for r in rows]
    mean = sum(jack) / len(jack)
    spread = sum((mean - j) ** 2 for j in jack)
    a = sum((mean - j) ** 3 for j in jack) / (6 * spread**1.5) if spread else 0.0
    z0 = normal.inv_cdf(share)

    def at(q: float) -> float:
        z = z0 + normal.inv_cdf(q)
        k = normal.cdf(z0 + z / (1 - a * z)) * (len(drawn) - 1)
        low = int(k)
        return drawn[low] + (k - low) * (drawn[min(low + 1, len(drawn) - 1)] - drawn[low])

    return seen, at(0.025), at(0.975)
