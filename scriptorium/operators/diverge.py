"""Distances between distributions, from counts."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def jensen_shannon(counts: DataFrame, group: str, item: str, n: str = "n") -> DataFrame:
    """(group, js): divergence in bits of each group's items from those of all groups. Absent items add nothing on their own side."""
    total = counts.groupBy(item).agg(F.sum(n).alias("_q"))
    own, all_ = Window.partitionBy(group), Window.partitionBy()
    p = counts.groupBy(group, item).agg(F.sum(n).alias("_p"))
    q = total.withColumn("_q", F.col("_q") / F.sum("_q").over(all_))
    joined = p.withColumn("_p", F.col("_p") / F.sum("_p").over(own)).join(q, item)
    m = (F.col("_p") + F.col("_q")) / 2
    # Items that a group lacks have m = q / 2, so each adds q to the other side's sum: 1 less the q of those it has.
    term = F.col("_p") * F.log2(F.col("_p") / m) + F.col("_q") * F.log2(F.col("_q") / m) - F.col("_q")
    return joined.groupBy(group).agg(((F.sum(term) + 1) / 2).alias("js"))


def kolmogorov_smirnov(values: DataFrame, group: str, value: str) -> DataFrame:
    """(group, ks): the largest gap between each group's distribution function and that of all. Values are counted first; the window runs over distinct values of a group."""
    every = values.groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
    up = Window.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    whole = every.select(value, (F.sum("_n").over(up) / F.sum("_n").over(Window.partitionBy())).alias("_f"))
    own = values.groupBy(group, value).agg(F.count(F.lit(1)).alias("_n"))
    groups = values.select(group).distinct()
    grid = groups.withColumn("_k", F.lit(1)).join(whole.withColumn("_k", F.lit(1)), "_k").drop("_k")
    rising = Window.partitionBy(group).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    filled = grid.join(own, [group, value], "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    share = F.sum("_n").over(rising) / F.sum("_n").over(Window.partitionBy(group))
    return filled.withColumn("_g", F.abs(share - F.col("_f"))).groupBy(group).agg(F.max("_g").alias("ks"))


def chi_square(observed: DataFrame, group: str, item: str, n: str = "n") -> DataFrame:
    """(group, chi2, df): observed counts against those expected from all groups' shares."""
    own = observed.groupBy(group, item).agg(F.sum(n).alias("_o"))
    total = own.groupBy(item).agg(F.sum("_o").alias("_t"))
    groups = own.groupBy(group).agg(F.sum("_o").alias("_g"))
    grid = groups.withColumn("_k", F.lit(1)).join(total.withColumn("_k", F.lit(1)).withColumn("_all", F.sum("_t").over(Window.partitionBy())), "_k").drop("_k")
    cell = grid.join(own, [group, item], "left").withColumn("_o", F.coalesce("_o", F.lit(0))).withColumn("_e", F.greatest(F.col("_g") * F.col("_t") / F.col("_all"), F.lit(1e-9)))
    return cell.groupBy(group).agg(F.sum(F.pow(F.col("_o") - F.col("_e"), 2) / F.col("_e")).alias("chi2"), (F.count(F.lit(1)) - 1).alias("df"))


def two_sample_ks(values: DataFrame, group: str, value: str, a: str, b: str) -> DataFrame:
    """One row (ks, n_a, n_b, p) of two samples; p by the asymptotic law. The window runs over distinct values."""
    one = lambda g: F.sum(F.when(F.col(group) == g, 1).otherwise(0))
    counts = values.where(F.col(group).isin(a, b)).groupBy(value).agg(one(a).alias("_a"), one(b).alias("_b"))
    up, every = Window.orderBy(value), Window.partitionBy()
    share = lambda c: F.sum(c).over(up) / F.sum(c).over(every)
    gaps = counts.select(F.abs(share("_a") - share("_b")).alias("_d"), "_a", "_b")
    out = gaps.agg(F.max("_d").alias("ks"), F.sum("_a").alias("n_a"), F.sum("_b").alias("n_b"))
    root = F.sqrt(F.col("n_a") * F.col("n_b") / (F.col("n_a") + F.col("n_b")))
    x = (root + 0.12 + 0.11 / root) * F.col("ks")
    terms = sum(2.0 * (-1) ** (k - 1) * F.exp(-2.0 * k * k * x * x) for k in range(1, 40))
    return out.withColumn("p", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(x < 0.2, 1.0).otherwise(terms))))


def baseline_chi_square(observed: DataFrame, baseline: DataFrame, item: str, n: str = "n") -> DataFrame:
    """One row (chi2, df): observed counts against those of a baseline, at least 1e-9 each and rescaled to the observed total."""
    both = observed.select(item, F.col(n).alias("_o")).join(baseline.select(item, F.col(n).alias("_b")), item, "full")
    cells = both.select(F.coalesce("_o", F.lit(0)).alias("_o"), F.greatest(F.coalesce("_b", F.lit(0)).cast("double"), F.lit(1e-9)).alias("_b"))
    every = Window.partitionBy()
    expected = cells.withColumn("_e", F.col("_b") * F.sum("_o").over(every) / F.sum("_b").over(every))
    return expected.agg(F.sum(F.try_divide(F.pow(F.col("_o") - F.col("_e"), 2), F.col("_e"))).alias("chi2"), (F.count(F.lit(1)) - 1).alias("df"))


def chi_square_p(chi2: float, df: int) -> float:
    """Upper tail of the chi-square law, by the series or the continued fraction of the incomplete gamma function."""
    a, x = df / 2.0, chi2 / 2.0
    if x <= 0 or df <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > 1e-15 * abs(total):
            k += 1
            term *= x / k
            total += term
        return 1.0 - total * scale
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 500):
        step = -i * (i - a)
        b += 2
        d = 1 / (step * d + b or 1e-300)
        c = b + step / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * scale
