"""Samples and splits that don't depend on partitions: order comes from hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.operators.resample import number


def eval_split(rows: DataFrame, key: str, held: int, seed: str = "42") -> DataFrame:
    """rows with split: eval for the `held` keys with the lowest hashes, else train. Only the border is looked up, by a top-k."""
    order = F.struct(number(seed, F.col(key)).alias("h"), F.col(key).alias("k"))
    border = rows.select(order.alias("o")).distinct().orderBy("o").limit(held).agg(F.max("o").alias("_o"))
    return rows.join(F.broadcast(border), F.lit(True), "left").withColumn("split", F.when(order <= F.col("_o"), "eval").otherwise("train")).drop("_o")


def round_robin(rows: DataFrame, key: str, buckets: str, n: int, seed: str = "0") -> DataFrame:
    """n keys, taken from the buckets by turns, the rarest bucket first; a key that two buckets give counts once, at its first turn."""
    single = rows.select(key, F.explode(buckets).alias("bucket"))
    sizes = single.groupBy("bucket").agg(F.count(F.lit(1)).alias("_size"))
    turn = F.row_number().over(Window.partitionBy("bucket").orderBy(number(seed, F.col(key)), key))
    ranked = single.withColumn("turn", turn).where(F.col("turn") <= n).join(F.broadcast(sizes), "bucket")
    first = ranked.groupBy(key).agg(F.min(F.struct("turn", "_size", "bucket")).alias("f"))
    return first.select(key, "f.turn", "f.bucket", "f._size").orderBy("turn", "_size", "bucket", key).limit(n).select(key, "bucket", "turn")


def weighted_choice(u: Column, items: dict[str, float]) -> Column:
    """The item whose share of the summed weights holds u in [0, 1)."""
    total, reached, out = sum(items.values()), 0.0, None
    for name, weight in items.items():
        reached += weight
        out = F.when(u < reached / total, name) if out is None else out.when(u < reached / total, name)
    return out.otherwise(list(items)[-1])


def quality_top(rows: DataFrame, score: str, key: str, above: float, n: int) -> DataFrame:
    return rows.where(F.col(score) > above).orderBy(F.desc(score), F.desc(key)).limit(n)
