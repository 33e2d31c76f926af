"""Mixing sources to target weights, in DataFrame operations only.

Tokens are summed by source, each source gets a target and so a repetition rate, and a document is
emitted floor(rate) times plus once more where a hash of its id, read as a number in [0, 1), is below
the fraction. Decisions depend on the id and the seed alone, so reruns and repeated rows agree.

A null text has no words; a null source is a source of its own, last in order; a null id is hashed as
the word null. A source without words has rate 0. No rows give no sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm.common import stored, word_count

WEIGHTS = (5, 2, 1)
SHARE, CAP, SEED = 1.5, 2, "mix-1"
#: Up to so many sources their rates are broadcast (some 100 bytes each); beyond, the join shuffles.
BROADCAST_SOURCES = 10_000


def source_rates(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(source, source_size, target, rate) from rows (source, size).

    Targets share out share * all words by weight; none is above cap * its source's words, and what is
    over goes to the others by weight. Sorted by cap per weight, the capped sources are a prefix: each
    is capped if its cap is at most its share of what the ones before it left.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = by_source.withColumn("rank", F.row_number().over(in_order)).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int")).cast("long")
    )
    limit = F.col("source_size") * cap
    filling = Window.orderBy((limit.cast("double") / F.col("weight")), F.col("rank"))
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    everything = filling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = ranked.select(
        "source",
        "source_size",
        "weight",
        limit.alias("limit"),
        F.row_number().over(filling).alias("turn"),
        (F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum(limit).over(before), F.lit(0))).alias("left"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("weight_left"),
    ).withColumn("own", F.col("weight") * F.col("left") / F.col("weight_left"))
    free = F.when(F.col("limit") > F.col("own"), F.struct("turn", "left", "weight_left"))
    first = F.min(free).over(Window.orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.when(F.col("first").isNull() | (F.col("turn") < F.col("first.turn")), F.col("limit").cast("double")).otherwise(
        F.col("weight") * F.col("first.left") / F.col("first.weight_left")
    )
    return (
        level.withColumn("first", first)
        .select("source", "source_size", target.alias("target"))
        .withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    )


def chance(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1), the same for the same id and seed: the first 48 bits of an MD5."""
    key = F.concat_ws("|", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("double") / F.lit(float(2**48))


def copies(rate: Column, doc_id: Column, seed: str = SEED) -> Column:
    whole = F.floor(rate)
    return (whole + F.when(chance(doc_id, seed) < rate - whole, 1).otherwise(0)).cast("long")


def with_rates(rows: DataFrame, rates: DataFrame) -> DataFrame:
    """rows with source_size, target and rate of their source; a column of rows with such a name is replaced."""
    kept = rows.drop("source_size", "target", "rate")
    named = rates.withColumnRenamed("source", "_source")
    side = F.broadcast(named) if rates.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else named
    return kept.join(side, kept["source"].eqNullSafe(side["_source"]), "left").drop("_source")


def mix_plan(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken) of every row of docs."""
    sizes = stored(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    rates = stored(source_rates(sizes, **options), "mix-rates")
    planned = with_rates(sizes, rates).withColumn("copies", copies(F.col("rate"), F.col("doc_id")))
    return planned.select("doc_id", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """Every row of docs as often as its source's rate says, with the columns of docs."""
    sizes = docs.select("source", word_count(F.col("text")).alias("size"))
    rates = stored(source_rates(sizes, **options), "mix-rates")
    columns = docs.columns
    planned = docs.select(F.struct(*columns).alias("_row"), "source")
    often = with_rates(planned, rates).select("_row", copies(F.col("rate"), F.col("_row.doc_id")).cast("int").alias("_n"))
    return often.where("_n > 0").select("_row", F.explode(F.array_repeat(F.lit(0), F.col("_n"))).alias("_i")).select("_row.*")


ORACLE = """
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight,
      row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank FROM s),
t AS (SELECT *, row_number() OVER (ORDER BY (2 * source_size)::DOUBLE / weight, rank) AS turn FROM r),
l AS (SELECT source, source_size, weight, turn,
      1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(2 * source_size) OVER w, 0)::DOUBLE AS rest,
      (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0))::DOUBLE AS weight_left
      FROM t WINDOW w AS (ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT min(turn) AS turn FROM l WHERE 2 * source_size > weight * rest / weight_left),
x AS (SELECT l.source, l.source_size, CASE WHEN f.turn IS NULL OR l.turn < f.turn THEN (2 * l.source_size)::DOUBLE
      ELSE l.weight * (SELECT rest FROM l AS m WHERE m.turn = f.turn) / (SELECT weight_left FROM l AS m WHERE m.turn = f.turn) END AS target
      FROM l, f),
y AS (SELECT d.doc_id, d.size, x.source_size, x.target, CASE WHEN x.source_size > 0 THEN x.target / x.source_size ELSE 0 END AS rate
      FROM d JOIN x ON d.source IS NOT DISTINCT FROM x.source)
SELECT doc_id, size, source_size, target,
  (size * (floor(rate)::BIGINT + CASE WHEN ('0x' || substr(md5('mix-1|' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT::DOUBLE / 281474976710656.0::DOUBLE
    < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM y
"""
