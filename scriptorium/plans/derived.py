"""Inputs that queries derive from the driver's documents, in the same way as their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.profiles import LATIN
from scriptorium.sources.tables import table

#: Streams of a word w at place p, in order; the first is the anchor. SQL has the same rules.
STREAMS = ("mixed", "folded", "confused", "cut", "faithful")


def confused(w: Column) -> Column:
    return F.replace(F.replace(w, F.lit("rn"), F.lit("m")), F.lit("li"), F.lit("h"))


def stream_words(w: Column, p: Column) -> list[Column]:
    n = F.length(w)
    fold = T.folded(w)
    return [
        F.when((n + p) % 5 == 0, confused(fold)).otherwise(w),
        F.when((n + 2 * p) % 3 == 0, fold).otherwise(w),
        F.when((n + 3 * p) % 7 == 0, confused(w)).otherwise(w),
        F.when(((n + p) % 11 == 0) & (n > 3), F.substring(w, F.lit(1), n - 1)).otherwise(w),
        F.when((n + 5 * p) % 13 == 0, F.translate(w, "e", "c")).otherwise(w),
    ]


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, p, w): every word of every document."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "lang", "source", F.posexplode(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("p", "w"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, p, w, ord, hyp, ed, len): each word with each stream's reading of it."""
    rows = words(spark, sf_dir)
    hyps = F.posexplode(F.array(*stream_words(F.col("w"), F.col("p")))).alias("ord", "hyp")
    edit = F.when(F.col("w") == F.col("hyp"), 0).otherwise(F.levenshtein("w", "hyp")).cast("long")
    return rows.select("*", hyps).withColumn("ed", edit).withColumn("len", F.length("w").cast("long"))


def by_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, ord, ed, len) summed over words: one row a document and stream, so that later steps are small."""
    return pairs(spark, sf_dir).groupBy("doc_id", "lang", "source", "ord").agg(F.sum("ed").alias("ed"), F.sum("len").alias("len"))


def triples(spark: SparkSession, sf_dir: str, variant: int = 1, baseline: int = 0) -> DataFrame:
    """(id, lang, ev, eb, len) of two streams."""
    rows = pairs(spark, sf_dir).where(F.col("ord").isin(variant, baseline))
    one = lambda k, c: F.sum(F.when(F.col("ord") == k, F.col(c)).otherwise(0))
    return rows.groupBy(F.col("doc_id").alias("id"), "lang").agg(one(variant, "ed").alias("ev"), one(baseline, "ed").alias("eb"), one(baseline, "len").alias("len"))


_CONTROL = "".join(map(chr, (*range(1, 9), *range(14, 28))))
_FOLD = f"translate({{}}, '{LATIN}', 'ACEEEINOOUsaceeeinoou')"
_CONFUSE = "replace(replace({}, 'rn', 'm'), 'li', 'h')"

WORDS_SQL = r"""words AS (SELECT doc_id, lang, source, (unnest(generate_series(1, len(ws))) - 1)::INT AS p, unnest(ws) AS w
  FROM (SELECT doc_id, lang, source, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM documents))"""

#: The engine of the SQL counts bytes in levenshtein, so letters beyond ASCII become unused control characters first.
PAIRS_SQL = (
    WORDS_SQL
    + f""", hyps AS (SELECT doc_id, lang, source, p, w, unnest([0, 1, 2, 3, 4]) AS ord, unnest([
  CASE WHEN (length(w) + p) % 5 = 0 THEN {_CONFUSE.format(_FOLD.format('w'))} ELSE w END,
  CASE WHEN (length(w) + 2 * p) % 3 = 0 THEN {_FOLD.format('w')} ELSE w END,
  CASE WHEN (length(w) + 3 * p) % 7 = 0 THEN {_CONFUSE.format('w')} ELSE w END,
  CASE WHEN (length(w) + p) % 11 = 0 AND length(w) > 3 THEN substring(w, 1, length(w) - 1) ELSE w END,
  CASE WHEN (length(w) + 5 * p) % 13 = 0 THEN replace(w, 'e', 'c') ELSE w END]) AS hyp FROM words),
pairs AS (SELECT *, CASE WHEN w = hyp THEN 0 ELSE levenshtein(translate(w, '{LATIN}', '{_CONTROL}'), translate(hyp, '{LATIN}', '{_CONTROL}')) END AS ed, length(w) AS len FROM hyps)"""
)

NUMBER_SQL = "('0x' || substr(md5({}), 1, 8))::BIGINT"

BLOCKS_SQL = (
    PAIRS_SQL
    + f""", triples AS (SELECT doc_id AS id, lang, sum(CASE WHEN ord = 1 THEN ed ELSE 0 END)::BIGINT AS ev, sum(CASE WHEN ord = 0 THEN ed ELSE 0 END)::BIGINT AS eb,
  sum(CASE WHEN ord = 0 THEN len ELSE 0 END)::BIGINT AS len FROM pairs WHERE ord IN (0, 1) GROUP BY ALL),
blocks AS (SELECT {{by}} {NUMBER_SQL.format("'block|' || id")} % 256 AS block, sum(ev)::BIGINT AS ev, sum(eb)::BIGINT AS eb, sum(len)::BIGINT AS len FROM triples GROUP BY ALL),
slots AS (SELECT *, row_number() OVER ({{over}} ORDER BY block) - 1 AS slot, count(*) OVER ({{over}}) AS n FROM blocks)"""
)
