"""What the corpus operators share: words, shared storage, batching."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as str.split and bytes.split know it for bytes.
WHITESPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"

#: Rows in an Arrow batch: even with the longest texts a batch stays at some tens of MB.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Python workers of a local session find this package; on a cluster send it with --py-files. Arrow batches are kept small."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A local session without it, as in tests, gets one of its own; elsewhere that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        at = "file://" + tempfile.mkdtemp(prefix="scriptorium-")
        spark.conf.set("spark.checkpoint.dir", at)
        spark.sparkContext.setCheckpointDir(at)
    return at


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: its lineage ends there, so a lost executor costs nothing."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A key is heavy if it has over one in so many rows, so at most so many are; each is dealt over PARTS.
HEAVY, PARTS = 4096, 64


def heavy_keys(counts: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """Of rows (key, n) the keys with over total / HEAVY rows: HEAVY of them at most, so they may be broadcast."""
    return counts.where(F.col(n) * HEAVY > total).select(F.col(key).alias("_heavy"))


def salted_join(rows: DataFrame, side: DataFrame, key: str, heavy: DataFrame, by: Column, how: str = "inner") -> DataFrame:
    """rows joined to side (one row a key) by key; rows of heavy keys are dealt over PARTS by a hash of by, and side's rows of them repeated."""
    heavy = F.broadcast(heavy)
    marked = lambda df, salt: df.join(heavy, df[key].eqNullSafe(F.col("_heavy")), "left").withColumn("_salt", salt).drop("_heavy")
    left = marked(rows, F.when(F.col("_heavy").isNotNull(), F.pmod(F.xxhash64(by), F.lit(PARTS))).otherwise(F.lit(0)).cast("int"))
    every = F.when(F.col("_heavy").isNotNull(), F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(F.lit(0)))
    right = marked(side, every).withColumn("_salt", F.explode("_salt"))
    return left.join(right, [key, "_salt"], how).drop("_salt")


def let(value: Column, then) -> Column:
    """then(value), with value computed once, also where lambdas read it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def once(rows: DataFrame, value: Column, then, name: str) -> DataFrame:
    """rows with the column name: then(value). A generator computes it once, however often and by whatever filter it is read."""
    return rows.withColumn(name, F.explode(F.transform(F.array(value), then)))


def words_of(text: Column) -> Column:
    """Array of the words of a text; null has none."""
    inner = F.btrim(text, F.lit(WHITESPACE))
    return F.when(inner.isNull() | (inner == ""), F.array().cast("array<string>")).otherwise(F.split(inner, GAP))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def chunks(batches: Iterable[pa.RecordBatch], most_bytes: int, text: str = "text") -> Iterator[list[dict]]:
    """Rows as dicts, in groups whose texts hold most_bytes or one row."""
    rows: list[dict] = []
    size = 0
    for batch in batches:
        for row in batch.to_pylist():
            rows.append(row)
            size += len(row[text] or "")
            if size >= most_bytes:
                yield rows
                rows, size = [], 0
    if rows:
        yield rows
