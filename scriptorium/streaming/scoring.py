"""Extension: scoring predictions as they arrive. The batch engine has no streaming operators of its own.

Predictions are joined to a static gold table and added up by stream in the state of the query; a checkpoint
folder makes runs resumable, so what a run has scored it doesn't score again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scriptorium.operators.metrics import edits


def read_predictions(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema("id string, stream string, hyp string").option("maxFilesPerTrigger", files_per_trigger).json(path)


def running_rates(predictions: DataFrame, gold: DataFrame) -> DataFrame:
    """(stream, n, edits, chars): totals so far. Repeated (id, stream) pairs count once."""
    joined = predictions.dropDuplicates(["id", "stream"]).join(gold.select("id", "text"), "id")
    return joined.groupBy("stream").agg(F.count(F.lit(1)).alias("n"), F.sum(edits(F.col("text"), F.col("hyp"))).alias("edits"), F.sum(F.length("text")).alias("chars"))


def start(rates: DataFrame, checkpoint: str, name: str) -> StreamingQuery:
    """All files that are there, then stop; results are in the table `name`."""
    return rates.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def attempted(new: DataFrame, known: DataFrame, key: str = "title") -> DataFrame:
    """Rows whose key hasn't been tried: a cache of attempts as an anti join."""
    return new.join(known.select(key).distinct(), key, "left_anti")
