"""Readers of manifests, predictions, lexicons and shards into canonical frames.

Field names differ between producers, so readers coalesce aliases; a frame of one schema comes out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

# Aliases in order of preference.
IMAGE = ("image", "file", "filename", "img", "path", "image_path")
TEXT = ("text", "paragraph", "gt", "transcription", "label", "gold")
LINES = ("as_lines", "lines", "raw_lines", "line_list")
HYPOTHESIS = ("hypothesis", "pred")

MANIFEST = StructType()
for _name in ("id", *IMAGE, *TEXT, *HYPOTHESIS):
    MANIFEST = MANIFEST.add(_name, StringType())
for _name in LINES:
    MANIFEST = MANIFEST.add(_name, ArrayType(StringType()))


def _first(names: tuple[str, ...], empty_too: bool):
    return F.coalesce(*(F.nullif(F.col(n), F.lit("")) if empty_too else F.col(n) for n in names))


def canonical(rows: DataFrame, empty_counts_as_missing: bool = True) -> DataFrame:
    """(id, image, text, as_lines): id falls back to the image's name; lines to the text split at its line feeds; an image without suffix is a .jpg."""
    image = _first(IMAGE, True)
    image = F.when(~image.rlike(r"(?i)\.(jpe?g|png|tiff?|bmp|webp)$"), F.concat(image, F.lit(".jpg"))).otherwise(image)
    text = _first(TEXT, empty_counts_as_missing)
    lines = F.coalesce(*LINES, F.when(text.contains("\n"), F.split(text, "\n")))
    return rows.select(F.coalesce("id", image).alias("id"), image.alias("image"), F.coalesce(text, F.lit("")).alias("text"), lines.alias("as_lines"))


def gold(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    """Gold rows from JSON lines, or (lines=False) from a JSON list. A malformed row raises. Rows without id and image are dropped."""
    return canonical(spark.read.schema(MANIFEST).option("mode", "FAILFAST").option("multiLine", not lines).json(path)).where("id is not null")


def gold_map(spark: SparkSession, path: str) -> DataFrame:
    """Gold rows from one JSON object of records by id."""
    whole = spark.read.text(path, wholetext=True)
    entry = F.explode(F.from_json("value", f"map<string,struct<{', '.join(f'{f.name}:{f.dataType.simpleString()}' for f in MANIFEST)}>>")).alias("key", "own")
    rows = whole.select(entry).select("key", "own.*")
    return canonical(rows.withColumn("id", F.coalesce("id", "key")).drop("key"))


def predictions(spark: SparkSession, path: str, stream: str | None = None) -> DataFrame:
    """(id, stream, hyp) from JSON lines; of equal ids the last in the file stays."""
    rows = spark.read.schema(MANIFEST).option("mode", "FAILFAST").json(path).withColumn("_at", F.monotonically_increasing_id())
    rows = rows.where("id is not null").select("id", "_at", F.coalesce(*HYPOTHESIS, *TEXT, F.lit("")).alias("hyp"))
    last = rows.groupBy("id").agg(F.max_by("hyp", "_at").alias("hyp"))
    return last.select("id", F.lit(stream).alias("stream"), "hyp")


def lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(word, n) from a JSON list of words or an object of counts, with the lower-cased words."""
    whole = spark.read.text(path, wholetext=True)
    listed = whole.select(F.explode(F.from_json("value", "array<string>")).alias("word"), F.lit(1).cast("long").alias("n")).where("word is not null")
    counted = whole.select(F.explode(F.from_json("value", "map<string,bigint>")).alias("word", "n"))
    both = listed.union(counted)
    return both.union(both.select(F.lower("word"), "n")).groupBy("word").agg(F.max("n").alias("n"))


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """(text, lang, domain) from JSON lines; a list of lines becomes a text; malformed rows are dropped."""
    rows = spark.read.text(path).select(F.from_json("value", "text string, lang string, domain string").alias("r")).where("r.text is not null").select("r.*")
    lines = F.from_json("text", "array<string>")
    return rows.withColumn("text", F.when(F.col("text").startswith("[") & lines.isNotNull(), F.array_join(lines, "\n")).otherwise(F.col("text")))


def shard(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a folder of JSON files with their file's name; files that begin with _ aren't records."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").option("multiLine", True).json(path)
    return rows.withColumn("_file", F.col("_metadata.file_name"))


def conllu(spark: SparkSession, path: str) -> DataFrame:
    """Sentences of CoNLL-U files: the lines that begin with '# text = '."""
    mark = "# text = "
    return spark.read.text(path).where(F.startswith("value", F.lit(mark))).select(F.substring("value", len(mark) + 1, 1 << 30).alias("text"))


def domain_shards(rows: DataFrame, path: str, least: int = 40, per_file: int = 50_000) -> None:
    """Write stripped texts of at least so many characters as JSON lines by domain, in files of at most per_file rows."""
    kept = rows.withColumn("text", F.trim("text")).where(F.length("text") >= least)
    kept.write.partitionBy("domain").option("maxRecordsPerFile", per_file).mode("overwrite").json(path)
