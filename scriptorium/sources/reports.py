"""Sinks: small result frames as Markdown and JSON, packaged corpora, box files."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows a report reads at most; results are aggregates. A longer frame is refused, not cut: write it as a table.
MOST = 1000


def shown(value: object) -> str:
    """Four decimals; - for nothing, nan for what isn't a number."""
    if value is None:
        return "-"
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.4f}"
    return str(value)


def _rows(frame: DataFrame, most: int) -> list:
    rows = frame.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report holds at most {most} rows")
    return rows


def markdown(frame: DataFrame, title: str, most: int = MOST) -> str:
    rows = _rows(frame, most)
    lines = [f"## {title}", "", "| " + " | ".join(frame.columns) + " |", "|" + "---|" * len(frame.columns)]
    return "\n".join([*lines, *("| " + " | ".join(map(shown, r)) + " |" for r in rows), ""])


def as_json(frames: dict[str, DataFrame], most: int = MOST) -> str:
    clean = lambda v: None if isinstance(v, float) and math.isnan(v) else v
    return json.dumps({k: [{c: clean(v) for c, v in r.asDict().items()} for r in _rows(f, most)] for k, f in frames.items()}, sort_keys=True, ensure_ascii=False, default=str)


def missing_leaves(frame: DataFrame) -> DataFrame:
    """(column, n): columns of a report with nulls; a full report has none."""
    counts = frame.agg(*(F.sum(F.col(c).isNull().cast("int")).alias(c) for c in frame.columns))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("n")) for c in frame.columns))).alias("x")).select("x.*").where("n > 0")


def packaged(manifests: DataFrame) -> DataFrame:
    """(file_name, text, source, match_score, provenance): pairs of manifests (source_doc, source, pairs) under unique names; the first of equal names stays."""
    pair = manifests.select("source_doc", "source", F.explode("pairs").alias("p"))
    name = F.concat_ws("_", "source", F.substring(F.sha2("source_doc", 256), 1, 10), "p.crop")
    rows = pair.select(name.alias("file_name"), F.col("p.text").alias("text"), "source", F.col("p.match_score").alias("match_score"), F.struct("source_doc", "p.page", "p.bbox").alias("provenance"))
    first = F.min(F.struct("provenance.page", "text", "match_score", "source", "provenance"))
    return rows.groupBy("file_name").agg(first.alias("f")).select("file_name", "f.text", "f.source", "f.match_score", "f.provenance")


def box_lines(text: Column, width: Column, height: Column) -> Column:
    """A line's box file: each letter with the whole line's box, then a tab that ends it."""
    line = lambda c: F.concat(c, F.lit(" 0 0 "), width.cast("string"), F.lit(" "), height.cast("string"), F.lit(" 0"))
    letters = F.filter(F.split(text, ""), lambda c: c != "")
    return F.array_join(F.concat(F.transform(letters, line), F.array(line(F.lit("\t")))), "\n")
