"""Where images, recognisers and the network would come in: contracts only."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame


class Recogniser(Protocol):
    """Reads images: a stream's text for each, empty where reading fails."""

    def __call__(self, images: list[bytes], stream: str) -> list[str]: ...


class Renderer(Protocol):
    """Draws a paragraph's lines; the seed belongs to the row, so order and partitions don't matter."""

    def __call__(self, lines: list[str], seed: int) -> bytes: ...


def recognised(images: DataFrame, recogniser: Recogniser, streams: tuple[str, ...], key: str = "id", image: str = "image") -> DataFrame:
    """(key, ord, stream, hyp): each image through each stream, in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, data = batch.column(0), batch.column(1).to_pylist()
            for k, stream in enumerate(streams):
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([ids, pa.array([k] * n, pa.int32()), pa.array([stream] * n), pa.array(recogniser(data, stream), pa.string())], names=[key, "ord", "stream", "hyp"])

    return images.select(key, image).mapInArrow(run, f"{key} {dict(images.dtypes)[key]}, ord int, stream string, hyp string")


def rendered(paragraphs: DataFrame, renderer: Renderer, key: str = "idx", lines: str = "lines", seed: int = 0) -> DataFrame:
    """(key, image): row idx is drawn with seed * 1000003 + idx."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            images = [renderer(x, seed * 1_000_003 + i) for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(images, pa.binary())], names=[key, "image"])

    return paragraphs.select(key, lines).mapInArrow(run, f"{key} {dict(paragraphs.dtypes)[key]}, image binary")
