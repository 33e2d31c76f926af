"""Token counts by offset-mapped attribution.

Each document is encoded once as a whole. Tokens of a byte-level tokenizer concatenate to the text's
UTF-8, so running sums of their lengths are exact offsets. Sections are intervals of the same bytes: the
sentences, each with the white space behind it; a line feed ends one too. Those of the first line are the
head, the others the body. Tokens with the space before their word begin in the section before theirs.
Tokens are joined to sections by searching the sections' ends in the token offsets.

A token over a section's end is allocated by an explicit rule: "most" (the default) gives it to the
section with most of its bytes, the earlier one of equals; "start" to that of its first byte; "end" to
that of its last byte. Each token is counted once, so the sections' tokens add up to the document's.

A null or empty text has one empty section and no tokens. Repeated rows get equal results.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from scriptorium.llm.common import chunks, ship

#: Ends of sections.
END = re.compile(rb"[.!?]+[ \t\r]+\n*|\n+")
SCHEMA = "doc_id bigint, section int, kind string, first_byte bigint, n_bytes bigint, n_tokens bigint, n_crossing bigint"
RULES = ("most", "start", "end")
KEPT_PIECES, GROUP_BYTES = 300_000, 2_000_000


class Lengths:
    """Byte lengths of a text's tokens. The tokenizer cuts texts by its pattern first, and pieces repeat, so each is encoded once while it is remembered."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, k in ranks.items():
            self.size[k] = len(token)
        self.cut, self.kept = regex.compile(pattern), {}

    def piece(self, piece: str) -> list[int]:
        if (got := self.kept.get(piece)) is None:
            got = self.size[self.encoding._core_bpe.encode_single_piece(piece.encode())].tolist()
            if len(piece) <= 64:
                if len(self.kept) >= KEPT_PIECES:
                    self.kept.clear()
                self.kept[piece] = got
        return got

    def of(self, text: str) -> np.ndarray:
        out: list[int] = []
        for piece in self.cut.findall(text):
            out += self.piece(piece)
        return np.array(out, np.int64)


def attribute(token_ends: np.ndarray, section_ends: np.ndarray, rule: str = "most") -> tuple[np.ndarray, np.ndarray]:
    """The section of each token, and whether it crosses a section's end. Both arrays are ascending byte offsets."""
    starts = np.concatenate(([0], token_ends[:-1])) if len(token_ends) else token_ends
    first = np.searchsorted(section_ends, starts, "right")
    last = np.searchsorted(section_ends, token_ends, "left")
    crossing = last > first
    if rule == "start":
        return first, crossing
    if rule == "end":
        return last, crossing
    edges = np.concatenate(([0], section_ends))
    own = np.where(crossing & (token_ends - edges[last] > edges[first + 1] - starts), last, first)
    for k in np.flatnonzero(last > first + 1):  # a token over more than two sections
        inside = np.arange(first[k], last[k] + 1)
        share = np.minimum(edges[inside + 1], token_ends[k]) - np.maximum(edges[inside], starts[k])
        own[k] = inside[int(share.argmax())]
    return own, crossing


def count(docs: DataFrame, path: str, pattern: str, rule: str = "most") -> DataFrame:
    """A row for each section of each row of docs, with its tokens and those of them that cross an end."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = Lengths(path, pattern)
        for rows in chunks(batches, GROUP_BYTES):
            ids, parts, kinds = [], [], []
            for row in rows:
                text = row["text"] or ""
                data = text.encode()
                ends = np.array([m.end() for m in END.finditer(data)], np.int64)
                if not len(ends) or ends[-1] != len(data):
                    ends = np.append(ends, len(data))
                own, crossing = attribute(np.cumsum(lengths.of(text)), ends, rule)
                n = len(ends)
                first = np.concatenate(([0], ends[:-1]))
                parts.append((np.arange(n), first, ends - first, np.bincount(own, minlength=n), np.bincount(own, crossing, minlength=n).astype(np.int64)))
                ids += [row["doc_id"]] * n
                line = data.find(b"\n")
                kinds.append(first <= (line if line >= 0 else len(data)))
            section, first, size, tokens, crossed = (np.concatenate(x) for x in zip(*parts, strict=True))
            kind = pa.array(np.where(np.concatenate(kinds), "head", "body"))
            arrays = [pa.array(ids, pa.int64()), pa.array(section, pa.int32()), kind, *(pa.array(x, pa.int64()) for x in (first, size, tokens, crossed))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "section", "kind", "first_byte", "n_bytes", "n_tokens", "n_crossing"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
