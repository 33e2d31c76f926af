"""Forensics of joined lines, length statistics and shard summaries."""

from __future__ import annotations

import re
from functools import lru_cache
from hashlib import md5

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.align import distance
from scriptorium.functions.columns import let
from scriptorium.functions.text import SOFT_HYPHEN, first_divergence
from scriptorium.operators.paragraphs import CLITICS, wrap_points

DASHES = "[-–—]"
_WHITES = re.compile(r"[ \t\n\x0b\f\r]+")


def _packed(s: Column) -> Column:
    return F.regexp_replace(s, r"(?U)\s+", "")


def compound_at_wrap(parts: Column, gold: Column, joined: Column) -> Column:
    """A hyphen at a line's end stands in the gold and is gone in the joined text."""

    def lost(p: Column, t: Column) -> Column:
        word, dash = F.regexp_replace(p.last, f"{DASHES}+$", ""), F.substring(p.last, -1, 1)
        return F.contains(t.g, F.concat(word, dash, p.next)) & F.contains(t.j, F.concat(word, p.next))

    return let(F.struct(_packed(gold).alias("g"), _packed(joined).alias("j")), lambda t: F.exists(wrap_points(parts), lambda p: lost(p, t)))


def failure_class(parts: Column, gold: Column, joined: Column, clitics: tuple[str, ...] = CLITICS) -> Column:
    """The first rule that explains why joined differs from gold.

    C: the gold has blanks behind clitics, the joiner hasn't. G: a compound's hyphen at a line's end. L: a soft hyphen became a hyphen.
    S: a clitic's hyphen is gone. B: the blank behind a leading dash. U: a dash changed or a long one lost its blank. P: a blank behind
    a clitic that the gold hasn't. O: none of these. Null for equal texts.
    """
    names = "|".join(sorted(clitics, key=len, reverse=True))
    spaced = rf"(?iu)(?<![\p{{L}}\p{{N}}_'’])({names})-[ \t]+"
    tight = rf"(?iu)(?<![\p{{L}}\p{{N}}_'’])(?:{names})-\p{{L}}+"
    squashed = F.regexp_replace(gold, spaced, "$1-")
    soft = F.filter(F.split(F.array_join(parts, ""), r"\s+"), lambda w: w.contains("­"))
    survived = F.exists(soft, lambda w: F.contains(joined, F.translate(w, "­", "-")) & F.contains(_packed(gold), F.translate(w, "­", "")))
    lower = F.lower(joined)
    articles = F.array_distinct(F.transform(F.regexp_extract_all(gold, F.lit(tight), F.lit(0)), F.lower))
    dropped = F.exists(articles, lambda a: ~F.contains(lower, a) & F.contains(_packed(lower), F.replace(a, F.lit("-"), F.lit(""))))
    stray = F.exists(articles, lambda a: F.contains(lower, F.replace(a, F.lit("-"), F.lit("- "))))
    letter = lambda t, at: F.substring(t, at + 1, F.lit(1))
    changed = lambda g, j: (g.rlike(DASHES) & j.rlike(DASHES)) | (g.rlike("[–—]") & (j != "") & ~j.rlike(DASHES))
    swapped = let(first_divergence(gold, joined), lambda at: changed(letter(gold, at), letter(joined, at)))
    lost_blank = F.regexp_count(gold, F.lit(r"—\s")) > F.regexp_count(joined, F.lit(r"—\s"))
    return (
        F.when(gold == joined, None)
        .when(gold.rlike(spaced) & (squashed == joined), "C")
        .when(compound_at_wrap(parts, gold, joined), "G")
        .when(survived, "L")
        .when(dropped, "S")
        .when(gold.startswith("- ") & joined.startswith("-") & ~joined.startswith("- "), "B")
        .when(lost_blank | swapped, "U")
        .when(stray, "P")
        .otherwise("O")
    )


def packed_failure_class(parts: Column, gold: Column, joined: Column, clitics: tuple[str, ...] = CLITICS) -> Column:
    """Classes on texts without white space. G: as above. D: dashes differ. C: a clitic's hyphen is gone. A: a numbered continuation line. B: one that begins with a dash. E: soft hyphens. F: none. Null for equal texts."""
    g, j = _packed(gold), _packed(joined)
    at = first_divergence(g, j)
    a, b = F.substring(g, at + 1, F.lit(1)), F.substring(j, at + 1, F.lit(1))
    near = lambda s: F.substring(s, F.greatest(at - 5, F.lit(1)), F.lit(10))
    clitic = rf"(?iu)(?:{'|'.join(sorted(clitics, key=len, reverse=True))})-\p{{L}}"
    rest = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    return (
        F.when(g == j, None)
        .when(compound_at_wrap(parts, gold, joined), "G")
        .when(a.rlike(DASHES) & b.rlike(DASHES), "D")
        .when(near(g).rlike(clitic) & ~near(j).contains("-"), "C")
        .when(F.exists(rest, lambda p: p.rlike(r"^\s*\d{1,3}[.)]\s")), "A")
        .when(F.exists(rest, lambda p: p.rlike(rf"^\s*{DASHES}")), "B")
        .when(F.exists(parts, lambda p: p.contains("­")), "E")
        .otherwise("F")
    )


def dash_token_pairs(rows: DataFrame, ref: str, hyp: str, *keep: str) -> DataFrame:
    """(keep, ed, len) over the words with dashes, in order and joined by blanks; rows whose reference has none are left out."""
    words = lambda c: F.regexp_extract_all(c, F.lit(rf"\S*{DASHES}\S*"), F.lit(0))
    some = rows.select(*keep, words(F.col(ref)).alias("r"), words(F.col(hyp)).alias("h")).where(F.size("r") > 0)
    pad = lambda a, b: F.array_join(F.concat(a, F.array_repeat(F.lit(""), F.greatest(F.size(b) - F.size(a), F.lit(0)))), " ")
    both = some.select(*keep, pad(F.col("r"), F.col("h")).alias("a"), pad(F.col("h"), F.col("r")).alias("b"))
    return both.select(*keep, distance(F.col("a"), F.col("b")).cast("long").alias("ed"), F.length("a").cast("long").alias("len"))


def split_words(lines: list[str | None], key: str | None, rate: float, seed: str) -> tuple[list[str | None], list[str | None], int]:
    """(printed, label, n) of hyphenated."""
    printed, label, tail, n = [], [], "", 0
    head = seed if key is None else f"{seed}|{key}"
    for i, line in enumerate(lines):
        text = None if line is None else line.strip(" ")
        shown = f"{tail} {text}".strip(" ") if tail and text is not None else text
        after = ""
        if not tail and text is not None and i + 1 < len(lines):
            words = _WHITES.split(text)
            last = words[-1]
            if len(words) > 1 and len(last) >= 6 and int(md5(f"{head}|{i}".encode()).hexdigest()[:8], 16) / 2**32 < rate:
                cut, before = len(last) // 2, text[: len(text) - len(last)]
                shown, after = f"{before}{last[:cut]}-", last[cut:]
                text = f"{before}{last[:cut]}{SOFT_HYPHEN}{after}"
                n += 1
        printed.append(shown)
        label.append(text)
        tail = after
    return printed, label, n


@lru_cache
def _splitter(rate: float, seed: str):
    def split(lines: pd.Series, keys: pd.Series) -> pd.DataFrame:
        rows = [(None, None, None) if x is None else split_words(x, None if pd.isna(k) else k, rate, seed) for x, k in zip(lines, keys, strict=True)]
        return pd.DataFrame({"printed": pd.Series([r[0] for r in rows], dtype=object), "label": pd.Series([r[1] for r in rows], dtype=object), "n": pd.Series([r[2] for r in rows], dtype="Int32")})

    split.__annotations__ = {"lines": pd.Series, "keys": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(split, "printed array<string>, label array<string>, n int")


def hyphenated(lines: Column, key: Column, rate: float, seed: str = "0") -> Column:
    """struct<printed, label, n>: with the given rate a line's last word of six letters or more is split; the printed lines show a hyphen and go on in the next line, the label has a soft hyphen. The line behind a split isn't split itself. Draws are hashes of key and line."""
    return _splitter(rate, seed)(lines, key.cast("string"))


def nearest_rank(values: DataFrame, value: str, shares: dict[str, float]) -> DataFrame:
    """One row: the values at places round(q * (n - 1)), halves to even, in order. Values are counted first."""
    counted = values.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    listed = counted.agg(F.sort_array(F.collect_list(F.struct(F.col(value).alias("v"), "n"))).alias("all"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"))

    def at(q: float) -> Column:
        place = F.bround(F.lit(q) * (F.col("total") - 1))
        kind = dict(values.dtypes)[value]
        step = lambda a, x: F.struct((a.seen + x.n).alias("seen"), F.when(a.found.isNull() & (a.seen + x.n > place), x.v).otherwise(a.found).alias("found"))
        return F.aggregate("all", F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast(kind).alias("found")), step).found

    return listed.select(F.col("total").alias("n"), *(at(q).alias(k) for k, q in shares.items()))


def shard_summary(rows: DataFrame, group: str, text: str) -> DataFrame:
    """(group, n, chars, shortest, median, mean, p95, longest): lengths of each shard's texts, with linear percentiles."""
    n = F.length(text)
    return rows.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.sum(n).alias("chars"), F.min(n).alias("shortest"), F.percentile(n, 0.5).alias("median"), F.round(F.avg(n), 6).alias("mean"), F.percentile(n, 0.95).alias("p95"), F.max(n).alias("longest"),
    )


def label_distances(vectors: DataFrame, label: str, vector: str, most: int = 50) -> DataFrame:
    """(a, b, rms) of labels a < b: root mean square distance of their mean vectors, the nearest first. Labels are few; their means are one array."""
    means = vectors.select(label, F.posexplode(vector).alias("i", "x")).groupBy(label, "i").agg(F.avg("x").alias("x"))
    rows = means.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p.x).alias("v"))
    every = rows.agg(F.array_sort(F.collect_list(F.struct(F.col(label).alias("k"), "v"))).alias("all"))
    gap = lambda p, q: F.sqrt(F.aggregate(F.zip_with(p.v, q.v, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, d: s + d) / F.size(p.v))
    pairs = F.flatten(F.transform("all", lambda p: F.transform(F.filter("all", lambda q: q.k > p.k), lambda q: F.struct(p.k.alias("a"), q.k.alias("b"), gap(p, q).alias("rms")))))
    return every.select(F.explode(pairs).alias("x")).select("x.*").orderBy("rms", "a", "b").limit(most)
