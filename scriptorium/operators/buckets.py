"""Tags of paragraphs: length, language, article, line-end hyphen, em dash, line count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.profiles import GENERIC, Language

EMPTY_CUTS = (80, 200, 400)


def quartile_cuts(rows: DataFrame, text: str = "text") -> DataFrame:
    """One row (n, q1, q2, q3): the lengths of places n//4, n//2 and 3n//4 among non-empty texts in order; EMPTY_CUTS for under four.

    Lengths are counted first, so what is put in order is a row for each length, not for each text.
    """
    lengths = rows.where(F.length(text) > 0).groupBy(F.length(text).alias("len")).agg(F.count(F.lit(1)).alias("n"))
    listed = lengths.agg(F.sort_array(F.collect_list(F.struct("len", "n"))).alias("all"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))

    def at(place: Column) -> Column:
        step = lambda a, x: F.struct((a.seen + x.n).alias("seen"), F.when(a.found.isNull() & (a.seen + x.n > place), x.len).otherwise(a.found).alias("found"))
        return F.aggregate("all", F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("int").alias("found")), step).found

    cuts = [F.when(F.col("n") < 4, d).otherwise(at(F.floor(F.col("n") * k / 4))).alias(f"q{k}") for k, d in zip((1, 2, 3), EMPTY_CUTS, strict=True)]
    return listed.select("n", *cuts)


def length_bucket(s: Column, cuts: tuple[int, int, int]) -> Column:
    n = F.length(s)
    return F.when(n <= cuts[0], "len-q1").when(n <= cuts[1], "len-q2").when(n <= cuts[2], "len-q3").otherwise("len-q4")


def language_bucket(s: Column, language: Language = GENERIC) -> Column:
    latin = s.rlike("[A-Za-z]")
    return F.when(T.canaries(s, language) > 0, "lang-own").when(latin & (T.english_ratio(s) >= 0.20), "lang-en").when(latin, "lang-own").otherwise("lang-other")


def article_bucket(s: Column, language: Language) -> Column:
    names = "|".join(language.articles) or "(?!)"
    return F.when(s.rlike(rf"(?iu)(?:^|[\s(\[\"‘“])(?:{names})-[a-zA-Zàèìòùċġħż]"), "prefix-yes").otherwise("prefix-no")


def line_hyphen_bucket(lines: Column) -> Column:
    broken = F.exists(F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: F.rtrim(F.coalesce(x, F.lit(""))).rlike("[^ ][-­]$"))
    return F.when(broken, "linehyp-yes").otherwise("linehyp-no")


def tags(s: Column, lines: Column, cuts: tuple[int, int, int], language: Language = GENERIC) -> Column:
    return F.array(
        length_bucket(s, cuts),
        language_bucket(s, language),
        article_bucket(s, language),
        line_hyphen_bucket(lines),
        F.when(s.contains("—"), "em-dash-yes").otherwise("em-dash-no"),
        F.when(F.size(lines) > 1, "multi-line").otherwise("single-line"),
    )


def hyphen_kind(line: Column, clitics: tuple[str, ...]) -> Column:
    """NONE without a closing hyphen, STRUCTURAL behind a clitic, else COMPOUND."""
    tail = F.lower(F.element_at(F.split(F.rtrim(line), r"\s+"), -1))
    return F.when(~F.rtrim(line).endswith("-"), "NONE").when(tail.isin(*(c + "-" for c in clitics)), "STRUCTURAL").otherwise("COMPOUND")


def simple_length(s: Column) -> Column:
    return F.when(F.length(s) < 80, "short").when(F.length(s) < 200, "mid").otherwise("long")


def simple_language(s: Column, language: Language = GENERIC) -> Column:
    return F.when(T.canaries(s, language) > 0, "own").when(s.rlike("[A-Za-z]"), "english").otherwise("other-lang")


def simple_prefix(s: Column, language: Language) -> Column:
    names = "|".join(language.articles) or "(?!)"
    return F.when(s.rlike(rf"(?iu)\b(?:{names})-"), "il-prefix").otherwise("no-prefix")


def simple_line_hyphen(lines: Column) -> Column:
    broken = F.exists(F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: F.endswith(F.rtrim(x), F.lit("-")))
    return F.when(broken, "line-hyphen").otherwise("no-line-hyphen")


def simple_hyphen(s: Column) -> Column:
    return F.when(F.contains(s, F.lit("-")), "hyphen").otherwise("plain")
