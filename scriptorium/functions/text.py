"""Scalar text rules as column expressions. Only Unicode normal forms need Python, in Arrow batches."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from scriptorium.functions.columns import let
from scriptorium.profiles import ENGLISH, GENERIC, MARKERS, PUNCTUATION, Language

#: ASCII and Unicode white space that str.strip removes.
SPACES = "".join(map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: Unicode's space separators, which SQL's trim removes.
BLANKS = "".join(map(chr, (0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)))
SOFT_HYPHEN, EN_DASH, EM_DASH = "­", "–", "—"


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFC", x))


@F.pandas_udf(StringType())
def nfd(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFD", x))


def trimmed(s: Column) -> Column:
    """As SQL's trim; Spark's own removes the space alone."""
    return F.btrim(s, F.lit(BLANKS))


def stripped(s: Column) -> Column:
    return F.btrim(s, F.lit(SPACES))


def normalised(s: Column, hypothesis: bool = False) -> Column:
    """Composed, without outer white space; a hypothesis has spaces for its line ends. Null becomes empty."""
    s = nfc(F.coalesce(s, F.lit("")))
    return stripped(F.translate(s, "\n\r", "  ") if hypothesis else s)


def output_form(s: Column) -> Column:
    """No soft hyphens, em dashes for en dashes, composed."""
    return nfc(F.translate(s, EN_DASH + SOFT_HYPHEN, EM_DASH))


def dashes(s: Column) -> Column:
    return F.translate(s, EN_DASH, EM_DASH)


def collapsed(s: Column) -> Column:
    return stripped(F.regexp_replace(s, r"(?U)\s+", " "))


def label_form(s: Column) -> Column:
    return nfc(collapsed(F.translate(s, EN_DASH + SOFT_HYPHEN, EM_DASH)))


def clitic_spaces(s: Column, language: Language) -> Column:
    """No blanks behind an article's hyphen."""
    names = "|".join(sorted(language.clitics, key=len, reverse=True)) or "(?!)"
    ahead = rf"(?=.{{1,{max(map(len, language.clitics), default=1)}}}?-[ \t])"  # few places have a hyphen near; the names are tried there alone
    return F.regexp_replace(s, rf"(?iu)(?<![\p{{L}}\p{{N}}_'’]){ahead}({names})-[ \t]+", "$1-")


def lead_marker(s: Column) -> Column:
    """A leading number, a dash with a space at one side (or a long dash) and a letter become number, space, em dash, space."""
    pattern = r"^(?U)\s*(\d{1,2})(?:\s+[-–—]\s*|\s*[-–—]\s+|\s*[–—]\s*)(?=\p{L})"
    return F.regexp_replace(s, pattern, "$1 — ")


def curly(s: Column, straight: str, opening: str, closing: str) -> Column:
    first = F.regexp_replace(s, rf"(?U)(?<=^|\s){straight}(?=[\p{{L}}\p{{N}}])", opening)
    return F.translate(first, straight, closing)


def curly_apostrophe(s: Column) -> Column:
    return curly(s, "'", "‘", "’")


def curly_quote(s: Column) -> Column:
    return curly(s, '"', "“", "”")


def convention_fold(s: Column) -> Column:
    return F.translate(s, "‘’“”–—", "''\"\"--")


def composed(s: Column) -> Column:
    """NFC where a text has combining marks, jamo or letters that compose further. The batch goes to Python all the same; ASCII comes back at once."""
    return F.when(s.rlike(r"[\p{M}\x{1100}-\x{11FF}\x{2126}\x{212A}\x{212B}\x{F900}-\x{FAFF}]"), nfc(s)).otherwise(s)


def lookup_key(s: Column) -> Column:
    """Composed, without outer punctuation. Words are joined by this key, so it is built once for each distinct word."""
    return F.btrim(composed(s), F.lit(PUNCTUATION))


def closing_apostrophe(s: Column) -> Column:
    """Every straight apostrophe as a closing one: the rule without places."""
    return F.translate(s, "'", "’")


def pdf_text(s: Column) -> Column:
    """Without geometric marks, white space collapsed."""
    return collapsed(F.regexp_replace(s, "[■-◿]", ""))


def boilerplate(s: Column, prefix: str, markers: tuple[str, ...], least: int = 15) -> Column:
    """The text of a block without its markers; null for disclaimers and for blocks of which fewer than least characters remain."""
    bare = s
    for m in markers:
        bare = F.replace(bare, F.lit(m), F.lit(""))
    marked = F.lit(False)
    for m in markers:
        marked = marked | F.contains(s, F.lit(m))
    return F.when(F.startswith(s, F.lit(prefix)), None).when(marked & (F.length(pdf_text(bare)) < least), None).when(marked, F.trim(bare)).otherwise(s)


def letters(s: Column) -> Column:
    return F.length(F.regexp_replace(s, r"[^\p{L}]", ""))


def accented_letters(s: Column) -> Column:
    return F.length(F.regexp_replace(s, r"[^\p{L}]|[\x00-\x7F]", ""))


def without_marks(s: Column, language: Language = GENERIC) -> Column:
    """Decomposed, without non-spacing marks, then folded: for letters beyond the language's own."""
    return F.translate(F.regexp_replace(nfd(s), r"\p{Mn}", ""), language.fold, language.to)


def folded(s: Column, language: Language = GENERIC) -> Column:
    """The language's letters as their plain forms."""
    return F.translate(s, language.fold, language.to)


def canaries(s: Column, language: Language = GENERIC) -> Column:
    return F.length(s) - F.length(F.translate(s, language.canaries, ""))


def tokens(s: Column) -> Column:
    return F.filter(F.split(F.translate(s, "\n", " "), "[ \t]+"), lambda x: x != "")


def gram_words(s: Column) -> Column:
    """Lower-cased words of letters, digits and underscores."""
    return F.filter(F.split(F.regexp_replace(F.lower(s), r"[^\p{L}\p{N}_]+", " "), " "), lambda x: x != "")


def grams(words: Column, n: int = 5) -> Column:
    """The set of n-word grams; fewer words are one gram, none are none."""
    many = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(words, i, n), " "))
    return F.when(F.size(words) > 0, F.array_distinct(many)).otherwise(F.array().cast("array<string>"))


def english_ratio(s: Column) -> Column:
    """Share of ASCII words that are in a list of frequent English ones."""
    found = F.regexp_extract_all(s, F.lit("[A-Za-z]+"), F.lit(0))
    share = lambda ws: F.when(F.size(ws) > 0, F.size(F.filter(ws, lambda w: F.lower(w).isin(*ENGLISH))) / F.size(ws)).otherwise(F.lit(0.0))
    return let(found, share)


def marker_language(s: Column) -> Column:
    """ltz, fr or de by distinct marker words, if one leads by a clear margin; else unclear."""
    low = F.lower(s)
    words = F.regexp_extract_all(low, F.lit(r"\p{L}+"), F.lit(0))
    hits = {k: F.size(F.array_intersect(words, F.array(*map(F.lit, v)))) for k, v in MARKERS.items()}
    hits["ltz"] = hits["ltz"] + F.when(low.rlike("ë|iewe|aach|oer"), 1).otherwise(0)
    best = F.greatest(*hits.values())
    second = F.element_at(F.sort_array(F.array(*hits.values()), False), 2)
    unclear = (F.size(words) < 3) | (best == 0) | ((best <= 1) & (F.size(words) < 6)) | (best - second < 1)
    return F.when(unclear, "unclear").when(hits["ltz"] == best, "ltz").when(hits["fr"] == best, "fr").otherwise("de")


def prose_score(s: Column) -> Column:
    """Share of letters less twice that of digits among what isn't white space, less 0.3 for short lines; -1 for texts of under 200 characters."""
    visible = F.length(F.regexp_replace(s, r"\s", ""))
    alpha, digit = letters(s), F.length(F.regexp_replace(s, r"[^0-9]", ""))
    lines = F.filter(F.transform(F.split(s, r"[\n\r]+"), lambda x: F.btrim(x, F.lit(" \t"))), lambda x: x != "")
    mean = F.aggregate(lines, F.lit(0), lambda a, x: a + F.length(x)) / F.greatest(F.size(lines), F.lit(1))
    score = alpha / visible - 2.0 * (digit / visible) - F.when(mean < 40, 0.3).otherwise(0.0)
    return F.when(F.length(F.trim(F.coalesce(s, F.lit("")))) < 200, -1.0).otherwise(score)


def first_divergence(a: Column, b: Column) -> Column:
    """Index of the first differing character; null for equal texts."""
    size = F.least(F.length(a), F.length(b))
    same = F.aggregate(
        F.sequence(F.lit(0), F.lit(31)),
        F.struct(F.lit(0).alias("low"), size.alias("high")),
        lambda acc, _: F.when(
            F.substring(a, F.lit(1), ((acc.low + acc.high + 1) / 2).cast("int")) == F.substring(b, F.lit(1), ((acc.low + acc.high + 1) / 2).cast("int")),
            F.struct(((acc.low + acc.high + 1) / 2).cast("int").alias("low"), acc.high.alias("high")),
        ).otherwise(F.struct(acc.low.alias("low"), F.greatest(acc.low, ((acc.low + acc.high + 1) / 2).cast("int") - 1).alias("high"))),
    ).low
    return F.when(a == b, None).otherwise(same)
