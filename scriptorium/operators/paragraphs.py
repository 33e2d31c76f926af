"""Lines and paragraphs as array expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from scriptorium.functions.text import collapsed

# Words whose closing hyphen stays when a line ends there.
CLITICS = tuple(
    "il is id it in ir iż iz ix iċ tal tas tat tad tar tan tax taċ taż tah tagħ mal mas mat mad mar man max maċ maż bil bis bit bid bir bin bix biċ biż "
    "fil fis fit fid fir fin fix fiċ fiż għal għall għas għat għad għar għan għax lil lill lis lit lid lir lin lix liċ liż sal sas sat sad sar san sax "
    "saċ saż l s t d r n x ċ ż".split()
)


_DASHES = str.maketrans("–", "—", "­")
_WHITE, _WHITES = re.compile(r"[ \t\n\x0b\f\r]"), re.compile(r"[ \t\n\x0b\f\r]+")
_BORNE = re.compile(r"[0-9]\Z|://|www\.")


def joined(lines: Iterable[str | None], clitics: frozenset[str]) -> str:
    """The paragraph of join_lines. What decides how a line goes on is the run without white space at the end of the text so far, so that alone is held, in parts as well."""
    out, run, blank = [], [], False  # run: parts of the last run; blank: a space stands before it
    for line in lines:
        line = (line or "").translate(_DASHES).strip(" ")
        if not line:
            continue
        glue = not out
        if out:
            last = run[-1] if run else ""
            alone = len(run) == 1 and len(last) == 1 and blank
            if last.endswith("—") and not alone:
                glue = True
            elif last.endswith("-") and not alone:
                glue, tail = True, "".join(run)[:-1].lower()
                bare = len(tail)
                while bare and tail[bare - 1].isalpha():
                    bare -= 1
                if not (tail == "" or tail[bare:] in clitics or _BORNE.search(tail)):
                    out[-1], run[-1] = out[-1][:-1], last[:-1]
        if not glue:
            out.append(" ")
            run, blank = [], True
        out.append(line)
        pieces = _WHITE.split(line)
        if len(pieces) > 1:
            run, blank = [pieces[-1]] if pieces[-1] else [], line[len(line) - len(pieces[-1]) - 1] == " "
        else:
            run.append(line)
    return "".join(out)


@lru_cache
def _joiner(clitics: frozenset[str]):
    return F.pandas_udf(lambda rows: pd.Series([None if x is None else joined(x, clitics) for x in rows], dtype=object), StringType())


def join_lines(lines: Column, clitics: tuple[str, ...] = CLITICS) -> Column:
    """Lines as one paragraph: soft hyphens go, en dashes become em dashes; behind a hyphen nothing is put between, and the hyphen goes unless a clitic, a digit or an address bears it. In Arrow batches: a fold of columns would copy and search the text so far at each line."""
    return _joiner(frozenset(clitics))(lines)


def gold_from_parts(parts: Column, between: str = " ") -> Column:
    return collapsed(F.translate(F.array_join(parts, between), "­", ""))


def chunks(text: Column, least: int = 200, most: int = 1200) -> Column:
    """Paragraphs of least to most characters: blocks between blank lines, long ones cut at sentence ends and packed again as soon as they reach least."""

    def packed(block: Column) -> Column:
        start = F.struct(F.lit("").alias("held"), F.array().cast("array<string>").alias("out"))

        def step(a: Column, s: Column) -> Column:
            joined = F.when(a.held == "", s).otherwise(F.concat(a.held, F.lit(" "), s))
            fits = F.length(a.held) + 1 + F.length(s) <= most
            whole = fits & (F.length(joined) >= least)
            told = F.when(whole, F.array(joined)).when(~fits & (F.length(a.held) >= least), F.array(a.held)).otherwise(F.array().cast("array<string>"))
            return F.struct(F.when(whole, "").when(fits, joined).otherwise(s).alias("held"), F.concat(a.out, told).alias("out"))

        done = F.aggregate(F.filter(F.split(block, r"(?<=[.!?])\s+"), lambda s: s != ""), start, step)
        rest = F.when(F.length(done.held).between(least, most), F.array(done.held)).otherwise(F.array().cast("array<string>"))
        return F.concat(done.out, rest)

    blocks = F.transform(F.split(text, r"\n\s*\n+"), collapsed)
    none = F.array().cast("array<string>")
    return F.flatten(F.transform(blocks, lambda b: F.when(F.length(b).between(least, most), F.array(b)).when(F.length(b) < least, none).otherwise(packed(b))))


def filled(text: str, width: int) -> list[str]:
    """The lines of wrapped."""
    out, held, size = [], [], 0
    for w in filter(None, _WHITES.split(text)):
        if held and size + 1 + len(w) > width:
            out.append(" ".join(held))
            held = []
        size = size + 1 + len(w) if held else len(w)
        held.append(w)
    return [*out, " ".join(held)] if held else out


@lru_cache
def _filler(width: int):
    return F.pandas_udf(lambda texts: pd.Series([None if x is None else filled(x, width) for x in texts], dtype=object), ArrayType(StringType()))


def wrapped(text: Column, width: int) -> Column:
    """Lines of at most width characters, filled greedily; a longer word has a line of its own."""
    return _filler(width)(text)


def wrap_points(lines: Column) -> Column:
    """array<struct<line, last, next>>: dashes behind a letter at the end of lines but the last, with the words beside them."""
    at = F.transform(lines, lambda x, i: F.struct(i.alias("line"), F.regexp_extract(F.rtrim(x), r"(\S*\p{L}[-–—])$", 1).alias("last"), F.regexp_extract(F.ltrim(F.get(lines, i + 1)), r"^(\S*)", 1).alias("next")))
    return F.filter(at, lambda p: (p.last != "") & p.next.isNotNull())


def pieces(words: Column, size: int, skip: int = 0) -> Column:
    """Runs of size words behind the first skip ones."""
    rest = F.slice(words, skip + 1, F.greatest(F.size(words) - skip, F.lit(0)))
    many = F.transform(F.sequence(F.lit(1), F.greatest(F.size(rest), F.lit(1)), F.lit(size)), lambda i: F.array_join(F.slice(rest, i, size), " "))
    return F.filter(many, lambda x: F.length(x) >= 3)


def links(html: Column, pattern: str = r"(?i)href=[\"']([^\"'#?]+)[\"']") -> Column:
    return F.regexp_extract_all(html, F.lit(pattern), F.lit(1))


def visible_text(html: Column) -> Column:
    """Text without scripts, styles, comments and tags; five named entities are decoded and white space collapsed."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(?:script|style)>|(?s)<!--.*?-->", " "), r"<[^>]*>", " ")
    for entity, letter in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(letter))
    return F.trim(F.regexp_replace(bare, r"\s+", " "))
