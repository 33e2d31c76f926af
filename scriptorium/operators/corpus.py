"""The corpus chain and the inspection of texts: packing, gates, interleaving, letter statistics, label edits."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from scriptorium.operators.resample import number

#: Dashes by name.
DASHES = {"hyphen": "-", "en_dash": "–", "em_dash": "—", "minus": "−", "soft_hyphen": "­"}


def occurrences(s: Column, part: str) -> Column:
    return ((F.length(s) - F.length(F.replace(s, F.lit(part), F.lit("")))) / len(part)).cast("long")


def packed(sentences: Column, most: int = 1000, least: int = 150) -> Column:
    """Consecutive sentences put together while at most `most` characters; what has at least `least` is told."""
    start = F.struct(F.lit("").alias("held"), F.array().cast("array<string>").alias("out"))
    done = lambda a: F.when(F.length(a.held) >= least, F.concat(a.out, F.array(a.held))).otherwise(a.out)

    def step(a: Column, s: Column) -> Column:
        fits = F.length(a.held) + 1 + F.length(s) <= most
        return F.struct(F.when(~fits, s).when(a.held == "", s).otherwise(F.trim(F.concat(a.held, F.lit(" "), s))).alias("held"), F.when(fits, a.out).otherwise(done(a)).alias("out"))

    return F.aggregate(sentences, start, step, done)


def letter_rates(s: Column, letters: str) -> Column:
    """array<struct<letter, rate>>: occurrences in 1,000 characters."""
    n = F.greatest(F.length(s), F.lit(1))
    return F.array(*(F.struct(F.lit(c).alias("letter"), (F.lit(1000.0) * occurrences(s, c) / n).alias("rate")) for c in letters))


def macro_scan(rows: DataFrame, source: str, key: str, text: str, letters: str, watched: str, chars: int = 10_000) -> DataFrame:
    """(source, letter, rate, low): rates in the first `chars` characters of each source, in order of key; low: the watched letter is suspiciously rare."""
    length = F.length(F.coalesce(text, F.lit("")))
    before = F.coalesce(F.sum(length + 1).over(Window.partitionBy(source).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = rows.withColumn("_before", before).where(F.col("_before") < chars)
    joined = first.groupBy(source).agg(F.sort_array(F.collect_list(F.struct(key, text))).alias("_t"))
    head = F.substring(F.concat(F.lit(" "), F.array_join(F.transform("_t", lambda x: x[text]), " ")), 1, chars)
    rates = joined.select(source, F.explode(letter_rates(head, letters)).alias("x")).select(source, "x.letter", "x.rate")
    return rates.withColumn("low", (F.col("letter") == watched) & (F.col("rate") < 0.5))


def sign_counts(rows: DataFrame, text: str, parts: dict[str, str]) -> DataFrame:
    """(item, n): occurrences of letters, digraphs and dashes in all texts, summed within the row before anything is shuffled."""
    return _items(rows, {k: occurrences(F.col(text), p) for k, p in parts.items()})


def _items(rows: DataFrame, values: dict[str, Column]) -> DataFrame:
    """(item, n): sums of the values over all rows. Names may differ in case alone, so columns go by number."""
    sums = rows.agg(*(F.coalesce(F.sum(v), F.lit(0)).cast("long").alias(f"c{k}") for k, v in enumerate(values.values())))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(name).alias("item"), F.col(f"c{k}").alias("n")) for k, name in enumerate(values)))).alias("x")).select("x.*")


def fallback_ratios(inventory: DataFrame, fold: str, to: str) -> DataFrame:
    """(letter, plain, ratio): plain letters over each accented one; null without either, infinite without the accented one."""
    two = inventory.sparkSession.range(1).select(F.explode(F.array(*(F.struct(F.lit(a).alias("letter"), F.lit(b).alias("plain")) for a, b in zip(fold, to, strict=True)))).alias("x")).select("x.*")
    own, bare = inventory.select("letter", F.col("n").alias("_a")), inventory.select(F.col("letter").alias("plain"), F.col("n").alias("_b"))
    both = two.join(own, "letter", "left").join(bare, "plain", "left")
    ratio = F.when(F.col("_a").isNotNull(), F.coalesce("_b", F.lit(0)) / F.col("_a")).when(F.col("_b").isNotNull(), F.lit(float("inf")))
    return both.select("letter", "plain", ratio.alias("ratio"))


def hyphen_statistics(rows: DataFrame, text: str, lines: str, prefixes: tuple[str, ...]) -> DataFrame:
    """(item, n): dashes, lines but the last that end in each dash, texts with such a line, texts with each article prefix."""
    inner = F.transform(F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: F.right(F.rtrim(x), F.lit(1)))
    ending = lambda d: F.size(F.filter(inner, lambda c: c == d))
    ends = {f"line_{k}": ending(DASHES[k]) for k in ("hyphen", "en_dash", "em_dash")}
    low = F.lower(F.col(text))
    prefix = {f"prefix_{p}": low.rlike(rf"(?:^|[\s(\[\"]){p}-[a-zàèìòùċġħż]").cast("int") for p in prefixes}
    values = {k: occurrences(F.col(text), d) for k, d in DASHES.items()} | ends | {"line_any": F.exists(inner, lambda c: c.isin("-", "–", "—")).cast("int")} | prefix
    return _items(rows, values)


def charset_packs(letters: DataFrame, letter: str, size: int = 22) -> DataFrame:
    """(line, text): the letters of a charset (some hundred rows), in order, size to a line."""
    ranked = letters.select(letter, ((F.row_number().over(Window.orderBy(letter)) - 1) / size).cast("int").alias("line"))
    return ranked.groupBy("line").agg(F.array_join(F.sort_array(F.collect_list(letter)), "").alias("text"))


@F.pandas_udf(DoubleType())
def block_coverage(block: pd.Series, text: pd.Series) -> pd.Series:
    """Share of a block in matching runs of eight or more characters of the text, to three places; 0 for blocks of under 15."""

    def one(a: str, b: str) -> float:
        if a is None or len(a) < 15:
            return 0.0
        runs = difflib.SequenceMatcher(None, a, b or "", autojunk=False).get_matching_blocks()
        return round(sum(m.size for m in runs if m.size >= 8) / len(a), 3)

    return pd.Series([one(a, b) for a, b in zip(block, text, strict=True)], dtype="float64")


def injected_article(text: Column, key: Column, rate: float, prefixes: tuple[str, ...], seed: str = "article") -> Column:
    """With the chance of rate, an article before the second word of texts that have none."""
    u, pick = number(seed, key) / float(2**32), F.pmod(number(seed + "-which", key), F.lit(len(prefixes))) + 1
    has = F.lit(False)
    for p in prefixes:
        has = has | F.contains(F.lower(text), F.lit(p))
    two = F.split(text, " ", 2)
    return F.when((u < rate) & ~has & (F.size(two) == 2), F.concat(F.get(two, F.lit(0)), F.lit(" "), F.element_at(F.array(*map(F.lit, prefixes)), pick.cast("int")), F.get(two, F.lit(1)))).otherwise(text)


def substituted_dash(text: Column, key: Column, p: float, seed: str = "dash") -> Column:
    """With the chance of p, the first spaced hyphen as an em dash; an en dash never gets into a label."""
    at = F.instr(text, " - ")
    changed = F.concat(F.substring(text, F.lit(1), at - 1), F.lit(" — "), F.substring(text, at + 3, F.length(text)))
    return F.when((at > 0) & (number(seed, key) / float(2**32) < p), changed).otherwise(text)


def printed_dashes(lines: Column, key: Column, p: float, seed: str = "printed") -> Column:
    """With the chance of p a line, em dashes as en dashes, in what is printed only."""
    return F.transform(lines, lambda x, i: F.when(F.contains(x, F.lit("—")) & (number(seed, key, i) / float(2**32) < p), F.translate(x, "—", "–")).otherwise(x))


def dictionary_joined(lines: Column, known: Column) -> Column:
    """Lines as one text; a word split by a hyphen at a line's end is joined if its lower-cased whole is in the array known, else both halves stay."""
    words = F.filter(F.transform(lines, lambda x: F.filter(F.split(x, r"\s+"), lambda w: w != "")), lambda ws: F.size(ws) > 0)

    def step(out: Column, line: Column) -> Column:
        last = F.element_at(out, -1)
        whole = F.concat(F.substring(last, F.lit(1), F.length(last) - 1), F.get(line, F.lit(0)))
        glued = F.concat(F.slice(out, 1, F.size(out) - 1), F.array(whole), F.slice(line, 2, F.size(line)))
        return F.when((F.size(out) > 0) & F.coalesce(F.endswith(last, F.lit("-")), F.lit(False)) & F.array_contains(known, F.lower(whole)), glued).otherwise(F.concat(out, line))

    return F.array_join(F.aggregate(words, F.array().cast("array<string>"), step), " ")


def _letter(code: Column) -> Column:
    """The letter of a code point."""
    beyond = code - 0x10000
    two = F.concat(F.hex(F.lit(0xD800) + F.shiftright(beyond, 10)), F.hex(F.lit(0xDC00) + beyond.bitwiseAND(F.lit(0x3FF))))
    return F.decode(F.unhex(F.when(code < 0x10000, F.lpad(F.hex(code), 4, "0")).otherwise(two)), "UTF-16BE")


def formex_text(xml: Column, tags: tuple[str, ...] = ("TITLE", "TI", "ALINEA", "P", "TXT", "STI")) -> Column:
    """Lines of the elements that carry prose: notes go, tags become blanks, five entities and numeric references are decoded, white space collapses."""
    bare = F.regexp_replace(xml, r"(?s)<NOTE\b.*?</NOTE>", "")
    found = F.regexp_extract_all(bare, F.lit(rf"(?s)<({'|'.join(tags)})(?:\s[^>]*)?>(.*?)</\1>"), F.lit(2))

    def clean(x: Column) -> Column:
        x = F.regexp_replace(x, "<[^>]+>", " ")
        for entity, letter in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
            x = F.replace(x, F.lit(entity), F.lit(letter))
        codes = F.array_distinct(F.regexp_extract_all(x, F.lit(r"&#(\d+);"), F.lit(1)))
        x = F.aggregate(codes, x, lambda t, c: F.replace(t, F.concat(F.lit("&#"), c, F.lit(";")), _letter(c.cast("int"))))
        return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))

    return F.array_join(F.filter(F.transform(found, clean), lambda x: x != ""), "\n")


def round_trip_report(rows: DataFrame, parts: str, label: str, joined: Column) -> DataFrame:
    """One row: texts with soft hyphens and those that are recovered, texts of several lines and those that the joiner puts together (blanks aside), with both shares."""
    bare = lambda s: F.regexp_replace(s, r"(?U)[\s­]+", "")
    flat = lambda s: F.translate(s, "\n­", "")
    soft, many = F.exists(parts, lambda x: F.contains(x, F.lit("­"))), F.size(parts) > 1
    recovered = flat(F.array_join(parts, "")) == flat(F.col(label))
    good = bare(joined) == bare(F.array_join(parts, ""))
    counts = rows.select(soft.alias("a"), (soft & recovered).alias("b"), many.alias("c"), (many & good).alias("d"))
    out = counts.agg(F.count(F.lit(1)).alias("n_samples"), *(F.count_if(F.col(c)).alias(k) for c, k in zip("abcd", ("soft_hyphen_samples", "soft_hyphen_pass", "joiner_samples", "joiner_pass"), strict=True)))
    share = lambda a, b: F.round(F.col(a) / F.greatest(F.col(b), F.lit(1)), 4)
    return out.withColumns({"soft_hyphen_pass_rate": share("soft_hyphen_pass", "soft_hyphen_samples"), "joiner_pass_rate": share("joiner_pass", "joiner_samples")})


def weighted_interleave(rows: DataFrame, source: str, key: str, weights: dict[str, float], n: int, extra: DataFrame | None = None, share: float = 0.0, seed: str = "mix") -> DataFrame:
    """(slot, source, key) of n slots: first the extra table with the chance of share, else a source by weight; a source that is used up begins again.

    Slots are hash draws. A source's slots are numbered, and slot number modulo its rows finds the row: one equi-join, no iterator.
    """
    total, low = sum(weights.values()), 0.0
    u, v = number(seed, F.col("slot")) / float(2**32), number(seed + "-source", F.col("slot")) / float(2**32)
    chosen = F.when(u < share, F.lit("extra")) if extra is not None and share > 0 else F.when(F.lit(False), F.lit(""))
    for name, weight in weights.items():
        low += weight
        chosen = chosen.when(v <= low / total, F.lit(name))
    slots = rows.sparkSession.range(n).select(F.col("id").alias("slot")).withColumn(source, chosen.otherwise(F.lit(list(weights)[-1])))
    slots = slots.withColumn("_k", F.row_number().over(Window.partitionBy(source).orderBy("slot")) - 1)
    pool = rows.where(F.col(source).isin(*weights)).select(source, key)
    if extra is not None and share > 0:
        pool = pool.union(extra.select(F.lit("extra"), key))
    pool = pool.withColumn("_at", F.row_number().over(Window.partitionBy(source).orderBy(key)) - 1)
    sizes = pool.groupBy(source).agg(F.count(F.lit(1)).alias("_n"))
    placed = slots.join(sizes, source).withColumn("_at", F.pmod(F.col("_k"), F.col("_n")).cast("int"))
    return placed.join(pool, [source, "_at"]).select("slot", source, key)


def first_of_buckets(rows: DataFrame, bucket: str, key: str, n: int = 120, buckets: int = 4) -> DataFrame:
    """The first n / buckets rows of each bucket by key."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(bucket).orderBy(key))).where(F.col("_r") <= n // buckets).drop("_r")


def otsu(counts: DataFrame, group: str, level: str, n: str) -> DataFrame:
    """(group, threshold): the level of largest variance between classes, from a histogram of at most 256 levels a group; the lowest of equals, 127 if one class stays empty."""
    up = Window.partitionBy(group).orderBy(level)
    every = Window.partitionBy(group)
    rows = counts.withColumns({"_b": F.sum(n).over(up), "_sb": F.sum(F.col(level) * F.col(n)).over(up), "_t": F.sum(n).over(every), "_s": F.sum(F.col(level) * F.col(n)).over(every)})
    front = F.col("_t") - F.col("_b")
    between = F.col("_b") * front * F.pow(F.col("_sb") / F.col("_b") - (F.col("_s") - F.col("_sb")) / front, 2)
    scored = rows.withColumn("_v", F.when((F.col("_b") > 0) & (front > 0), between))
    return scored.groupBy(group).agg(F.coalesce(F.min_by(level, F.when(F.col("_v").isNotNull(), F.struct(-F.col("_v"), F.col(level)))), F.lit(127)).alias("threshold"))
