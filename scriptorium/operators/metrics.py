"""Error rates: sums of edits over sums of reference characters, overall and by group; confusions; inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.functions.align import distance
from scriptorium.profiles import Language

#: How far our rate may be from the organiser's.
TOLERANCE = 1e-3

def edits(ref: Column, hyp: Column) -> Column:
    """Edit distance of code points; pairs with an empty reference count nothing."""
    return F.when(F.length(ref) > 0, distance(ref, F.coalesce(hyp, F.lit("")))).otherwise(0).cast("long")


def rate(edits: Column, chars: Column) -> Column:
    return F.coalesce(F.try_divide(F.sum(edits), F.sum(chars)), F.lit(0.0))


def cer(pairs: DataFrame, *by: str) -> DataFrame:
    """(by, n, edits, chars, cer) of rows with ed and len."""
    return pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("ed").alias("edits"), F.sum("len").alias("chars"), rate(F.col("ed"), F.col("len")).alias("cer"))


def cer_by_sets(pairs: DataFrame, first: str, others: list[str]) -> DataFrame:
    """Rates by first, and by first with each of the others, in one pass over expanded rows. axis names the other column."""
    axes = F.array(F.struct(F.lit("all").alias("axis"), F.lit("").alias("value")), *(F.struct(F.lit(c).alias("axis"), F.col(c).cast("string").alias("value")) for c in others))
    small = pairs.groupBy(first, *others).agg(F.count(F.lit(1)).alias("n"), F.sum("ed").alias("ed"), F.sum("len").alias("len"))
    return (
        small.withColumn("_x", F.explode(axes)).groupBy(first, F.col("_x.axis").alias("axis"), F.col("_x.value").alias("value"))
        .agg(F.sum("n").alias("n"), F.sum("ed").alias("edits"), F.sum("len").alias("chars"), rate(F.col("ed"), F.col("len")).alias("cer"))
    )


def macro_cer(pairs: DataFrame, *by: str) -> DataFrame:
    """Mean of rows' own rates, as the simple stratified report has it."""
    return pairs.groupBy(*by).agg(F.avg(F.when(F.col("len") > 0, F.col("ed") / F.col("len")).otherwise(0.0)).alias("cer"))


def confusions(aligned: DataFrame, column: str = "pairs", most: int | None = None) -> DataFrame:
    """(ref, hyp, n) of aligned letters that differ; gaps are <INS> and <DEL>. Ties are in order of the letters."""
    pair = aligned.select(F.explode(column).alias("p")).select(F.coalesce("p.a", F.lit("<INS>")).alias("ref"), F.coalesce("p.b", F.lit("<DEL>")).alias("hyp"))
    out = pair.where("ref <> hyp").groupBy("ref", "hyp").agg(F.count(F.lit(1)).alias("n"))
    return out if most is None else out.orderBy(F.desc("n"), "ref", "hyp").limit(most)


def confusion_probabilities(counts: DataFrame, least: int = 5, most: int = 10) -> DataFrame:
    """(hyp, ref, p): the likeliest references of each recognised letter with at least `least` observations."""
    own = Window.partitionBy("hyp")
    ranked = counts.withColumn("_total", F.sum("n").over(own)).withColumn("_rank", F.row_number().over(own.orderBy(F.desc("n"), "ref")))
    return ranked.where((F.col("_total") >= least) & (F.col("_rank") <= most)).select("hyp", "ref", F.round(F.col("n") / F.col("_total"), 5).alias("p"))


def canary_table(aligned: DataFrame, canaries: str, fold: str, to: str, column: str = "pairs", n: str | None = None) -> DataFrame:
    """n: a column with how often a row stands. For each canary letter, and in total: gold, recovered, demoted to its plain form, other and spurious; recall is null without gold."""
    pair = aligned.select(F.explode(column).alias("p"), (F.lit(1) if n is None else F.col(n)).cast("long").alias("_n")).select(F.col("p.a").alias("a"), F.col("p.b").alias("b"), "_n")
    letters = [F.struct(F.lit(c).alias("letter"), F.lit(dict(zip(fold, to, strict=True)).get(c, "")).alias("plain")) for c in canaries]
    hit = pair.where(F.col("a").isin(*canaries) | F.col("b").isin(*canaries)).groupBy("a", "b").agg(F.sum("_n").alias("n"))
    per = hit.withColumn("_l", F.explode(F.array(*letters))).where((F.col("a") == F.col("_l.letter")) | (F.col("b") == F.col("_l.letter")))
    gold, same = F.col("a") == F.col("_l.letter"), F.col("b").eqNullSafe(F.col("_l.letter"))
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    out = per.rollup(F.col("_l.letter").alias("letter")).agg(
        total(gold).alias("gold"), total(gold & same).alias("recovered"), total(gold & ~same & F.col("b").eqNullSafe(F.col("_l.plain"))).alias("demoted"),
        total(gold & ~same & ~F.col("b").eqNullSafe(F.col("_l.plain"))).alias("other"), total(~F.coalesce(gold, F.lit(False)) & same).alias("spurious"),
    )
    return out.select(F.coalesce("letter", F.lit("TOTAL")).alias("letter"), "gold", "recovered", "demoted", "other", "spurious", F.try_divide("recovered", "gold").alias("recall"))


def positional_confusions(pairs: DataFrame, ref: str, hyp: str) -> DataFrame:
    """(ref, hyp, n) of letters at equal places that differ, without alignment."""
    size = F.least(F.length(ref), F.length(hyp))
    letter = lambda c, i: F.substring(F.col(c), i, F.lit(1))
    both = F.transform(F.sequence(F.lit(1), size), lambda i: F.struct(letter(ref, i).alias("ref"), letter(hyp, i).alias("hyp")))
    differing = F.filter(both, lambda p: p.ref != p.hyp)
    return pairs.where((size > 0) & (F.col(ref) != F.col(hyp))).select(F.explode(differing).alias("p")).groupBy("p.ref", "p.hyp").agg(F.count(F.lit(1)).alias("n"))


def char_inventory(texts: DataFrame, text: str, key: str) -> DataFrame:
    """(letter, code, n, first_id): letters are counted within the text before anything is shuffled."""
    letters = texts.select(key, F.explode(F.filter(F.split(text, ""), lambda c: c != "")).alias("letter"))
    out = letters.groupBy("letter").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first_id"))
    return out.select("letter", F.format_string("U+%04X", F.ascii("letter")).alias("code"), "n", "first_id")


def charset_violations(inventory: DataFrame, charset: str) -> DataFrame:
    return inventory.where(~F.col("letter").isin(*charset))


def lexicon(words: DataFrame, word: str = "w", least: int = 2, n: str | None = None) -> DataFrame:
    """(word, n): each word counts as itself and lower-cased (a lower-case one twice), of 2 to 40 letters, at least `least` times. n: a column with how often a row stands."""
    both = words.groupBy(word).agg((F.count(F.lit(1)) if n is None else F.sum(n)).alias("n")).select(F.explode(F.array(F.col(word), F.lower(word))).alias("word"), "n")
    return both.where(F.length("word").between(2, 40)).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def key_lexicon(words: DataFrame, word: str = "w") -> DataFrame:
    """The lexicon of the words' keys, which are built once for each distinct word: building them takes a way through Python."""
    distinct = words.groupBy(word).agg(F.count(F.lit(1)).alias("n"))
    return lexicon(distinct.select(T.lookup_key(F.col(word)).alias(word), "n"), word, n="n")


def oov(words: DataFrame, known: DataFrame, word: str = "w") -> DataFrame:
    """One row: types, tokens and those outside the lexicon; a word is known as it is or lower-cased."""
    types = words.where(F.col(word) != "").groupBy(word).agg(F.count(F.lit(1)).alias("n"))
    seen = types.join(known.select(F.col("word").alias(word), F.lit(True).alias("_a")), word, "left").join(known.select(F.col("word").alias("_low"), F.lit(True).alias("_b")), F.lower(word) == F.col("_low"), "left")
    out = F.col("_a").isNull() & F.col("_b").isNull()
    return seen.agg(
        F.count(F.lit(1)).alias("types"), F.sum("n").alias("tokens"), F.sum(F.when(out, 1).otherwise(0)).alias("oov_types"), F.sum(F.when(out, F.col("n")).otherwise(0)).alias("oov_tokens")
    )


def pair_cer(ref: Column, hyp: Column) -> Column:
    """A pair's own rate; 0 without reference characters."""
    return F.when(F.length(ref) > 0, distance(ref, hyp) / F.length(ref)).otherwise(F.lit(0.0))


def normalised_pairs(rows: DataFrame, ref: str, hyp: str) -> DataFrame:
    """rows with both texts normalised; rows whose reference is empty then are dropped."""
    return _once(rows.withColumns({ref: T.normalised(F.col(ref)), hyp: T.normalised(F.col(hyp), True)})).where(F.length(ref) > 0)


def _once(rows: DataFrame) -> DataFrame:
    """The same rows by a generator, through which filters don't go down: they would compute again what they read."""
    return rows.select(F.explode(F.array(F.struct(*rows.columns))).alias("_x")).select("_x.*")


def normalised_cer(rows: DataFrame, ref: str, hyp: str, *by: str) -> DataFrame:
    kept = normalised_pairs(rows, ref, hyp)
    return cer(kept.select(*by, edits(F.col(ref), F.col(hyp)).alias("ed"), F.length(ref).cast("long").alias("len")), *by)


def dual_cer(rows: DataFrame, ref: str, hyp: str, language: Language, *by: str) -> DataFrame:
    """(by, raw_cer, normalised_cer, delta): without and with blanks behind articles removed on both sides, in one pass."""
    kept = normalised_pairs(rows, ref, hyp)
    a, b = (T.clitic_spaces(F.col(c), language) for c in (ref, hyp))
    counted = kept.select(*by, edits(F.col(ref), F.col(hyp)).alias("_e"), F.length(ref).alias("_n"), edits(a, b).alias("_ec"), F.length(a).alias("_nc"))
    rates = counted.groupBy(*by).agg(rate(F.col("_e"), F.col("_n")).alias("raw_cer"), rate(F.col("_ec"), F.col("_nc")).alias("normalised_cer"))
    return rates.withColumn("delta", F.col("raw_cer") - F.col("normalised_cer"))


def normalised_triples(rows: DataFrame, ref: str, variant: str, baseline: str, language: Language) -> DataFrame:
    """(id, ev, eb, len) of normalised texts without blanks behind articles."""
    clean = lambda c, h: T.clitic_spaces(T.normalised(F.col(c), h), language).alias(c)
    kept = _once(rows.select("id", clean(ref, False), clean(variant, True), clean(baseline, True))).where(F.length(ref) > 0)
    return kept.select("id", edits(F.col(ref), F.col(variant)).alias("ev"), edits(F.col(ref), F.col(baseline)).alias("eb"), F.length(ref).cast("long").alias("len"))


def letters_in(s: Column, letters: str) -> Column:
    """Those of the letters that a text has."""
    return F.filter(F.array(*(F.when(F.contains(s, F.lit(c)), F.lit(c)) for c in letters)), lambda c: c.isNotNull())


def subset_cer(rows: DataFrame, ref: str, hyp: str, letters: str) -> DataFrame:
    """(letter, n, cer) over the references with each letter; nan where none has it."""
    counted = rows.select(letters_in(F.col(ref), letters).alias("_l"), edits(F.col(ref), F.col(hyp)).alias("ed"), F.length(ref).alias("len"))
    got = counted.select(F.explode("_l").alias("letter"), "ed", "len").groupBy("letter").agg(F.count(F.lit(1)).alias("n"), F.sum("ed").alias("ed"), F.sum("len").alias("len"))
    every = rows.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, letters))).alias("letter"))
    return every.join(got, "letter", "left").select("letter", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.col("ed") / F.col("len"), F.lit(float("nan"))).alias("cer"))
