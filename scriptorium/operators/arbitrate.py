"""Arbitration of several hypothesis streams, word by word, with a lexicon as gate.

Decisions depend on a pair of words alone, so they are taken once for each distinct pair and joined back;
the lexicon is joined to distinct words. Votes are counted by position; ties go to the first stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.profiles import GENERIC, Language

MOST_EDITS = 2


def closure(lexicon: DataFrame, word: str = "word") -> DataFrame:
    return lexicon.select(F.explode(F.array(F.col(word), F.lower(word))).alias("word")).distinct()


def base_text(streams: Column, ratio: float = 0.6) -> Column:
    """The anchor, or the primary stream where it is empty, unless the longest of over ten letters is so long that the base has under ratio of it. streams: ordered array<struct<ord,hyp>>, the anchor first."""
    first = F.get(F.filter(streams, lambda x: F.length(x.hyp) > 0), F.lit(0)).hyp
    order = F.sort_array(F.transform(streams, lambda x: F.struct((-F.length(x.hyp)).alias("n"), x.ord.alias("ord"), x.hyp.alias("hyp"))))
    longest = F.get(order, F.lit(0))
    return F.when((-longest.n > 10) & (F.coalesce(F.length(first), F.lit(0)) < ratio * -longest.n), longest.hyp).otherwise(F.coalesce(first, F.lit("")))


def candidates(base: Column, streams: Column) -> Column:
    """Streams that aren't empty or equal to the base, each once, in order."""
    return F.array_distinct(F.filter(streams, lambda x: F.coalesce((x != "") & (x != base), F.lit(False))))


def fallback(anchor: Column, other: Column, ratio: float = 0.6) -> Column:
    """The anchor, unless it is empty or has under ratio of the other stream's letters."""
    a, b = F.coalesce(anchor, F.lit("")), F.coalesce(other, F.lit(""))
    return F.when((a == "") | ((F.length(b) > 10) & (F.length(a) < ratio * F.length(b))), b).otherwise(a)


def guarded(anchor: Column, candidate: Column, anchor_known: Column, candidate_known: Column, language: Language = GENERIC) -> Column:
    """Whether the guards alone let the candidate stand for the anchor; accents aren't restored."""
    return decide(anchor, candidate, anchor_known, candidate_known, language, restore=False) != anchor


def routed(words: DataFrame, lexicon: DataFrame, key: str, anchor: str, streams: list[str], language: Language = GENERIC) -> DataFrame:
    """(key, word): streams taken one after the other, each against what the ones before it left."""
    now = words.select(key, F.col(anchor).alias("anchor"), *streams)
    for s in streams:
        swaps = decisions(now.select("anchor", F.col(s).alias("candidate")), lexicon, language).where("swap <> anchor")
        named = swaps.withColumnRenamed("candidate", s)
        now = now.join(named, ["anchor", s], "left").withColumn("anchor", F.coalesce("swap", "anchor")).drop("swap")
    return now.select(key, F.col("anchor").alias("word"))


def decide(anchor: Column, candidate: Column, anchor_known: Column, candidate_known: Column, language: Language = GENERIC, restore: bool = True) -> Column:
    """The word to stand for anchor: the candidate if it restores accents, or if it alone is known and passes the guards."""
    a, c = T.lookup_key(anchor), T.lookup_key(candidate)
    close = lambda x, y: F.levenshtein(x, y) <= MOST_EDITS
    restores = (a != "") & (c != "") & (T.folded(F.lower(a), language) == T.folded(F.lower(c), language))
    restores = restores & (T.canaries(candidate, language) > T.canaries(anchor, language)) & candidate_known & close(a, c)
    la, lc = T.letters(anchor), T.letters(candidate)
    guards = (lc >= la) & (la >= 3) & (lc >= 3) & (F.length(candidate) >= F.length(anchor) - 1) & (F.abs(F.length(anchor) - F.length(candidate)) <= 2)
    guards = guards & (T.accented_letters(candidate) >= T.accented_letters(anchor)) & F.levenshtein(anchor, candidate).between(1, MOST_EDITS)
    out = F.when(candidate.isNull() | (candidate == "") | (candidate == anchor), anchor)
    if restore:
        out = out.when(restores, candidate)
    return out.when(anchor_known, anchor).when(~candidate_known, anchor).when(guards, candidate).otherwise(anchor)


def known_words(words: DataFrame, lexicon: DataFrame, word: str) -> DataFrame:
    """(word, known) for distinct words: the key as it is or lower-cased is in the lexicon."""
    own = words.select(word).distinct().withColumn("_key", T.lookup_key(F.col(word)))
    lex = lexicon.select("word").distinct()
    as_is = own.join(lex.select(F.col("word").alias("_key"), F.lit(1).alias("_a")), "_key", "left")
    low = as_is.join(lex.select(F.col("word").alias("_low"), F.lit(1).alias("_b")), F.lower("_key") == F.col("_low"), "left")
    return low.select(word, ((F.col("_key") != "") & (F.col("_a").isNotNull() | F.col("_b").isNotNull())).alias("known"))


def decisions(pairs: DataFrame, lexicon: DataFrame, language: Language = GENERIC, restore: bool = True) -> DataFrame:
    """(anchor, candidate, swap) for distinct differing pairs."""
    distinct = pairs.where("anchor <> candidate").select("anchor", "candidate").distinct()
    words = distinct.select(F.explode(F.array("anchor", "candidate")).alias("word"))
    known = known_words(words, lexicon, "word")
    both = distinct.join(known.select(F.col("word").alias("anchor"), F.col("known").alias("_a")), "anchor").join(known.select(F.col("word").alias("candidate"), F.col("known").alias("_c")), "candidate")
    return both.select("anchor", "candidate", decide(F.col("anchor"), F.col("candidate"), F.col("_a"), F.col("_c"), language, restore).alias("swap"))


def swapped(tokens: DataFrame, lexicon: DataFrame, keys: tuple[str, ...] = ("id", "pos"), language: Language = GENERIC, restore: bool = True, frequency: DataFrame | None = None) -> DataFrame:
    """(keys, voted) of the places whose anchor gives way, from rows (keys, anchor, ord, candidate): the commonest swap, of equals (with frequency: the commoner word, then) that of the first stream. Only tokens that swap are put together by place."""
    swaps = tokens.where("anchor <> candidate").join(decisions(tokens, lexicon, language, restore).where("swap <> anchor"), ["anchor", "candidate"])
    counted = swaps.groupBy(*keys, "swap").agg(F.count(F.lit(1)).alias("votes"), F.min("ord").alias("ord"))
    order = [F.desc("votes"), "ord"]
    if frequency is not None:
        counted = counted.join(frequency.select(F.col("word").alias("swap"), F.col("n").alias("_n")), "swap", "left")
        order = [F.desc("votes"), F.desc(F.coalesce("_n", F.lit(0))), "ord"]
    return counted.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").select(*keys, F.col("swap").alias("voted"))


def vote(tokens: DataFrame, lexicon: DataFrame, keys: tuple[str, ...] = ("id", "pos"), language: Language = GENERIC, restore: bool = True, frequency: DataFrame | None = None) -> DataFrame:
    """(keys, anchor, voted) of all places: what swapped has, else the anchor."""
    best = swapped(tokens, lexicon, keys, language, restore, frequency).withColumnRenamed("voted", "_swap")
    anchors = tokens.select(*keys, "anchor").dropDuplicates(list(keys))
    return anchors.join(best, list(keys), "left").select(*keys, "anchor", F.coalesce("_swap", "anchor").alias("voted"))


def corrected_words(words: DataFrame, confusions: DataFrame, lexicon: DataFrame, threshold: float = 0.05) -> DataFrame:
    """(word, fixed) for distinct unknown words of three letters or more: the likeliest substitution of one letter that the lexicon has and the guards allow. confusions: (hyp, ref, p)."""
    known = known_words(words, lexicon, "word")
    odd = known.where(~F.col("known") & (F.length("word") >= 3)).select("word")
    at = odd.select("word", F.posexplode(F.filter(F.split("word", ""), lambda c: c != "")).alias("at", "hyp"))
    tried = at.join(F.broadcast(confusions.where((F.col("p") >= threshold) & (F.col("hyp") != F.col("ref")) & (F.length("hyp") == 1))), "hyp")
    new = tried.select("word", "at", "p", "ref", F.concat(F.substring("word", F.lit(1), F.col("at")), F.col("ref"), F.substring("word", F.col("at") + 2, F.length("word"))).alias("fixed"))
    good = new.join(known_words(new, lexicon, "fixed").where("known").select("fixed"), "fixed")
    w, f = F.col("word"), F.col("fixed")
    good = good.where((T.letters(f) >= T.letters(w)) & (T.letters(f) >= 3) & (T.accented_letters(f) >= T.accented_letters(w)) & (F.abs(F.length(f) - F.length(w)) <= 1) & (F.levenshtein(w, f) <= MOST_EDITS))
    return good.withColumn("_r", F.row_number().over(Window.partitionBy("word").orderBy(F.desc("p"), "at", "ref"))).where("_r = 1").select("word", "fixed")


def disagreement(tokens: DataFrame, keys: tuple[str, ...] = ("id", "pos")) -> DataFrame:
    """(ord_a, ord_b, positions, differing) of each two streams at equal places; the streams of a place are a small array, so nothing is joined."""
    streams = tokens.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("ord", "candidate"))).alias("s"))
    two = F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b.ord > a.ord), lambda b: F.struct(a.ord.alias("ord_a"), b.ord.alias("ord_b"), (a.candidate != b.candidate).cast("long").alias("d")))))
    return streams.select(F.explode(two).alias("x")).groupBy("x.ord_a", "x.ord_b").agg(F.count(F.lit(1)).alias("positions"), F.sum("x.d").alias("differing"))


def array_disagreement(rows: DataFrame, streams: str, names: tuple[int, ...]) -> DataFrame:
    """The same where each row has a place's streams, named in order, as an array: sums of columns, so nothing but a row a task is shuffled. Missing ones are null."""
    both = [(i, j) for i in range(len(names)) for j in range(i + 1, len(names))]
    at = lambda k: F.get(streams, F.lit(k))
    sums = rows.agg(*(f.alias(f"{c}{k}") for k, (i, j) in enumerate(both) for c, f in (("n", F.count(at(i) != at(j))), ("d", F.coalesce(F.count_if(at(i) != at(j)), F.lit(0))))))
    each = F.array(*(F.struct(F.lit(names[i]).alias("ord_a"), F.lit(names[j]).alias("ord_b"), F.col(f"n{k}").alias("positions"), F.col(f"d{k}").alias("differing")) for k, (i, j) in enumerate(both)))
    return sums.select(F.explode(each).alias("x")).select("x.*").where("positions > 0")
