"""The whole chain from several readings of a text to one: base, vote by windows, label rules; and what each rule is worth.

Alignments are made once for each distinct pair of line and window, in Arrow batches; decisions between words once
for each distinct pair of words, and joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import align
from scriptorium.functions import text as T
from scriptorium.operators import arbitrate, metrics
from scriptorium.profiles import GENERIC, Language

RULES = ("lead", "apostrophe", "positional_quote", "diacritic_vote", "double_quote")
#: Differences of rates up to this are none.
EPSILON = 1e-5


def tokens_of(rows: DataFrame, key: str, anchor: str, candidates: str) -> DataFrame:
    """(key, line, pos, anchor, ord, candidate): each word of the anchor with the word of each candidate that is aligned to it, from windows of twice a line that move on by the line.

    candidates: array<string>, in order of the streams. A word without a partner has candidate null.
    """
    lines = F.transform(F.split(anchor, "\n"), T.tokens)
    streams = F.transform(candidates, T.tokens)
    aligned = rows.select(key, lines.alias("_lines"), align.windowed(lines, streams).alias("_w"))
    words = aligned.select(key, F.flatten(F.transform("_lines", lambda line, k: F.transform(line, lambda w, p: F.struct(k.alias("line"), p.alias("pos"), w.alias("anchor"))))).alias("_a"), "_w")
    each = words.select(key, "_w", F.posexplode("_a").alias("_at", "_x")).select(key, "_at", "_x.*", F.posexplode_outer("_w").alias("ord", "_s"))
    return each.select(key, "line", "pos", "anchor", F.coalesce("ord", F.lit(0)).alias("ord"), F.get("_s", F.col("_at")).alias("candidate"))


def voted_texts(rows: DataFrame, lexicon: DataFrame, key: str = "id", language: Language = GENERIC, restore: bool = True) -> DataFrame:
    """(key, text): the base with each word replaced by the commonest swap its candidates propose; rows (key, base, candidates)."""
    tokens = tokens_of(rows, key, "base", "candidates")
    keys = (key, "line", "pos")
    best = arbitrate.vote(tokens, lexicon, keys, language, restore)
    line = best.groupBy(key, "line").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "voted"))), lambda x: x.voted), " ").alias("_t"))
    count = rows.select(key, F.size(F.split("base", "\n")).alias("_n"))
    text = line.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("line", "_t"))).alias("_m"))
    every = count.join(text, key, "left")
    whole = F.array_join(F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda k: F.coalesce(F.try_element_at("_m", k), F.lit(""))), "\n")
    return every.select(key, whole.alias("text"))


def label_rules(text: Column, without: str | None = None) -> Column:
    """Lead marker, apostrophes and double quotes, in order; one of them may be left out."""
    out = text if without == "lead" else T.lead_marker(text)
    if without == "positional_quote":
        out = T.closing_apostrophe(out)
    elif without != "apostrophe":
        out = T.curly_apostrophe(out)
    return out if without == "double_quote" else T.curly_quote(out)


def with_base(rows: DataFrame) -> DataFrame:
    """rows (id, streams) with base and candidates; rows without any reading have an empty base."""
    base = arbitrate.base_text(F.col("streams"))
    with_it = rows.withColumn("base", F.coalesce(base, F.lit("")))
    return with_it.withColumn("candidates", arbitrate.candidates(F.col("base"), F.transform("streams", lambda s: s.hyp)))


def transcribe(rows: DataFrame, lexicon: DataFrame, language: Language = GENERIC, without: str | None = None, rules: bool = True) -> DataFrame:
    """rows (id, streams, ...) with text: the whole chain; without one rule, or (rules=False) recognition alone."""
    ready = with_base(rows)
    text = voted_texts(ready, lexicon, "id", language, restore=without != "diacritic_vote")
    return ready.join(text.withColumn("text", label_rules(F.col("text"), without) if rules else F.col("text")), "id").drop("base", "candidates")


def rule_triggers(rows: DataFrame, gold: str) -> DataFrame:
    """(n, lead, apostrophe, double_quote): texts with what each label rule changes."""
    g = F.col(gold)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(g.rlike(r"^\s*\d{1,2}\s*[-–—]")).alias("lead"), F.count_if(g.rlike("['‘’]")).alias("apostrophe"), F.count_if(g.rlike('["“”]')).alias("double_quote"))


def overfit_verdict(dev: Column, synthetic: Column, hard: Column, epsilon: float = EPSILON) -> Column:
    """What a rule's worth (rate without it less rate with it) on three sets says: NEUTRAL, OVERFIT, SAFE or GATE_TIGHTER."""
    helps, hurts = dev > epsilon, (synthetic < -epsilon) | (hard < -epsilon)
    inert = (F.abs(dev) <= epsilon) & (F.abs(synthetic) <= epsilon) & (F.abs(hard) <= epsilon)
    return F.when(inert, "NEUTRAL").when(helps & hurts, "OVERFIT").when(helps, "SAFE").when(~hurts, "NEUTRAL").otherwise("GATE_TIGHTER")


def left_out(rows: DataFrame, lexicon: DataFrame, language: Language = GENERIC, gold: str = "gold") -> DataFrame:
    """(config, cer, delta): the whole chain, recognition alone, and the chain without each rule; delta: what leaving it out adds."""
    out = None
    for config in ("full", "recognition", *RULES):
        text = transcribe(rows, lexicon, language, config if config in RULES else None, config != "recognition")
        one = metrics.cer(text.select(F.lit(config).alias("config"), metrics.edits(F.col(gold), F.col("text")).alias("ed"), F.length(gold).alias("len")), "config").select("config", "cer")
        out = one if out is None else out.union(one)
    full = F.broadcast(out.where("config = 'full'").select(F.col("cer").alias("_full")))  # one row
    return out.join(full).select("config", "cer", (F.col("cer") - F.col("_full")).alias("delta"))
