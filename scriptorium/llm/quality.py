"""Quality rules: text statistics and a learned decision list, in DataFrame operations only.

Statistics of whole texts (null: no words) are built from array functions within the row, so nothing
is shuffled. The list is learned by sequential covering on the statistics of labelled rows: a rule
grows by the condition with the largest information gain, is pruned on rows held back, and stays if it
is precise there. It becomes one ordered CASE expression.

The fit reads at most SAMPLE labelled rows, those with the lowest hash of their id; statistics and
verdicts cover every row. Without labels, or without a precise rule, every document that passes the
base rules is kept. Empty texts fail the base rules. Repeated rows get the same verdict.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import let, once, words_of

#: Most labelled rows the fit reads.
SAMPLE = 20_000
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
GRAM = 5


def _repeat_words(grams: Column) -> Column:
    """Words under 5-word windows that occur twice, from the windows' hashes in order."""

    def positions(pairs: Column) -> Column:
        same = lambda x, other: F.coalesce(other.getField("h") == x.getField("h"), F.lit(False))
        twice = F.filter(pairs, lambda x, k: same(x, F.get(pairs, k + 1)) | (F.when(k > 0, same(x, F.get(pairs, F.greatest(k - 1, F.lit(0))))).otherwise(False)))
        return F.sort_array(F.transform(twice, lambda x: x.getField("i")))

    pairs = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    start = F.struct(F.lit(-GRAM).alias("at"), F.lit(0).alias("n"))
    step = lambda a, x: F.struct(x.alias("at"), (a.getField("n") + F.least(F.lit(GRAM), x - a.getField("at"))).alias("n"))
    return F.aggregate(let(pairs, positions), start, step).getField("n")


def with_statistics(rows: DataFrame, text: str = "text") -> DataFrame:
    """rows with the five base statistics (long); columns with such names are replaced."""
    whole = F.coalesce(F.col(text), F.lit(""))

    def grams(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - GRAM), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(GRAM))))
        return F.when(F.size(w) >= GRAM, hashes).otherwise(F.array().cast("array<bigint>"))

    def statistics(w: Column) -> Column:
        repeats = let(grams(w), lambda g: F.when(F.size(F.array_distinct(g)) < F.size(g), _repeat_words(g)).otherwise(0))
        lines = let(
            F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
            lambda x: F.size(x) - F.size(F.array_distinct(x)),
        )
        values = (F.size(w), F.length(F.array_join(w, "")), F.regexp_count(whole, F.lit("[#*$%&|<>]")), lines, repeats)
        return F.struct(*(v.cast("long").alias(k) for k, v in zip(BASE, values, strict=True)))

    rows = rows.drop(*BASE, "_s")
    return once(rows, words_of(F.col(text)), statistics, "_s").select(*rows.columns, "_s.*")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def features() -> dict[str, Column]:
    """What rules may compare, from the base statistics."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "words": F.col("n_words").cast("double"),
        "word_length": F.col("word_chars") / n,
        "symbols_per_word": F.col("n_symbols") / n,
        "dup_lines": F.col("n_dup_lines").cast("double"),
        "dup_lines_per_word": F.col("n_dup_lines") / n,
        "repeated_share": F.col("n_repeat_words") / n,
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = features()[self.feature]
        return value > self.threshold if self.above else value <= self.threshold

    def holds(self, row: dict) -> bool:
        return (row[self.feature] > self.threshold) == self.above


Rule = tuple[Condition, ...]


def _gain(p0: int, n0: int, p: int, n: int) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else -1.0


def _cuts(rows: list[dict], feature: str, most: int = 48) -> list[float]:
    values = sorted({r[feature] for r in rows})
    return values if len(values) <= most else sorted({values[k * (len(values) - 1) // most] for k in range(most)})


def _grow(rows: list[dict], cuts: dict[str, list[float]], most: int) -> Rule:
    rule: Rule = ()
    while len(rule) < most:
        p0 = sum(r["bad"] for r in rows)
        n0 = len(rows) - p0
        if not p0 or not n0:
            break
        best = (1e-9, None)
        for f, at in cuts.items():
            order = sorted(rows, key=lambda r: r[f])
            k = p = n = 0
            for t in at:
                while k < len(order) and order[k][f] <= t:
                    p, n, k = p + order[k]["bad"], n + 1 - order[k]["bad"], k + 1
                for c, a, b in ((Condition(f, False, t), p, n), (Condition(f, True, t), p0 - p, n0 - n)):
                    if (g := _gain(p0, n0, a, b)) > best[0]:
                        best = (g, c)
        if best[1] is None:
            break
        rule += (best[1],)
        rows = [r for r in rows if best[1].holds(r)]
    return rule


def _covered(rule: Rule, rows: list[dict]) -> tuple[int, int]:
    bad = [r["bad"] for r in rows if all(c.holds(r) for c in rule)]
    return sum(bad), len(bad) - sum(bad)


def _prune(rule: Rule, rows: list[dict]) -> Rule:
    worth = lambda r: (lambda p, n: (p - n) / (p + n) if p + n else -1.0)(*_covered(r, rows))
    return max((rule[:k] for k in range(1, len(rule) + 1)), key=worth, default=())


def learn(rows: list[dict], precision: float = 0.98, most_rules: int = 12, most_conditions: int = 4) -> list[Rule]:
    """Rules for bad rows, in order. rows hold the features, bad (0 or 1) and held (true: for pruning)."""
    rules: list[Rule] = []
    cuts = {f: _cuts(rows, f) for f in features_names()} if rows else {}
    while rows and len(rules) < most_rules:
        grow, held = [r for r in rows if not r["held"]], [r for r in rows if r["held"]]
        rule = _prune(_grow(grow, cuts, most_conditions), held)
        p, n = _covered(rule, held) if rule else (0, 0)
        every = _covered(rule, rows) if rule else (0, 0)
        if p < 3 or p < precision * (p + n) or every[0] < precision * sum(every):
            break
        rules.append(rule)
        rows = [r for r in rows if not all(c.holds(r) for c in rule)]
    return rules


def features_names() -> tuple[str, ...]:
    return ("words", "word_length", "symbols_per_word", "dup_lines", "dup_lines_per_word", "repeated_share")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[Rule]:
    """Learn from at most sample labelled rows: those whose ids have the lowest hashes. Rows the base rules reject teach nothing."""
    order = F.xxhash64(F.col("doc_id"))
    chosen = labels.where("doc_id is not null and quality is not null").select("doc_id", F.col("quality").alias("_quality"), order.alias("_order"))
    chosen = F.broadcast(chosen.orderBy("_order", "doc_id", "_quality").limit(sample))
    rows = with_statistics(docs.select("doc_id", "text").join(chosen, "doc_id")).where(~base_failed())
    rows = rows.select("_order", "doc_id", (F.col("_quality") == 0).cast("int").alias("bad"), *(c.alias(k) for k, c in features().items()))
    got = sorted((r.asDict() for r in rows.orderBy("_order", "doc_id", "bad").limit(2 * sample).collect()), key=lambda r: (r["_order"], r["doc_id"], r["bad"]))
    return learn([r | {"held": k % 3 == 2} for k, r in enumerate(got)])


def verdict(rules: list[Rule]) -> Column:
    """True where no rule holds, as one ordered CASE."""
    out = F.when(base_failed(), F.lit(False))
    for rule in rules:
        condition = rule[0].column()
        for c in rule[1:]:
            condition = condition & c.column()
        out = out.when(condition, F.lit(False))
    return out.otherwise(F.lit(True))


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """docs with the statistics, base_failed and kept."""
    return with_statistics(docs).withColumns({"base_failed": base_failed(), "kept": verdict(rules)})


def keep_good(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows of docs that are kept, with the columns of docs."""
    columns = docs.columns
    return judge(docs.select(F.struct(*columns).alias("_row"), "text"), rules).where("kept").select("_row.*")
