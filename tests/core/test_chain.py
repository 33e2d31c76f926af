"""The normaliser's golden pairs, and the operators of the corpus chain on small inputs."""

import math
import random

from pyspark.sql import functions as F

from scriptorium.functions import align
from scriptorium.functions import text as T
from scriptorium.operators import arbitrate, corpus, diverge, pairwise, transcribe
from scriptorium.profiles import MALTESE

CLITICS = {
    "il- foo": "il-foo", "tal- Kummissjoni": "tal-Kummissjoni", "għall- finijiet": "għall-finijiet", "l- artiklu": "l-artiklu", "fis- seħħ": "fis-seħħ", "biż- żmien": "biż-żmien",
    "Il- Gvernatur": "Il-Gvernatur", "L- Akkwist": "L-Akkwist", "GĦALL- finijiet": "GĦALL-finijiet", "0 – il- foo": "0 – il-foo", "Marie- Louise": "Marie- Louise", "oxy- / oxi-": "oxy- / oxi-",
    "foo- bar": "foo- bar", "fil-Parlament — jipproponi": "fil-Parlament — jipproponi", "": "",
}


def column(spark, values, make, kind="string"):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, x {kind}")
    return [r[0] for r in rows.select("k", make(F.col("x")).alias("y")).orderBy("k").select("y").collect()]


def test_clitic_pairs(spark):
    got = column(spark, list(CLITICS), lambda x: T.clitic_spaces(x, MALTESE))
    assert got == list(CLITICS.values()) and column(spark, got, lambda x: T.clitic_spaces(x, MALTESE)) == got


def test_keys_are_composed(spark):
    assert column(spark, ["(café)", "«é»", "--", "Å."], T.lookup_key) == ["café", "é", "", "Å"]
    assert column(spark, ["ħàŻ"], lambda x: T.without_marks(x, MALTESE)) == ["haZ"]


def test_packing_and_dictionary(spark):
    texts = [["a" * 100, "b" * 100, "c" * 900, "d" * 20], ["x" * 149], ["y" * 1200, "z" * 160]]
    assert column(spark, texts, corpus.packed, "array<string>") == [["a" * 100 + " " + "b" * 100, "c" * 900 + " " + "d" * 20], [], ["y" * 1200, "z" * 160]]
    lines = [["mul-", "ti ever-", "green"], ["", "one-", "two"]]
    assert column(spark, lines, lambda x: corpus.dictionary_joined(x, F.array(F.lit("multi"), F.lit("evergreen"))), "array<string>") == ["multi evergreen", "one- two"]


def test_formex_and_boilerplate(spark):
    xml = "<P>one &amp; <B>two</B><NOTE>gone</NOTE> &#233;</P><X>no</X><TI.x>no</TI.x><TITLE a='1'> three\n four</TITLE><P> </P>"
    assert column(spark, [xml], corpus.formex_text) == ["one & two é\nthree four"]
    blocks = ["This is a disclaimer", "[M] short", "[M] long enough to be kept here", "plain"]
    assert column(spark, blocks, lambda x: T.boilerplate(x, "This is", ("[M]",))) == [None, None, "long enough to be kept here", "plain"]


def test_verdicts_and_fallback(spark):
    rows = spark.createDataFrame([(0.0, 0.0, 0.0), (1.0, -1.0, 0.0), (1.0, 0.0, 0.0), (-1.0, 0.0, 0.5), (-1.0, -1.0, 0.0)], "a double, b double, c double")
    assert [r[0] for r in rows.select(transcribe.overfit_verdict(F.col("a"), F.col("b"), F.col("c"))).collect()] == ["NEUTRAL", "OVERFIT", "SAFE", "NEUTRAL", "GATE_TIGHTER"]
    pairs = spark.createDataFrame([("", "b"), ("short", "a much longer reading"), ("fine as it is", "fine as it was")], "a string, b string")
    assert [r[0] for r in pairs.select(arbitrate.fallback(F.col("a"), F.col("b"))).collect()] == ["b", "a much longer reading", "fine as it is"]


def full_path(a, b):
    """The plain table with its traceback: diagonal, deletion, insertion."""
    cost = [[i + j if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            cost[i][j] = min(cost[i - 1][j - 1] + (a[i - 1] != b[j - 1]), cost[i - 1][j] + 1, cost[i][j - 1] + 1)
    i, j, out = len(a), len(b), []
    while i or j:
        if i and j and cost[i][j] == cost[i - 1][j - 1] + (a[i - 1] != b[j - 1]):
            i, j = i - 1, j - 1
            out.append((a[i], b[j]))
        elif i and cost[i][j] == cost[i - 1][j] + 1:
            i -= 1
            out.append((a[i], None))
        else:
            j -= 1
            out.append((None, b[j]))
    return out[::-1]


def test_alignment_shortcuts_keep_the_preference():
    rng = random.Random(4)
    for _ in range(3000):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(0, 7))] for _ in range(2))
        assert align.path(a, b) == full_path(a, b)


def test_transcription(spark):
    lexicon = spark.createDataFrame([("għadha", 2), ("ghadha", 2), ("seħħ", 3)], "word string, n long")
    streams = "id int, gold string, streams array<struct<ord:int,hyp:string>>"
    rows = spark.createDataFrame([(1, "0 — Għadha għadha seħħ", [(0, "0 - Xhadha ghadha sehh"), (1, "0 - Għadha għadha seħħ"), (2, ""), (3, "0 - Xhadha ghadha sehh more")]), (2, "", [(0, ""), (1, "")])], streams)
    got = {r["id"]: r["text"] for r in transcribe.transcribe(rows, lexicon, MALTESE).collect()}
    assert got == {1: "0 — Għadha għadha seħħ", 2: ""}
    worth = {r["config"]: r["delta"] for r in transcribe.left_out(rows, lexicon, MALTESE).collect()}
    assert worth["full"] == 0 and worth["diacritic_vote"] > 0


def test_pairwise_resampling(spark):
    rng = random.Random(1)
    rows = [(k, rng.randrange(5), rng.randrange(9), 100) for k in range(60)]
    df = spark.createDataFrame([*rows, (99, 5, 5, 0)], "id long, ev long, eb long, len long")
    drawn = pairwise.bootstrap(df, draws=400).collect()
    seen = sum(v - b for _, v, b, _ in rows) / 6000
    spread = math.sqrt(sum((v - b - 100 * seen) ** 2 for _, v, b, _ in rows)) / 6000
    mean = sum(r["delta"] for r in drawn) / len(drawn)
    assert len(drawn) == 400 and abs(mean - seen) < 4 * spread / 20 and abs(math.sqrt(sum((r["delta"] - mean) ** 2 for r in drawn) / 400) / spread - 1) < 0.15
    (test,) = pairwise.sign_flips(df, draws=10_000).collect()
    assert test["n"] == 60 and abs(test["delta"] - seen) < 1e-12 and 1 / 10_001 <= test["p"] < 0.05 and 0 < test["critical"] < abs(seen)
    (sure,) = pairwise.sign_flips(df.withColumn("ev", F.col("eb") - 1), draws=10_000).collect()
    assert sure["p"] == 1 / 10_001  # no flip of sixty signs gets there
    delta, low, high = pairwise.bca(df, draws=1000)
    assert delta == seen and abs(low - (seen - 1.96 * spread)) < 0.3 * spread and abs(high - (seen + 1.96 * spread)) < 0.3 * spread
    assert all(math.isnan(x) for x in pairwise.bca(df.limit(0))[1:])


def test_tails():
    assert abs(diverge.chi_square_p(3.841459, 1) - 0.05) < 1e-6 and abs(diverge.chi_square_p(30.0, 10) - 0.000857) < 1e-6 and diverge.chi_square_p(0, 3) == 1.0
