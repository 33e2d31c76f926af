import math

from pyspark.sql import functions as F

from scriptorium.operators import arbitrate, diverge, joins, metrics, resample, sampling
from scriptorium.profiles import MALTESE
from scriptorium.sources import readers, reports
from scriptorium.streaming import scoring


def vote(spark, lexicon, anchor, streams, **how):
    rows = spark.createDataFrame([(1, 0, anchor, k, s) for k, s in enumerate(streams)], "id int, pos int, anchor string, ord int, candidate string")
    words = spark.createDataFrame([(w,) for w in lexicon], "word string")
    return arbitrate.vote(rows, words, language=MALTESE, **how).first()["voted"]


def test_votes(spark):
    lexicon = ["għadha", "ghadha"]
    assert vote(spark, lexicon, "Xhadha", ["Għadha", "Xhadha", "Xhadha"]) == "Għadha"
    assert vote(spark, ["ghadha", "vadha"], "Xadha", ["Ghadha", "Ghadha", "Vadha", "Vadha"]) == "Ghadha"
    frequency = spark.createDataFrame([("Vadha", 9), ("Ghadha", 1)], "word string, n bigint")
    assert vote(spark, ["ghadha", "vadha"], "Xadha", ["Ghadha", "Ghadha", "Vadha", "Vadha"], frequency=frequency) == "Vadha"


def test_decisions(spark):
    lexicon = spark.createDataFrame([("żwieġ",), ("zwieg",), ("kelb",)], "word string")
    pairs = spark.createDataFrame([("zwieg", "żwieġ"), ("żwieġ", "zwieg"), ("kelb", "xqsd")], "anchor string, candidate string")
    got = {r["anchor"]: r["swap"] for r in arbitrate.decisions(pairs, lexicon, MALTESE).collect()}
    assert got == {"zwieg": "żwieġ", "żwieġ": "żwieġ", "kelb": "kelb"}
    assert {r["anchor"]: r["swap"] for r in arbitrate.decisions(pairs, lexicon, MALTESE, restore=False).collect()}["zwieg"] == "zwieg"


def test_base_and_correction(spark):
    s = spark.createDataFrame([([(0, ""), (1, "short"), (2, "a much longer text")],), ([(0, "anchor text"), (1, "anchor text!")],)], "s array<struct<ord:int,hyp:string>>")
    assert [r[0] for r in s.select(arbitrate.base_text(F.col("s"))).collect()] == ["a much longer text", "anchor text"]
    words = spark.createDataFrame([("kclb",), ("kelb",), ("zz",)], "word string")
    table = spark.createDataFrame([("c", "e", 0.5), ("c", "a", 0.6), ("k", "x", 0.01)], "hyp string, ref string, p double")
    assert [tuple(r) for r in arbitrate.corrected_words(words, table, spark.createDataFrame([("kelb",)], "word string")).collect()] == [("kclb", "kelb")]


def test_sign_flips_never_reach_zero(spark):
    same = spark.createDataFrame([(k, 3, 3, 10) for k in range(20)], "id int, ev bigint, eb bigint, len bigint")
    assert resample.sign_flips(resample.blocks(same), draws=50).first()["p"] == 1.0
    far = spark.createDataFrame([(k, 9, 0, 10) for k in range(60)], "id int, ev bigint, eb bigint, len bigint")
    assert resample.sign_flips(resample.blocks(far), draws=99).first()["p"] == 0.01
    lo, hi = resample.interval(resample.bootstrap(resample.blocks(far), draws=50)).first()
    assert lo == hi == 0.9 and tuple(resample.index_interval(resample.bootstrap(resample.blocks(far), draws=50)).first()) == (0.9, 0.9)
    delta, low, high = resample.bca(resample.blocks(far.withColumn("ev", (F.col("id") % 5).cast("long"))), draws=200)
    assert low <= delta <= high


def test_false_discovery(spark):
    tests = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.5)], "name string, p double")
    got = {r["name"]: r["significant"] for r in resample.benjamini_hochberg(tests).collect()}
    assert got == {"a": True, "b": False, "c": False, "d": False}


def test_similar_texts_against_brute_force(spark):
    base = [f"w{k}" for k in range(60)]
    texts = {k: " ".join(base[: 60 - k] + [f"z{k}{j}" for j in range(k // 3)]) for k in range(0, 30, 2)} | {100: " ".join(base), 101: "", 102: "a b", 103: "a b"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    members, links = joins.similar(docs)
    sets = {k: {tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} if t else set() for k, t in texts.items()}
    own = [k for k in texts if all(sets[j] != sets[k] for j in texts if j < k)]
    want = {(a, b) for a in own for b in own if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8}
    assert {(r["a"], r["b"]) for r in links.collect()} == want and want
    assert {r["doc_id"]: r["class_id"] for r in members.collect()} == {k: min(j for j in texts if sets[j] == sets[k]) for k in texts}


def test_hamming_pairs(spark):
    import random

    rng = random.Random(1)
    values = [rng.getrandbits(63) for _ in range(40)]
    values += [v ^ sum(1 << b for b in rng.sample(range(63), rng.randrange(7))) for v in values[:30]]
    rows = spark.createDataFrame(list(enumerate(values)), "k int, bits bigint")
    want = {(a, b) for a in range(70) for b in range(a + 1, 70) if (values[a] ^ values[b]).bit_count() <= 4}
    assert {(r["a"], r["b"]) for r in joins.hamming_pairs(rows, "k", "bits").collect()} == want


def test_rates_and_divergences(spark):
    rows = spark.createDataFrame([("abc", "abd"), ("", "xyz"), ("żżż", None)], "r string, h string").select(metrics.edits(F.col("r"), F.col("h")).alias("ed"), F.length("r").alias("len"))
    assert metrics.cer(rows).first()["cer"] == 4 / 6
    n = spark.createDataFrame([("a", "x", 1), ("b", "y", 1)], "g string, i string, n bigint")
    js = {r["g"]: r["js"] for r in diverge.jensen_shannon(n, "g", "i").collect()}
    want = (1 * math.log2(1 / 0.75) + 0.5 * math.log2(0.5 / 0.75) + 0.5 * math.log2(0.5 / 0.25)) / 2
    assert abs(js["a"] - want) < 1e-12


def test_samples(spark):
    rows = spark.createDataFrame([(k, ["rare"] if k < 3 else ["often"]) for k in range(50)], "k int, b array<string>")
    got = [tuple(r) for r in sampling.round_robin(rows, "k", "b", 8).collect()]
    assert len(got) == 8 and sum(b == "rare" for _, b, _ in got) == 3 and got[0][1] == "rare"
    split = sampling.eval_split(rows, "k", 10).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in split} == {"eval": 10, "train": 40}
    u = spark.createDataFrame([(0.0,), (0.49,), (0.5,), (0.99,)], "u double").select(sampling.weighted_choice(F.col("u"), {"a": 1, "b": 1}).alias("x"))
    assert [r["x"] for r in u.collect()] == ["a", "a", "b", "b"]


def test_readers_and_reports(spark, tmp_path):
    path = tmp_path / "gold.jsonl"
    path.write_text('{"id": "a", "paragraph": "x\\ny"}\n\n{"file": "b", "text": "t", "lines": ["t"]}\n{"text": "lost"}\n')
    got = {r["id"]: (r["image"], r["text"], r["as_lines"]) for r in readers.gold(spark, str(path)).collect()}
    assert got == {"a": (None, "x\ny", ["x", "y"]), "b.jpg": ("b.jpg", "t", ["t"])}
    preds = tmp_path / "pred.jsonl"
    preds.write_text('{"id": "a", "pred": "old"}\n{"id": "a", "pred": "x y"}\n')
    assert [tuple(r) for r in readers.predictions(spark, str(preds), "s").collect()] == [("a", "s", "x y")]
    lexicon = tmp_path / "lex.json"
    lexicon.write_text('{"Word": 3, "two": 1}')
    assert {tuple(r) for r in readers.lexicon(spark, str(lexicon)).collect()} == {("Word", 3), ("word", 3), ("two", 1)}
    frame = spark.createDataFrame([("a", 0.12345, None)], "k string, v double, w string")
    assert "| a | 0.1235 | - |" in reports.markdown(frame, "T") and reports.missing_leaves(frame).first()["column"] == "w"


def test_streaming_totals(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text('{"id": "a", "stream": "s", "hyp": "abd"}\n{"id": "a", "stream": "s", "hyp": "abd"}\n')
    gold = spark.createDataFrame([("a", "abc"), ("b", "xx")], "id string, text string")
    scoring.start(scoring.running_rates(scoring.read_predictions(spark, str(tmp_path / "in")), gold), str(tmp_path / "cp"), "rates").awaitTermination()
    assert [tuple(r) for r in spark.table("rates").collect()] == [("s", 1, 1, 3)]
