"""What was too slow, too large or not as its SQL has it at size: small inputs that show the same."""

import random
import time
from hashlib import md5

import duckdb
from pyspark.sql import functions as F

from scriptorium.functions import align
from scriptorium.functions import text as T
from scriptorium.operators import arbitrate, forensic, joins, metrics, pairwise, paragraphs
from scriptorium.plans import audits, corpora, queries
from scriptorium.profiles import MALTESE


def test_exact_distance_equals_the_table():
    rng, kept = random.Random(1), {}
    for _ in range(3000):
        letters = rng.choice(("ab ", "abc -", "é e-an ", "abcdefgh   ", "𝄞é a"))
        a = "".join(rng.choice(letters) for _ in range(rng.randrange(30)))
        b = list(a)
        for _ in range(rng.randrange(6)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(2)] = rng.choice(("", rng.choice(letters)))
        b = "".join(b)
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        assert align.exact_distance(a, b, kept) == align.bits_distance(a, b) == row[-1]


def test_long_lines_need_no_table(spark):
    """400,000 letters in a line; the table would have 1.6e11 places."""
    line = "carne élite pérla il- dar " * 16_000
    rows = spark.createDataFrame([(line, line.replace("é", "e"), line.replace("rn", "m").replace("il- ", "il-"))], "a string, b string, c string")
    began = time.time()
    got = rows.select(metrics.edits(F.col("a"), F.col("b")), metrics.edits(F.col("a"), F.col("c")), metrics.pair_cer(F.col("a"), F.col("b"))).first()
    assert tuple(got) == (32_000, 48_000, 32_000 / len(line)) and time.time() - began < 60


def test_edits_of_nothing(spark):
    rows = spark.createDataFrame([("", "ab"), ("ab", None), (None, "ab"), ("ab", "")], "a string, b string")
    assert [r[0] for r in rows.select(metrics.edits(F.col("a"), F.col("b"))).collect()] == [0, 2, 0, 2]


def test_normalised_references_are_computed_once(spark):
    """F2, F8: the filter on the normalised reference reads it and doesn't make it again."""
    rows = spark.createDataFrame([(1, " il- dar ", "il-dar", "il dar"), (2, " ", "x", "y")], "id long, ref string, v string, b string")
    got = metrics.normalised_triples(rows, "ref", "v", "b", MALTESE)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("nfc(coalesce(ref") == 1
    assert [tuple(r) for r in got.collect()] == [(1, 0, 1, 6)]


def test_clitic_spaces_keep_their_places(spark):
    texts = ["IL- dar", "xil- dar", "għall- \tx", "l- a", "il-- x", "’il- x", "bilx- a", "ĠOS- x il- -"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in texts], "s string").select(T.clitic_spaces(F.col("s"), MALTESE)).collect()]
    assert got == ["IL-dar", "xil- dar", "għall-x", "l-a", "il-- x", "’il- x", "bilx- a", "ĠOS-x il--"]


def test_draws_are_sums_in_batches(spark):
    """No row for a pair and draw; small groups lack the draws that have none of their pairs."""
    rows = [(g, i, i % 5, i % 3, 10 + i % 4) for g in ("a", None) for i in range(40)] + [("b", 1, 2, 1, 9), ("b", 2, 7, 1, 0), ("c", None, 3, 1, 4)]
    df = spark.createDataFrame(rows, "g string, id long, ev long, eb long, len long").repartition(3)
    drawn, tests = pairwise.bootstrap(df, "g", draws=30), pairwise.sign_flips(df, "g", draws=70)
    for got in (drawn, tests):
        assert "sequence" not in got._jdf.queryExecution().optimizedPlan().toString()
    hexed = lambda seed, lot, i: md5("|".join([seed, str(lot), *([] if i is None else [str(i)])]).encode()).hexdigest()
    want = {}
    for g, i, ev, eb, n in rows:
        for d in range(30) if n else ():
            u = int(hexed("42", d // 4, i)[8 * (d % 4) :][:8], 16)
            w = sum(u >= x for x in pairwise.LIMITS)
            old = want.get((g, d), (0, 0, 0))
            want[g, d] = tuple(x + w * y for x, y in zip(old, (ev, eb, n), strict=True))
    want = {k: (v[0] / v[2], v[1] / v[2]) for k, v in want.items() if v[2]}
    assert {(r["g"], r["draw"]): (r["cer_v"], r["cer_b"]) for r in drawn.collect()} == want and ("b", 0) in want and len([k for k in want if k[0] == "b"]) < 30
    for r in tests.collect():
        own = [(i, ev - eb, n) for g, i, ev, eb, n in rows if g == r["g"] and n]
        flips = sorted(abs(sum(d if hexed("7", k // 32, i)[k % 32] in "02468ace" else -d for i, d, _ in own)) for k in range(70))
        total, size = sum(d for _, d, _ in own), sum(n for *_, n in own)
        assert (r["n"], r["delta"], r["p"]) == (len(own), total / size, (sum(x >= abs(total) for x in flips) + 1) / 71) and r["critical"] == flips[66] / size


def test_branches_of_an_audit_share_the_counting_of_edits(spark):
    """rates, bounds, folds and flips read one exchange of the documents' sums."""
    plan = audits.manifest_audit(spark, "/root/testdata/sf0.001")
    assert len(plan.collect()) == 3
    assert plan._jdf.queryExecution().executedPlan().toString().count("ReusedExchange") >= 3


def test_blank_texts_are_counted_as_in_sql(spark, tmp_path):
    """texts without lines have no sum of characters, and blanks are all of Unicode's."""
    texts = ["", "\n", " \n\u3000", "a\n\u00a0\n b ", None, "\t\nx\r\n", "\u2028\n \u202f\ny. \u00a0z"]
    rows = spark.createDataFrame([(k, x, "en", "s", 0) for k, x in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    rows.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name, f in (("line_counts", queries.line_counts), ("length_filters", corpora.length_filters)):
        assert sorted(map(tuple, f(spark, str(tmp_path)).collect())) == sorted(db.execute(queries.SQL[name]).fetchall())


def test_a_long_text_is_hyphenated_and_joined_once(spark):
    """600,000 letters in 10,000 lines; each line used to copy and search the text before it."""
    df = spark.createDataFrame([(1, "abcdefgh ijklmnop " * 30_000)], "doc_id long, text string")
    began = time.time()
    lines = df.select("doc_id", paragraphs.wrapped(F.col("text"), 60).alias("lines"))
    made = lines.select(F.size("lines").alias("k"), forensic.hyphenated(F.col("lines"), F.col("doc_id"), 0.3).alias("h")).select("k", "h.*")
    got = made.select("k", "n", paragraphs.join_lines(F.col("printed")).alias("j"), paragraphs.gold_from_parts(F.col("label")).alias("g")).first()
    assert got["k"] == 10_000 and got["n"] > 1000 and got["j"] == got["g"] and time.time() - began < 60


def test_joiner_reads_what_stands_before_a_bare_line():
    """Runs without white space go over several lines."""
    join = lambda *lines: paragraphs.joined(lines, frozenset(paragraphs.CLITICS))
    assert join("a -", "b") == "a - b" and join("a", "-", "b") == "a - b" and join("-", "b") == "-b"
    assert join("see http://x-", "y-", "z") == "see http://x-y-z" and join("so-", "me-", "thing") == "something"
    assert join("a —", "b") == "a — b" and join("a—", "b") == "a—b" and join("x\t-", "b") == "x\t-b" and join("il-", " ", None, "dar") == "il-dar"
    assert paragraphs.filled(" aa  bbb c\tdddddd e ", 5) == ["aa", "bbb c", "dddddd", "e"] and paragraphs.filled(" ", 5) == []


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_streams_of_a_place_are_compared_where_they_are(spark):
    """no place is shuffled; F22, F12: places that don't swap aren't, and words' keys are built for distinct words."""
    sf = "/root/testdata/sf0.001"
    assert "doc_id" not in "".join(x for x in _plan(queries.stream_disagreement(spark, sf)).splitlines() if "Aggregate" in x)
    assert "Aggregate [doc_id#" not in "".join(x for x in _plan(queries.plurality_vote(spark, sf)).splitlines() if "swap" not in x)
    assert "doc_id#" not in "".join(x for x in _plan(queries.vote_ablation(spark, sf)).splitlines() if "Aggregate" in x)
    rows = [(1, ["a", "b", None]), (2, ["a", "a", "c"]), (3, [None, "x", "x"])]
    arrays = spark.createDataFrame(rows, "id long, s array<string>")
    single = arrays.select("id", F.posexplode("s").alias("ord", "candidate")).where("candidate is not null").withColumn("pos", F.lit(0))
    want = sorted(map(tuple, arbitrate.disagreement(single).collect()))
    assert sorted(map(tuple, arbitrate.array_disagreement(arrays, "s", (0, 1, 2)).collect())) == want
    assert arbitrate.array_disagreement(arrays.limit(0), "s", (0, 1, 2)).count() == 0


def test_keys_are_built_for_distinct_words(spark):
    """the way through Python comes behind the counting."""
    words = spark.createDataFrame([(w,) for w in ("Ab,", "ab", "(ab)", "cd", "x", "cd.", "é-é")], "w string")
    got = metrics.key_lexicon(words)
    want = metrics.lexicon(words.select(T.lookup_key(F.col("w")).alias("w")))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 3
    plan = _plan(got)
    assert plan.index("ArrowEvalPython") < plan.rindex("Aggregate")


def test_pairs_of_words_are_aligned_once(spark):
    """equal pairs come together before they go to Python; small tables give the same paths as arrays."""
    for f in (queries.canary_table, queries.confusion_probabilities):
        plan = _plan(f(spark, "/root/testdata/sf0.001"))
        assert any("Aggregate [w#" in x for x in plan[plan.index("ArrowEvalPython") :].splitlines())
    rng = random.Random(3)
    for _ in range(300):
        a, b = (["ab"[rng.randrange(2)] for _ in range(rng.randrange(9))] for _ in range(2))
        if a and b:
            assert align._small(a, b) == align._costs(a, b).tolist()


def test_similar_texts_meet_by_hashes(spark):
    """no string of a gram is shuffled; links are those of all pairs."""
    rng = random.Random(5)
    base = [[rng.choice("abcdefghij") + str(rng.randrange(40)) for _ in range(60)] for _ in range(6)]
    texts = [" ".join(b if k % 4 else [*b[:-k // 4], "z"]) for b in base for k in range(10)] + ["", "a b", "a b", "A, b!"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    members, links = joins.similar(df)
    grams = lambda t: (lambda w: {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())(t.lower().replace(",", "").replace("!", "").split())
    sets = [frozenset(grams(t)) for t in texts]
    first = {s: k for k, s in reversed(list(enumerate(sets)))}
    assert {r["doc_id"]: r["class_id"] for r in members.collect()} == {k: first[s] for k, s in enumerate(sets)}
    ids = sorted(first[s] for s in first if s)
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in ids for b in ids if a < b}
    assert {(r["a"], r["b"]): r["jaccard"] for r in links.collect()} == {k: j for k, j in want.items() if j >= 0.8} and len(want) > 5
    assert "array_join" not in _plan(members)
