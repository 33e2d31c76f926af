from pyspark.sql import functions as F

from scriptorium.operators import forensic


def test_failure_classes(spark):
    cases = [
        (["fil- dar"], "fil- dar", "fil-dar", "C"), (["notice-", "board x"], "notice-board x", "noticeboard x", "G"), (["kel­", "ma"], "kelma", "kel-ma", "L"), (["kel­ma hi"], "kelma hi", "kel-ma hi", "L"), (["il-kelb"], "il-kelb", "ilkelb", "S"),
        (["- abc"], "- abc", "-abc", "B"), (["a — b"], "a — b", "a —b", "U"), (["a – b"], "a – b", "a - b", "U"), (["fil-dar x"], "fil-dar x", "fil- dar x", "P"), (["abc"], "abc", "abd", "O"), (["abc"], "abc", "abc", None),
    ]
    rows = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, parts array<string>, gold string, joined string, want string")
    got = rows.select("k", "want", forensic.failure_class(F.col("parts"), F.col("gold"), F.col("joined")).alias("got")).orderBy("k").collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]
    packed = spark.createDataFrame([(["ab", "1. cd"], "ab 1. cx", "ab 1. cd"), (["a–b"], "a–b", "a—b"), (["x", "- y"], "x-y", "x-z"), (["q"], "q", "r")], "parts array<string>, gold string, joined string")
    assert [r[0] for r in packed.select(forensic.packed_failure_class(F.col("parts"), F.col("gold"), F.col("joined"))).collect()] == ["A", "D", "B", "F"]


def test_split_words(spark):
    rows = spark.createDataFrame([(1, ["one splitting", "two another", "three"])], "k int, lines array<string>")
    h = rows.select(forensic.hyphenated(F.col("lines"), F.col("k"), 1.0).alias("h")).first()["h"]
    assert h["printed"] == ["one spli-", "tting two another", "three"] and h["label"] == ["one spli­tting", "two another", "three"] and h["n"] == 1
    assert rows.select(forensic.hyphenated(F.col("lines"), F.col("k"), 0.0).alias("h")).first()["h"]["printed"] == rows.first()["lines"]


def test_nearest_rank_and_dashes(spark):
    rows = spark.createDataFrame([(v,) for v in (5, 1, 3, 9, 7, 7)], "v int")
    assert tuple(forensic.nearest_rank(rows, "v", {"a": 0.0, "b": 0.5, "c": 1.0}).first()) == (6, 1, 5, 9)
    assert tuple(forensic.nearest_rank(rows.limit(0), "v", {"a": 0.5}).first()) == (0, None)
    pairs = spark.createDataFrame([("a-b c", "a–b c"), ("no dash", "x-y"), ("p-q r-s", "p-q")], "r string, h string")
    assert sorted((r["ed"], r["len"]) for r in forensic.dash_token_pairs(pairs, "r", "h").collect()) == [(1, 3), (3, 7)]
