import hashlib
import random

from scriptorium.llm import substring


def brute(rows, window=20):
    """Expected (doc_id, n_words, n_removed, kept_sha256) of each row."""
    split = [(-(2**63) if i is None else i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, words in split:
        for k in range(len(words) - window + 1):
            w = tuple(words[k : k + window])
            first[w] = min(first.get(w, (i, k)), (i, k))
    out = []
    for (i, words), (doc, _) in zip(split, rows, strict=True):
        gone = set()
        for k in range(len(words) - window + 1):
            if first[tuple(words[k : k + window])] < (i, k):
                gone |= set(range(k, k + window))
        kept = [w for k, w in enumerate(words) if k not in gone]
        out.append((doc, len(words), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


def texts(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "of", "a"]) if rng.random() < 0.4 else "w%d" % rng.randrange(400)
    passages = [" ".join(word() for _ in range(rng.randrange(18, 60))) for _ in range(6)]
    rows = []
    for k in range(120):
        parts = [" ".join(word() for _ in range(rng.randrange(0, 80))) for _ in range(rng.randrange(1, 4))]
        if rng.random() < 0.5:
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(passages))
        if rng.random() < 0.1:
            parts += [passages[0]] * 3
        rows.append((k * 3 % 120, rng.choice([" ", "\n", " \t "]).join(parts)))
    rows += [(200 + k, rows[5][1]) for k in range(15)] + [rows[5], rows[6], (300, None), (301, ""), (302, "la " * 60), (303, "the " * 19), (304, "the " * 19), (None, rows[7][1]), (None, rows[8][1]), (305, "é " * 25 + "\x00 " * 25)]
    rows += [(400, " ".join(f"x{k % 25}" for k in range(3000)))]
    return rows


def test_against_brute_force(spark, monkeypatch):
    for seed, size, most, tree in ((1, 4_000_000, 50_000, 20_000), (2, 3000, 50_000, 5), (3, 3000, 4, 20_000)):
        for name, value in (("GROUP_BYTES", size), ("GROUP_ROWS", most), ("TREE_ROWS", tree)):
            monkeypatch.setattr(substring, name, value)
        rows = texts(seed)
        df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS tag", "'x' AS payload").repartition(3)
        got = sorted((tuple(r) for r in substring.dedup(df).collect()), key=str)
        assert got == brute(rows)


def test_removed_text_takes_effect(spark):
    long = " ".join(f"q{k}" for k in range(30))
    rows = [(1, f"a  {long} b", 7), (2, f"c {long} d", 8), (3, "short  text", 9), (4, None, None), (5, f"a  {long} b", 7)]
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in substring.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint")).collect()}
    assert got == {1: (rows[0][1], 7), 2: ("c d", 3), 3: ("short  text", 9), 4: (None, None), 5: ("", 0)}


def test_empty_table(spark):
    assert substring.dedup(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
