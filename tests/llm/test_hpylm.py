import math
import random
import zlib
from collections import Counter

import numpy as np

from scriptorium.llm import hpylm


def rows(seed=3):
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "Of", "and"]) if rng.random() < 0.5 else "v%d" % int(rng.paretovariate(0.6) % 5000)
    out = [(k, " ".join(word() for _ in range(rng.randrange(0, 90)))) for k in range(150)]
    return out + [(500, None), (501, ""), (None, "the the"), out[3], (502, "only unseen-words here ééé")]


def brute(table):
    train, tokens = Counter(), []
    for i, text in table:
        own = [w for w in (text or "").encode().lower().split()] + [b"\n"]
        tokens.append(own)
        if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2:
            train.update(own)
    n, v = sum(train.values()), len(train)
    out = []
    for (i, _), own in zip(table, tokens, strict=True):
        held = zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
        out.append((i, held, len(own), sum(train[w] > 0 for w in own), n, round(sum(math.log10((train[w] + 1) / (n + v + 1)) for w in own), 6)))
    return sorted(out, key=str)


def test_base_against_brute_force(spark, monkeypatch):
    table = rows()
    df = spark.createDataFrame(table, "doc_id bigint, text string").selectExpr("*", "1 AS word", "2 AS n").repartition(3)
    for size, look in ((16_000_000, 64), (2000, 1)):
        monkeypatch.setattr(hpylm, "GROUP_BYTES", size)
        monkeypatch.setattr(hpylm, "LOOK", look)
        got = hpylm.score(df).collect()
        assert sorted(((r[0], r[1], r[2], r[3], r[4], round(r[5], 6)) for r in got), key=str) == brute(table)
        held = [r for r in got if r["held_out"]]
        # These words are drawn one by one, so contexts say nothing: the model can only equal the base.
        assert sum(r["score"] for r in held) > 1.005 * sum(r["base_score"] for r in held)
        want = model_scores(table)
        assert all(abs(r["score"] - want[(r["doc_id"], r["n_tokens"], r["n_known"])]) < 1e-4 * r["n_tokens"] for r in got)


def test_words_that_follow_each_other_score_above_the_base(spark):
    rng = random.Random(8)
    follows = {f"w{k}": [f"w{rng.randrange(300)}" for _ in range(3)] for k in range(300)}

    def text():
        out = ["w%d" % rng.randrange(300)]
        while len(out) < 40:
            out.append(rng.choice(follows[out[-1]]))
        return " ".join(out)

    got = hpylm.score(spark.createDataFrame([(k, text()) for k in range(400)], "doc_id bigint, text string")).collect()
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > 0.4 * sum(r["base_score"] for r in held)


def model_scores(table):
    """Scores of the model by one process that holds everything."""
    contexts = hpylm.CONTEXTS
    g = hpylm.Group([t for i, t in table if not hpylm.held_out(i)], contexts)
    order = np.argsort(g.key)
    place = np.argsort(order)
    pair, n = np.unique(place[g.token] * contexts + g.context, return_counts=True)
    word, context, key = pair // contexts, pair % contexts, g.key[order]
    totals = [hpylm.Totals(len(key), len(g.token), np.bincount(context, n, contexts), (hpylm.discount_of(int((n == 1).sum()), int((n == 2).sum())), hpylm.discount_of(*(int((np.bincount(word, n) == k).sum()) for k in (1, 2)))))]
    for _ in range(2):
        s = hpylm.Seating(key, word, context, n, totals[-1])
        totals.append(hpylm.Totals(len(key), len(g.token), totals[0].customers, (totals[0].discount, totals[0].parent_discount), np.stack([np.bincount(context, t, contexts) for t in s.tables]), np.array([p[1].sum() for p in s.parents])))
    s, out = hpylm.Seating(key, word, context, n, totals[-2], totals[-1]), {}
    for context in (0, 1, contexts - 1):
        at = np.arange(-1, len(key))
        assert abs(s.probability(at, np.full(len(at), context)).sum() - 1) < 1e-9
    index = {k: p for p, k in enumerate(key.tolist())}
    for i, t in table:
        own = hpylm.Group([t], contexts)
        at = np.array([index.get(k, -1) for k in own.key.tolist()])[own.token]
        out[(i, len(at), int((at >= 0).sum()))] = float(np.log10(s.probability(at, own.context)).sum())
    return out


def test_tables_follow_the_exact_law():
    for discount in (0.7, 0.8):
        log_s = hpylm.stirling(discount, 400)
        for n in (65, 150, 400):
            for weight in (0.001, 0.05, 3.0, 20.0, 200.0):
                t = np.arange(1, n + 1)
                p = log_s[n, 1 : n + 1] + t * np.log(weight)
                p = np.exp(p - p.max()) / np.exp(p - p.max()).sum()
                mean, spread = (p * t).sum(), math.sqrt((p * t * t).sum() - (p * t).sum() ** 2)
                got = hpylm.draw_tables(np.full(20000, n), np.full(20000, weight), discount, hpylm.uniform(np.arange(20000), 3))
                assert abs(got.mean() / mean - 1) < 0.06 and abs(got.std() - spread) < 0.12 * spread + 0.05, (n, weight, mean, got.mean(), spread, got.std())


def test_probabilities_add_up(spark):
    rng = np.random.default_rng(5)
    word = np.sort(rng.integers(0, 40, 200))
    pairs = sorted({(int(w), int(c)) for w, c in zip(word, rng.integers(0, 4, 200), strict=True)})
    w, c = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
    index = np.unique(w, return_inverse=True)[1]
    n = rng.integers(1, 300, len(w))
    totals = hpylm.Totals(index.max() + 1, n.sum(), np.bincount(c, n, 4), (0.8, 0.7))
    for _ in range(2):
        s = hpylm.Seating(np.arange(index.max() + 1) * 7919, index, c, n, totals)
        assert all((t >= 1).all() and (t <= n).all() for t in s.tables)
        totals = hpylm.Totals(totals.words, totals.tokens, totals.customers, (0.8, 0.7), np.stack([np.bincount(c, t, 4) for t in s.tables]), np.array([p[1].sum() for p in s.parents]))
    s.totals = totals
    for context in range(4):
        at = np.append(np.arange(index.max() + 1), -1)
        assert abs(s.probability(at, np.full(len(at), context)).sum() - 1) < 1e-9


def test_nothing_to_learn_from(spark):
    assert hpylm.score(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    only = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)
    (r,) = hpylm.score(spark.createDataFrame([(only, "a b")], "doc_id bigint, text string")).collect()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) == (3, 0, 0, 0) and abs(r["score"]) < 1e-9


def test_sums_grow_with_places_not_with_documents_times_tasks():
    rng = np.random.default_rng(2)
    sums, want, told, places = hpylm.Sums(), {}, [], 0
    sums.MOST = 5000
    for _ in range(30):
        group, size = rng.integers(0, 40, 100) * 2**33, rng.integers(0, 9, 100)
        doc = rng.integers(0, 60_000, size.sum())
        known, base, score = rng.integers(0, 2, len(doc)), rng.random(len(doc)), -rng.random(len(doc))
        for at, *v in zip(zip(np.repeat(group, size).tolist(), doc.tolist(), strict=True), known, base, score, strict=True):
            want[at] = want.get(at, 0) + np.array(v)
        sums.add(group, size, doc, known, base, score)
        places += len(doc)
        assert sum(len(k) for k, _ in sums.parts) <= sums.MOST + 900
        if sums.full():
            told.append(sums.told())
            sums.MOST = 5000
    told.append(sums.told())
    docs = {g * 2**33: np.zeros(60_000, [("known", "<i8"), ("base", "<f8"), ("score", "<f8")]) for g in range(40)}
    for r in (r for b in told for r in b.to_pylist()):
        hpylm.Sums.into(docs[r["grp"]], r["sums"])
    assert len(told) > 2 and all(np.allclose(list(docs[g][d].tolist()), v) for (g, d), v in want.items())
    assert sum(d["known"].sum() for d in docs.values()) == sum(v[0] for v in want.values())
    # A document's sums from every task took 24 bytes for each of a group's documents, 2.4 million here.
    assert sum(len(x) for b in told for x in b.column("sums").to_pylist()) <= 22 * places


def test_contexts_share_no_restaurant(spark, monkeypatch):
    rng, names, numbers = random.Random(4), [], {}
    for k in range(4000):  # more words than 8,192 restaurants had room for; draws' numbers of contexts differ, so that the model by one process keeps them apart too
        if numbers.setdefault(int(hpylm.Group([f"n{k}"], 1 << 22).context[1]), k) == k:
            names.append(f"n{k}")
    table = [(k, " ".join(x for w in rng.choices(range(len(names)), k=60) for x in (names[w], names[w * 7 % len(names)]))) for k in range(300)]
    got = hpylm.score(spark.createDataFrame(table, "doc_id bigint, text string").repartition(3)).collect()
    monkeypatch.setattr(hpylm, "CONTEXTS", 1 << 22)
    want = model_scores(table)
    assert len(got) == len(table)
    assert all(abs(r["score"] - want[(r["doc_id"], r["n_tokens"], r["n_known"])]) < 1e-4 * r["n_tokens"] for r in got)


def test_dealt_contexts_score_alike(spark, monkeypatch):
    table = rows(9)
    monkeypatch.setattr(hpylm, "LOOK", 1)
    monkeypatch.setattr(hpylm, "GROUP_BYTES", 1500)
    scores = []
    for often, tokens in ((4, 2_000_000), (4096, 10)):  # a few contexts dealt in 32 buckets, all in 2,048
        monkeypatch.setattr(hpylm, "FREQUENT", often)
        monkeypatch.setattr(hpylm, "BUCKET_TOKENS", tokens)
        got = hpylm.score(spark.createDataFrame(table, "doc_id bigint, text string").repartition(2)).collect()
        scores.append(sorted(((r["doc_id"], r["n_tokens"], r["n_known"], round(r["score"], 6)) for r in got), key=str))
    want = model_scores(table)
    assert scores[0] == scores[1] and all(abs(s - want[(i, n, k)]) < 1e-4 * n for i, n, k, s in scores[0])
