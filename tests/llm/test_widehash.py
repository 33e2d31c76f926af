"""The corpus stage's near-duplicates against brute force: five-word shingles, Jaccard 0.8."""

import random

import numpy as np

from scriptorium.llm import widehash


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def groups(texts, least=0.8):
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and find(i) != find(j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(texts))]


def near_texts():
    rng = random.Random(21)
    texts = [" ".join("w%d" % rng.randrange(4000) for _ in range(rng.randrange(3, 240))) for _ in range(60)]
    for _ in range(200):
        words = rng.choice(texts).split()
        for _ in range(rng.randrange(0, 6)):
            words[rng.randrange(len(words))] = "x%d" % rng.randrange(4000)
        texts.append(" ".join(words))
    return [*texts, None, "", " \n"]


def test_keep_first_keeps_one_of_each_group(spark):
    texts = near_texts()
    want = {k for k, root in enumerate(groups(texts)) if root == k}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    assert {r["doc_id"] for r in widehash.keep_first(df).collect()} == want and len(want) < len(texts) - 30
    assert widehash.keep_first(df.limit(0)).count() == 0


def test_candidates_of_a_cell_are_all_told(spark):
    sets = [widehash.shingles(t, widehash.Hashes()) for t in near_texts()]
    prints = np.stack([widehash.fingerprint(s) for s in sets])
    size = np.array([len(s) for s in sets])
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if widehash.similar(sets[i], sets[j])}
    got = {(int(a), int(b)) for i, j, _ in widehash.candidates(prints, size) for a, b in zip(i, j, strict=True)}
    assert want <= got and len(want) > 100


def test_forest_is_a_minimum_spanning_forest():
    rng = np.random.default_rng(3)
    i, j = rng.integers(0, 40, 90), rng.integers(40, 80, 90)
    order = rng.permutation(90)
    got, root, want = set(widehash.forest(80, i, j, order).tolist()), list(range(80)), set()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k in np.argsort(order).tolist():
        a, b = find(int(i[k])), find(int(j[k]))
        if a != b:
            root[a] = b
            want.add(k)
    assert got == want


def test_rows_that_share_an_id_or_have_none_are_judged_by_text(spark):
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(90)) for x in "abcd")
    rows = [(1, a), (2, a + " end"), (2, b), (2, c), (3, c), (3, c), (None, d), (None, d + " end"), (None, a), (4, d), (5, "x y z"), (5, "x y z"), (None, "q"), (None, "q")]
    want = [(1, a), (2, b), (2, c), (4, d), (5, "x y z"), (None, "q")]
    got = widehash.keep_first(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3))
    assert got.columns == ["doc_id", "text"] and sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_parity_bits_pass_every_similar_pair():
    rng = np.random.default_rng(5)
    sets = []
    for size in [1, 2, 5, 9, 40, 300, 3000]:
        for _ in range(6):
            own = rng.integers(0, 2**63, size).astype(np.uint64)
            for share in (0.0, 0.05, 0.11, 0.12, 0.2, 0.5):
                other = own.copy()
                other[: round(share * size)] = rng.integers(0, 2**63, round(share * size)).astype(np.uint64)
                sets.append(np.unique(other))
    odd = np.stack([widehash.parity(s) for s in sets]).view(np.uint64)
    size = np.array([len(s) for s in sets])
    i, j = np.triu_indices(len(sets), 1)
    passed = widehash.may_be_similar(odd, size, i, j)
    alike = np.array([widehash.similar(sets[a], sets[b]) for a, b in zip(i, j, strict=True)])
    assert alike.sum() > 50 and passed[alike].all()
    few = np.maximum(size[i], size[j]) <= 300  # the bits of thousands of shingles say little
    assert passed[few].sum() < alike[few].sum() + 20
