import random
import re

import numpy as np
import xxhash

from scriptorium.llm import simhash, widehash


def fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(values, most=4):
    """The smallest member of each value's component."""
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= most and find(i) != find(j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(values))]


def test_fingerprints():
    for text in (None, "", "one", "A b", "É a B c d", "a b c d e f g", "x  y\n z\tw " * 50, "İ K x y z"):
        assert simhash.fingerprint(text) % 2**64 == fingerprint(text)


def test_anchors_lose_no_pair():
    rng, anchors = random.Random(4), simhash.Anchors()
    x = [rng.getrandbits(64) for _ in range(3000)]
    y = [v ^ sum(1 << b for b in rng.sample(range(64), 4)) for v in x]
    both = [anchors.of(np.array(v, np.uint64).view(np.int64)) for v in (x, y)]
    sets = [[set() for _ in x], [set() for _ in x]]
    for (anchor, index), s in zip(both, sets, strict=True):
        for a, i in zip(anchor.tolist(), index.tolist(), strict=True):
            s[i].add(a)
    assert all(a & b for a, b in zip(*sets, strict=True)) and max(map(len, sets[0])) <= 18


def test_groups_against_brute_force(spark, monkeypatch):
    rng = random.Random(9)
    flip = lambda v, n: v ^ sum(1 << b for b in rng.sample(range(64), n))
    values = [0, 0, 2**64 - 1] + [rng.getrandbits(64) for _ in range(60)]
    for _ in range(300):
        values.append(flip(rng.choice(values), rng.randrange(0, 7)))
    chain = [rng.getrandbits(64)]
    for _ in range(40):
        chain.append(flip(chain[-1], 4))
    values += chain
    want = components(values)
    fps = np.array(values, np.uint64).view(np.int64).tolist()
    monkeypatch.setattr(simhash, "fingerprints", lambda docs: docs.select("doc_id", "fp"))
    for hot, matrix in ((16_000, 1500), (40, 10)):
        monkeypatch.setattr(simhash, "links", lambda nodes, h=hot: LINKS(nodes, h))
        monkeypatch.setattr(simhash, "MATRIX", matrix)
        got = {r["doc_id"]: r["component_id"] for r in simhash.near_groups(spark.createDataFrame(list(enumerate(fps)), "doc_id bigint, fp bigint")).collect()}
        assert [got[k] for k in range(len(values))] == want


LINKS = simhash.links


def test_documents_nulls_and_copies(spark):
    long = " ".join(f"w{k}" for k in range(200))
    rows = [(5, long), (3, long.upper()), (9, long + " tail"), (1, "other text of its own here"), (2, None), (4, ""), (None, "quite another one, with words"), (1, "other text of its own here")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS fp", "2 AS component_id")
    got = simhash.near_groups(df).collect()
    ids = {r["doc_id"]: r["component_id"] for r in got}
    assert len(got) == len(rows) and ids[5] == ids[3] == 3 and ids[9] in (3, 9) and ids[2] == ids[4] == 2 and ids[1] == 1 and ids[None] is None
    kept = widehash.keep_first(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted({c for c in ids.values()}, key=str)
    assert simhash.near_groups(df.limit(0)).count() == 0
