"""The pipeline and the Arrow queries on a small fixture, against brute force."""

import hashlib
import random
from collections import Counter
from fractions import Fraction

import public_tokenizers
import sentencepiece
from test_native import WORD, statistics, water_filling
from test_simhash import components, fingerprint

import corpus_pipeline
from scriptorium.llm import flac, hpylm, quality, spiece, tokencount
from scriptorium.llm.queries import QUERIES, SQL

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def fixture():
    rng = random.Random(11)
    word = lambda: rng.choice("the of and".split()) if rng.random() < 0.3 else "w%d" % rng.randrange(3000)
    passage = " ".join(word() for _ in range(55))
    rows = []
    for k in range(120):
        text = " ".join(word() for _ in range(rng.randrange(8, 160)))
        if k % 6 == 0:
            text = text[: len(text) // 2] + "\n" + passage + "\n" + text[len(text) // 2 :]
        if k % 9 == 0:
            text = " ".join(w + "###" for w in text.split())
        if k % 10 == 7:
            text = rows[k - 5][1]
        if k % 10 == 8:
            text = rows[k - 2][1] + " end"
        rows.append((k, text, "en", rng.choice(["a", "b", "é", None]), len(text)))
    return [*rows, (500, None, "en", "a", None), (501, "", "en", "a", 0), (502, "la la " * 30, "fr", "b", 180)]


def cut(rows, window=20):
    first, out = {}, []
    split = [(i, t.split()) for i, t, *_ in rows]
    for i, words in split:
        for k in range(len(words) - window + 1):
            first.setdefault(tuple(words[k : k + window]), []).append((i, k))
    for (i, words), row in zip(split, rows, strict=True):
        gone = {j for k in range(len(words) - window + 1) if min(first[tuple(words[k : k + window])]) < (i, k) for j in range(k, k + window)}
        out.append((i, " ".join(w for k, w in enumerate(words) if k not in gone) if gone else row[1], *row[2:]))
    return out


def test_pipeline_against_brute_force(spark, tmp_path):
    rows = fixture()
    docs = spark.createDataFrame(rows, DOCS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([(k, int(k % 9 != 0), 0) for k in range(110)], "doc_id bigint, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())

    rules = quality.fit(docs, labels)

    def good(row):
        n, chars, symbols, dup, repeat = statistics(row[1])
        own = {"words": n, "word_length": chars / max(n, 1), "symbols_per_word": symbols / max(n, 1), "dup_lines": dup, "dup_lines_per_word": dup / max(n, 1), "repeated_share": repeat / max(n, 1)}
        return n >= 10 and 100 * repeat <= 20 * n and not any(all(c.holds(own) for c in rule) for rule in rules)

    kept = sorted(filter(good, rows))
    root = components([fingerprint(r[1]) for r in kept])
    kept = cut([r for k, r in enumerate(kept) if root[k] == k])
    sizes = Counter()
    for r in kept:
        sizes[r[3]] += len(WORD.findall(r[1]))
    target = water_filling(sizes)
    library, want = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model")), []
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in kept:
        rate = target[r[3]] / sizes[r[3]] if sizes[r[3]] else Fraction(0)
        chance = int(hashlib.md5(f"mix-1|{r[0]}".encode()).hexdigest()[:12], 16) / 2**48
        ids = library.encode(r[1])
        want += [(r[0], len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))] * (int(rate) + (chance < float(rate - int(rate))))
    assert got == sorted(want) and 20 < len(want)


def test_arrow_queries_on_odd_rows(spark):
    model, ranks = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = [(1, None), (2, ""), (3, "a b. C d\n\né"), (3, "a b. C d\n\né"), (None, "x" * 200_000), (4, "\x00\t ")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS n_tokens", "2 AS media").repartition(2)
    library = sentencepiece.SentencePieceProcessor(model_file=model)
    got = Counter((r[0], r[1], r[2]) for r in spiece.encode(df, model).collect())
    assert got == Counter((i, len(x := library.encode(t or "")), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for i, t in rows)
    sections = tokencount.count(df, ranks, public_tokenizers.PATTERN).collect()
    assert sum(r["n_bytes"] for r in sections) == sum(len((t or "").encode()) for _, t in rows)
    assert [(r["n_tokens"], r["kind"]) for r in sections if r["doc_id"] == 1] == [(0, "head")]
    media = flac.encode_texts(df)
    back = {r["doc_id"]: r for r in flac.read_back(media).collect()}
    assert all(back[i]["payload_sha256"] == hashlib.sha256(flac.payload_of(t)).hexdigest() and back[i]["n_bytes"] == len((t or "").encode()) for i, t in rows)
    blocks = flac.pcm_blocks(media).where("doc_id = 4").collect()
    assert [(b["block"], b["first_sample"], b["n_samples"]) for b in blocks] == [(0, 0, 576)]
    none = df.limit(0)
    assert spiece.encode(none, model).count() == tokencount.count(none, ranks, public_tokenizers.PATTERN).count() == flac.read_back(flac.encode_texts(none)).count() == 0
    assert hpylm.perplexity(hpylm.score(df), False).first()["n_tokens"] > 0


def test_names():
    assert [f"op{n}_" for n in range(1, 11)] == sorted({k.split("_")[0] + "_" for k in QUERIES}, key=lambda k: int(k[2:-1])) and set(SQL) <= set(QUERIES)
    assert len(corpus_pipeline.STAGES) == 5
