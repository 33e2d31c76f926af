"""Queries of the corpus chain: inspection of texts, joins of streams, packing, interleaving and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.operators import arbitrate, corpus, diverge, joins, metrics, paragraphs, transcribe
from scriptorium.plans.audits import CONFUSE, DASHED, PROFILE, SEGMENTS_SQL, dashed, readings, segments
from scriptorium.plans.derived import NUMBER_SQL
from scriptorium.plans.registry import query, quoted
from scriptorium.profiles import ENGLISH, GENERIC, LATIN
from scriptorium.sources.tables import table

INVENTORY = "c AS (SELECT unnest(string_split(text, '')) AS letter FROM documents), i AS (SELECT letter, count(*) AS n FROM c WHERE letter <> '' GROUP BY letter)"


def _inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.char_inventory(table(spark, sf_dir, "documents"), "text", "doc_id")


@query(f"WITH {SEGMENTS_SQL}, k AS (SELECT length(trim(line)) AS k FROM segments) SELECT count(*) AS n, count_if(k >= 40) AS at_least_40, count_if(k >= 50) AS at_least_50, count_if(k >= 60) AS at_least_60, count_if(k BETWEEN 60 AND 600) AS between_60_600 FROM k")
def length_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.length(T.trimmed(F.col("line")))
    return segments(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("n"), *(F.count_if(k >= n).alias(f"at_least_{n}") for n in (40, 50, 60)), F.count_if(k.between(60, 600)).alias("between_60_600")
    )


@query(f"WITH l AS (SELECT unnest(string_split('{LATIN[:8]}', '')) AS letter) SELECT doc_id, letter, 1000.0::DOUBLE * (length(text) - length(replace(text, letter, '')))::DOUBLE / greatest(1, length(text))::DOUBLE AS rate FROM documents, l")
def canary_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(corpus.letter_rates(F.col("text"), LATIN[:8])).alias("x"))
    return rows.select("doc_id", "x.letter", "x.rate")


@query(f"""WITH b AS (SELECT source, doc_id, text, coalesce(sum(length(text) + 1) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents),
h AS (SELECT source, substring(' ' || string_agg(text, ' ' ORDER BY doc_id), 1, 10000) AS head FROM b WHERE before < 10000 GROUP BY source), l AS (SELECT unnest(string_split('{LATIN[11:19]}', '')) AS letter),
r AS (SELECT source, letter, 1000.0::DOUBLE * (length(head) - length(replace(head, letter, '')))::DOUBLE / length(head)::DOUBLE AS rate FROM h, l) SELECT *, letter = 'é' AND rate < 0.5 AS low FROM r""")
def macro_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letter rates in the first 10,000 characters of each source: the scan's limit is its feature."""
    return corpus.macro_scan(table(spark, sf_dir, "documents"), "source", "doc_id", "text", LATIN[11:19], "é")


PLAIN = [f"('{a}', '{b}')" for a, b in zip(GENERIC.fold, GENERIC.to, strict=True)]


@query(f"""WITH {INVENTORY}, p AS (SELECT * FROM (VALUES {', '.join(PLAIN)}) AS p(letter, plain)) SELECT p.letter, p.plain, CASE WHEN a.n IS NOT NULL THEN coalesce(b.n, 0)::DOUBLE / a.n::DOUBLE WHEN b.n IS NOT NULL THEN 'inf'::DOUBLE END AS ratio
FROM p LEFT JOIN i a ON a.letter = p.letter LEFT JOIN i b ON b.letter = p.plain""")
def fallback_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.fallback_ratios(_inventory(spark, sf_dir), GENERIC.fold, GENERIC.to)


PARTS = {**{c: c for c in LATIN}, "ch": "ch", "ie": "ie", **corpus.DASHES}


@query("WITH " + "SELECT item, n FROM (".replace("SELECT", "s AS (SELECT 1) SELECT", 1) + " UNION ALL ".join(f"SELECT '{k}' AS item, ((sum(length(text)) - sum(length(replace(text, '{p}', '')))) // {len(p)})::BIGINT AS n FROM (SELECT {DASHED.format('text')} AS text FROM documents)" for k, p in PARTS.items()) + ")")
def sign_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences of accented letters, digraphs and dashes."""
    return corpus.sign_counts(table(spark, sf_dir, "documents").select(dashed(F.col("text")).alias("text")), "text", PARTS)


PREFIXES = ("il", "is", "id", "it", "l", "fis", "bil", "tal")


def _hyphen_sql() -> str:
    ends = lambda c: f"sum(len(list_filter(lines[1:len(lines) - 1], lambda x: right(rtrim(x), 1) IN ({c}))))"
    parts = [f"SELECT '{k}' AS item, (sum(length(text)) - sum(length(replace(text, '{d}', ''))))::BIGINT AS n FROM t" for k, d in corpus.DASHES.items()]
    parts += [f"SELECT 'line_{k}', {ends(quoted([corpus.DASHES[k]]))}::BIGINT FROM t" for k in ("hyphen", "en_dash", "em_dash")]
    parts += ["SELECT 'line_any', count_if(len(list_filter(lines[1:len(lines) - 1], lambda x: right(rtrim(x), 1) IN ('-', '–', '—'))) > 0)::BIGINT FROM t"]
    parts += [f"""SELECT 'prefix_{p}', count_if(regexp_matches(lower(text), '(?:^|[\\s(\\["]){p}-[a-zàèìòùċġħż]'))::BIGINT FROM t""" for p in PREFIXES]
    return f"WITH t AS (SELECT text, string_split(text, chr(10)) AS lines FROM (SELECT replace({DASHED.format('text')}, ' la ', '-' || chr(10)) AS text FROM documents)) " + " UNION ALL ".join(parts)


@query(_hyphen_sql())
def hyphen_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.replace(dashed(F.col("text")), F.lit(" la "), F.lit("-\n")).alias("text"))
    return corpus.hyphen_statistics(docs.withColumn("lines", F.split("text", "\n")), "text", "lines", PREFIXES)


@query(f"""WITH w AS (SELECT text, regexp_extract_all(text, '[A-Za-z]+') AS ws FROM documents),
r AS (SELECT *, CASE WHEN len(ws) = 0 THEN 0.0 ELSE len(list_filter(ws, lambda x: lower(x) IN ({quoted(ENGLISH)})))::DOUBLE / len(ws)::DOUBLE END AS en, regexp_matches(text, '[{LATIN}]') AS own, regexp_matches(text, '[A-Za-z]') AS latin FROM w)
SELECT count_if(own OR (latin AND en < 0.2)) AS own, count_if(NOT own AND latin AND en >= 0.2) AS english, count_if(NOT own AND NOT latin) AS other, count_if(own AND latin AND en >= 0.1) AS mixed FROM r""")
def language_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts by language; mixed overlaps the others."""
    text = F.col("text")
    rows = table(spark, sf_dir, "documents").select((T.canaries(text) > 0).alias("own"), text.rlike("[A-Za-z]").alias("latin"), T.english_ratio(text).alias("en"))
    own, latin, en = F.col("own"), F.col("latin"), F.col("en")
    return rows.agg(
        F.count_if(own | (latin & (en < 0.2))).alias("own"), F.count_if(~own & latin & (en >= 0.2)).alias("english"), F.count_if(~own & ~latin).alias("other"), F.count_if(own & latin & (en >= 0.1)).alias("mixed")
    )


CHARSET = "abcdefghijklmnopqrstuvwxyz0123456789.,;:!?ħżœæ" + LATIN


@query(f"WITH {INVENTORY}, s AS (SELECT DISTINCT unnest(string_split('{CHARSET}', '')) AS letter) SELECT letter, letter IN (SELECT letter FROM i) AS covered FROM s")
def charset_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = spark.range(1).select(F.explode(F.array_distinct(F.array(*map(F.lit, CHARSET)))).alias("letter"))
    have = _inventory(spark, sf_dir).select("letter", F.lit(True).alias("covered"))
    return every.join(have, "letter", "left").select("letter", F.coalesce("covered", F.lit(False)).alias("covered"))


@query(f"WITH {INVENTORY}, r AS (SELECT letter, (row_number() OVER (ORDER BY letter) - 1) // 22 AS line FROM i WHERE letter > ' ') SELECT line::INT AS line, string_agg(letter, '' ORDER BY letter) AS text FROM r GROUP BY line")
def charset_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.charset_packs(_inventory(spark, sf_dir).where("letter > ' '"), "letter")


@query("""WITH c AS (SELECT source, unnest(string_split(text, '')) AS letter FROM documents), n AS (SELECT source, letter, count(*) AS n FROM c WHERE letter <> '' GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, letter) AS rank FROM n) SELECT source, letter, n, rank::INT AS rank FROM r WHERE rank <= 30""")
def top_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    letters = table(spark, sf_dir, "documents").select("source", F.explode(F.filter(F.split("text", ""), lambda c: c != "")).alias("letter"))
    counts = letters.groupBy("source", "letter").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "letter"))).where("rank <= 30")


@query("SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents) WHERE r <= 30")
def bucket_loader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evaluation set: the first 30 of each of four buckets by id."""
    return corpus.first_of_buckets(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id")


@query("SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 50")
def sorted_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang").orderBy("doc_id").limit(50)


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions with duplicates (the later one counts) and with some ids missing."""
    docs = table(spark, sf_dir, "documents").where("doc_id % 7 <> 0")
    one = docs.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("pos"), F.lit("").alias("hyp"))
    return one.union(docs.select("doc_id", F.col("doc_id") + 10_000_000_000, F.concat(F.lit("p"), F.col("doc_id").cast("string")))).union(docs.where("doc_id % 5 = 0").select("doc_id", F.col("doc_id") + 5, F.lit("early")))


@query("SELECT doc_id AS id, lang, 'p' || doc_id AS hyp FROM documents WHERE doc_id % 7 <> 0")
def gold_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang")
    return gold.join(joins.last_of_each(_predictions(spark, sf_dir), "id", "pos").select("id", "hyp"), "id").select("id", "lang", "hyp")


@query("SELECT doc_id AS id FROM documents WHERE doc_id % 7 = 0 ORDER BY doc_id LIMIT 20")
def missing_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 20 gold ids without a prediction."""
    gold = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    return joins.missing(gold, _predictions(spark, sf_dir), "id", "id")


def _streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, stream, hyp): three streams, two of which lack some ids."""
    docs = table(spark, sf_dir, "documents")
    each = F.explode(F.array(F.lit("a"), F.when(F.col("doc_id") % 3 > 0, F.lit("b")), F.when(F.col("doc_id") % 5 > 0, F.lit("c")))).alias("stream")
    return docs.select(F.col("doc_id").alias("id"), each).where("stream is not null").withColumn("hyp", F.concat("stream", F.col("id").cast("string")))


@query("SELECT doc_id AS id, s AS stream, s || doc_id AS hyp FROM documents, (SELECT unnest(['a', 'b', 'c']) AS s) WHERE doc_id % 3 > 0 AND doc_id % 5 > 0")
def complete_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.in_all_streams(_streams(spark, sf_dir), "id", "stream", ("a", "b", "c"))


@query("SELECT doc_id AS id, 'a' || doc_id AS a, CASE WHEN doc_id % 3 > 0 THEN 'b' || doc_id ELSE '' END AS b, CASE WHEN doc_id % 5 > 0 THEN 'c' || doc_id ELSE '' END AS c FROM documents")
def stream_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.pivoted(_streams(spark, sf_dir), "id", "stream", "hyp", ("a", "b", "c"))


@query("SELECT doc_id AS id, v AS seed, 'a' || doc_id AS anchor, v || doc_id AS candidate FROM documents, (SELECT unnest(['b', 'c']) AS v) WHERE doc_id % (CASE WHEN v = 'b' THEN 3 ELSE 5 END) > 0")
def seed_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold, anchor and each seed's candidate, by id and seed."""
    rows = _streams(spark, sf_dir)
    gold = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    anchor = rows.where("stream = 'a'").select("id", F.col("hyp").alias("anchor"))
    seeds = rows.where("stream <> 'a'").select("id", F.col("stream").alias("seed"), F.col("hyp").alias("candidate"))
    return gold.join(anchor, "id").join(seeds, "id").select("id", "seed", "anchor", "candidate")


@query(f"""WITH {SEGMENTS_SQL}, r AS (SELECT doc_id, pos, line AS base, [replace(line, 'li', 'h'), line, '', {CONFUSE.format('line')}, replace(line, 'li', 'h')] AS x FROM segments)
SELECT doc_id, pos::INT AS pos, len(list_distinct(list_filter(x, lambda c: c <> '' AND c <> base))) AS n FROM r""")
def candidate_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many different candidates a line's base has: no empty ones, none equal to it."""
    line = F.col("line")
    h = F.replace(line, F.lit("li"), F.lit("h"))
    every = F.array(h, line, F.lit(""), readings(line)[1], h)
    return segments(spark, sf_dir).select("doc_id", "pos", F.size(arbitrate.candidates(line, every)).cast("long").alias("n"))


@query(f"""WITH {SEGMENTS_SQL}, q AS (SELECT doc_id, pos, replace(replace(replace(line, ' de ', ' ''de'' '), ' the ', ' "the" '), ' la ', ' l''a ') AS t FROM segments),
a AS (SELECT *, replace(regexp_replace(t, '(^|\\s)''([\\p{{L}}\\p{{N}}])', '\\1‘\\2', 'g'), '''', '’') AS b FROM q)
SELECT doc_id, pos::INT AS pos, replace(regexp_replace(b, '(^|\\s)"([\\p{{L}}\\p{{N}}])', '\\1“\\2', 'g'), '"', '”') AS curly, replace(t, '''', '’') AS closing, translate(replace(regexp_replace(b, '(^|\\s)"([\\p{{L}}\\p{{N}}])', '\\1“\\2', 'g'), '"', '”'), '‘’“”', '''''""') AS plain FROM a""")
def quote_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Straight quotes by place, all as closing ones, and folded back."""
    line = F.col("line")
    t = F.replace(F.replace(F.replace(line, F.lit(" de "), F.lit(" 'de' ")), F.lit(" the "), F.lit(' "the" ')), F.lit(" la "), F.lit(" l'a "))
    rows = segments(spark, sf_dir).select("doc_id", "pos", t.alias("t"))
    curly = T.curly_quote(T.curly_apostrophe(F.col("t")))
    return rows.select("doc_id", "pos", curly.alias("curly"), T.closing_apostrophe(F.col("t")).alias("closing"), T.convention_fold(curly).alias("plain"))


@query(f"""WITH {SEGMENTS_SQL} SELECT doc_id, pos::INT AS pos, regexp_replace({DASHED.format('line')}, '(^|[^\\p{{L}}\\p{{N}}_''’])(il|Tal)-[ \\t]+', '\\1\\2-', 'g') AS text FROM segments""")
def clitic_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(spark, sf_dir).select("doc_id", "pos", T.clitic_spaces(dashed(F.col("line")), PROFILE).alias("text"))


@query(f"""WITH {SEGMENTS_SQL}, t AS (SELECT doc_id, pos, CASE pos % 4 WHEN 0 THEN 'Disclaimer: ' || line WHEN 1 THEN '[REV] ' || line WHEN 2 THEN '■ ' || line ELSE line END AS t FROM segments),
b AS (SELECT doc_id, pos, CASE WHEN starts_with(t, 'Disclaimer') THEN NULL WHEN contains(t, '[REV]') AND length(trim(regexp_replace(replace(t, '[REV]', ''), '\\s+', ' ', 'g'))) < 15 THEN NULL WHEN contains(t, '[REV]') THEN trim(replace(t, '[REV]', '')) ELSE t END AS b FROM t)
SELECT pos % 4 AS kind, count(*) AS n, count(b) AS kept, sum(length(trim(regexp_replace(regexp_replace(b, '[■-◿]', '', 'g'), '\\s+', ' ', 'g'))))::BIGINT AS chars FROM b GROUP BY 1""")
def boilerplate_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks with disclaimers, revision marks and geometric marks, and what is kept of them."""
    kind, line = F.col("pos") % 4, F.col("line")
    t = F.when(kind == 0, F.concat(F.lit("Disclaimer: "), line)).when(kind == 1, F.concat(F.lit("[REV] "), line)).when(kind == 2, F.concat(F.lit("■ "), line)).otherwise(line)
    rows = segments(spark, sf_dir).select(kind.cast("long").alias("kind"), t.alias("t")).select("kind", T.boilerplate(F.col("t"), "Disclaimer", ("[REV]",)).alias("b"))
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count("b").alias("kept"), F.sum(F.length(T.pdf_text(F.col("b"))).cast("long")).alias("chars"))


@query()
def block_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of the benchmark's items as a glyph layer has them, against the items' texts: coverage, and kept from 0.7."""
    items = table(spark, sf_dir, "benchmark").select("item_id", T.pdf_text(F.col("text")).alias("text"))
    rows = items.select("item_id", T.pdf_text(F.replace(F.replace("text", F.lit("rn"), F.lit("m")), F.lit("li"), F.lit("h"))).alias("block"), "text")
    scored = rows.select("item_id", F.length("block").alias("n"), corpus.block_coverage(F.col("block"), F.col("text")).alias("coverage"))
    return scored.select("item_id", "coverage", F.when(F.col("coverage") >= 0.7, "kept").when(F.col("n") < 15, "too_short").otherwise("no_match").alias("status"))


@query()
def packed_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of each document put together as paragraphs of 150 to 1,000 characters."""
    docs = table(spark, sf_dir, "documents")
    sentences = F.filter(F.split("text", r"\n|(?<=[.!?])\s+"), lambda s: s != "")
    return docs.select("doc_id", F.posexplode(corpus.packed(sentences)).alias("pos", "text"))


@query(f"""WITH s AS (SELECT range AS slot FROM range(400)), v AS (SELECT slot, CASE WHEN {NUMBER_SQL.format("'mix|' || slot")}::DOUBLE / 4294967296.0 < 0.12 THEN 'extra' WHEN {NUMBER_SQL.format("'mix-source|' || slot")}::DOUBLE / 4294967296.0 <= 0.7 THEN 'de' ELSE 'fr' END AS lang FROM s),
k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY slot) - 1 AS k FROM v), p AS (SELECT lang, doc_id FROM documents WHERE lang IN ('de', 'fr') UNION ALL SELECT 'extra', doc_id FROM documents WHERE lang = 'en'),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM p) SELECT slot, k.lang AS lang, doc_id FROM k JOIN r ON k.lang = r.lang AND r.pos = k.k % r.n""")
def weighted_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """400 slots: 12 % English, the rest German and French as 7 to 3, each source over again when it ends."""
    docs = table(spark, sf_dir, "documents").select("lang", "doc_id")
    return corpus.weighted_interleave(docs, "lang", "doc_id", {"de": 0.7, "fr": 0.3}, 400, docs.where("lang = 'en'"), 0.12)


@query(r"""WITH h AS (SELECT page_id, regexp_extract_all(regexp_replace(html, '(?s)<NOTE\b.*?</NOTE>', '', 'g'), '(?s)<p(?:\s[^>]*)?>(.*?)</p>', 1) AS x FROM pages),
c AS (SELECT page_id, list_filter(list_transform(x, lambda t: trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(t, '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&amp;', '&'), '\s+', ' ', 'g'))), lambda t: t <> '') AS x FROM h)
SELECT page_id, array_to_string(x, chr(10)) AS text FROM c""")
def element_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the pages' paragraph elements."""
    return table(spark, sf_dir, "pages").select("page_id", corpus.formex_text(F.col("html"), ("p",)).alias("text"))


@query("""WITH h AS (SELECT vec_id, unnest(embedding) AS e FROM embeddings), l AS (SELECT label, (floor((e + 1) * 128))::INT AS level FROM h JOIN embeddings USING (vec_id)), c AS (SELECT label, greatest(0, least(255, level)) AS level, count(*)::DOUBLE AS n FROM l GROUP BY ALL),
r AS (SELECT *, sum(n) OVER w AS b, sum(level * n) OVER w AS sb, sum(n) OVER (PARTITION BY label) AS t, sum(level * n) OVER (PARTITION BY label) AS s FROM c WINDOW w AS (PARTITION BY label ORDER BY level)),
v AS (SELECT *, b * (t - b) * pow(sb / b - (s - sb) / (t - b), 2) AS v, row_number() OVER (PARTITION BY label ORDER BY b * (t - b) * pow(sb / b - (s - sb) / (t - b), 2) DESC NULLS LAST, level) AS r FROM r WHERE t > b) SELECT label, level::INT AS threshold FROM v WHERE r = 1""")
def otsu_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The threshold of each label's values as grey levels."""
    level = F.greatest(F.lit(0), F.least(F.lit(255), F.floor((F.col("e") + 1) * 128).cast("int")))
    values = table(spark, sf_dir, "embeddings").select("label", F.explode("embedding").alias("e")).select("label", level.alias("level"))
    return corpus.otsu(values.groupBy("label", "level").agg(F.count(F.lit(1)).cast("double").alias("n")), "label", "level", "n")


@query("""WITH p AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN string_split(replace(text, ' de ', ' d' || chr(173) || 'e '), chr(10)) ELSE string_split(text, chr(10)) END AS parts FROM documents),
s AS (SELECT len(list_filter(parts, lambda x: contains(x, chr(173)))) > 0 AS soft, len(parts) > 1 AS many FROM p)
SELECT count(*) AS n_samples, count_if(soft) AS soft_hyphen_samples, count_if(soft) AS soft_hyphen_pass, count_if(many) AS joiner_samples, count_if(many) AS joiner_pass,
  round(count_if(soft)::DOUBLE / greatest(count_if(soft), 1)::DOUBLE, 4) AS soft_hyphen_pass_rate, round(count_if(many)::DOUBLE / greatest(count_if(many), 1)::DOUBLE, 4) AS joiner_pass_rate FROM s""")
def round_trip_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with soft hyphens: all are recovered, and the joiner puts all lines together."""
    text = F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit(" de "), F.lit(" d­e "))).otherwise(F.col("text"))
    rows = table(spark, sf_dir, "documents").select("doc_id", text.alias("label"), F.split(text, "\n").alias("parts"))
    return corpus.round_trip_report(rows, "parts", "label", paragraphs.join_lines(F.col("parts")))


@query("""WITH v AS (SELECT lang, length(text) AS x FROM documents WHERE lang IN ('en', 'de')), d AS (SELECT DISTINCT x FROM v), n AS (SELECT count_if(lang = 'en') AS a, count_if(lang = 'de') AS b FROM v),
f AS (SELECT d.x, (SELECT count(*) FROM v WHERE lang = 'en' AND v.x <= d.x)::DOUBLE / a AS fa, (SELECT count(*) FROM v WHERE lang = 'de' AND v.x <= d.x)::DOUBLE / b AS fb FROM d, n) SELECT round(max(abs(fa - fb)), 12) AS ks, any_value(a) AS n_a, any_value(b) AS n_b FROM f, n""")
def ks_two_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").where("lang in ('en', 'de')").select("lang", F.length("text").alias("x"))
    got = diverge.two_sample_ks(rows, "lang", "x", "en", "de")
    return got.select(F.round("ks", 12).alias("ks"), "n_a", "n_b")


@query("""WITH o AS (SELECT lang, count(*)::DOUBLE AS o FROM documents WHERE doc_id % 3 = 0 GROUP BY lang), b AS (SELECT lang, count(*)::DOUBLE AS b FROM documents WHERE doc_id % 3 > 0 GROUP BY lang),
j AS (SELECT coalesce(o, 0) AS o, greatest(coalesce(b, 0), 1e-9::DOUBLE) AS b FROM o FULL JOIN b USING (lang)), e AS (SELECT o, b * (SELECT sum(o) FROM j) / (SELECT sum(b) FROM j) AS e FROM j) SELECT round(sum((o - e) * (o - e) / e), 9) AS chi2, (count(*) - 1)::BIGINT AS df FROM e""")
def chi2_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of languages in a third of the documents against those of the others, rescaled."""
    docs = table(spark, sf_dir, "documents")
    counted = lambda rows: rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    got = diverge.baseline_chi_square(counted(docs.where("doc_id % 3 = 0")), counted(docs.where("doc_id % 3 > 0")), "lang")
    return got.withColumn("chi2", F.round("chi2", 9))


@query(f"""WITH {SEGMENTS_SQL}, t AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN (doc_id % 100) || ' - ' || text WHEN doc_id % 3 = 1 THEN replace(text, ' de ', ' ''de'' ') ELSE replace(text, ' the ', ' "the" ') END AS g FROM documents)
SELECT count(*) AS n, count_if(regexp_matches(g, '^\\s*\\d{{1,2}}\\s*[-–—]')) AS lead, count_if(regexp_matches(g, '[''‘’]')) AS apostrophe, count_if(regexp_matches(g, '["“”]')) AS double_quote FROM t""")
def rule_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that exercise each label rule."""
    k, text = F.col("doc_id"), F.col("text")
    g = F.when(k % 3 == 0, F.concat((k % 100).cast("string"), F.lit(" - "), text)).when(k % 3 == 1, F.replace(text, F.lit(" de "), F.lit(" 'de' "))).otherwise(F.replace(text, F.lit(" the "), F.lit(' "the" ')))
    return transcribe.rule_triggers(table(spark, sf_dir, "documents").select(g.alias("g")), "g")


def _readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, gold, streams): lines of the benchmark's items with three readings; the anchor drops accents, the others confuse letters."""
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("gold"))
    g = F.col("gold")
    every = [T.folded(g), *readings(g)[1:3], F.translate(g, "ou", "ön")]
    return rows.withColumn("streams", F.array(*(F.struct(F.lit(k).alias("ord"), x.alias("hyp")) for k, x in enumerate(every))))


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select(F.explode(F.split("text", r"\s+")).alias("w"))
    return metrics.key_lexicon(words)


@query()
def transcribed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's items read by four streams and put together: base, windowed vote with the documents' lexicon, label rules."""
    return transcribe.transcribe(_readings(spark, sf_dir), _known(spark, sf_dir)).select("id", "text")


@query()
def rules_left_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate of the whole chain and of the chain without each rule, and what that says of the rule."""
    return transcribe.left_out(_readings(spark, sf_dir), _known(spark, sf_dir))
