"""Queries of scoring and auditing: rates in several forms, paired deltas and what resampling says of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.functions.align import distance
from scriptorium.operators import buckets, metrics, pairwise, resample
from scriptorium.plans.derived import _CONTROL
from scriptorium.plans.registry import query, quoted
from scriptorium.profiles import ENGLISH, GENERIC, LATIN, MALTESE, Language
from scriptorium.sources.tables import table

#: The driver's letters with the articles that the dashed input has.
PROFILE = Language("mixed", GENERIC.canaries, GENERIC.fold, GENERIC.to, MALTESE.articles, MALTESE.clitics)

# --- inputs -------------------------------------------------------------------------------------------------------


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, pos, line): every line and sentence of every document, in order."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "lang", "source", F.posexplode(F.split("text", r"\n|[.!?] ")).alias("pos", "line")).where(T.trimmed(F.col("line")) != "")


SEGMENTS_SQL = r"""segments AS (SELECT doc_id, lang, source, pos, line FROM (SELECT doc_id, lang, source, generate_subscripts(x, 1) - 1 AS pos, unnest(x) AS line
  FROM (SELECT doc_id, lang, source, regexp_split_to_array(text, '\n|[.!?] ') AS x FROM documents)) WHERE trim(line) <> '')"""


def dashed(line: Column) -> Column:
    """Articles with a stray blank behind their hyphen in place of some short words."""
    return F.replace(F.replace(line, F.lit(" de "), F.lit(" il- ")), F.lit(" the "), F.lit(" Tal- "))


DASHED = "replace(replace({}, ' de ', ' il- '), ' the ', ' Tal- ')"
FOLD = f"translate({{}}, '{LATIN}', '{GENERIC.to}')"
CONFUSE = "replace(replace({}, 'rn', 'm'), 'li', 'h')"
ED = f"levenshtein(translate({{}}, '{LATIN}', '{_CONTROL}'), translate({{}}, '{LATIN}', '{_CONTROL}'))"


def readings(line: Column) -> list[Column]:
    """Four systems' readings of a line; the first is the baseline."""
    confused = F.replace(F.replace(line, F.lit("rn"), F.lit("m")), F.lit("li"), F.lit("h"))
    return [T.folded(line), confused, F.translate(line, "é", "e"), F.when(F.length(line) % 3 == 0, T.folded(line)).otherwise(confused)]


READINGS = [FOLD.format("line"), CONFUSE.format("line"), "translate(line, 'é', 'e')", f"CASE WHEN length(line) % 3 = 0 THEN {FOLD.format('line')} ELSE {CONFUSE.format('line')} END"]


def _read(spark: SparkSession, sf_dir: str, systems: tuple[int, ...]) -> DataFrame:
    """(doc_id, lang, len, e0, e1, ...): a document's characters and each system's edits, summed over its lines. Lines aren't repeated by system."""
    rows = segments(spark, sf_dir).select("doc_id", "lang", "line", *(readings(F.col("line"))[k].alias(f"h{k}") for k in systems))
    counted = rows.select("doc_id", "lang", F.length("line").cast("long").alias("len"), *(distance("line", f"h{k}").cast("long").alias(f"e{k}") for k in systems))
    return counted.groupBy("doc_id", "lang").agg(F.sum("len").alias("len"), *(F.sum(f"e{k}").alias(f"e{k}") for k in systems))


def read_lines(spark: SparkSession, sf_dir: str, systems: tuple[int, ...] = (0, 1, 2, 3)) -> DataFrame:
    """(doc_id, lang, system, ed, len) summed over a document's lines, of those systems alone that are asked for."""
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("system"), F.col(f"e{k}").alias("ed"), "len") for k in systems))).alias("x")
    return _read(spark, sf_dir, systems).select("doc_id", "lang", each).select("doc_id", "lang", "x.system", "x.ed", "x.len")


READ_SQL = (
    SEGMENTS_SQL
    + f""", readings AS (SELECT doc_id, lang, line, unnest([0, 1, 2, 3]) AS system, unnest([{', '.join(READINGS)}]) AS hyp FROM segments),
systems AS (SELECT doc_id, lang, system, sum(CASE WHEN line = hyp THEN 0 ELSE {ED.format('line', 'hyp')} END)::BIGINT AS ed, sum(length(line))::BIGINT AS len FROM readings GROUP BY ALL)"""
)


def triples(spark: SparkSession, sf_dir: str, *variants: int) -> DataFrame:
    """(id, lang, variant, ev, eb, len): each document with a variant's and the baseline's edits. The generator keeps all sums, so that branches of a query share one exchange."""
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("variant"), F.col(f"e{k}").alias("ev"), F.col("e0").alias("eb"), "len") for k in variants))).alias("x")
    return _read(spark, sf_dir, tuple(sorted({0, *variants}))).select(F.col("doc_id").alias("id"), "lang", each).select("id", "lang", "x.*")


def triples_sql(*variants: int) -> str:
    return READ_SQL + f""", triples AS (SELECT v.doc_id AS id, v.lang, v.system AS variant, v.ed AS ev, b.ed AS eb, v.len FROM systems v JOIN systems b ON v.doc_id = b.doc_id AND b.system = 0 WHERE v.system IN ({', '.join(map(str, variants))}))"""


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, tag): the six labels of each document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", dashed(F.col("text")).alias("text"))
    cuts = F.broadcast(buckets.quartile_cuts(docs).drop("n"))  # one row
    labels = buckets.tags(F.col("text"), F.split("text", "\n"), (F.col("q1"), F.col("q2"), F.col("q3")), PROFILE)
    return docs.join(cuts).select("doc_id", F.explode(labels).alias("tag"))


TAGS_SQL = f"""dashed AS (SELECT doc_id, {DASHED.format('text')} AS text FROM documents), l AS (SELECT list_sort(list(length(text))) AS x FROM dashed WHERE length(text) > 0),
cuts AS (SELECT x[len(x) // 4 + 1] AS q1, x[len(x) // 2 + 1] AS q2, x[3 * len(x) // 4 + 1] AS q3 FROM l),
tag_w AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines, regexp_extract_all(text, '[A-Za-z]+') AS ws FROM dashed),
tag_r AS (SELECT *, CASE WHEN len(ws) = 0 THEN 0.0 ELSE len(list_filter(ws, lambda x: lower(x) IN ({quoted(ENGLISH)})))::DOUBLE / len(ws)::DOUBLE END AS en FROM tag_w),
tags AS (SELECT doc_id, unnest([CASE WHEN length(text) <= q1 THEN 'len-q1' WHEN length(text) <= q2 THEN 'len-q2' WHEN length(text) <= q3 THEN 'len-q3' ELSE 'len-q4' END,
  CASE WHEN regexp_matches(text, '[{LATIN}]') THEN 'lang-own' WHEN regexp_matches(text, '[A-Za-z]') AND en >= 0.2 THEN 'lang-en' WHEN regexp_matches(text, '[A-Za-z]') THEN 'lang-own' ELSE 'lang-other' END,
  CASE WHEN regexp_matches(text, '(?i)(?:^|[\\s(\\["‘“])(?:{"|".join(MALTESE.articles)})-[a-zA-Zàèìòùċġħż]') THEN 'prefix-yes' ELSE 'prefix-no' END,
  CASE WHEN len(list_filter(lines[1:len(lines) - 1], lambda x: regexp_matches(rtrim(x), '[^ ][-­]$'))) > 0 THEN 'linehyp-yes' ELSE 'linehyp-no' END,
  CASE WHEN contains(text, '—') THEN 'em-dash-yes' ELSE 'em-dash-no' END, CASE WHEN len(lines) > 1 THEN 'multi-line' ELSE 'single-line' END]) AS tag FROM tag_r, cuts)"""

# --- SQL of the resampling ------------------------------------------------------------------------------------------

WEIGHT = "CASE " + " ".join(f"WHEN u < {limit} THEN {k}" for k, limit in enumerate(pairwise.LIMITS)) + f" ELSE {len(pairwise.LIMITS)} END"


def drawn_sql(by: str = "", draws: int = 1000, seed: str = "42", source: str = "triples", name: str = "drawn") -> str:
    """by: columns, each with a comma behind it."""
    return f"""{name}_w AS (SELECT {by} ev, eb, len, g * 4 + k AS draw, ('0x' || substr(md5('{seed}|' || g || '|' || id), 1 + 8 * k, 8))::BIGINT AS u
  FROM {source}, (SELECT unnest(generate_series(0, {(draws - 1) // 4})) AS g), (SELECT unnest([0, 1, 2, 3]) AS k) WHERE len > 0),
{name} AS (SELECT {by} draw, sum(w * ev)::DOUBLE / sum(w * len)::DOUBLE AS cer_v, sum(w * eb)::DOUBLE / sum(w * len)::DOUBLE AS cer_b, sum(w * ev)::DOUBLE / sum(w * len)::DOUBLE - sum(w * eb)::DOUBLE / sum(w * len)::DOUBLE AS delta
  FROM (SELECT *, {WEIGHT} AS w FROM {name}_w) WHERE w > 0 AND draw < {draws} GROUP BY ALL)"""


def flips_sql(by: str = "", draws: int = 1000, seed: str = "7", source: str = "triples", name: str = "flips") -> str:
    on = " AND ".join(f"f.{c} IS NOT DISTINCT FROM o.{c}" for c in by.replace(",", " ").split()) or "true"
    return f"""{name}_o AS (SELECT {by} count(*) AS n, sum(ev - eb) AS d, sum(len) AS len FROM {source} WHERE len > 0 GROUP BY ALL),
{name}_f AS (SELECT {by} g * 32 + k - 1 AS draw, sum(CASE WHEN substr(md5('{seed}|' || g || '|' || id), k, 1) IN ('0', '2', '4', '6', '8', 'a', 'c', 'e') THEN ev - eb ELSE eb - ev END) AS d
  FROM {source}, (SELECT unnest(generate_series(0, {(draws - 1) // 32})) AS g), (SELECT unnest(generate_series(1, 32)) AS k) WHERE len > 0 AND g * 32 + k - 1 < {draws} GROUP BY ALL),
{name} AS (SELECT {''.join(f'o.{c}, ' for c in by.replace(',', ' ').split())} any_value(o.n) AS n, any_value(o.d)::DOUBLE / any_value(o.len)::DOUBLE AS delta, (sum(CASE WHEN abs(f.d) >= abs(o.d) THEN 1 ELSE 0 END) + 1)::DOUBLE / (count(*) + 1)::DOUBLE AS p,
  list_sort(list(abs(f.d)))[floor(count(*) * 0.95)::INT + 1]::DOUBLE / any_value(o.len)::DOUBLE AS critical FROM {name}_o o JOIN {name}_f f ON {on} GROUP BY {', '.join(f'o.{c}' for c in by.replace(',', ' ').split()) or '()'})"""


BETWEEN = "round(quantile_cont({0}, 0.025), 12) AS lo, round(quantile_cont({0}, 0.975), 12) AS hi"
VERDICT = "CASE WHEN lo <= 0 AND hi >= 0 THEN 'INSIDE NOISE' WHEN hi < 0 THEN 'KEEP' ELSE 'DROP' END"


def fdr_sql(source: str, order: str) -> str:
    return f"""fdr_k AS (SELECT *, row_number() OVER (ORDER BY p, {order}) AS rank, count(*) OVER () AS m FROM {source}),
fdr AS (SELECT * EXCLUDE (m, rank), rank::INT AS rank, coalesce(rank <= max(CASE WHEN p <= rank * 0.05::DOUBLE / m THEN rank END) OVER (), false) AS significant FROM fdr_k)"""


def _interval(drawn: DataFrame, *by: str, value: str = "delta") -> DataFrame:
    return resample.interval(drawn, *by, value=value).select(*by, *(F.round(c, 12).alias(c) for c in ("lo", "hi")))


# --- rates ----------------------------------------------------------------------------------------------------------


def _noisy(line: Column) -> Column:
    return F.concat(F.lit(" "), T.folded(line), F.lit("\n"))


@query(f"""WITH {SEGMENTS_SQL}, r AS (SELECT lang, trim(line, ' ' || chr(9)) AS ref, {FOLD.format("trim(line, ' ' || chr(9))")} AS hyp FROM segments)
SELECT lang, count(*) AS n, sum({ED.format('ref', 'hyp')})::BIGINT AS edits, sum(length(ref))::BIGINT AS chars, sum({ED.format('ref', 'hyp')})::DOUBLE / sum(length(ref))::DOUBLE AS cer FROM r WHERE ref <> '' GROUP BY lang""")
def normalised_cer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of normalised texts: the hypotheses have a blank before and a line end behind."""
    rows = segments(spark, sf_dir).select("lang", "line", _noisy(F.col("line")).alias("hyp"))
    return metrics.normalised_cer(rows, "line", "hyp", "lang")


@query(f"""WITH {SEGMENTS_SQL}, r AS (SELECT lang, trim({DASHED.format('line')}, ' ' || chr(9)) AS ref, {FOLD.format("trim(replace(replace(line, ' de ', ' il-'), ' the ', ' Tal-'), ' ' || chr(9))")} AS hyp FROM segments),
c AS (SELECT *, regexp_replace(ref, '(^|[^\\p{{L}}\\p{{N}}_''’])(il|Tal)-[ \\t]+', '\\1\\2-', 'g') AS ref_n FROM r),
s AS (SELECT lang, sum({ED.format('ref', 'hyp')})::DOUBLE / sum(length(ref))::DOUBLE AS raw_cer, sum({ED.format('ref_n', 'hyp')})::DOUBLE / sum(length(ref_n))::DOUBLE AS normalised_cer FROM c WHERE ref <> '' GROUP BY lang)
SELECT *, raw_cer - normalised_cer AS delta FROM s""")
def dual_cer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw rates and those without blanks behind articles, of a gold that has such blanks and readings that don't."""
    line = F.col("line")
    hyp = T.folded(F.replace(F.replace(line, F.lit(" de "), F.lit(" il-")), F.lit(" the "), F.lit(" Tal-")))
    return metrics.dual_cer(segments(spark, sf_dir).select("lang", dashed(line).alias("ref"), hyp.alias("hyp")), "ref", "hyp", MALTESE, "lang")


@query(f"""WITH {READ_SQL}, c AS (SELECT unnest(string_split('{LATIN}ħ', '')) AS letter), x AS (SELECT line, sum(0) AS z, any_value(CASE WHEN system = 0 THEN hyp END) AS hyp, count(*) // 4 AS k FROM readings GROUP BY line)
SELECT letter, coalesce(sum(k), 0)::BIGINT AS n, CASE WHEN sum(k) IS NULL THEN 'nan'::DOUBLE ELSE sum(k * {ED.format('line', 'hyp')})::DOUBLE / sum(k * length(line))::DOUBLE END AS cer FROM c LEFT JOIN x ON contains(line, letter) GROUP BY letter""")
def canary_subset_cer(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segments(spark, sf_dir).select("line", T.folded(F.col("line")).alias("hyp"))
    return metrics.subset_cer(rows, "line", "hyp", LATIN + "ħ")


@query(f"WITH {READ_SQL}, {TAGS_SQL} SELECT tag, count(*) AS n, sum(ed)::DOUBLE / sum(len)::DOUBLE AS cer, count(*) < 20 AS small FROM systems JOIN tags USING (doc_id) WHERE system = 1 AND len > 0 GROUP BY tag")
def per_bucket_cer(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_lines(spark, sf_dir, (1,)).where("len > 0").join(tagged(spark, sf_dir), "doc_id")
    return metrics.cer(rows, "tag").select("tag", "n", "cer", (F.col("n") < 20).alias("small"))


@query(f"WITH {TAGS_SQL} SELECT tag, count(*) AS n FROM tags GROUP BY tag")
def tag_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagged(spark, sf_dir).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {SEGMENTS_SQL}, r AS (SELECT line, {FOLD.format('line')} AS hyp, CASE WHEN length(line) < 80 THEN 'short' WHEN length(line) < 200 THEN 'mid' ELSE 'long' END AS len_b,
  CASE WHEN contains({DASHED.format('line')}, '-') THEN 'hyphen' ELSE 'plain' END AS hyp_b FROM segments), e AS (SELECT *, {ED.format('line', 'hyp')}::DOUBLE / length(line)::DOUBLE AS c FROM r),
x AS (SELECT c, unnest(['overall', len_b, hyp_b]) AS bucket FROM e) SELECT bucket, count(*) AS n, round(avg(c), 9) AS mean_cer FROM x GROUP BY bucket""")
def stratified_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the lines' own rates, overall and by the simple buckets."""
    line = F.col("line")
    rows = segments(spark, sf_dir).select(metrics.pair_cer(line, T.folded(line)).alias("c"), F.array(F.lit("overall"), buckets.simple_length(line), buckets.simple_hyphen(dashed(line))).alias("b"))
    rows = rows.select("c", F.explode("b").alias("bucket"))  # behind the rate, which a line needs once
    return rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("c"), 9).alias("mean_cer"))


# --- paired deltas --------------------------------------------------------------------------------------------------


@query(f"WITH {triples_sql(1)}, {drawn_sql()}, s AS (SELECT sum(ev)::DOUBLE / sum(len)::DOUBLE AS cer, count(*) AS n FROM triples WHERE len > 0) SELECT any_value(cer) AS cer, {BETWEEN.format('cer_v')}, any_value(n) AS n FROM drawn, s")
def bootstrap_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A system's rate with the bounds of its bootstrap."""
    rows = triples(spark, sf_dir, 1)
    seen = pairwise.observed(rows, "variant").select("variant", F.col("cer_v").alias("cer"), "n")
    return _interval(pairwise.bootstrap(rows, "variant"), "variant", value="cer_v").join(seen, "variant").select("cer", "lo", "hi", "n")


@query(f"""WITH {triples_sql(1)}, {TAGS_SQL}, t AS (SELECT triples.*, tag FROM triples JOIN tags ON id = doc_id), {drawn_sql('tag, ', 400, source='t')},
s AS (SELECT tag, sum(ev)::DOUBLE / sum(len)::DOUBLE AS cer, count(*) AS n FROM t WHERE len > 0 GROUP BY tag), i AS (SELECT tag, {BETWEEN.format('cer_v')} FROM drawn GROUP BY tag)
SELECT tag, cer, CASE WHEN n >= 20 THEN lo END AS lo, CASE WHEN n >= 20 THEN hi END AS hi, n, n < 20 AS small FROM s JOIN i USING (tag)""")
def bucket_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by tag; groups of under 20 pairs are small and have no bounds."""
    rows = triples(spark, sf_dir, 1).join(tagged(spark, sf_dir).withColumnRenamed("doc_id", "id"), "id")
    seen = pairwise.observed(rows, "tag").select("tag", F.col("cer_v").alias("cer"), "n", (F.col("n") < 20).alias("small"))
    both = seen.join(_interval(pairwise.bootstrap(rows, "tag", draws=400), "tag", value="cer_v"), "tag")
    return both.select("tag", "cer", *(F.when(~F.col("small"), F.col(c)).alias(c) for c in ("lo", "hi")), "n", "small")


@query(f"WITH {triples_sql(1)}, {drawn_sql()}, i AS (SELECT {BETWEEN.format('delta')} FROM drawn) SELECT *, {VERDICT} AS verdict FROM i")
def pair_bootstrap_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _interval(pairwise.bootstrap(triples(spark, sf_dir, 1)))
    return got.withColumn("verdict", resample.verdict(F.col("lo"), F.col("hi")))


@query(f"WITH {triples_sql(1)}, {drawn_sql()}, x AS (SELECT list_sort(list(delta)) AS x FROM drawn) SELECT round(x[floor(0.025 * len(x))::INT + 1], 12) AS lo, round(x[floor(0.975 * len(x))::INT + 1], 12) AS hi FROM x")
def index_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = resample.index_interval(pairwise.bootstrap(triples(spark, sf_dir, 1)))
    return got.select(*(F.round(c, 12).alias(c) for c in ("lo", "hi")))


@query(f"WITH {triples_sql(3)}, {flips_sql('', 10_000)} SELECT * FROM flips")
def permutation_critical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """10,000 sign flips: p and the critical value."""
    return pairwise.sign_flips(triples(spark, sf_dir, 3))


@query(f"WITH {triples_sql(1)}, {TAGS_SQL}, t AS (SELECT triples.*, tag FROM triples JOIN tags ON id = doc_id), {flips_sql('tag, ', 500, source='t')}, {fdr_sql('flips', 'tag')} SELECT * FROM fdr")
def bucket_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired deltas by tag with their sign-flip p and the false-discovery control."""
    rows = triples(spark, sf_dir, 1).join(tagged(spark, sf_dir).withColumnRenamed("doc_id", "id"), "id")
    return resample.benjamini_hochberg(pairwise.sign_flips(rows, "tag", draws=500), order="tag")


CANARY_SQL = f"letters AS (SELECT unnest(string_split('{LATIN}ħ', '')) AS letter), t AS (SELECT triples.*, letter FROM triples JOIN documents ON id = doc_id JOIN letters ON contains(text, letter))"


def _by_canary(spark: SparkSession, sf_dir: str, variant: int) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.explode(metrics.letters_in(F.col("text"), LATIN + "ħ")).alias("letter"))
    return triples(spark, sf_dir, variant).join(docs, "id")


def _letters(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*map(F.lit, LATIN + "ħ"))).alias("letter"))


@query(f"""WITH {triples_sql(1)}, {CANARY_SQL}, {flips_sql('letter, ', 500, '11', source='t')}, x AS (SELECT letter, coalesce(n, 0) AS n, coalesce(delta, 'nan'::DOUBLE) AS delta, coalesce(p, 1.0) AS p FROM letters LEFT JOIN flips USING (letter)),
{fdr_sql('x', 'letter')} SELECT * FROM fdr""")
def canary_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired deltas over documents with each letter; a letter that none has gets p = 1 and still counts in the control."""
    tests = pairwise.sign_flips(_by_canary(spark, sf_dir, 1), "letter", draws=500, seed="11")
    every = _letters(spark).join(tests, "letter", "left")
    filled = every.select("letter", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("delta", F.lit(float("nan"))).alias("delta"), F.coalesce("p", F.lit(1.0)).alias("p"))
    return resample.benjamini_hochberg(filled, order="letter")


@query(f"""WITH {triples_sql(3)}, {CANARY_SQL}, {drawn_sql('letter, ', 400, source='t')}, o AS (SELECT letter, sum(ev)::DOUBLE / sum(len)::DOUBLE - sum(eb)::DOUBLE / sum(len)::DOUBLE AS delta FROM t WHERE len > 0 GROUP BY letter),
x AS (SELECT letter, any_value(o.delta) AS delta, (sum(CASE WHEN drawn.delta * o.delta <= 0 THEN 1 ELSE 0 END) + 1)::DOUBLE / (count(*) + 1)::DOUBLE AS p FROM drawn JOIN o USING (letter) GROUP BY letter), {fdr_sql('x', 'letter')} SELECT * FROM fdr""")
def canary_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By letter: the share of draws of the other sign, with the false-discovery control."""
    rows = _by_canary(spark, sf_dir, 3)
    tests = pairwise.sign_p(pairwise.bootstrap(rows, "letter", draws=400), pairwise.observed(rows, "letter"), "letter")
    return resample.benjamini_hochberg(tests, order="letter")


FOLDS = "f AS (SELECT variant, ('0x' || substr(md5('13|' || id), 1, 8))::BIGINT % 5 AS fold, sum(ev)::DOUBLE / sum(len)::DOUBLE AS c FROM triples WHERE len > 0 GROUP BY ALL)"


@query(f"WITH {triples_sql(1)}, {FOLDS} SELECT round(avg(c), 12) AS mean, round(coalesce(stddev_samp(c), 0.0), 12) AS std FROM f")
def fold_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = pairwise.fold_summary(triples(spark, sf_dir, 1))
    return got.select(*(F.round(c, 12).alias(c) for c in ("mean", "std")))


@query(f"""WITH b AS (SELECT item_id AS id, text AS ref, {CONFUSE.format('text')} AS hyp FROM benchmark WHERE length(text) > 0), d AS (SELECT unnest(generate_series(0, 19)) AS draw),
r AS (SELECT draw, ref, row_number() OVER (PARTITION BY draw ORDER BY id) AS pos FROM b, d), h AS (SELECT draw, hyp, row_number() OVER (PARTITION BY draw ORDER BY md5('0|' || draw || '|' || id), id) AS pos FROM b, d),
n AS (SELECT draw, sum({ED.format('ref', 'hyp')})::DOUBLE / sum(length(ref))::DOUBLE AS c FROM r JOIN h USING (draw, pos) GROUP BY draw), o AS (SELECT sum({ED.format('ref', 'hyp')})::DOUBLE / sum(length(ref))::DOUBLE AS o FROM b)
SELECT any_value(o) AS observed, (sum(CASE WHEN c <= o THEN 1 ELSE 0 END) + 1)::DOUBLE / (count(*) + 1)::DOUBLE AS p, round(avg(c), 12) AS null_mean, min(c) AS null_min FROM n, o""")
def shuffle_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of the benchmark's items dealt to its items anew."""
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("ref"), F.replace(F.replace("text", F.lit("rn"), F.lit("m")), F.lit("li"), F.lit("h")).alias("hyp"))
    got = pairwise.shuffle_test(rows, metrics.edits, draws=20)
    return got.withColumn("null_mean", F.round("null_mean", 12))


@query(f"""WITH {triples_sql(1, 2, 3)}, {FOLDS}, {drawn_sql('variant, ', 400)}, {flips_sql('variant, ', 500)}, o AS (SELECT variant, sum(ev)::DOUBLE / sum(len)::DOUBLE AS cer_v, sum(eb)::DOUBLE / sum(len)::DOUBLE AS cer_b FROM triples WHERE len > 0 GROUP BY variant),
i AS (SELECT variant, {BETWEEN.format('delta')} FROM drawn GROUP BY variant), k AS (SELECT variant, round(avg(c), 12) AS fold_mean, round(coalesce(stddev_samp(c), 0.0), 12) AS fold_std FROM f GROUP BY variant),
a AS (SELECT variant, n, cer_b, cer_v, delta, lo, hi, p, fold_mean, fold_std, {VERDICT} AS verdict FROM o JOIN i USING (variant) JOIN flips USING (variant) JOIN k USING (variant))
SELECT *, row_number() OVER (ORDER BY delta, variant)::INT AS rank FROM a""")
def manifest_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All variants against the baseline in one job: rates, delta with bounds, p, folds, verdict, and the rank by delta."""
    return audit_table(triples(spark, sf_dir, 1, 2, 3), "variant", draws=400, flips=500)


def audit_table(rows: DataFrame, variant: str, draws: int = 1000, flips: int = 1000, folds: int = 5) -> DataFrame:
    """(variant, n, cer_b, cer_v, delta, lo, hi, p, fold_mean, fold_std, verdict, rank) from triples of several variants."""
    seen = pairwise.observed(rows, variant).select(variant, "cer_b", "cer_v")
    tests = pairwise.sign_flips(rows, variant, draws=flips).drop("critical")
    bounds = _interval(pairwise.bootstrap(rows, variant, draws=draws), variant)
    fold = F.pmod(resample.number("13", F.col("id")), F.lit(folds)).alias("fold")
    rates = rows.where("len > 0").groupBy(variant, fold).agg((F.sum("ev") / F.sum("len")).alias("c")).groupBy(variant)
    rates = rates.agg(F.round(F.avg("c"), 12).alias("fold_mean"), F.round(F.coalesce(F.stddev_samp("c"), F.lit(0.0)), 12).alias("fold_std"))
    both = tests.join(seen, variant).join(bounds, variant).join(rates, variant).withColumn("verdict", resample.verdict(F.col("lo"), F.col("hi")))
    ranked = both.withColumn("rank", F.row_number().over(Window.orderBy("delta", variant)))  # a row a variant
    return ranked.select(variant, "n", "cer_b", "cer_v", "delta", "lo", "hi", "p", "fold_mean", "fold_std", "verdict", "rank")


@query(f"""WITH {triples_sql(1, 2, 3)}, pooled AS (SELECT id || '|' || variant AS id, ev, eb, len FROM triples), {flips_sql('', 1000, source='pooled')}, s AS (SELECT variant, sum(ev - eb)::DOUBLE / sum(len)::DOUBLE AS d FROM triples GROUP BY variant)
SELECT n, delta, p, (SELECT bool_and(d * delta >= 0) FROM s) AS same_sign FROM flips""")
def multi_seed_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The variants as seeds of one system: a pooled sign-flip test, and whether all seeds point one way."""
    rows = triples(spark, sf_dir, 1, 2, 3)
    return multi_seed(rows, "variant").select("n", "delta", "p", "same_sign")


def multi_seed(rows: DataFrame, seed: str, draws: int = 1000) -> DataFrame:
    pooled = rows.select(F.concat_ws("|", F.col("id").cast("string"), F.col(seed).cast("string")).alias("id"), "ev", "eb", "len", F.lit(1).alias("one"))
    test = pairwise.sign_flips(pooled, "one", draws=draws)
    signs = pairwise.observed(rows, seed).select(F.lit(1).alias("one"), F.col("delta").alias("_d"))
    same = test.join(signs, "one").groupBy("one").agg(F.bool_and(F.col("_d") * F.col("delta") >= 0).alias("same_sign"))
    return test.join(same, "one").drop("one")


@query()
def multi_seed_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """KEEP needs an upper bound below zero by the accelerated rule, p below .05 and one sign for all seeds."""
    rows = triples(spark, sf_dir, 1, 2, 3)
    pooled = rows.select(F.concat_ws("|", F.col("id").cast("string"), F.col("variant").cast("string")).alias("id"), "ev", "eb", "len")
    _, lo, hi = pairwise.bca(pooled, draws=1000)
    keep = (F.lit(hi) < 0) & (F.col("p") < 0.05) & F.col("same_sign")
    return multi_seed(rows, "variant").select("n", "delta", F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), "p", "same_sign", F.when(keep, "KEEP").otherwise("DROP").alias("verdict"))


@query(f"""WITH {SEGMENTS_SQL}, r AS (SELECT doc_id AS id, {DASHED.format('line')} AS ref, replace(replace(line, ' de ', ' il-'), ' the ', ' Tal-') AS v, {FOLD.format(DASHED.format('line'))} AS b FROM segments),
c AS (SELECT id, regexp_replace(trim(ref, ' ' || chr(9)), '(^|[^\\p{{L}}\\p{{N}}_''’])(il|Tal)-[ \\t]+', '\\1\\2-', 'g') AS ref, trim(v, ' ' || chr(9)) AS v, regexp_replace(trim(b, ' ' || chr(9)), '(^|[^\\p{{L}}\\p{{N}}_''’])(il|Tal)-[ \\t]+', '\\1\\2-', 'g') AS b FROM r)
SELECT sum({ED.format('ref', 'v')})::DOUBLE / sum(length(ref))::DOUBLE - sum({ED.format('ref', 'b')})::DOUBLE / sum(length(ref))::DOUBLE AS delta FROM c WHERE ref <> ''""")
def normalised_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variant less baseline, all texts without blanks behind articles; negative is better."""
    line = F.col("line")
    rows = segments(spark, sf_dir).select(
        F.col("doc_id").alias("id"), dashed(line).alias("ref"), F.replace(F.replace(line, F.lit(" de "), F.lit(" il-")), F.lit(" the "), F.lit(" Tal-")).alias("v"), T.folded(dashed(line)).alias("b")
    )
    return pairwise.observed(metrics.normalised_triples(rows, "ref", "v", "b", MALTESE)).select("delta")


@query(f"""WITH {READ_SQL}, a AS (SELECT sum(ed)::DOUBLE / sum(len)::DOUBLE AS x FROM systems WHERE system = 1), b AS (SELECT sum({ED.format('line', CONFUSE.format('line'))})::DOUBLE / sum(length(line))::DOUBLE AS y FROM segments)
SELECT x AS ours, y AS theirs, abs(x - y) <= 0.001 AS agree FROM a, b""")
def organiser_crosscheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    ours = pairwise.observed(triples(spark, sf_dir, 1), "variant").select(F.lit(1).alias("k"), F.col("cer_v").alias("ours"))
    line = F.col("line")
    theirs = segments(spark, sf_dir).select(metrics.edits(line, readings(line)[1]).alias("e"), F.length(line).alias("n")).agg((F.sum("e") / F.sum("n")).alias("theirs")).withColumn("k", F.lit(1))
    return ours.join(theirs, "k").select("ours", "theirs", (F.abs(F.col("ours") - F.col("theirs")) <= metrics.TOLERANCE).alias("agree"))
