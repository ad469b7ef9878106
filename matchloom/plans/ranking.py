"""Queries that link texts to a catalogue: normalisation, candidates, calibration, fusion, expansion, routing.

The catalogue is ``benchmark`` (or the different part names), the signals are
all ``documents`` (or parts); see the operators for what they compute.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.functions import text as x
from matchloom.operators import analytics, calibrate, candidates, expand, route, rules
from matchloom.plans.registry import Bank, indel_sql, table

bank = Bank()

TERMS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), candidates.words(F.coalesce("text", F.lit(""))).alias("terms"))


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("ord"), F.col("item_id").cast("string").alias("code"), candidates.words(F.coalesce("text", F.lit(""))).alias("terms"))


# --- text -------------------------------------------------------------------------------------------------


@bank.add("SELECT doc_id, md5(strip_accents(upper(replace(text, 'ß', 'SS')))) AS folded FROM documents")
def strip_accents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(x.fold(F.col("text")).cast("binary")).alias("folded"))


@bank.add(
    r"""SELECT doc_id, coalesce(array_to_string(list_transform(regexp_extract_all(coalesce(text, ''), '-?\d+'), lambda v: CAST(TRY_CAST(v AS INTEGER) AS VARCHAR)), ','), '') AS numbers,
    len(regexp_extract_all(strip_accents(upper(replace(coalesce(text, ''), 'ß', 'SS'))), '\b\d+[A-Z](?:\d+|O)\b')) AS n_ids FROM documents"""
)
def extract_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, ids = x.without_ids(x.fold(F.coalesce("text", F.lit(""))))
    numbers = F.array_join(F.transform(x.integers(F.col("text")), lambda v: v.cast("string")), ",")
    return table(spark, sf_dir, "documents").select("doc_id", numbers.alias("numbers"), F.size(ids).cast("long").alias("n_ids"))


@bank.add(
    r"""SELECT p_partkey, array_to_string(list_filter(string_split(regexp_replace(upper(concat_ws(' ', p_name, p_type, p_brand)), '[/\-.(),;:]', ' ', 'g'), ' '),
    lambda t: t <> '' AND t NOT IN ('DE','DA','DO','DOS','DAS','E','O','A','OS','AS','EM','NO','NA')), ' ') AS canonical FROM part"""
)
def norm_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", x.canonical(F.concat_ws(" ", "p_name", "p_type", "p_brand")).alias("canonical"))


@bank.add(
    """SELECT c_custkey, CASE WHEN len(p) >= 3 THEN p[1] END AS station, CASE WHEN len(p) >= 3 THEN p[2] END AS module, CASE WHEN len(p) >= 4 THEN p[3] END AS equipment,
    ends_with(n, '_' || c_mktsegment) OR n = c_mktsegment AS has_code
    FROM (SELECT c_custkey, c_mktsegment, n, string_split(n, '_') AS p FROM (SELECT *, replace(c_name, '#', '_') || CASE WHEN c_nationkey % 2 = 0 THEN '_' || c_mktsegment ELSE '_A_B' END AS n FROM customer))"""
)
def name_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.replace("c_name", F.lit("#"), F.lit("_")), F.when(F.col("c_nationkey") % 2 == 0, F.concat(F.lit("_"), "c_mktsegment")).otherwise("_A_B"))
    rows = table(spark, sf_dir, "customer").withColumn("n", name)
    return rows.select("c_custkey", x.name_parts(F.col("n")).alias("p"), x.code_in_name(F.col("c_mktsegment"), F.col("n")).alias("has_code")).select("c_custkey", "p.*", "has_code")


@bank.add(
    """WITH k AS (SELECT event_id, upper(CASE event_type WHEN 'view' THEN 'Status' WHEN 'click' THEN 'Comando' WHEN 'purchase' THEN 'AI' WHEN 'error' THEN 'A/D' ELSE event_type END) AS t,
      upper(CASE event_type WHEN 'view' THEN 'rele atuado' WHEN 'click' THEN 'disjuntor desligado' WHEN 'purchase' THEN 'chave ligada' WHEN 'error' THEN 'estado indefinido' ELSE 'falha e fechado' END) AS s FROM events)
    SELECT event_id, CASE WHEN t = 'AI' THEN 'Analog' WHEN t = 'A/D' THEN 'DiscreteAnalog' WHEN contains(t, 'COMANDO') OR contains(t, 'STATUS') THEN 'Discrete' END AS category,
      CASE WHEN t IN ('AI', 'A/D') THEN 'Input' WHEN contains(t, 'COMANDO') THEN 'Output' WHEN contains(t, 'STATUS') THEN 'Input' END AS direction,
      CASE WHEN contains(s, 'INDEFINID') THEN 'INDEFINIDO' WHEN contains(s, 'FALHA') THEN NULL WHEN contains(s, 'ATUAD') THEN 'EVENTO' ELSE 'POSICAO' END AS state,
      CASE WHEN contains(s, 'DESLIG') THEN 'B' WHEN contains(s, 'LIGADA') THEN 'A' END AS polarity FROM k"""
)
def type_and_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_type")
    kind = F.when(e == "view", "Status").when(e == "click", "Comando").when(e == "purchase", "AI").when(e == "error", "A/D").otherwise(e)
    said = F.when(e == "view", "rele atuado").when(e == "click", "disjuntor desligado").when(e == "purchase", "chave ligada").when(e == "error", "estado indefinido").otherwise("falha e fechado")
    rows = table(spark, sf_dir, "events").select("event_id", x.type_of(kind).alias("t"), said.alias("s"))
    return rows.select("event_id", "t.category", "t.direction", x.text_state(F.col("s")).alias("state"), x.text_polarity(F.col("s")).alias("polarity"))


@bank.add(
    r"""SELECT p_partkey, nullif(regexp_extract(c, '^(\d{2})\d*', 1), '') AS family, nullif(regexp_extract(c, '(\d)$', 1), '') AS stage,
    CASE WHEN ends_with(b, 'N') THEN 'N' WHEN ends_with(b, 'ABC') THEN 'ABC' WHEN ends_with(b, 'AB') THEN 'AB' WHEN ends_with(b, 'BC') THEN 'BC' WHEN ends_with(b, 'CA') THEN 'CA' WHEN ends_with(b, 'F') THEN 'F' WHEN regexp_matches(b, '[ABC]$') THEN right(b, 1) END AS phase
    FROM (SELECT *, CASE WHEN length(c) > 1 AND regexp_matches(c, '[1-4]$') THEN left(c, length(c) - 1) ELSE c END AS b FROM
      (SELECT p_partkey, CAST(p_partkey AS VARCHAR) || list_extract(['A', 'N', 'F', 'ABC', 'CA', ''], CAST(p_size % 6 + 1 AS INTEGER)) || CASE WHEN p_size % 2 = 0 THEN CAST(p_size % 6 AS VARCHAR) ELSE '' END AS c FROM part))"""
)
def code_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    letters = F.element_at(F.array(*map(F.lit, ("A", "N", "F", "ABC", "CA", ""))), (F.col("p_size") % 6 + 1).cast("int"))
    code = F.concat(F.col("p_partkey").cast("string"), letters, F.when(F.col("p_size") % 2 == 0, (F.col("p_size") % 6).cast("string")).otherwise(""))
    rows = table(spark, sf_dir, "part").select("p_partkey", code.alias("c"))
    return rows.select("p_partkey", x.leading_number(F.col("c")).alias("family"), x.code_stage(F.col("c")).alias("stage"), x.code_phase(F.col("c")).alias("phase"))


# --- candidates -------------------------------------------------------------------------------------------

#: From the terms of a catalogue c(ord, code, terms) and of signals s(id, terms).
LEXICAL = """
tf AS (SELECT ord, term, count(*) AS tf FROM (SELECT ord, unnest(terms) AS term FROM c) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
n AS (SELECT count(*) AS n, avg(len(terms)) AS mean FROM c),
p AS (SELECT term, ord, code, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(terms) / mean)) AS w FROM tf JOIN df USING (term) JOIN c USING (ord), n),
q AS (SELECT DISTINCT id, unnest(terms) AS term FROM s),
b0 AS (SELECT id, ord, code, round(sum(w), 9) AS score FROM q JOIN p USING (term) GROUP BY ALL),
bm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, ord) AS rank FROM b0 WHERE score > 0) WHERE rank <= 5)"""

BM25 = f"""
c AS (SELECT item_id AS ord, CAST(item_id AS VARCHAR) AS code, {TERMS} AS terms FROM benchmark),
s AS (SELECT doc_id AS id, {TERMS} AS terms FROM documents),
{LEXICAL}"""

TFIDF = """
idf AS (SELECT term, ln((1.0 + n) / (1.0 + df)) + 1 AS idf FROM df, n),
cw AS (SELECT ord, term, tf * idf AS w FROM tf JOIN idf USING (term)),
cn AS (SELECT ord, sqrt(sum(w * w)) AS norm FROM cw GROUP BY ALL),
qw AS (SELECT id, term, count(*) * any_value(idf) AS w FROM (SELECT id, unnest(terms) AS term FROM s) JOIN idf USING (term) GROUP BY ALL),
qn AS (SELECT id, sqrt(sum(w * w)) AS norm FROM qw GROUP BY ALL),
t0 AS (SELECT qw.id, cw.ord, c.code, round(sum(qw.w * cw.w / cn.norm) / any_value(qn.norm), 9) AS score FROM qw JOIN cw USING (term) JOIN cn USING (ord) JOIN c USING (ord) JOIN qn USING (id) GROUP BY ALL),
ti AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, ord) AS rank FROM t0) WHERE rank <= 5)"""

FUSION = """
m AS (SELECT id, 'lexical' AS method, code, ord, score FROM bm UNION ALL SELECT id, 'vector', code, ord, score FROM ti),
mm AS (SELECT *, min(score) OVER w AS low, max(score) OVER w AS high FROM m WINDOW w AS (PARTITION BY id, method)),
fu AS (SELECT id, code, min(ord) AS ord, round(sum(CASE WHEN high > low THEN (score - low) / (high - low) ELSE 0 END * CASE method WHEN 'lexical' THEN 0.7 ELSE 0.3 END), 9) AS fused FROM mm GROUP BY ALL),
pl AS (SELECT id, code, ord, round(1 / (1 + exp(-(2.0403 * fused - 0.9391))), 9) AS score FROM fu)"""

FUSED = (
    FUSION
    + """,
ld AS (SELECT id, max(CASE WHEN k = 1 THEN code END) AS code, max(CASE WHEN k = 1 THEN score END) AS score, coalesce(max(CASE WHEN k = 2 THEN score END), 0) AS second
  FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, ord, code) AS k FROM pl) GROUP BY id),
routed AS (SELECT s.id, ld.code, ld.score, ld.score - second AS gap,
  CASE WHEN ld.code IS NULL THEN 'no_candidate' WHEN ld.score < 0.2 THEN 'low_score' WHEN ld.score >= 0.45 AND ld.score - second >= 0.08 THEN 'decided' WHEN ld.score >= 0.45 THEN 'several_codes' ELSE 'low_score' END AS reason
  FROM s LEFT JOIN ld USING (id))"""
)


@bank.add(f"WITH {BM25} SELECT id, code, round(score, 6) AS score, ord, CAST(rank AS INTEGER) AS rank FROM bm")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.bm25(documents(spark, sf_dir), benchmark(spark, sf_dir)).withColumn("score", F.round("score", 6))


@bank.add(f"WITH {BM25}, {TFIDF} SELECT id, code, round(score, 6) AS score, ord, CAST(rank AS INTEGER) AS rank FROM ti")
def tfidf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.tfidf(documents(spark, sf_dir), benchmark(spark, sf_dir)).withColumn("score", F.round("score", 6))


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The different part names as a catalogue."""
    names = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("text")).agg(F.min("p_partkey").alias("ord"))
    return names.select("ord", F.col("text").alias("code"), "text")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different part labels as signals."""
    part = table(spark, sf_dir, "part")
    return part.groupBy(F.concat_ws(" ", F.lower("p_type"), F.reverse("p_name"), "p_name").alias("text")).agg(F.min("p_partkey").alias("id")).select("id", "text")


_GRAMS = "list_concat(" + ", ".join(f"CASE WHEN length(text) >= {n} THEN list_transform(range(1, length(text) - {n} + 2), lambda i: substr(text, i, {n})) ELSE [] END" for n in (3, 4, 5)) + ")"


@bank.add(
    f"""WITH c AS (SELECT min(p_partkey) AS ord, p_name AS code, any_value(list_concat({_GRAMS.replace("text", "p_name")})) AS terms FROM part GROUP BY p_name),
    s AS (SELECT id, {_GRAMS} AS terms FROM (SELECT min(p_partkey) AS id, text FROM (SELECT p_partkey, concat_ws(' ', lower(p_type), reverse(p_name), p_name) AS text FROM part) GROUP BY text)),
    tf AS (SELECT ord, term, count(*) AS tf FROM (SELECT ord, unnest(terms) AS term FROM c) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL), n AS (SELECT count(*) AS n FROM c), {TFIDF}
    SELECT id, code, round(score, 6) AS score, ord, CAST(rank AS INTEGER) AS rank FROM ti"""
)
def char_ngram_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    signals, names = _labels(spark, sf_dir), _names(spark, sf_dir)
    grams = candidates.char_grams(F.col("text"))
    return candidates.tfidf(signals.select("id", grams.alias("terms")), names.select("ord", "code", grams.alias("terms"))).withColumn("score", F.round("score", 6))


@bank.add(
    f"""WITH c AS (SELECT min(p_partkey) AS ord, p_name AS code, list_distinct(string_split(p_name, ' ')) AS y FROM part GROUP BY p_name),
    s AS (SELECT min(p_partkey) AS id, list_distinct(string_split(text, ' ')) AS x FROM (SELECT p_partkey, concat_ws(' ', lower(p_type), reverse(p_name), p_name) AS text FROM part) GROUP BY text),
    w AS (SELECT id, ord, code, x, list_sort(list_intersect(x, y)) AS k, list_sort(list_filter(x, lambda v: NOT list_contains(y, v))) AS l, list_sort(list_filter(y, lambda v: NOT list_contains(x, v))) AS r FROM s, c),
    j AS (SELECT *, array_to_string(k, ' ') AS base, array_to_string(k || l, ' ') AS one, array_to_string(k || r, ' ') AS two FROM w),
    t AS (SELECT id, ord, code, CASE WHEN len(k) > 0 AND (len(l) = 0 OR len(r) = 0) THEN 100.0
      ELSE greatest({indel_sql("one", "two")}, CASE WHEN len(k) > 0 THEN 200.0 * length(base) / (length(base) + least(length(one), length(two))) ELSE 0 END) END / 100 + CASE WHEN list_contains(x, code) THEN 0.25 ELSE 0 END AS score FROM j)
    SELECT id, code, round(least(1.0, score), 6) AS score, ord, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(least(1.0, score), 9) DESC, ord) AS rank FROM t) WHERE rank <= 5"""
)
def fuzzy_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.fuzzy(_labels(spark, sf_dir), _names(spark, sf_dir)).withColumn("score", F.round("score", 6))


@bank.add(
    f"""WITH v AS (SELECT DISTINCT unnest(string_split(upper(p_name), ' ')) AS term FROM part), t AS (SELECT DISTINCT left(term, 2) || substr(term, 4) AS token FROM v WHERE length(term) > 4),
    k AS (SELECT token, term, {indel_sql("token", "term")} AS s FROM t JOIN v ON abs(length(token) - length(term)) <= 1 WHERE length(token) > 3 AND NOT regexp_matches(token, '[0-9]') AND token NOT IN (SELECT term FROM v))
    SELECT token, term FROM k WHERE s >= 85 QUALIFY row_number() OVER (PARTITION BY token ORDER BY s DESC, term) = 1"""
)
def typo_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Misspelt words of part names (a letter is missing) repaired from the vocabulary of all part names."""
    part = table(spark, sf_dir, "part")
    words = part.select(F.explode(x.tokens(F.upper("p_name"))).alias("term")).distinct()
    spoilt = part.select(F.explode(x.tokens(F.upper("p_name"))).alias("w")).distinct().where(F.length("w") > 4).select(F.concat(F.substring("w", 1, 2), F.expr("substring(w, 4)")).alias("token"))
    return candidates.repaired(spoilt.distinct(), words)


@bank.add(
    """WITH u AS (SELECT label, i, avg(embedding[i]) AS m FROM embeddings, range(1, 65) r(i) GROUP BY ALL), c AS (SELECT label, list(m ORDER BY i) AS v FROM u GROUP BY label),
    r AS (SELECT vec_id AS id, CAST(c.label AS VARCHAR) AS code, c.label AS ord, greatest(0, list_cosine_similarity(list_transform(embedding, lambda z: CAST(z AS DOUBLE)), v)) AS score FROM embeddings e, c)
    SELECT id, code, round(score, 6) AS score, CAST(ord AS BIGINT) AS ord, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, ord) AS rank FROM r) WHERE rank <= 3"""
)
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector against the mean vector of every label."""
    e = table(spark, sf_dir, "embeddings")
    means = e.select("label", F.posexplode("embedding").alias("at", "v")).groupBy("label", "at").agg(F.avg("v").alias("m"))
    centres = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "m"))), lambda z: z["m"]).alias("vector"))  # one vector for each label
    found = candidates.cosine(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), centres.select(F.col("label").cast("long").alias("ord"), F.col("label").cast("string").alias("code"), "vector"), 3)
    return found.withColumn("score", F.round("score", 6))


@bank.add(
    """WITH u AS (SELECT vec_id, list_transform(embedding, lambda z: CAST(z AS DOUBLE)) AS v FROM embeddings), n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda z: z * z))) AS l FROM u),
    m AS (SELECT i, avg(v[i] / l) AS m FROM n, range(1, 65) r(i) GROUP BY i), c AS (SELECT list(m ORDER BY i) AS c FROM m)
    SELECT vec_id AS id, round(list_cosine_similarity(v, c), 6) AS affinity FROM u, c"""
)
def centroid_affinity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    found = candidates.centroid_affinity(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), e.select(F.col("embedding").alias("vector")))
    return found.withColumn("affinity", F.round("affinity", 6))


@bank.add(f"WITH {BM25}, {TFIDF} SELECT id, code, round(sum(1.0 / (60 + rank)), 9) AS score FROM (SELECT id, code, rank FROM bm UNION ALL SELECT id, code, rank FROM ti) GROUP BY ALL")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, b = documents(spark, sf_dir), benchmark(spark, sf_dir)
    return candidates.reciprocal_ranks(candidates.bm25(d, b), candidates.tfidf(d, b)).withColumn("score", F.round("score", 9))


# --- calibration, fusion, routing -------------------------------------------------------------------------


@bank.add(
    f"""WITH {BM25} SELECT id, code, round(CASE WHEN high > low THEN (score - low) / (high - low) ELSE 0 END, 6) AS minmax, round(exp((score - high) / 0.1) / sum(exp((score - high) / 0.1)) OVER (PARTITION BY id), 6) AS softmax,
    round(1 / (1 + exp(-(2.0403 * score - 0.9391))), 6) AS platt,
    round(CASE WHEN score <= 0 THEN 0 WHEN score <= 5 THEN score * 0.06 WHEN score <= 20 THEN 0.3 + (score - 5) * (0.6 / 15) ELSE 0.9 END, 6) AS isotonic
    FROM (SELECT *, min(score) OVER w AS low, max(score) OVER w AS high FROM bm WINDOW w AS (PARTITION BY id))"""
)
def calibrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("score")
    found = candidates.bm25(documents(spark, sf_dir), benchmark(spark, sf_dir))
    each = {"minmax": calibrate.min_max(s, "id"), "softmax": calibrate.softmax(s, "id"), "platt": calibrate.platt(s), "isotonic": calibrate.isotonic(s, [(0, 0), (5, 0.3), (20, 0.9)])}
    return found.select("id", "code", *(F.round(c, 6).alias(n) for n, c in each.items()))


def fused_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, b = documents(spark, sf_dir), benchmark(spark, sf_dir)
    both = candidates.bm25(d, b).withColumn("method", F.lit("lexical")).unionByName(candidates.tfidf(d, b).withColumn("method", F.lit("vector")))
    fused = calibrate.fused(calibrate.calibrated(both, {"lexical": "minmax", "vector": "minmax"}), {"lexical": 0.7, "vector": 0.3})
    return fused.withColumn("fused", F.round("score", 9)).withColumn("score", F.round(calibrate.platt(F.col("fused")), 9))


@bank.add(f"WITH {BM25}, {TFIDF}, {FUSED} SELECT id, code, ord, fused, pl.score FROM fu JOIN pl USING (id, code, ord)")
def weighted_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fused_candidates(spark, sf_dir).select("id", "code", "ord", "fused", "score")


def routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return route.quadrant(documents(spark, sf_dir), fused_candidates(spark, sf_dir))


@bank.add(f"WITH {BM25}, {TFIDF}, {FUSED} SELECT id, code, round(score, 6) AS score, round(gap, 6) AS gap, CASE WHEN reason = 'decided' THEN 'decided' ELSE 'review' END AS status, reason FROM routed")
def linkage_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: every document is linked to a catalogue item or goes to review with a reason."""
    return routed(spark, sf_dir).withColumn("score", F.round("score", 6)).withColumn("gap", F.round("gap", 6))


@bank.add(f"WITH {BM25}, {TFIDF}, {FUSED} SELECT count(*) AS total, count(*) FILTER (reason = 'decided') AS decided, count(*) FILTER (reason <> 'decided') AS review, round(100.0 * count(*) FILTER (reason = 'decided') / count(*), 1) AS rate FROM routed")
def decision_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.decision_summary(routed(spark, sf_dir))


@bank.add(f"WITH {BM25}, {TFIDF}, {FUSED} SELECT reason, count(*) AS n FROM routed WHERE reason <> 'decided' GROUP BY reason")
def reason_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.reasons(routed(spark, sf_dir))


@bank.add(
    f"""WITH {BM25}, {TFIDF}, k AS (SELECT id, method, code FROM (SELECT *, row_number() OVER (PARTITION BY id, method ORDER BY score DESC, ord, code) AS k FROM
      (SELECT id, 'fuzzy' AS method, code, ord, score / 60 AS score FROM bm UNION ALL SELECT id, 'vector', code, ord, score FROM ti)) WHERE k = 1),
    f AS (SELECT id, max(CASE WHEN method = 'fuzzy' AND sc >= 0.95 THEN code END) AS fuzzy, max(CASE WHEN method = 'vector' AND sc >= 0.95 THEN code END) AS vector, CASE WHEN count(*) = 2 AND count(DISTINCT code) = 1 THEN max(code) END AS agreed
      FROM (SELECT k.*, CASE WHEN method = 'fuzzy' THEN bm.score / 60 ELSE ti.score END AS sc FROM k LEFT JOIN bm USING (id, code) LEFT JOIN ti USING (id, code)) GROUP BY id)
    SELECT id, coalesce(fuzzy, vector, agreed) AS code, CASE WHEN fuzzy IS NOT NULL THEN 'fuzzy' WHEN vector IS NOT NULL THEN 'vector' WHEN agreed IS NOT NULL THEN 'consensus' ELSE 'none' END AS how FROM f"""
)
def vote_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, b = documents(spark, sf_dir), benchmark(spark, sf_dir)
    both = candidates.bm25(d, b).withColumn("score", F.col("score") / 60).withColumn("method", F.lit("fuzzy")).unionByName(candidates.tfidf(d, b).withColumn("method", F.lit("vector")))
    return route.votes(both)


@bank.add(
    f"""WITH {BM25}, {TFIDF}, {FUSED}, o AS (SELECT id, code, score, ord, row_number() OVER (PARTITION BY id ORDER BY score DESC, ord, code) AS k FROM pl)
    SELECT s.id, {", ".join(f"max(CASE WHEN k = {i} THEN code END) AS code_{i}, max(CASE WHEN k = {i} THEN round(score, 3) END) AS score_{i}" for i in (1, 2, 3))} FROM s LEFT JOIN o USING (id) GROUP BY s.id"""
)
def report_wide_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = candidates.top(fused_candidates(spark, sf_dir).select("id", "code", "ord", "score"), 3)
    return analytics.wide_top(documents(spark, sf_dir).select("id"), top, 3)


# --- expansion, filters, tie rules on the part catalogue --------------------------------------------------

FAMILIES = "cat AS (SELECT p_partkey AS ord, CAST(10 + p_partkey % 400 // 4 AS VARCHAR) || p_brand AS code, CAST(10 + p_partkey % 400 // 4 AS VARCHAR) AS family FROM part), ca AS (SELECT min(ord) AS ord, code, family FROM cat GROUP BY code, family), cd AS (SELECT l_orderkey AS id, ca.code, round(max(l_quantity) / 50, 6) AS score, min(ca.ord) AS ord FROM lineitem JOIN cat ON cat.ord = l_partkey JOIN ca USING (code) GROUP BY 1, 2)"


def _family_catalogue(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(catalogue, candidates): codes made from part numbers and brands; an order's candidates are the codes of its lines."""
    family = F.floor(10 + F.floor((F.col("p_partkey") % 400) / 4)).cast("string")
    cat = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), F.concat(family, "p_brand").alias("code"), family.alias("family"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("ord"), "l_quantity")
    codes = cat.groupBy("code", "family").agg(F.min("ord").alias("ord"))
    found = lines.join(cat, "ord").groupBy("id", "code").agg(F.round(F.max("l_quantity") / 50, 6).alias("score"))
    return codes, found.join(codes.select("code", "ord"), "code")


@bank.add(
    f"""WITH {FAMILIES}, best AS (SELECT id, family, max(score) AS best FROM cd JOIN ca USING (code) GROUP BY ALL)
    SELECT id, code, round(score, 6) AS score, 'direct' AS source FROM cd UNION ALL
    SELECT id, code, round(best * 0.9, 6), 'family' FROM best JOIN ca USING (family) WHERE NOT EXISTS (SELECT 1 FROM cd WHERE cd.id = best.id AND cd.code = ca.code)"""
)
def family_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat, found = _family_catalogue(spark, sf_dir)
    return expand.by_family(found, cat).withColumn("score", F.round("score", 6))


ANCHORED = FAMILIES + ", an AS (SELECT id, code FROM (SELECT id, code, row_number() OVER (PARTITION BY id ORDER BY score, ord) AS k FROM cd) WHERE k = 1 AND id % 3 = 0)"


def _anchored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    cat, found = _family_catalogue(spark, sf_dir)
    weakest = found.groupBy("id").agg(F.min_by("code", F.struct("score", "ord")).alias("code")).where("id % 3 = 0")
    return cat, found, expand.anchors(weakest.select("id", F.array(F.lit("REL"), "code", F.lit("ATUADO")).alias("tokens")), cat)


@bank.add(f"WITH {ANCHORED} SELECT id, code, greatest(cd.score, CASE WHEN an.code IS NOT NULL THEN 0.85 END) AS score FROM cd LEFT JOIN an USING (id, code)")
def anchor_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, found, named = _anchored(spark, sf_dir)
    return expand.anchored(found, named)


@bank.add(
    f"""WITH {ANCHORED}, r AS (SELECT an.id, ca.family, an.code AS root FROM an JOIN ca USING (code)),
    k AS (SELECT cd.id, cd.code, cd.score, r.root IS NULL OR starts_with(cd.code, r.root) AS ok FROM cd JOIN ca USING (code) LEFT JOIN r ON r.id = cd.id AND r.family = ca.family)
    SELECT id, code, score FROM k WHERE ok OR id NOT IN (SELECT id FROM k WHERE ok)"""
)
def subtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat, found, named = _anchored(spark, sf_dir)
    return expand.subtree(found, named, cat)


@bank.add(
    f"""WITH {ANCHORED}, g AS (SELECT * FROM cd WHERE NOT EXISTS (SELECT 1 FROM an WHERE an.id = cd.id AND an.code = cd.code)),
    t AS (SELECT DISTINCT id, family FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, code) AS k FROM g) JOIN ca USING (code) WHERE k <= 3)
    SELECT id, code, score FROM g UNION ALL SELECT an.id, an.code, 0.85 FROM an JOIN ca USING (code) WHERE length(family) = 2 AND NOT EXISTS (SELECT 1 FROM t WHERE t.id = an.id AND t.family = ca.family)"""
)
def missing_family_rescue(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat, found, named = _anchored(spark, sf_dir)
    return expand.rescued(found.join(named, ["id", "code"], "left_anti"), named, cat)


@bank.add(f"WITH {FAMILIES} SELECT id, code, score FROM (SELECT *, score >= 0.9 AS ok, bool_or(score >= 0.9) OVER (PARTITION BY id) AS has FROM cd) WHERE ok OR NOT has")
def never_empty_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, found = _family_catalogue(spark, sf_dir)
    return expand.never_empty(found.withColumn("ok", F.col("score") >= 0.9), "ok", "id").select("id", "code", "score")


@bank.add(
    """WITH k AS (SELECT l_orderkey AS id, l_linenumber AS n, p_brand AS family, p_partkey AS code, len(list_intersect(string_split(p_name, ' '), ['red', 'small', 'ring', 'bolt'])) AS shared FROM lineitem JOIN part ON p_partkey = l_partkey)
    SELECT id, n, code FROM (SELECT *, max(shared) OVER w AS most, count(*) OVER w AS c FROM k WINDOW w AS (PARTITION BY id, family)) WHERE c < 2 OR most = 0 OR shared = most"""
)
def specificity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    frame = rows.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), F.col("p_brand").alias("family"), F.col("p_partkey").alias("code"), F.array(*map(F.lit, ("red", "small", "ring", "bolt"))).alias("tokens"), F.split("p_name", " ").alias("code_tokens"))
    return rules.most_specific(frame).select("id", "n", "code")


@bank.add(
    f"""WITH {FAMILIES}, l AS (SELECT id, code, score, row_number() OVER (PARTITION BY id ORDER BY score DESC, ord, code) AS k FROM cd),
    p AS (SELECT a.id, a.code AS a, a.score AS sa, b.code AS b, coalesce(b.score, 0) AS sb FROM l a LEFT JOIN l b ON b.id = a.id AND b.k = 2 WHERE a.k = 1)
    SELECT id, least(a, b) AS code FROM p JOIN ca x ON x.code = a JOIN ca y ON y.code = b WHERE sa >= 0.45 AND sa - sb <= 0.005 AND x.family = y.family"""
)
def tie_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat, found = _family_catalogue(spark, sf_dir)
    return route.same_description(route.leaders(found), cat.withColumn("text", F.col("family")))


@bank.add(
    f"""WITH {FAMILIES}, d AS (SELECT *, CASE ord % 3 WHEN 0 THEN 0.1 WHEN 1 THEN -0.1 ELSE 0 END AS delta FROM cd),
    l AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, ord, code) AS k FROM d)
    SELECT a.id, a.code FROM l a LEFT JOIN l b ON b.id = a.id AND b.k = 2 WHERE a.k = 1 AND a.score >= 0.45 AND a.score - coalesce(b.score, 0) < 0.08 AND a.delta > 0 AND coalesce(b.delta, 0) <= 0"""
)
def rescue_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, found = _family_catalogue(spark, sf_dir)
    delta = F.when(F.col("ord") % 3 == 0, 0.1).when(F.col("ord") % 3 == 1, -0.1).otherwise(0.0)
    return route.by_rules(route.leaders(found.withColumn("delta", delta)))


@bank.add(
    """WITH c AS (SELECT DISTINCT string_split(p_name, ' ')[2] AS family, p_name AS code, string_split(p_name, ' ')[1] AS token FROM part), u AS (SELECT family, token, min(code) AS sibling FROM c GROUP BY ALL HAVING count(DISTINCT code) = 1),
    d AS (SELECT p_partkey AS id, string_split(p_name, ' ')[2] AS code, [string_split(p_name, ' ')[1], 'red'] AS tokens FROM part), w AS (SELECT DISTINCT id, code AS family, unnest(tokens) AS token FROM d),
    f AS (SELECT id, count(DISTINCT sibling) AS n, min(sibling) AS sibling FROM w JOIN u USING (family, token) GROUP BY id)
    SELECT id, CASE WHEN n = 1 THEN sibling ELSE code END AS code, coalesce(n > 1, false) AS ambiguous FROM d LEFT JOIN f USING (id)"""
)
def sibling_qualifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.split("p_name", " ")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", words[0].alias("token"), words[1].alias("family"))
    cat = part.select("family", F.col("p_name").alias("code"), F.array("token").alias("tokens")).distinct()
    decided = part.select(F.col("p_partkey").alias("id"), F.col("family").alias("code"), F.array("token", F.lit("red")).alias("tokens"))
    return route.sibling(decided, cat)


@bank.add(
    """WITH o AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'O' THEN 'A' || o_custkey END AS a, round(o_totalprice / 500000, 6) AS ga, CASE WHEN o_orderpriority < '4' THEN 'B' || o_custkey END AS b, round(o_custkey % 97 / 97.0, 6) AS gb, o_custkey % 2 = 0 AS allow FROM orders),
    k AS (SELECT *, a IS NOT NULL AS oka, b IS NOT NULL AND allow AS okb, b IS NOT NULL AND NOT allow AS forbidden FROM o),
    w AS (SELECT *, CASE WHEN oka AND okb THEN CASE WHEN abs(ga - gb) > 0.03 THEN CASE WHEN ga > gb THEN 'a' ELSE 'b' END WHEN id % 3 = 0 THEN 'a' WHEN id % 3 = 1 THEN 'b' END WHEN oka AND NOT forbidden THEN 'a' WHEN okb AND NOT forbidden THEN 'b' END AS bundle FROM k)
    SELECT id, CASE bundle WHEN 'a' THEN a WHEN 'b' THEN b END AS code, bundle, CASE WHEN bundle IS NOT NULL THEN 'decided' WHEN oka AND (okb OR forbidden) THEN 'category_ambiguous' WHEN forbidden THEN 'category_conflict' ELSE 'low_score' END AS reason FROM w"""
)
def dual_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    a = F.when(F.col("o_orderstatus") == "O", F.concat(F.lit("A"), F.col("o_custkey").cast("string")))
    b = F.when(F.col("o_orderpriority") < "4", F.concat(F.lit("B"), F.col("o_custkey").cast("string")))
    one = lambda bundle, code, gap, allowed: o.select(F.col("o_orderkey").alias("id"), F.lit(bundle).alias("bundle"), code.alias("code"), F.round(gap, 6).alias("gap"), F.when(code.isNotNull(), "decided").otherwise("review").alias("status"), allowed.alias("allowed"))
    both = one("a", a, F.col("o_totalprice") / 500000, F.lit(True)).unionByName(one("b", b, F.col("o_custkey") % 97 / 97.0, F.col("o_custkey") % 2 == 0))
    near = o.select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 3 == 0).cast("int").alias("a"), (F.col("o_orderkey") % 3 == 1).cast("int").alias("b"))
    return route.dual(both, near)
