"""The numbered queries: each applies its operator to a whole table and returns the digest that its contract names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm import common, decontaminate, jaccard, jpeg, langid, mixing, packing, periodic, phrases, secrets, substrings, tokenstore, toxicity, urls


def vocabulary(name: str) -> str:
    """The path of a public tokenizer's file, which is not part of this repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.covered(common.table(spark, sf_dir, "documents"))
    removed = F.col("n_bytes") - F.octet_length("kept")
    return found.select("doc_id", "n_bytes", removed.cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.scan(docs, common.table(spark, sf_dir, "benchmark"))
    items = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), items.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP2_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark),
t AS (
  SELECT DISTINCT item_id, n, array_to_string(ws[i : i + n - 1], ' ') AS win
  FROM (SELECT item_id, ws, least(len(ws), 10) AS n, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM t),
d AS (
  SELECT doc_id, n, i, array_to_string(ws[i : i + n - 1], ' ') AS win
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w, sizes)),
hits AS (SELECT doc_id, item_id, i, n FROM d JOIN t USING (n, win)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS ids FROM hits GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(ids), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


#: The rules of the contract.
URL_RULES = [
    urls.Rule("allow", "org", "/"),
    urls.Rule("block", "example.org", "/es/"),
    urls.Rule("block", "example.org", "/en/1"),
    urls.Rule("allow", "com", "/fr/"),
    urls.Rule("block", "com", "/de/"),
]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url")
    found = urls.judged(pages, URL_RULES)
    return found.select("page_id", "host", "path", "rule", "verdict", F.round("reputation", 6).alias("reputation"))


def op3_sql() -> str:
    def level(name: str, above: str, keys: str, join: str) -> str:
        return f"""
{name}_u AS (SELECT u.*, a.mean FROM (SELECT {keys}, sum(n) AS n, sum(good) AS good FROM hosts GROUP BY {keys}) u JOIN {above} a {join}),
{name}_k AS (
  SELECT 1 / greatest(0.001, least(0.5, coalesce(sum(power(good - n * mean, 2) - n * mean * (1 - mean)) / nullif(sum(n * (n - 1) * mean * (1 - mean)), 0), 0.5))) - 1 AS k FROM {name}_u),
{name}_p AS (SELECT {keys}, good + k * mean AS alpha, n - good + k * (1 - mean) AS beta FROM {name}_u, {name}_k),
{name} AS (SELECT {keys}, alpha / (alpha + beta) AS mean, sqrt(alpha * beta / (power(alpha + beta, 2) * (alpha + beta + 1))) AS sd FROM {name}_p)"""

    fits = " ".join(
        f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN {{what[{i}]}}"
        for i, r in sorted(enumerate(URL_RULES), key=lambda x: (-len(x[1].text), x[1].text))
    )
    texts, verdicts = [f"'{r.text}'" for r in URL_RULES], [f"'{r.verdict}'" for r in URL_RULES]
    long = ", ".join(f"'{x}'" for x in urls.LONG_SUFFIXES)
    return rf"""
WITH p AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), '{urls.UPPER}', '{urls.LOWER}') AS host,
    regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
j AS (SELECT *, CASE {fits.format(what=texts)} END AS rule, CASE {fits.format(what=verdicts)} END AS ruled FROM p),
h AS (
  SELECT host, regexp_replace(regexp_replace(host, '^.*@', ''), ':\d*$', '') AS name, count(ruled) AS n, count(*) FILTER (ruled = 'allow') AS good
  FROM j GROUP BY host),
hosts AS (
  SELECT host, n, good,
    CASE WHEN regexp_matches(name, '^[0-9.]+$|^\[') THEN name WHEN two IN ({long}) THEN two ELSE regexp_extract(name, '([^.]*)$', 1) END AS suffix,
    CASE WHEN regexp_matches(name, '^[0-9.]+$|^\[') THEN name WHEN two IN ({long}) THEN CASE WHEN three = '' THEN two ELSE three END WHEN two = '' THEN name ELSE two END AS domain
  FROM (SELECT *, regexp_extract(name, '([^.]*\.[^.]*)$', 1) AS two, regexp_extract(name, '([^.]*\.[^.]*\.[^.]*)$', 1) AS three FROM h)),
total AS (SELECT (sum(good) + 1.0) / (sum(n) + 2.0) AS mean FROM hosts),
{level("s", "total", "suffix", "ON true")},
{level("d", "s", "suffix, domain", "USING (suffix)")},
{level("f", "d", "suffix, domain, host", "USING (suffix, domain)")}
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN round(mean - {urls.Z} * sd, 9) >= {urls.THRESHOLD} THEN 'allow' ELSE 'block' END) AS verdict,
  round(mean - {urls.Z} * sd, 6) AS reputation
FROM j JOIN f USING (host)
"""


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    known = common.table(spark, sf_dir, "labels").where(common.crc_fold("doc_id", 5) != 0)
    scored = toxicity.score(docs, toxicity.fit(docs, known))
    return scored.select("doc_id", (common.crc_fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_jpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg.round_trip(common.table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(common.table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenstore.round_trip(common.table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = [F.size(secrets.of_kind(F.col("spans"), r.kind)).cast("long").alias(f"n_{r.kind}") for r in secrets.BASE_RULES]
    base = F.filter("spans", lambda s: s["kind_order"] < len(secrets.BASE_RULES))
    return found.select("doc_id", *n, F.sha2(secrets.spelled(base).cast("binary"), 256).alias("base_sha256"), secrets.spelled(F.col("spans")).alias("spans"))


def _spans_sql() -> str:
    """The same spans by regular expressions alone, over all texts."""
    parts = []
    for order, r in enumerate(secrets.BASE_RULES + secrets.MORE_RULES):
        regex = r.regex.replace("'", "''")
        parts.append(f"""
  SELECT doc_id, {order} AS k, '{r.kind}' AS kind, unnest(range(1, len(m) + 1)) AS i,
    list_transform(m, lambda x: len(x)) AS sizes, list_transform(t, lambda x: len(x)) AS tested, {r.least} AS least,
    list_transform(regexp_split_to_array(text, '{regex}'), lambda x: len(x)) AS gaps
  FROM (SELECT doc_id, text, regexp_extract_all(text, '{regex}') AS m, regexp_extract_all(text, '{regex}', {r.group}) AS t FROM docs)""")
    return " UNION ALL ".join(parts)


def op9_sql() -> str:
    n = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in secrets.BASE_RULES)
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS ({_spans_sql()}),
s AS (
  SELECT doc_id, k, kind, list_sum(gaps[1:i]) + coalesce(list_sum(sizes[1:i-1]), 0) AS a, list_sum(gaps[1:i]) + list_sum(sizes[1:i]) AS e
  FROM m WHERE tested[i] >= least),
g AS (
  SELECT doc_id, {n}, string_agg(kind || ':' || CAST(a AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY a, k) FILTER (k < {len(secrets.BASE_RULES)}) AS base,
    string_agg(kind || ':' || CAST(a AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY a, k) AS spans
  FROM s GROUP BY doc_id)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in secrets.BASE_RULES)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN g USING (doc_id)
"""


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(langid.training_rows(docs))
    scored = langid.predict(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (common.crc_fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.components(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.col("n_features").alias("n_shingles"), F.col("component").alias("component_id"))


OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END)) AS shingle
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
  FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 90 * (x.n + y.n - common)),
reach AS (
  SELECT doc_id AS node, doc_id AS other FROM documents
  UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.other) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN reach r ON r.node = d.doc_id GROUP BY d.doc_id, n.n
"""


def with_repeats(docs: DataFrame) -> DataFrame:
    """The documents of the contract: one in ten repeats, from some word on, the words there. A null id counts as empty text."""
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    cut = docs.withColumn("__w", F.when(h % 10 == 0, words)).withColumn("__n", F.size("__w")).withColumn("__g", F.floor(h / 10))
    cut = cut.withColumn("__a", F.when(F.col("__n") > 0, F.col("__g") % F.col("__n")).cast("int"))
    cut = cut.withColumn("__p", (F.floor((F.col("__n") - F.col("__a")) / (3 + F.col("__g") % 8)) + 1).cast("int"))
    rest = F.col("__n") - F.col("__a")
    period = F.array_repeat(F.slice("__w", F.col("__a") + 1, F.col("__p")), F.ceil(rest / F.col("__p")).cast("int"))
    repeated = F.array_join(F.concat(F.slice("__w", 1, F.col("__a")), F.slice(F.flatten(period), 1, rest)), " ")
    return cut.withColumn("text", F.when(F.col("__n") > 0, repeated).otherwise(F.col("text"))).select(docs.columns)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.runs(with_repeats(common.table(spark, sf_dir, "documents").select("doc_id", "text")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    best = periodic.best()
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.floor(1000 * best["length"] / best["period"]).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


#: A run of 24 words and three periods has words in common with itself, a period on, over 16 words or more: equal 16-word grams of a text, in pairs, give all runs.
OP11_SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)) AS chars FROM documents),
h AS (
  SELECT doc_id, w, len(w) AS n, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(chars, lambda c: list_transform(range(8), lambda b: (c >> CAST(b AS INTEGER)) & 1)))),
    lambda crc, bit: xor(crc >> 1, 3988292384 * (xor(crc, bit) & 1))), 4294967295) AS h FROM t),
g AS (SELECT doc_id, w, n, h % 10 = 0 AND n > 0 AS planted, h // 10 AS g, CASE WHEN n > 0 THEN (h // 10) % n ELSE 0 END AS a FROM h),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM g),
d AS (SELECT doc_id, n, CASE WHEN planted THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w END AS w FROM p),
words AS (SELECT doc_id, n, unnest(w) AS word, unnest(range(n)) AS i FROM d),
grams AS (SELECT doc_id, n, i, array_to_string(w[i + 1 : i + 16], ' ') AS gram FROM (SELECT doc_id, n, w, unnest(range(n - 15)) AS i FROM d)),
pairs AS (
  SELECT a.doc_id, b.i - a.i AS q, a.i, a.i - row_number() OVER (PARTITION BY a.doc_id, b.i - a.i ORDER BY a.i) AS island
  FROM grams a JOIN grams b ON a.doc_id = b.doc_id AND a.gram = b.gram AND a.i < b.i AND 3 * (b.i - a.i) <= a.n),
stretches AS (SELECT doc_id, q, min(i) AS s, count(*) + 15 + q AS length FROM pairs GROUP BY doc_id, q, island),
runs AS (SELECT doc_id, s, length, min(q) AS q FROM stretches WHERE length >= greatest(24, 3 * q) GROUP BY doc_id, s, length),
sums AS (
  SELECT doc_id, count(*) AS n_runs, sha256(string_agg(s || ',' || length || ',' || q || chr(10), '' ORDER BY s, q)) AS runs_sha256 FROM runs GROUP BY doc_id),
best AS (SELECT r.* FROM runs r LEFT JOIN runs o ON o.doc_id = r.doc_id AND (o.length * r.q > r.length * o.q OR (o.length * r.q = r.length * o.q AND (o.s, o.q) < (r.s, r.q))) WHERE o.doc_id IS NULL),
dropped AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + length)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM (SELECT * FROM words ANTI JOIN dropped USING (doc_id, i)) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, s AS start, length, q AS period, 1000 * length // q AS exponent_milli,
  coalesce(runs_sha256, sha256('')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM d LEFT JOIN sums USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mined(common.table(spark, sf_dir, "documents").select("lang", "text"))


OP12_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM (
    SELECT lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents)),
grams AS (
  SELECT lang, size, array_to_string(w[i : i + size - 1], ' ') AS phrase
  FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM pieces, range(1, 5) s(size))),
f AS (SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND f >= 30),
cuts AS (SELECT *, array_to_string(w[1:k], ' ') AS first, array_to_string(w[k + 1 :], ' ') AS rest FROM (SELECT *, unnest(range(1, size)) AS k FROM c)),
scored AS (
  SELECT c.lang, c.phrase, c.size, c.a, x.f AS l, y.f AS r, k, CAST(CAST(2000000 AS HUGEINT) * c.a // (CAST(x.f AS HUGEINT) + y.f) AS BIGINT) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.first JOIN f y ON y.lang = c.lang AND y.phrase = c.rest),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT lang, array_to_string(w[i : i + m - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT lang, w, a, m, unnest(range(1, size - m + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS m FROM c)) GROUP BY 1, 2),
kept AS (SELECT s.* FROM lowest s LEFT JOIN inside i USING (lang, phrase) WHERE i.longer IS NULL OR 100 * i.longer < 80 * s.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""


def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mixed(common.table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return plan.select("doc_id", "size", "source_size", "target", "taken", "source", "rate", "copies")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_decontamination": op2_decontamination,
    "op3_url_filter": op3_url_filter,
    "op4_toxicity": op4_toxicity,
    "op5_jpeg_media": op5_jpeg_media,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_language_id": op7_language_id,
    "op8_token_store": op8_token_store,
    "op9_secret_scan": op9_secret_scan,
    "op10_ngram_jaccard": op10_ngram_jaccard,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_phrase_mining": op12_phrase_mining,
    "op13_source_mix": op13_source_mix,
}

ORACLE_SQL: dict[str, str] = {
    "op2_decontamination": OP2_SQL,
    "op3_url_filter": op3_sql(),
    "op9_secret_scan": op9_sql(),
    "op10_ngram_jaccard": OP10_SQL,
    "op11_periodic_runs": OP11_SQL,
    "op12_phrase_mining": OP12_SQL,
}
