"""Queries that diagnose decisions and catalogues: buckets, families, taxonomies, traces, patches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.functions import tables as t
from matchloom.functions import text as x
from matchloom.operators import analytics, candidates, expand, rules
from matchloom.plans import ranking, signals
from matchloom.plans.registry import Bank, indel_sql, table

bank = Bank()

NAMES = tuple(c[0] for c in signals.CODES)
_CODE = signals._pick(NAMES, "l_partkey")
WRITE_CODES = ("DJCMD", "SEC_C", "79")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with a code of the catalogue and a direction."""
    way = F.when(F.col("l_returnflag") == "A", "Output").when(F.col("l_returnflag") == "N", "InputOutput").otherwise("Input")
    return table(spark, sf_dir, "lineitem").withColumn("code", signals.pick(NAMES, "l_partkey")).withColumn("direction", way)


@bank.add(
    f"""SELECT CASE WHEN l_returnflag = 'N' THEN 'paired' WHEN {_CODE} IN {signals._in(WRITE_CODES)} THEN 'legitimate_write' ELSE 'escaped' END AS bucket, count(*) AS n FROM lineitem WHERE l_returnflag IN ('A', 'N') GROUP BY ALL"""
)
def command_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.command_buckets(lines(spark, sf_dir), WRITE_CODES)


@bank.add(
    f"""WITH d AS (SELECT {_CODE} AS ours, CASE l_linenumber % 4 WHEN 0 THEN {_CODE} ELSE {_CODE} || 'X' || l_linenumber END AS real FROM lineitem WHERE l_linestatus = 'O' UNION ALL SELECT 'Q' || l_linenumber, 'Q' || l_linenumber || '1' FROM lineitem)
    SELECT ours AS parent, count(*) AS n, array_to_string(list_sort(list(DISTINCT real)), ',') AS children FROM d WHERE ours IN {signals._in(NAMES)} AND starts_with(real, ours) AND real <> ours GROUP BY ours"""
)
def child_for_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("l_linenumber").cast("string")
    own = lines(spark, sf_dir).where("l_linestatus = 'O'").select(F.col("code").alias("ours"), F.when(F.col("l_linenumber") % 4 == 0, F.col("code")).otherwise(F.concat("code", F.lit("X"), number)).alias("real"))
    odd = lines(spark, sf_dir).select(F.concat(F.lit("Q"), number).alias("ours"), F.concat(F.lit("Q"), number, F.lit("1")).alias("real"))
    found = analytics.child_for_parent(own.union(odd), signals.catalogue(spark))
    return found.withColumn("children", F.array_join("children", ","))


_ANCHORS = """
spelt AS (SELECT id, unnest(tokens) AS code FROM sig UNION ALL SELECT id, tokens[i] || tokens[i + 1] FROM (SELECT id, tokens, unnest(range(1, len(tokens))) AS i FROM sig)),
an AS (SELECT DISTINCT id, code, coalesce(code_family, code) AS f FROM spelt JOIN cat USING (code) WHERE length(code) >= 3 AND regexp_matches(code, '[0-9]') AND regexp_matches(code, '[A-Za-z]')),
top AS (SELECT id, code, coalesce(code_family, code) AS f FROM off QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, ord, code) <= 3)"""


@bank.add(
    f"""WITH {signals.OFFERED}, {_ANCHORS},
    g AS (SELECT DISTINCT id FROM an), k AS (SELECT g.id, coalesce(bool_or(EXISTS (SELECT 1 FROM an WHERE an.id = top.id AND an.code = top.code)), false) AS has, count(DISTINCT CASE WHEN EXISTS (SELECT 1 FROM an WHERE an.id = top.id AND an.f = top.f) THEN top.code END) AS kin FROM g LEFT JOIN top ON top.id = g.id GROUP BY g.id),
    z AS (SELECT id, list_filter([CASE WHEN id % 5 = 0 THEN 'below_floor' END, CASE WHEN NOT has THEN 'anchor_absent' END, CASE WHEN NOT has AND kin = 0 THEN 'family_absent' END, CASE WHEN NOT has AND kin = 1 THEN 'family_partial' END, CASE WHEN kin >= 2 THEN 'siblings' END], lambda v: v IS NOT NULL) AS tags FROM k)
    SELECT id, CASE WHEN len(tags) > 0 THEN array_to_string(tags, ',') ELSE 'other' END AS tags FROM z"""
)
def anchor_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, cat = signals.signals(spark, sf_dir), signals.catalogue(spark)
    families = cat.select("code", F.col("code_family").alias("family"))
    ranked = rules.ranked(signals.offered(spark, sf_dir))
    found = analytics.anchor_diagnosis(rows.select("id", (F.col("id") % 5 == 0).alias("low")), expand.anchors(rows, cat), ranked, families)
    return found.withColumn("tags", F.array_join("tags", ","))


@bank.add(
    """WITH k AS (SELECT p_type AS family, p_brand AS code, CASE p_size % 4 WHEN 0 THEN 'POSICAO' WHEN 1 THEN 'EVENTO' ELSE 'none' END AS state FROM part)
    SELECT family, state, array_to_string(list_sort(list(DISTINCT code)), ',') AS codes FROM k WHERE family IN (SELECT family FROM k GROUP BY family HAVING count(DISTINCT code) >= 2) GROUP BY family, state"""
)
def family_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as the variants of a part's type, by the state that a size stands for."""
    state = F.when(F.col("p_size") % 4 == 0, "POSICAO").when(F.col("p_size") % 4 == 1, "EVENTO")
    found = analytics.family_partition(table(spark, sf_dir, "part").select(F.col("p_type").alias("family"), F.col("p_brand").alias("code"), state.alias("code_state")))
    return found.withColumn("codes", F.array_join("codes", ","))


_ENTRY = f"CASE {' '.join(f"WHEN token = '{w}' THEN '[exact] {w}'" for w in t.STATE_TOKENS)} {' '.join(f"WHEN starts_with(token, '{p}') THEN '{p}'" for p, _, _ in t.STATES)} END"


@bank.add(f"WITH {signals.SIGNALS}, k AS (SELECT unnest(tokens) AS token FROM sig) SELECT {_ENTRY} AS entry, token, count(*) AS n FROM k WHERE ({_ENTRY}) IS NOT NULL GROUP BY ALL")
def lexicon_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.lexicon_hits(signals.signals(spark, sf_dir))


QUALIFIERS = {"stage": r"\\bE[1-4]\\b", "phase": r"\\bFASE\\b", "neutral": r"\\bNEUTRO\\b", "line": r"\\bLINHA\\b", "lock": r"BLOQUE"}
_TAGS = {name: p.replace("\\\\", "\\") for name, p in QUALIFIERS.items()}


def _tagged(column: str) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({column}, '{p}') THEN '{name}' END" for name, p in _TAGS.items()) + "], lambda v: v IS NOT NULL)"


@bank.add(
    f"""WITH {signals.SIGNALS}, k AS (SELECT s.id, a.code AS a, b.code AS b, {_tagged("s.text")} AS q, {_tagged("a.description")} AS qa, {_tagged("b.description")} AS qb FROM sig s JOIN cat a ON a.ord = s.id % {len(NAMES)} JOIN cat b ON b.ord = (s.id + 1) % {len(NAMES)}),
    m AS (SELECT *, coalesce(left(a, 2) = left(b, 2) AND regexp_matches(a, '^[0-9][0-9]') AND regexp_matches(b, '^[0-9][0-9]'), false) AS same, list_sort(list_filter(q, lambda v: list_contains(qa, v) <> list_contains(qb, v))) AS apart FROM k)
    SELECT id, CASE WHEN NOT same THEN 'other_family' WHEN len(apart) > 0 THEN array_to_string(apart, ',') ELSE 'same_family_without_qualifier' END AS category FROM m"""
)
def qualifier_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, cat = signals.signals(spark, sf_dir), signals.catalogue(spark)
    at = lambda n, s: candidates.small(cat.select(F.col("ord").alias(f"at_{s}"), F.col("code").alias(s), F.col("description").alias(f"{s}_text")))
    ties = rows.withColumn("at_first", F.col("id") % len(NAMES)).withColumn("at_second", (F.col("id") + 1) % len(NAMES)).join(at(0, "first"), "at_first").join(at(1, "second"), "at_second")
    return analytics.qualifier_taxonomy(ties, _TAGS)


@bank.add(
    f"""WITH {signals.SIGNALS}, e AS (SELECT DISTINCT s.id, c.code FROM (SELECT id, unnest(regexp_split_to_array(upper(text), '\\s+')) AS token FROM sig) s JOIN (SELECT DISTINCT upper(code) AS code FROM cat) c ON c.code = s.token),
    t AS (SELECT DISTINCT upper(text) AS said, array_to_string(list_sort(list_filter(regexp_split_to_array(upper(text), '\\s+'), lambda w: w <> '')), ' ') AS a FROM sig), d AS (SELECT upper(code) AS code, array_to_string(list_sort(list_filter(regexp_split_to_array(upper(description), '\\s+'), lambda w: w <> '')), ' ') AS b FROM cat),
    n AS (SELECT said, code, a, b FROM t, d WHERE a <> '' AND b <> '' AND 100 * levenshtein(a, b) <= 10 * (length(a) + length(b))), f AS (SELECT DISTINCT said, code FROM n WHERE {indel_sql("a", "b")} > 90)
    SELECT id, code, 'exact' AS how FROM e UNION ALL SELECT s.id, f.code, 'text' FROM sig s JOIN f ON f.said = upper(s.text) WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.id = s.id AND e.code = f.code)"""
)
def catalogue_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals that name a code of the catalogue or nearly spell its description."""
    return analytics.catalogue_probe(signals.signals(spark, sf_dir), signals.catalogue(spark).select("code", F.col("description").alias("text")))


@bank.add(
    """WITH a AS (SELECT DISTINCT p_brand AS v FROM part), b AS (SELECT 'Brand#' || n_nationkey AS v FROM nation)
    SELECT v AS value, 'only_ours' AS "where" FROM a WHERE v NOT IN (SELECT v FROM b) UNION ALL SELECT v, 'only_domain' FROM b WHERE v NOT IN (SELECT v FROM a) UNION ALL SELECT v, 'mapped_outside' FROM (VALUES ('Brand#7'), ('Brand#77'), ('x')) m(v) WHERE v NOT IN (SELECT v FROM b)"""
)
def domain_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    ours = table(spark, sf_dir, "part").select(F.col("p_brand").alias("value"))
    theirs = table(spark, sf_dir, "nation").select(F.concat(F.lit("Brand#"), F.col("n_nationkey").cast("string")).alias("value"))
    return analytics.domain_differences(ours, theirs, ["Brand#7", "Brand#77", "x"])


@bank.add(
    f"""WITH {signals.SIGNALS} SELECT coalesce(family, 'none') AS family, CASE WHEN contains(text, 'BLOQUEIO') THEN 'lock' WHEN contains(text, 'DESLIGADO') THEN 'position' ELSE 'other' END AS population, count(*) AS n FROM sig GROUP BY ALL"""
)
def population_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = signals.signals(spark, sf_dir).withColumn("family", F.coalesce("family", F.lit("none")))
    return analytics.population(rows, {"lock": F.contains("text", F.lit("BLOQUEIO")), "position": F.contains("text", F.lit("DESLIGADO"))}, "family")


@bank.add(
    rf"""WITH k AS (SELECT {_CODE} || CASE WHEN l_linenumber = 1 THEN '' ELSE CAST(l_suppkey AS VARCHAR) END AS code FROM lineitem UNION ALL SELECT '_' || l_linenumber FROM lineitem),
    f AS (SELECT coalesce(nullif(regexp_extract(upper(code), '^(\d{{2}})', 1), ''), 'ALPHA_' || nullif(left(regexp_extract(upper(code), '^(\p{{L}}+)', 1), 2), ''), 'OTHER') AS family FROM k)
    SELECT family, count(*) AS n, round(count(*) / (SELECT count(*) FROM f), 6) AS share FROM f GROUP BY family"""
)
def family_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir)
    code = F.concat("code", F.when(F.col("l_linenumber") == 1, "").otherwise(F.col("l_suppkey").cast("string")))
    both = rows.select(code.alias("code")).union(rows.select(F.concat(F.lit("_"), F.col("l_linenumber").cast("string"))))
    return analytics.family_report(both).withColumn("share", F.round("share", 6))


NUMBERS = {"50": "SOBRECORRENTE INSTANTANEA", "51": "SOBRECORRENTE TEMPORIZADA", "27": "SUBTENSAO", "67": "SOBRECORRENTE DIRECIONAL"}
QUANTITIES = {"CORRENTE": "MEDICAO DE CORRENTE, A", "TENSAO": "MEDICAO DE TENSAO, KV"}
TERMS = {"43LR": "CHAVE SELETORA", "79": "RELIGADOR"}


def _map(values: dict[str, str], key: str) -> str:
    return f"CASE {key} {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items())} END"


_SAID = f"({signals._list(('PROTECAO 50 E 51N', 'RELE 67N', 'AJUSTE G2 ATIVO', 'CORRENTE FASE A', 'TENSAO', 'CHAVE', ''))})[CAST(l_suppkey % 7 AS INTEGER) + 1]"


@bank.add(
    rf"""WITH k AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_CODE} AS code, {_SAID} AS text, CASE WHEN l_linenumber % 2 = 0 THEN 'Analog' ELSE 'Discrete' END AS category FROM lineitem),
    m AS (SELECT *, list_filter(regexp_extract_all(text, '\b(\d{{2}})[A-Z]*\b', 1), lambda n: n IN {signals._in(tuple(NUMBERS))}) AS found, nullif(regexp_extract(text, '^AJUSTE\s+(\S+)', 1), '') AS adjust FROM k),
    e AS (SELECT *, coalesce(CASE WHEN len(found) >= 2 THEN array_to_string(list_transform(found, lambda n: {_map(NUMBERS, "n")}), ' + ') WHEN len(found) = 1 THEN {_map(NUMBERS, "found[1]")} WHEN adjust IS NOT NULL THEN 'GRUPO DE AJUSTE ' || adjust
      WHEN category = 'Analog' THEN {_map(QUANTITIES, "string_split(text, ' ')[1]")} END, {_map(TERMS, "code")}) AS more FROM m)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, code, CASE WHEN more IS NULL THEN text ELSE text || ' - ' || more END AS text FROM e"""
)
def enrich_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptions with the synonyms that their protection numbers, adjustments, quantities or codes call for."""
    said = signals.pick(("PROTECAO 50 E 51N", "RELE 67N", "AJUSTE G2 ATIVO", "CORRENTE FASE A", "TENSAO", "CHAVE", ""), "l_suppkey")
    rows = lines(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "code", said.alias("text"), F.when(F.col("l_linenumber") % 2 == 0, "Analog").otherwise("Discrete").alias("category"))
    return analytics.enriched(rows, NUMBERS, QUANTITIES, TERMS).drop("category")


SUFFIXES = {"N": "NEUTRO", "A": "FASE A", "F1": "FASE, ESTAGIO 1"}


@bank.add(
    rf"""WITH c AS (SELECT p_partkey AS ord, {signals._pick(tuple(c[0] for c in signals.CODES), "p_partkey")} AS code FROM part), k AS (SELECT ord, code, regexp_extract(code, '^(\d{{2}})', 1) AS base, regexp_extract(code, '^\d{{2}}\d*(.*)$', 1) AS suffix FROM c), n AS (SELECT *, {_map(NUMBERS, "base")} AS name FROM k)
    SELECT ord, code, base || ' - ' || name || CASE WHEN suffix <> '' THEN ' (' || coalesce({_map(SUFFIXES, "suffix")}, suffix) || ')' ELSE '' END AS description, name IS NOT NULL AND row_number() OVER (PARTITION BY base ORDER BY ord) = 1 AS first FROM n"""
)
def number_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptions from the number and suffix of each part's code; the first row of each number is marked."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), signals.pick(tuple(c[0] for c in signals.CODES), "p_partkey").alias("code"))
    return analytics.rewritten(rows, NUMBERS, SUFFIXES).select("ord", "code", "description", "first")


@bank.add(
    """WITH c AS (SELECT p_partkey AS ord, 'C' || p_partkey AS code, p_type AS mm FROM part) SELECT ord, code, CASE WHEN s_suppkey IS NOT NULL THEN 'FIX' || s_nationkey ELSE mm END AS mm FROM c LEFT JOIN supplier ON 'C' || s_suppkey * 3 = code
    UNION ALL SELECT n_nationkey + 1000000, 'N' || n_nationkey, n_name FROM nation UNION ALL SELECT n_nationkey + 2000000, 'C' || (n_nationkey + 100000000), n_name FROM nation"""
)
def catalogue_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    cat = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), text("C", F.col("p_partkey")).alias("code"), F.col("p_type").alias("mm"))
    changes = table(spark, sf_dir, "supplier").select(text("C", F.col("s_suppkey") * 3).alias("code"), text("FIX", F.col("s_nationkey")).alias("value"))
    n = table(spark, sf_dir, "nation")
    key = F.col("n_nationkey").cast("long")
    added = n.select((key + 1000000).alias("ord"), text("N", key).alias("code"), F.col("n_name").alias("mm")).union(n.select(key + 2000000, text("C", key + 100000000), "n_name")).union(n.where("n_nationkey between 1 and 9").select(key + 3000000, text("C", key), "n_name"))
    return analytics.patched(cat, changes, added, "mm")


@bank.add(
    """SELECT 'output' AS kind, '' AS name, count(*) AS n FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'review', o_orderpriority, count(*) FROM orders WHERE o_orderstatus <> 'F' GROUP BY ALL UNION ALL SELECT 'identity', CASE WHEN event_type = 'error' THEN 'WARN' ELSE 'INFO' END, count(*) FROM events GROUP BY ALL"""
)
def flow_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    events = table(spark, sf_dir, "events").select(F.when(F.col("event_type") == "error", "WARN").otherwise("INFO").alias("level"))
    return analytics.flow_report(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus <> 'F'").withColumnRenamed("o_orderpriority", "reason"), events)


@bank.add(
    """WITH o AS (SELECT o_orderkey AS id, o_custkey AS m, o_orderkey % 100 AS a, o_orderstatus AS s, o_orderkey % 7 AS k FROM orders),
    d AS (SELECT * FROM o WHERE k <> 0), f AS (SELECT m, a, id + 1 AS id, 'InputOutput' AS direction FROM o WHERE k = 1 UNION ALL SELECT m, NULL, id, 'Output' FROM o WHERE k = 2), r AS (SELECT id, m, NULL AS a, 'low_score' AS reason FROM o WHERE k = 3 UNION ALL SELECT id + 1, m, a, 'duplicate' FROM o WHERE k = 4)
    SELECT o.id, CASE WHEN d.id IS NOT NULL AND EXISTS (SELECT 1 FROM f WHERE direction = 'InputOutput' AND f.m = d.m AND f.a = d.a) THEN 'output_pair' WHEN EXISTS (SELECT 1 FROM f WHERE direction = 'Output' AND f.id = o.id) THEN 'output_alone'
      WHEN EXISTS (SELECT 1 FROM r WHERE r.id = o.id) THEN 'review:' || (SELECT min(reason) FROM r WHERE r.id = o.id) WHEN d.id IS NOT NULL AND EXISTS (SELECT 1 FROM r WHERE r.m = d.m AND r.a = d.a) THEN 'review_pair:duplicate' WHEN d.id IS NOT NULL THEN 'lost_after_decision' ELSE 'lost_before_decision' END AS destination
    FROM o LEFT JOIN d ON d.id = o.id WHERE o.s <> 'P'"""
)
def trace_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("m"), (F.col("o_orderkey") % 100).alias("address"), "o_orderstatus", (F.col("o_orderkey") % 7).alias("k"))
    none = F.lit(None).cast("long")
    final = o.where("k = 1").select(F.expr("id + 1").alias("id"), "m", F.col("address").alias("output_address"), F.lit("InputOutput").alias("direction")).union(o.where("k = 2").select("id", "m", none, F.lit("Output")))
    review = o.where("k = 3").select("id", "m", none.alias("output_address"), F.lit("low_score").alias("reason")).union(o.where("k = 4").select(F.expr("id + 1"), "m", "address", F.lit("duplicate")))
    return analytics.trace_commands(o.where("o_orderstatus <> 'P'"), o.where("k <> 0").select("id", "m", "address"), final, review, ["m"])


@bank.add(
    f"""WITH {signals.OFFERED}, r AS (SELECT id, code, score, row_number() OVER (PARTITION BY id ORDER BY score DESC, ord, code) AS k FROM off)
    SELECT id, text, (SELECT code FROM r WHERE r.id = sig.id AND k = 1) AS code, 'first' AS reason, (SELECT string_agg(code, ',' ORDER BY k) FROM r WHERE r.id = sig.id AND k <= 4) AS top FROM sig WHERE contains(text, 'SF6') OR contains(text, 'ATUADO')"""
)
def keyword_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = rules.ranked(signals.offered(spark, sf_dir))
    decided = ranked.where("rank = 1").select("id", "code", F.lit("first").alias("reason"))
    return analytics.keyword_trace(signals.signals(spark, sf_dir), decided, ranked, ("sf6", "atuado"))


@bank.add(
    f"""WITH {signals.SIGNALS}, c AS (SELECT ord, code, code_tokens AS terms FROM cat), s AS (SELECT id, tokens AS terms FROM sig), {ranking.LEXICAL}, {ranking.TFIDF}, w AS (SELECT id, {signals._pick(NAMES, "id")} AS code FROM sig)
    SELECT id, code, CAST(bm.rank AS INTEGER) AS first_rank, CAST(ti.rank AS INTEGER) AS second_rank FROM w LEFT JOIN bm USING (id, code) LEFT JOIN ti USING (id, code)"""
)
def two_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, cat = signals.signals(spark, sf_dir), signals.catalogue(spark)
    asked, known = rows.select("id", F.col("tokens").alias("terms")), cat.select("ord", "code", F.col("code_tokens").alias("terms"))
    return analytics.two_ranks(candidates.bm25(asked, known), candidates.tfidf(asked, known), rows.select("id", signals.pick(NAMES, "id").alias("code")))


_FUNCTIONS = ("LIGADO;DESLIGADO", "ATUADO", "HABILITADO;BLOQUEADO", "LOCAL;REMOTO", None)


_MAPPINGS = (signals.CODES[0][2], signals.CODES[16][2], None, signals.CODES[30][2], "DIG___LOCAL@REMOTO__4", "X")


@bank.add(
    f"""WITH c AS (SELECT p_partkey AS code, {signals._pick(_FUNCTIONS, "p_partkey")} AS states, {signals._pick(_MAPPINGS, "p_size")} AS mm FROM part),
    m AS (SELECT code, {signals.the_one(f"list_filter(list_transform(string_split(states, ';'), lambda w: {signals.state_sql('trim(upper(w))')}), lambda v: v IS NOT NULL)")} AS a, CASE WHEN mm IS NOT NULL THEN {signals.the_one(signals.MAPPED)} END AS b FROM c)
    SELECT code, a AS function_state, b AS mapping_state FROM m WHERE a <> b"""
)
def function_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose function and message mapping name different state classes."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("code"), signals.pick(_FUNCTIONS, "p_partkey").alias("states"), signals.pick(_MAPPINGS, "p_size").alias("mm"))
    return analytics.function_divergence(rows)


def state_of(spark: SparkSession) -> DataFrame:
    """The state class of each code: of its function, else of its message mapping."""
    cat = signals.catalogue(spark).withColumn("states", signals.pick(_FUNCTIONS, "ord"))
    return cat.select("code", x.candidate_state(F.col("states"), F.col("mm")).alias("state"))
