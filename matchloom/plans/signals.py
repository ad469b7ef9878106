"""Queries on signals of the linkage domain: filters, rules, the whole funnel.

Every order is a signal: its key chooses a subject, a state, a detail and the
electrical context, so that each filter and each rule meets texts that make it
fire and texts that don't. The catalogue is a fixed list of codes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.functions import tables as t
from matchloom.functions import text as x
from matchloom.operators import analytics, candidates, funnel, report, rules
from matchloom.operators.candidates import small
from matchloom.plans import ranking
from matchloom.plans.registry import Bank, table
from matchloom.session import staged

bank = Bank()

SUBJECTS = ("DISJUNTOR", "SECCIONADORA CARGA", "RELE SOBRECORRENTE", "TENSAO SECUNDARIO", "FALHA DISJUNTOR", "RELIGAMENTO", "SF6 BAIXA PRESSAO", "SF6", "PROTECAO 87", "CORRENTE FASE A", "SUBTENSAO BARRA", "COMANDO", "TAP MAXIMO", "RELE 67N1", "RELE 50 F1")
STATES = ("ABERTO", "FECHADO", "LIGAR", "DESLIGADO", "BLOQUEIO", "ATUADO", "INDEFINIDO", "LOCAL", "FECHADO ATUADO", "", "HABILITADO")
DETAILS = ("", "E1", "E2", "50 NEUTRO", "LINHA", "ALTA", "MIN", "SUBCORRENTE", "SEC BT", "27E1", "BREAKER FAILURE", "AT PRIMARIO", "43LR")
PHASES = (None, "A", "B", "C", "ABC", "AB", "N")
FAMILIES = (None, "Disjuntor", "Seccionadora", "Transformador")
DIRECTIONS = ("Input", "Output", "InputOutput", None)
SIDES = (None, "AT", "BT")

_POSITION, _EVENT, _ENABLED = "DIG___ABERTO@FECHADO__1", "DIG___ATUADO@FALHA__2", "DIG___HABILITADO@DESABILITADO__3"
#: code, description, message mapping, direction, category, phases
CODES = (
    ("50F1", "SOBRECORRENTE INSTANTANEA FASE E1", _EVENT, "Read", "Discrete", None),
    ("50N2", "SOBRECORRENTE INSTANTANEA NEUTRO E2", _EVENT, "Read", "Discrete", None),
    ("51N", "SOBRECORRENTE TEMPORIZADA NEUTRO", _EVENT, "Read", "Discrete", None),
    ("51A1", "SOBRECORRENTE TEMPORIZADA FASE A E1", _EVENT, "Read", "Discrete", None),
    ("67N", "SOBRECORRENTE DIRECIONAL NEUTRO", _EVENT, "Read", "Discrete", None),
    ("67N1", "SOBRECORRENTE DIRECIONAL NEUTRO E1", _EVENT, "Read", "Discrete", None),
    ("67N2", "SOBRECORRENTE DIRECIONAL NEUTRO E2", _EVENT, "Read", "Discrete", None),
    ("67A", "SOBRECORRENTE DIRECIONAL FASE A", None, "Read", "Discrete", None),
    ("27", "SUBTENSAO", _EVENT, "Read", "Discrete", None),
    ("27E1", "SUBTENSAO E1", _EVENT, "Read", "Discrete", None),
    ("59", "SOBRETENSAO", _EVENT, "Read", "Discrete", None),
    ("59_L", "SOBRETENSAO LINHA", _EVENT, "Read", "Discrete", None),
    ("37", "SUBCORRENTE", _EVENT, "Read", "Discrete", None),
    ("87AT", "DIFERENCIAL ALTA", _EVENT, "Read", "Discrete", None),
    ("87BT", "DIFERENCIAL BAIXA", _EVENT, "Read", "Discrete", None),
    ("21B", "DISTANCIA BARRA", _EVENT, "Read", "Discrete", None),
    ("DJF1", "DISJUNTOR POSICAO", _POSITION, "ReadWrite", "Discrete", None),
    ("DJA1", "DISJUNTOR POSICAO CONTATO NA", _POSITION, "ReadWrite", "Discrete", None),
    ("DJCMD", "DISJUNTOR COMANDO", _POSITION, "Write", "Discrete", None),
    ("SECC", "SECCIONADORA CARGA", _POSITION, "ReadWrite", "Discrete", None),
    ("SECB", "SECCIONADORA BYPASS", _POSITION, "ReadWrite", "Discrete", None),
    ("SEC_C", "SECCIONADORA COMANDO", _POSITION, "Write", "Discrete", None),
    ("SF6", "SF6 BAIXA PRESSAO", _EVENT, "Read", "Discrete", None),
    ("SF6B", "SF6 BLOQUEIO", _EVENT, "Read", "Discrete", None),
    ("SFAB", "SF6 ABERTURA BLOQUEADA", _EVENT, "Read", "Discrete", None),
    ("86", "RELE BLOQUEIO", _EVENT, "Read", "Discrete", None),
    ("86BF", "BLOQUEIO FALHA DISJUNTOR", _EVENT, "Read", "Discrete", None),
    ("BFAT", "FALHA DISJUNTOR BLOQUEIO ALTA", _EVENT, "Read", "Discrete", None),
    ("62BF", "FALHA DISJUNTOR TEMPORIZADO", _EVENT, "Read", "Discrete", None),
    ("50BF", "FALHA DISJUNTOR", _EVENT, "Read", "Discrete", None),
    ("79", "RELIGAMENTO", _ENABLED, "Read", "Discrete", None),
    ("79OK", "RELIGAMENTO SUCESSO", _EVENT, "Read", "Discrete", None),
    ("43LR", "CHAVE LOCAL REMOTO", "DIG___LOCAL@REMOTO__4", "Read", "Discrete", None),
    ("MAXT", "TAP MAXIMO", _EVENT, "Read", "Discrete", None),
    ("MINT", "TAP MINIMO", _EVENT, "Read", "Discrete", None),
    ("IA", "CORRENTE FASE A", None, "Read", "Analog", "L1"),
    ("IN", "CORRENTE NEUTRO", None, "Read", "Analog", "N"),
    ("VAB", "TENSAO FASES AB", None, "Read", "Analog", "L1 L2"),
    ("VABC", "TENSAO", None, "Read", "Analog", "L1 L2 L3"),
    ("TAPP", "TAP POSICAO", None, "Read", "Analog", None),
)
PER_SIGNAL = 8


def pick(values: tuple[str | None, ...], index: str) -> Column:
    return F.element_at(F.array(*(F.lit(v).cast("string") for v in values)), (F.expr(index) % len(values)).cast("int") + 1)


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, text, tokens, phase, family, direction, side, inferred) of every order."""
    k = "o_orderkey"
    said = F.array_join(F.filter(F.array(pick(SUBJECTS, k), pick(STATES, f"{k} div 2"), pick(DETAILS, f"{k} div 5")), lambda s: s != ""), " ")
    rows = table(spark, sf_dir, "orders").select(
        F.col(k).alias("id"), said.alias("text"), pick(PHASES, f"{k} div 3").alias("phase"), pick(FAMILIES, f"{k} div 7").alias("family"),
        pick(DIRECTIONS, f"{k} div 11").alias("direction"), pick(SIDES, f"{k} div 13").alias("side"), (F.col(k) % 3 == 0).alias("inferred"),
    )
    return rows.withColumn("tokens", x.tokens(F.col("text")))


def catalogue(spark: SparkSession) -> DataFrame:
    """(ord, code, description, mm, code_direction, category, phases, code_tokens, code_family, code_state) of the fixed list."""
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(CODES)], "ord long, code string, description string, mm string, code_direction string, category string, phases string")
    return rows.select("*", x.tokens(F.col("description")).alias("code_tokens"), x.leading_number(F.col("code")).alias("code_family"), x.mapping_state(F.col("mm")).alias("code_state"))


def offered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every signal with ``PER_SIGNAL`` codes of the catalogue and a score for each."""
    step = len(CODES) // PER_SIGNAL
    # dealt by id before the rules cost time: their windows need it, and one small file would be one task
    each = signals(spark, sf_dir).repartition("id").withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(PER_SIGNAL - 1))))
    each = each.withColumn("ord", (F.col("id") * 7 + F.col("j") * step) % len(CODES)).withColumn("score", F.round((F.col("id") * 13 + F.col("j") * 29) % 97 / 97.0, 6))
    return each.drop("j").join(small(catalogue(spark)), "ord")


# --- the same in SQL --------------------------------------------------------------------------------------


def _list(values: tuple[str | None, ...]) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"


def _in(values: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _pick(values: tuple[str | None, ...], index: str) -> str:
    return f"({_list(values)})[CAST(({index}) % {len(values)} AS INTEGER) + 1]"


def _has(words: tuple[str, ...], every: bool = False) -> str:
    return f"list_has_{'all' if every else 'any'}(tokens, {_list(words)})"


def _marked(marks: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(c, '{m}')" for m in marks) + ")"


def state_sql(word: str) -> str:
    """The class of a token that names a state."""
    exact = " ".join(f"WHEN {word} = '{w}' THEN '{name}'" for w, name in t.STATE_TOKENS.items())
    return f"CASE {exact} {' '.join(f"WHEN starts_with({word}, '{p}') THEN '{name}'" for p, name, _ in t.STATES)} END"


def the_one(values: str) -> str:
    return f"CASE WHEN len(list_distinct({values})) = 1 THEN list_distinct({values})[1] END"


LEAD = r"nullif(regexp_extract(c, '^(\d{2})\d*', 1), '')"
_BASE = "CASE WHEN length(c) > 1 AND regexp_matches(c, '[1-4]$') THEN left(c, length(c) - 1) ELSE c END"
CODE_PHASE = f"CASE WHEN ends_with({_BASE}, 'N') THEN 'N' {' '.join(f"WHEN ends_with({_BASE}, '{p}') THEN '{p}'" for p in ('ABC', 'AB', 'BC', 'CA', 'F'))} WHEN regexp_matches({_BASE}, '[ABC]$') THEN right({_BASE}, 1) END"
NUMBERS = rf"list_filter(list_transform(tokens, lambda w: regexp_extract(w, '^(\d{{2}})\d*', 1)), lambda n: n IN {_in(t.PROTECTION_NUMBERS)})"
STAGE = f"right(list_sort(list_filter(tokens, lambda w: w IN {_in(t.STAGES)}))[1], 1)"
SIDE = f"CASE {' '.join(f"WHEN list_contains(tokens, '{w}') THEN '{s}'" for w, s in t.SIDE_WORDS.items())} END"
CODE_EQUIPMENT = "CASE WHEN starts_with(c, 'DJ') THEN 'Disjuntor' WHEN starts_with(c, 'SEC') THEN 'Seccionadora' END"
TEXT_STATE = f"CASE WHEN list_contains(list_transform(tokens, lambda w: {state_sql('w')}), 'INDEFINIDO') THEN 'INDEFINIDO' ELSE {the_one(f'list_filter(list_transform(tokens, lambda w: {state_sql("w")}), lambda s: s IS NOT NULL)')} END"
MAPPED = f"list_filter(list_transform(string_split(string_split(string_split(mm, '___')[2], '__')[1], '@'), lambda w: {state_sql('trim(upper(w))')}), lambda s: s IS NOT NULL)"

SIGNALS = f"""
sig0 AS (SELECT o_orderkey AS id, array_to_string(list_filter([{_pick(SUBJECTS, "o_orderkey")}, {_pick(STATES, "o_orderkey // 2")}, {_pick(DETAILS, "o_orderkey // 5")}], lambda s: s <> ''), ' ') AS text,
  {_pick(PHASES, "o_orderkey // 3")} AS phase, {_pick(FAMILIES, "o_orderkey // 7")} AS family, {_pick(DIRECTIONS, "o_orderkey // 11")} AS direction, {_pick(SIDES, "o_orderkey // 13")} AS side, o_orderkey % 3 = 0 AS inferred FROM orders),
sig AS (SELECT *, list_filter(string_split(text, ' '), lambda w: w <> '') AS tokens FROM sig0),
cat0(ord, code, description, mm, code_direction, category, phases) AS (VALUES {", ".join("(" + ", ".join([str(i), *("NULL" if v is None else f"'{v}'" for v in c)]) + ")" for i, c in enumerate(CODES))}),
cat AS (SELECT *, string_split(description, ' ') AS code_tokens, {LEAD.replace("(c,", "(code,")} AS code_family, CASE WHEN mm IS NOT NULL THEN {the_one(MAPPED)} END AS code_state FROM cat0)"""

OFFERED = f"""{SIGNALS},
off AS (SELECT s.*, cat.* EXCLUDE (ord), cat.ord, upper(cat.code) AS c, round((s.id * 13 + j * 29) % 97 / 97.0, 6) AS score FROM sig s, range({PER_SIGNAL}) r(j) JOIN cat ON cat.ord = (s.id * 7 + j * {len(CODES) // PER_SIGNAL}) % {len(CODES)})"""


def _opposed() -> list[str]:
    return [f"(({_has(a)} AND NOT {_has(b)} AND {_marked(mb)}) OR ({_has(b)} AND NOT {_has(a)} AND {_marked(ma)}))" for _, a, b, ma, mb in t.OPPOSITES]


_LOCK = _has(("BLOQUEIO", "BLOQUEADO"))
KEEPS = {
    "number": f"(len({NUMBERS}) = 0 OR {LEAD} IS NULL OR coalesce(list_contains({NUMBERS}, {LEAD}), false))",
    "opposites": f"NOT ({' OR '.join(_opposed())})",
    "phase": f"coalesce(phase = ({CODE_PHASE}), true)",
    "stage": rf"({STAGE} IS NULL OR CASE WHEN regexp_matches(code, '\d$') THEN right(code, 1) = {STAGE} ELSE NOT list_contains(list(CASE WHEN regexp_matches(code, '\d$') THEN right(code, 1) END) OVER (PARTITION BY id), {STAGE}) END)",
    "command": f"({_has(t.COMMAND_TOKENS)} = {_marked(t.STRICT_COMMAND_MARKS)})",
    "equipment": f"coalesce(({CODE_EQUIPMENT}) = CASE WHEN {_has(('DISJUNTOR', 'DJ'))} THEN 'Disjuntor' WHEN {_has(('SECCIONADORA', 'SEC'))} THEN 'Seccionadora' END, true)",
    "side": f"NOT coalesce(CASE {SIDE} WHEN 'AT' THEN {_marked(t.SIDE_MARKS['BT'])} WHEN 'BT' THEN {_marked(t.SIDE_MARKS['AT'])} END, false)",
    "position": f"(c NOT IN {_in(t.POSITION_CODES)} OR list_contains(tokens, 'NA') OR len(list_filter(tokens, lambda w: {' OR '.join(f"starts_with(w, '{p}')" for p in t.ON_PREFIXES + t.OFF_PREFIXES)})) > 0)",
    "sf6": f"(NOT {_has(('SF6',))} OR NOT ((c IN {_in(t.SF6_LOCK)} AND {_has(('BAIXA', 'PRESSAO'), True)} AND NOT {_LOCK}) OR (c = 'SF6' AND {_LOCK})))",
    "reclose": f"(NOT {_has(('RELIGAMENTO',))} OR c NOT IN {_in(t.GENERAL_LOCK)})",
    "breaker_failure": f"(NOT (({_has(('FALHA', 'DISJUNTOR'), True)} OR {_has(('BREAKER', 'FAILURE'), True)}) AND NOT {_has(('BLOQUEIO',))}) OR c NOT IN {_in(t.BREAKER_FAIL_LOCK)})",
}

_W = t.RULE_WEIGHTS
_SIDE = f"coalesce({SIDE}, side)"
_LETTERS = "list_sort(list_distinct(list_transform(string_split(upper(phases), ' '), lambda p: CASE p WHEN 'L1' THEN 'A' WHEN 'L2' THEN 'B' WHEN 'L3' THEN 'C' ELSE p END)))"


def _signed(good: str, weight: float, when: str) -> str:
    return f"CASE WHEN {when} THEN CASE WHEN {good} THEN {weight} ELSE -{weight} END ELSE 0.0 END"


DELTAS = {
    "number": _signed(f"list_contains({NUMBERS}, {LEAD})", _W["number"], f"len({NUMBERS}) > 0 AND {LEAD} IS NOT NULL"),
    "opposites": f"CASE WHEN {' OR '.join(_opposed())} THEN -{_W['opposites']} ELSE 0.0 END",
    "phase": _signed(f"(({CODE_PHASE}) = 'F' AND phase IN ('ABC', 'AB', 'BC', 'CA')) OR ({CODE_PHASE}) = phase", _W["phase"], f"phase IS NOT NULL AND ({CODE_PHASE}) IS NOT NULL"),
    "stage": f"CASE WHEN coalesce(ends_with(code, {STAGE}), false) THEN {_W['stage']} ELSE 0.0 END",
    "command": _signed(_marked(t.COMMAND_MARKS), _W["command"], _has(t.COMMAND_TOKENS)),
    "equipment": f"CASE WHEN coalesce(({CODE_EQUIPMENT}) <> family, false) THEN -{_W['equipment']} ELSE 0.0 END",
    "side": f"CASE {_SIDE} WHEN 'AT' THEN CASE WHEN {_marked(t.SIDE_MARKS['AT'])} THEN {_W['side']} WHEN {_marked(t.SIDE_MARKS['BT'])} THEN -{_W['side']} ELSE 0.0 END WHEN 'BT' THEN CASE WHEN {_marked(t.SIDE_MARKS['BT'])} THEN {_W['side']} WHEN {_marked(t.SIDE_MARKS['AT'])} THEN -{_W['side']} ELSE 0.0 END ELSE 0.0 END",
    "state": _signed(f"({TEXT_STATE}) = code_state", _W["state"], f"({TEXT_STATE}) <> 'INDEFINIDO' AND code_state IS NOT NULL"),
    "direction": _signed("code_direction IN ('ReadWrite', 'Write')", _W["direction"], "direction IN ('Output', 'InputOutput') AND code_direction IS NOT NULL"),
    "catalogue_phase": _signed(f"array_to_string({_LETTERS}, '') = 'ABC' OR len(list_filter(string_split(phase, ''), lambda p: NOT list_contains({_LETTERS}, p))) = 0", _W["phase"], "category = 'Analog' AND phases IS NOT NULL AND phase IS NOT NULL"),
}


# --- queries ----------------------------------------------------------------------------------------------


@bank.add(
    f"""WITH {OFFERED}, k AS (SELECT id, code, {", ".join(f"{sql} AS {name}" for name, sql in KEEPS.items())} FROM off)
    SELECT *, ({" AND ".join(KEEPS)}) OR NOT bool_or({" AND ".join(KEEPS)}) OVER (PARTITION BY id) AS kept FROM k"""
)
def hard_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each filter says of every candidate (true: keep), and what stays in the end."""
    rows = offered(spark, sf_dir)
    judged = rows.select("id", "code", *(f().alias(name) for name, f in rules.FILTERS.items()))
    kept = rules.filtered(rows).select("id", "code", F.lit(True).alias("kept"))
    return judged.join(kept, ["id", "code"], "left").withColumn("kept", F.coalesce("kept", F.lit(False)))


@bank.add(
    f"""WITH {OFFERED}, d AS (SELECT id, code, ord, score, {", ".join(f"{sql} AS {name}" for name, sql in DELTAS.items())} FROM off),
    n AS (SELECT *, {" + ".join(DELTAS)} AS delta FROM d)
    SELECT id, code, {", ".join(f"round({name}, 6) AS {name}" for name in DELTAS)}, round(delta, 6) AS delta, round(score + delta, 6) AS score,
      array_to_string(list_filter([{", ".join(f"CASE WHEN {name} <> 0 THEN '{name}' END" for name in DELTAS)}], lambda r: r IS NOT NULL), ',') AS rules,
      row_number() OVER (PARTITION BY id ORDER BY round(score + delta, 9) DESC, ord, code) AS rank FROM n"""
)
def rule_adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The delta of each rule for every candidate, and the new order."""
    found = rules.adjusted(offered(spark, sf_dir), each=True)
    each = [F.round(F.col(f"d_{name}").cast("double"), 6).alias(name) for name in rules.adjustments()]
    return found.select("id", "code", *each, F.round("delta", 6).alias("delta"), F.round("score", 6).alias("score"), F.array_join("rules", ",").alias("rules"), F.col("rank").cast("long").alias("rank"))


@bank.add(
    f"""WITH {OFFERED}, k AS (SELECT id, code, coalesce(code_state = s OR s = 'INDEFINIDO' OR code_state = 'INDEFINIDO', true) AS fits FROM (SELECT *, ({TEXT_STATE}) AS s FROM off))
    SELECT id, code, NOT bool_or(fits) OVER (PARTITION BY id) AS lost FROM k QUALIFY fits OR NOT bool_or(fits) OVER (PARTITION BY id)"""
)
def state_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates whose state class fits the text's; signals that lose all are marked."""
    return rules.of_state(offered(spark, sf_dir)).select("id", "code", "lost")


WHITELIST = {"Disjuntor": ("DJF1", "DJA1", "DJCMD", "SF6", "SF6B", "50BF"), "Seccionadora": ("SECC", "SECB", "SEC_C")}


@bank.add(
    f"""WITH {OFFERED}, k AS (SELECT id, code, CASE {" ".join(f"WHEN family = '{f}' AND NOT inferred THEN code IN {_in(codes)}" for f, codes in WHITELIST.items())} ELSE true END AS ok FROM off)
    SELECT id, code, NOT bool_or(ok) OVER (PARTITION BY id) AS outside FROM k QUALIFY ok OR NOT bool_or(ok) OVER (PARTITION BY id)"""
)
def equipment_whitelist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that the whitelist of a signal's own equipment allows; signals that lose all are marked."""
    return rules.in_whitelist(offered(spark, sf_dir), WHITELIST).select("id", "code", "outside")


# --- the funnel -------------------------------------------------------------------------------------------

SETTINGS = funnel.Settings(whitelist=WHITELIST)


def scored(rows: DataFrame, cat: DataFrame) -> DataFrame:
    """Both methods' candidates of signals."""
    asked, known = rows.select("id", F.col("tokens").alias("terms")), cat.select("ord", "code", F.col("code_tokens").alias("terms"))
    return candidates.bm25(asked, known).withColumn("method", F.lit("lexical")).unionByName(candidates.tfidf(asked, known).withColumn("method", F.lit("vector")))


_ALL = " AND ".join(f"({sql})" for sql in KEEPS.values())
_FITS = f"coalesce(code_state = ({TEXT_STATE}) OR ({TEXT_STATE}) = 'INDEFINIDO' OR code_state = 'INDEFINIDO', true)"
_ALLOWED = f"CASE {' '.join(f"WHEN family = '{f}' AND NOT inferred THEN code IN {_in(codes)}" for f, codes in WHITELIST.items())} ELSE true END"


def funnel_sql(category: str | None = None) -> str:
    """CTEs up to ``decided``: the decisions of the funnel, of the codes of one category if it is named."""
    some = f" WHERE category = '{category}'" if category else ""
    return f"""{SIGNALS.replace("cat AS (", "cat_all AS (")},
cat AS (SELECT * FROM cat_all{some}),
c AS (SELECT ord, code, code_tokens AS terms FROM cat), s AS (SELECT id, tokens AS terms FROM sig),
{ranking.LEXICAL}, {ranking.TFIDF}, {ranking.FUSION},
spelt AS (SELECT id, unnest(tokens) AS code, true AS exact, unnest(range(1, len(tokens) + 1)) AS pos FROM sig UNION ALL SELECT id, tokens[i] || tokens[i + 1], false, i FROM (SELECT id, tokens, unnest(range(1, len(tokens))) AS i FROM sig)),
an AS (SELECT id, code, code_family AS f, bool_or(exact) AS exact, min(pos) AS pos FROM spelt JOIN cat USING (code) WHERE length(code) >= 3 AND regexp_matches(code, '[0-9]') AND regexp_matches(code, '[A-Za-z]') GROUP BY ALL),
h1 AS (SELECT id, code, greatest(pl.score, CASE WHEN an.code IS NOT NULL THEN 0.85 END) AS score FROM (SELECT id, code, score FROM pl) pl FULL JOIN an USING (id, code)),
best AS (SELECT id, code_family AS f, max(score) AS best FROM h1 JOIN cat USING (code) WHERE code_family IS NOT NULL GROUP BY ALL),
h2 AS (SELECT id, code, score FROM h1 UNION ALL SELECT id, code, best * 0.9 FROM best JOIN cat ON cat.code_family = best.f WHERE NOT EXISTS (SELECT 1 FROM h1 WHERE h1.id = best.id AND h1.code = cat.code)),
roots AS (SELECT id, f, list(code) AS roots FROM an WHERE f IS NOT NULL GROUP BY ALL),
h3 AS (SELECT id, code, score FROM (SELECT h2.*, roots IS NULL OR len(list_filter(roots, lambda r: starts_with(h2.code, r))) > 0 AS ok FROM h2 JOIN cat USING (code) LEFT JOIN roots ON roots.id = h2.id AND roots.f = cat.code_family) QUALIFY ok OR NOT bool_or(ok) OVER (PARTITION BY id)),
d0 AS (SELECT s.*, cat.*, upper(cat.code) AS c, h3.score FROM h3 JOIN cat USING (code) JOIN sig s USING (id)),
d1 AS (SELECT * FROM (SELECT *, {_ALL} AS ok FROM d0) QUALIFY ok OR NOT bool_or(ok) OVER (PARTITION BY id)),
d2 AS (SELECT * FROM (SELECT *, len(list_intersect(tokens, code_tokens)) AS shared FROM d1) QUALIFY code_family IS NULL OR count(*) OVER (PARTITION BY id, code_family) < 2 OR max(shared) OVER (PARTITION BY id, code_family) = 0 OR shared = max(shared) OVER (PARTITION BY id, code_family)),
d3 AS (SELECT *, NOT bool_or(fits) OVER (PARTITION BY id) AS lost FROM (SELECT *, {_FITS} AS fits FROM d2) QUALIFY fits OR NOT bool_or(fits) OVER (PARTITION BY id)),
top3 AS (SELECT DISTINCT id, code_family AS f FROM d3 WHERE NOT lost QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, code) <= 3),
back AS (SELECT id, f, arg_min(code, pos * 1000 + o) AS code FROM (SELECT an.*, row_number() OVER (ORDER BY code) AS o FROM an) an WHERE exact AND regexp_matches(f, '^[0-9][0-9]$') AND code NOT IN {_in(funnel.REDIRECTED)}
  AND NOT EXISTS (SELECT 1 FROM top3 WHERE top3.id = an.id AND top3.f = an.f) AND NOT EXISTS (SELECT 1 FROM d3 WHERE d3.id = an.id AND d3.code = an.code AND NOT lost) AND id NOT IN (SELECT id FROM d3 WHERE lost) GROUP BY ALL),
e0 AS (SELECT id, code, score FROM d3 WHERE NOT lost UNION ALL SELECT id, code, 0.85 FROM back),
e1 AS (SELECT s.*, cat.*, upper(cat.code) AS c, e0.score FROM e0 JOIN cat USING (code) JOIN sig s USING (id)),
e2 AS (SELECT *, NOT bool_or(ok) OVER (PARTITION BY id) AS outside FROM (SELECT *, {_ALLOWED} AS ok FROM e1) QUALIFY ok OR NOT bool_or(ok) OVER (PARTITION BY id)),
e3 AS (SELECT *, {" + ".join(DELTAS.values())} AS delta, list_filter([{", ".join(f"CASE WHEN {sql} <> 0 THEN '{name}' END" for name, sql in DELTAS.items())}], lambda r: r IS NOT NULL) AS rules FROM e2 WHERE NOT outside),
e4 AS (SELECT *, round(score + delta, 9) AS moved FROM e3),
ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY moved DESC, ord, code) AS k FROM e4),
fired AS (SELECT id, array_to_string(list_sort(list(DISTINCT r)), ',') AS rules FROM (SELECT id, unnest(rules) AS r FROM e4) GROUP BY id),
two AS (SELECT id, max(CASE WHEN k = 1 THEN code END) AS a, max(CASE WHEN k = 2 THEN code END) AS b, max(CASE WHEN k = 1 THEN moved END) AS sa, max(CASE WHEN k = 2 THEN moved END) AS sb, max(CASE WHEN k = 1 THEN delta END) AS da, max(CASE WHEN k = 2 THEN delta END) AS db FROM ranked WHERE k <= 2 GROUP BY id),
led AS (SELECT *, sa - coalesce(sb, 0) AS gap FROM two),
said AS (SELECT code, description FROM cat),
j0 AS (SELECT sig.id, sig.phase, sig.tokens, sig.text, led.*  EXCLUDE (id), x.description = y.description AS same, CASE WHEN sig.id IN (SELECT id FROM d3 WHERE lost) THEN 'no_candidate_of_state' WHEN sig.id IN (SELECT id FROM e2 WHERE outside) THEN 'outside_whitelist' WHEN a IS NULL THEN 'no_candidate' WHEN sa - da < 0.2 THEN 'low_score' WHEN sa >= 0.45 AND gap >= 0.08 THEN 'decided' WHEN sa >= 0.45 THEN 'several_codes' ELSE 'low_score' END AS r0
  FROM sig LEFT JOIN led USING (id) LEFT JOIN said x ON x.code = a LEFT JOIN said y ON y.code = b),
j1 AS (SELECT *, CASE WHEN r0 = 'decided' THEN a WHEN r0 = 'several_codes' THEN CASE WHEN same AND gap <= 0.005 THEN least(a, b) WHEN da > 0 AND coalesce(db, 0) <= 0 AND gap < 0.08 THEN a END END AS code0,
  CASE WHEN r0 = 'decided' THEN 'quadrant' WHEN r0 = 'several_codes' THEN CASE WHEN same AND gap <= 0.005 THEN 'same_description' WHEN da > 0 AND coalesce(db, 0) <= 0 AND gap < 0.08 THEN 'rule_rescue' END END AS stage0 FROM j0),
tk AS (SELECT DISTINCT code_family AS f, code, unnest(code_tokens) AS tk FROM cat WHERE code_family IS NOT NULL),
own AS (SELECT f, tk, min(code) AS sib FROM tk WHERE code <> f AND NOT EXISTS (SELECT 1 FROM tk r WHERE r.code = r.f AND r.f = tk.f AND r.tk = tk.tk) GROUP BY f, tk HAVING count(DISTINCT code) = 1),
sb AS (SELECT id, count(DISTINCT sib) AS n, min(sib) AS sib FROM (SELECT DISTINCT id, code0 AS f, unnest(tokens) AS tk FROM j1 WHERE code0 IS NOT NULL) JOIN own USING (f, tk) GROUP BY id),
j2 AS (SELECT j1.*, coalesce(n > 1, false) AS unclear, CASE WHEN n = 1 THEN sib ELSE code0 END AS code1 FROM j1 LEFT JOIN sb USING (id)),
decided AS (SELECT id, text, tokens, CASE WHEN NOT unclear THEN code1 END AS code, sa AS score, gap, CASE WHEN unclear THEN 'ambiguous_qualifier' WHEN stage0 IS NOT NULL THEN 'decided' ELSE r0 END AS reason, CASE WHEN NOT unclear AND code1 <> code0 THEN 'sibling' ELSE stage0 END AS stage,
  CASE WHEN stage0 IS NOT NULL AND NOT unclear THEN coalesce(phase, (SELECT CASE WHEN p = 'F' THEN 'ABC' ELSE p END FROM (SELECT {CODE_PHASE.replace("(c,", "(code0,").replace("(c)", "(code0)").replace("ELSE c END", "ELSE code0 END")} AS p))) ELSE phase END AS phase, coalesce(fired.rules, '') AS rules FROM j2 LEFT JOIN fired USING (id))"""


_OUT = "id, code, round(score, 6) AS score, round(gap, 6) AS gap, CASE WHEN reason = 'decided' THEN 'decided' ELSE 'review' END AS status, reason, stage, phase, rules"


def _rounded(decisions: DataFrame) -> DataFrame:
    return decisions.withColumn("score", F.round("score", 6)).withColumn("gap", F.round("gap", 6))


@bank.add(f"WITH {funnel_sql()} SELECT {_OUT} FROM decided")
def full_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every signal through the whole funnel."""
    rows, cat = signals(spark, sf_dir), catalogue(spark)
    return _rounded(funnel.by_kind(rows, lambda each: funnel.decide(each, cat, scored(each, cat), SETTINGS)[0]))


_VARIANT = f"""
fam AS (SELECT id, count(DISTINCT coalesce(f, code)) > 1 AS several FROM an GROUP BY id),
due AS (SELECT d.*, several FROM decided d JOIN fam USING (id) WHERE reason NOT IN ('decided', {", ".join(f"'{r}'" for r in funnel.FINAL)})),
ex AS (SELECT due.id, an.code AS anchor, coalesce(f, an.code) AS af FROM due JOIN an ON an.id = due.id AND an.exact WHERE NOT several),
kin AS (SELECT ex.id, cat.code, code_state IS NOT NULL AND code_state = st AND st <> 'INDEFINIDO' AS fit, right(cat.code, 1) = sg AND regexp_matches(cat.code, '[0-9]$') AS at_stage
  FROM (SELECT DISTINCT id, af FROM ex) ex JOIN (SELECT id, ({TEXT_STATE}) AS st, {STAGE} AS sg FROM sig) USING (id) JOIN cat ON cat.code_family = ex.af),
kc AS (SELECT id, count(*) AS n_kin, count(*) FILTER (fit) AS nf, count(*) FILTER (fit AND at_stage) AS ns, min(code) FILTER (fit) AS cf, min(code) FILTER (fit AND at_stage) AS cs FROM kin GROUP BY id),
kd AS (SELECT id, n_kin, CASE WHEN nf > 1 AND ns > 0 THEN ns ELSE nf END AS n, CASE WHEN nf > 1 AND ns > 0 THEN cs ELSE cf END AS one FROM kc),
near AS (SELECT r.id, bool_and(coalesce(r.code_family, r.code) IN (SELECT af FROM ex WHERE ex.id = r.id)) AS all_in, arg_min(r.code, r.k) FILTER (r.code IN (SELECT anchor FROM ex WHERE ex.id = r.id)) AS anchor FROM ranked r WHERE r.k <= 3 AND r.id IN (SELECT id FROM ex) GROUP BY r.id),
var AS (SELECT e.id, CASE WHEN n = 1 THEN one WHEN n > 1 AND n < n_kin THEN NULL WHEN all_in THEN anchor END AS code, CASE WHEN n = 1 THEN 'variant_state' ELSE 'variant_anchor' END AS how FROM (SELECT DISTINCT id FROM ex) e LEFT JOIN kd USING (id) LEFT JOIN near USING (id)),
routed AS (SELECT d.id, coalesce(v.code, d.code) AS code, score, gap, CASE WHEN v.code IS NOT NULL THEN 'decided' WHEN reason = 'decided' OR reason IN ({", ".join(f"'{r}'" for r in funnel.FINAL)}) THEN reason WHEN several THEN 'several_anchors' WHEN several IS NOT NULL THEN 'ambiguous_variant' ELSE 'low_score' END AS reason,
  CASE WHEN v.code IS NOT NULL THEN how ELSE stage END AS stage, phase, rules FROM decided d LEFT JOIN fam USING (id) LEFT JOIN var v ON v.id = d.id)"""


@bank.add(f"WITH {funnel_sql()}, {_VARIANT} SELECT {_OUT} FROM routed")
def single_router(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every signal through the funnel and, from review, through the anchored variants."""
    rows, cat = signals(spark, sf_dir), catalogue(spark)
    return _rounded(funnel.by_kind(rows, lambda each: funnel.single(each, cat, scored(each, cat), SETTINGS)[0]))


@bank.add(
    f"""WITH {funnel_sql()} SELECT id, array_to_string(list_filter(tokens, lambda w: w <> ''), ' ') AS text, rules, round(coalesce(gap, 0), 6) AS gap, 0.08 AS wanted_gap, coalesce(stage, '') AS stage FROM decided"""
)
def funnel_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why each signal was decided as it was; the normalised text is tested by ``normal_forms``."""
    rows, cat = signals(spark, sf_dir), catalogue(spark)

    def told(each: DataFrame) -> DataFrame:
        found = funnel.diagnostics(each, funnel.decide(each, cat, scored(each, cat), SETTINGS)[0], SETTINGS)
        return found.join(each.select("id", "text"), "id").select("id", "text", "rules", F.round("gap", 6).alias("gap"), "wanted_gap", "stage")

    return funnel.by_kind(rows, told)


@bank.add(
    f"""WITH {funnel_sql()}, w AS (SELECT *, ({_list(tuple(c[0] for c in CODES))})[CAST(id % {len(CODES)} AS INTEGER) + 1] AS wanted FROM decided),
    h AS (SELECT w.id, w.reason = 'decided' AS decided, coalesce(bool_or(k = 1 AND ranked.code = wanted), false) AS one, coalesce(bool_or(k <= 3 AND ranked.code = wanted), false) AS three FROM w LEFT JOIN ranked USING (id) GROUP BY ALL)
    SELECT round(avg(CASE WHEN one THEN 1.0 ELSE 0 END), 6) AS acc_1, round(avg(CASE WHEN three THEN 1.0 ELSE 0 END), 6) AS recall_3, round(avg(CASE WHEN decided THEN 1.0 ELSE 0 END), 6) AS decided, round(avg(CASE WHEN decided THEN CASE WHEN one THEN 1.0 ELSE 0 END END), 6) AS precision FROM h"""
)
def funnel_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy after the whole funnel, against a code that the key chooses."""
    rows, cat = signals(spark, sf_dir), catalogue(spark)
    each, members = funnel.kinds(rows)
    decisions, offered_codes = funnel.decide(each, cat, scored(each, cat), SETTINGS)
    asked = members.groupBy("kind", pick(tuple(c[0] for c in CODES), "id").alias("code")).agg(F.count("*").alias("n")).withColumnRenamed("kind", "id")
    wanted = asked.join(decisions.select("id", (F.col("status") == "decided").alias("decided")), "id")
    found = analytics.accuracy(offered_codes.where("not lost and not outside"), wanted)
    return found.select(*(F.round(c, 6).alias(c) for c in found.columns))


CATEGORIES = ("Discrete", "Analog", "DiscreteAnalog")


@bank.add(
    f"""WITH a AS (WITH {funnel_sql("Discrete")} SELECT id, code, reason = 'decided' AS ok, coalesce(gap, 0) AS gap FROM decided), b AS (WITH {funnel_sql("Analog")} SELECT id, code, reason = 'decided' AS ok, coalesce(gap, 0) AS gap FROM decided),
    k AS (SELECT a.id, {_pick(CATEGORIES, "a.id")} AS category, a.code AS ca, b.code AS cb, a.ok AS oa, b.ok AS ob, a.gap AS ga, b.gap AS gb FROM a JOIN b USING (id)),
    l AS (SELECT *, oa AND category <> 'Analog' AS la, ob AND category <> 'Discrete' AS lb, (oa AND category = 'Analog') OR (ob AND category = 'Discrete') AS forbidden FROM k),
    w AS (SELECT *, CASE WHEN la AND lb THEN CASE WHEN abs(ga - gb) > 0.03 THEN CASE WHEN ga > gb THEN 'a' ELSE 'b' END WHEN id % 2 = 0 THEN 'a' END WHEN la AND NOT forbidden THEN 'a' WHEN lb AND NOT forbidden THEN 'b' END AS bundle FROM l)
    SELECT id, CASE bundle WHEN 'a' THEN ca WHEN 'b' THEN cb END AS code, bundle, CASE WHEN bundle IS NOT NULL THEN 'decided' WHEN (la AND lb) OR ((la OR lb) AND forbidden) THEN 'category_ambiguous' WHEN forbidden THEN 'category_conflict' ELSE 'low_score' END AS reason FROM w"""
)
def dual_router(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals of an untrusted category through both bundles."""
    rows, cat = signals(spark, sf_dir), catalogue(spark)
    bundles = {}
    for name, category in (("a", "Discrete"), ("b", "Analog")):
        own = cat.where(F.col("category") == category)
        bundles[name] = (own, scored)
    affinity = rows.select("id", (F.col("id") % 2 == 0).cast("int").alias("a"), F.lit(0).alias("b"))
    tied = affinity.withColumn("a", F.when(F.col("a") == 1, 1.0).otherwise(0.0)).withColumn("b", F.lit(0.0))
    return funnel.dual(rows.withColumn("category", pick(CATEGORIES, "id")), bundles, tied, SETTINGS)


def _polarity_sql(word: str) -> str:
    return f"CASE {' '.join(f"WHEN starts_with({word}, '{p}') THEN " + (f"'{polarity}'" if polarity else "NULL") for p, _, polarity in t.STATES)} END"


_SEMANTIC = f"concat_ws('/', {TEXT_STATE}, CASE WHEN ({TEXT_STATE}) = 'POSICAO' THEN {the_one(f'list_filter(list_transform(tokens, lambda w: {_polarity_sql("w")}), lambda s: s IS NOT NULL)')} END)"
_THREE = "coalesce(format('{{:.3f}}', round({0}, 3)), '')"


def _audit_sql() -> str:
    at = lambda k, c: f"coalesce(max(CASE WHEN aq.k = {k} THEN aq.{c} END), '')"
    score = lambda k, c: f"coalesce(max(CASE WHEN aq.k = {k} THEN {_THREE.format(f'aq.{c}')} END), '')"
    columns = ", ".join(f"{at(k, 'code')} AS c{k}, {score(k, 'bm')} AS t{k}, {score(k, 'ti')} AS v{k}" for k in (1, 2, 3))
    shown = ", ".join(f"coalesce(c{k}, '') AS \"Candidato {k}\", coalesce(t{k}, '') AS \"Score tfidf {k}\", coalesce(v{k}, '') AS \"Score vetorial {k}\", '' AS \"Score fuzzy {k}\"" for k in (1, 2, 3))
    return f"""WITH {funnel_sql()},
    aq AS (SELECT r.id, r.k, r.code, r.moved, bm.score AS bm, ti.score AS ti FROM ranked r LEFT JOIN bm ON bm.id = r.id AND bm.code = r.code LEFT JOIN ti ON ti.id = r.id AND ti.code = r.code WHERE r.k <= 3),
    aw AS (SELECT id, {columns}, max(CASE WHEN aq.k = 1 THEN moved END) AS top FROM aq GROUP BY id)
    SELECT d.id, 'S' || (d.id % 7) || ':' || d.id AS "ID Sinal", CASE WHEN d.code IS NOT NULL AND regexp_matches(s.text, '^[A-Z0-9_/-]+$') THEN d.code ELSE s.text END AS "Descrição Bruta", 'Discrete' || coalesce('/' || s.direction, '') AS "Tipo", CAST(d.id * 2 AS VARCHAR) AS "Endereço", CASE WHEN reason = 'decided' THEN 'decided' ELSE 'review' END AS "Status",
      coalesce(d.code, '') AS "Sigla Decidida", {_THREE.format("aw.top")} AS "Score Final", CASE WHEN reason = 'decided' THEN '' ELSE reason END AS "Motivo Revisão", {shown}, 'S' || (d.id % 7) AS "Sheet Origem", s.text AS "Desc Normalizada",
      array_to_string(s.tokens, ' ') AS "Desc Canônica", coalesce(s.family, '') AS "Equip Alvo (N0)", '' AS "Nome Equip", '' AS "Barra", coalesce(s.phase, '') AS "Fase", (SELECT {_SEMANTIC.replace("tokens", "s.tokens")}) AS "Estado Semântico", d.rules AS "Regras Aplicadas",
      {_THREE.format("d.gap")} AS "Gap", CASE WHEN d.gap IS NULL THEN '' ELSE '0.080' END AS "Gap Exigido", coalesce(stage, '') AS "Etapa Decisora", CAST(d.id * 2 AS VARCHAR) AS "Endereço Bruto"
    FROM decided d JOIN sig s USING (id) LEFT JOIN aw USING (id)"""


@bank.add(_audit_sql())
def audit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 33 columns of the audit report for every signal."""
    rows, cat = signals(spark, sf_dir), catalogue(spark)
    each, members = funnel.kinds(rows)
    given = staged(scored(each, cat), "audit-scored")
    decisions, offered_codes = funnel.decide(each, cat, given, SETTINGS)
    none, own = F.lit(None).cast("string"), F.array(F.col("id") * 2)
    told = members.select(
        "id", "kind", F.concat(F.lit("S"), F.col("id") % 7, F.lit(":"), "id").alias("label"), "text", F.col("text").alias("normalised"), F.array_join("tokens", " ").alias("canonical"), F.lit("Discrete").alias("category"), "direction",
        own.alias("addresses"), own.alias("raw_addresses"), "family", none.alias("device"), none.alias("bus"), "phase",
    )
    names = F.when(F.col("method") == "lexical", "tfidf").otherwise("vetorial")
    return report.audit(told, decisions, offered_codes.where("not lost and not outside"), given.withColumn("method", names), SETTINGS.gap)
