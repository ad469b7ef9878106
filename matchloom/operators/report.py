"""The audit report: one row of text cells for each signal, ready for a sheet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.functions import text as x
from matchloom.operators.candidates import small
from matchloom.session import staged

# The titles of the report, and the methods whose scores it shows.
TITLES = (
    "ID Sinal", "Descrição Bruta", "Tipo", "Endereço", "Status", "Sigla Decidida", "Score Final", "Motivo Revisão",
    "Candidato 1", "Score tfidf 1", "Score vetorial 1", "Score fuzzy 1", "Candidato 2", "Score tfidf 2", "Score vetorial 2", "Score fuzzy 2",
    "Candidato 3", "Score tfidf 3", "Score vetorial 3", "Score fuzzy 3",
    "Sheet Origem", "Desc Normalizada", "Desc Canônica", "Equip Alvo (N0)", "Nome Equip", "Barra", "Fase", "Estado Semântico", "Regras Aplicadas",
    "Gap", "Gap Exigido", "Etapa Decisora", "Endereço Bruto",
)
METHODS = ("tfidf", "vetorial", "fuzzy")


def _three(value: Column) -> Column:
    """Three digits, or nothing."""
    return F.when(value.isNotNull(), F.format_string("%.3f", F.round(value, 3))).otherwise("")


def _text(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def semantic_state(text: Column) -> Column:
    """class/polarity of the state that a text names, the class alone without a polarity, or nothing."""
    return F.concat_ws("/", x.text_state(text), x.text_polarity(text))


def audit(rows: DataFrame, decisions: DataFrame, ranked: DataFrame, scores: DataFrame, wanted_gap: float) -> DataFrame:
    """The 33 columns of ``TITLES`` for each of ``rows``; what is unknown is empty, never made up.

    rows (id, label, text, normalised, canonical, category, direction, addresses, raw_addresses, family, device, bus, phase),
    decisions (id, code, status, reason, gap, stage, rules), ranked (id, code, score, rank), scores (id, method, code, score).
    ``label`` is ``sheet:row``. Rows with ``kind`` are members of a kind, whose id the other frames have.
    """
    best = ranked.where("rank <= 3").select("id", "code", "score", "rank")
    own = scores.where(F.col("method").isin(*METHODS)).groupBy("id", "code").agg(*(F.max(F.when(F.col("method") == m, F.col("score"))).alias(m) for m in METHODS))
    told = best.join(own, ["id", "code"], "left")
    at = lambda k, c: F.max(F.when(F.col("rank") == k, F.col(c)))
    wide = told.groupBy("id").agg(at(1, "score").alias("first"), *(at(k, c).alias(f"{c}_{k}") for k in (1, 2, 3) for c in ("code", *METHODS)))
    chosen = decisions.select("id", F.col("code").alias("chosen"), "status", "reason", "gap", "stage", "rules")
    facts, key = chosen.join(wide, "id", "full"), "id"
    if "kind" in rows.columns:
        facts, key = small(staged(facts.withColumnRenamed("id", "kind"), "audit-kinds")), "kind"
    all_ = rows.join(facts, key, "left")
    addresses = lambda c: F.array_join(F.transform(c, lambda a: a.cast("string")), ";")
    columns = {
        "ID Sinal": F.col("label"), "Descrição Bruta": x.display_text(F.col("text"), F.col("chosen")), "Tipo": F.concat_ws("/", "category", "direction"), "Endereço": addresses("addresses"),
        "Status": F.col("status"), "Sigla Decidida": F.col("chosen"), "Score Final": _three(F.col("first")), "Motivo Revisão": F.when(F.col("status") == "review", F.col("reason")),
        "Sheet Origem": F.when(F.contains("label", F.lit(":")), F.regexp_replace("label", ":[^:]*$", "")), "Desc Normalizada": F.col("normalised"), "Desc Canônica": F.col("canonical"),
        "Equip Alvo (N0)": F.col("family"), "Nome Equip": F.col("device"), "Barra": F.col("bus"), "Fase": F.col("phase"), "Estado Semântico": semantic_state(F.col("canonical")), "Regras Aplicadas": F.col("rules"),
        "Gap": _three(F.col("gap")), "Gap Exigido": F.when(F.col("gap").isNotNull(), _three(F.lit(wanted_gap))), "Etapa Decisora": F.col("stage"), "Endereço Bruto": addresses("raw_addresses"),
    }
    for k in (1, 2, 3):
        columns[f"Candidato {k}"] = F.col(f"code_{k}")
        columns |= {f"Score {m} {k}": _three(F.col(f"{m}_{k}")) for m in METHODS}
    return all_.select("id", *(_text(columns[t]).alias(t) for t in TITLES))
