"""Queries on made and stored data: noisy variants, workbooks and tables written and read back, a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.operators import corrupt
from matchloom.plans import ranking, signals
from matchloom.plans.registry import Bank, table
from matchloom.session import fresh_path
from matchloom.sources import tables, workbooks
from matchloom.streaming import scoring

bank = Bank()

PHRASES = ("50 - FALHA DISJUNTOR LIGADO", "CORRENTE TRANSFORMADOR FASE A", "67 PROTECAO SECCIONADORA BLOQUEIO ATUADO", "TENSAO", "RELIGAMENTO DESLIGADO", "", "TEMPERATURA OLEO TRANSFORMADOR ALTA SINALIZACAO")


def _number(*parts: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8) AS BIGINT)"


def _less(share: float) -> int:
    return int(share * (1 << 32))


_W = "list_filter(regexp_split_to_array(t, '\\s+'), lambda w: w <> '')"


def _per_word(step: str, share: float, mapping: dict[str, str]) -> str:
    table_of = f"CASE upper(w[i]) {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in mapping.items())} ELSE w[i] END"
    return f"array_to_string(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN {_number('k', f"'{step}'", 'CAST(i - 1 AS VARCHAR)')} < {_less(share)} THEN {table_of} ELSE w[i] END), ' ')"


def _misspelt(step: str) -> str:
    at = f"({_number('k', f"'{step}'", "'at'")} % greatest(length(t), 1) + 1)"
    how = f"{_number('k', f"'{step}'", "'how'")} % 3"
    left, here, after, rest = f"substr(t, 1, {at} - 1)", f"substr(t, {at}, 1)", f"substr(t, {at} + 1, 1)", f"substr(t, {at} + 2)"
    return f"CASE WHEN length(t) < 2 THEN t WHEN {how} = 0 THEN {left} || {after} || {rest} WHEN {how} = 1 THEN {left} || {here} || {here} || {after} || {rest} ELSE {left} || {after} || {here} || {rest} END"


def _step(change: object, step: str) -> str:
    lit = f"'{step}'"
    chosen = lambda values: f"({signals._list(values)})[{_number('k', lit)} % {len(values)} + 1]"
    return {
        corrupt.abbreviated: _per_word(step, 0.7, corrupt.SHORT),
        corrupt.with_synonyms: _per_word(step, 0.6, corrupt.SYNONYMS),
        corrupt.reordered: f"array_to_string(list_transform(list_sort(list_transform(range(1, len(w) + 1), lambda i: {{'o': {_number('k', lit, 'CAST(i - 1 AS VARCHAR)')}, 'i': i, 'w': w[i]}})), lambda s: s.w), ' ')",
        corrupt.with_device: f"t || ' ' || {chosen(corrupt.DEVICES)}",
        corrupt.with_state: f"t || ' - ' || {chosen(corrupt.SUFFIXES)}",
        corrupt.shortened: f"CASE WHEN len(w) > 2 THEN array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda i: i = 1 OR NOT {_number('k', lit, 'CAST(i - 1 AS VARCHAR)')} < {_less(1 / 3)}), lambda i: w[i]), ' ') ELSE t END",
        corrupt.number_in_parentheses: "CASE WHEN regexp_matches(w[1], '^\\d{2}$') THEN array_to_string(list_filter(w[2:], lambda v: v <> '-'), ' ') || ' (' || w[1] || ')' ELSE t END",
        corrupt.misspelt: _misspelt(step),
    }[change]


def _corruption_sql() -> str:
    parts = [f"p AS (SELECT 'C' || p_partkey AS code, {signals._pick(PHRASES, 'p_partkey')} || ' ' || p_name AS text, unnest([0, 1]) AS variant FROM part)"]
    out = []
    for level in range(1, corrupt.LEVELS + 1):
        name = f"l{level}"
        parts.append(f"{name}_0 AS (SELECT code, variant, code || '|{level}|' || variant || '|0' AS k, array_to_string({_W.replace('(t,', '(text,')}, ' ') AS t FROM p)")
        n = 0
        for below in range(2, level + 1):
            for j, change in enumerate(corrupt.CLASSES[below]):
                parts.append(f"{name}_{n + 1} AS (SELECT code, variant, k, {_step(change, f'{below}.{j}')} AS t FROM (SELECT *, {_W} AS w FROM {name}_{n}))")
                n += 1
        out.append(f"SELECT code, {level} AS level, variant, array_to_string({_W}, ' ') AS text FROM {name}_{n}")
    return f"WITH {', '.join(parts)} {' UNION ALL '.join(out)}"


@bank.add(_corruption_sql())
def corruption(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two noisy variants of every part's description at each of five levels."""
    text = F.concat_ws(" ", signals.pick(PHRASES, "p_partkey"), "p_name")
    return corrupt.dataset(table(spark, sf_dir, "part").select(F.concat(F.lit("C"), F.col("p_partkey").cast("string")).alias("code"), text.alias("text")), variants=2)


@bank.add("SELECT n_name AS name, CAST(n_regionkey AS VARCHAR) AS region, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) + 1 AS row_no FROM nation")
def xlsx_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One workbook for each region, written and read back; row 1 is the header."""
    rows = table(spark, sf_dir, "nation").withColumn("region", F.col("n_regionkey").cast("string"))
    made = workbooks.workbooks(rows, "n_regionkey", "n_nationkey", ["n_name", "region"])
    path = fresh_path(spark, "workbooks")
    workbooks.save(made, path)
    read = workbooks.read(spark, path).where("row_no > 1")
    return read.select(F.col("cells")[0].alias("name"), F.col("cells")[1].alias("region"), F.col("row_no").cast("long").alias("row_no"))


@bank.add("SELECT s_suppkey, s_name, round(s_acctbal, 2) AS s_acctbal, 'n' || s_nationkey AS tags FROM supplier")
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as CSV files, read back in their types."""
    path = fresh_path(spark, "csv")
    tables.write_csv(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.round("s_acctbal", 2).alias("s_acctbal"), F.array(F.concat(F.lit("n"), F.col("s_nationkey").cast("string"))).alias("tags")), path)
    return tables.read_csv(spark, path, "s_suppkey long, s_name string, s_acctbal double, tags string")


@bank.add(
    f"""WITH {ranking.BM25}, mm AS (SELECT *, min(score) OVER (PARTITION BY id) AS low, max(score) OVER (PARTITION BY id) AS high FROM bm), pl AS (SELECT id, code, ord, 1 / (1 + exp(-(2.0403 * CASE WHEN high > low THEN (score - low) / (high - low) ELSE 0 END - 0.9391))) AS score FROM mm),
    ld AS (SELECT id, max(CASE WHEN k = 1 THEN code END) AS code, max(CASE WHEN k = 1 THEN score END) AS score, coalesce(max(CASE WHEN k = 2 THEN score END), 0) AS second FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, ord, code) AS k FROM pl) GROUP BY id)
    SELECT s.id, ld.code, CASE WHEN ld.code IS NULL THEN 'no_candidate' WHEN ld.score < 0.2 THEN 'low_score' WHEN ld.score >= 0.45 AND ld.score - second >= 0.08 THEN 'decided' WHEN ld.score >= 0.45 THEN 'several_codes' ELSE 'low_score' END AS reason FROM s LEFT JOIN ld USING (id)"""
)
def stream_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that arrive as a stream, decided batch by batch."""
    docs, known = ranking.documents(spark, sf_dir), ranking.benchmark(spark, sf_dir)
    path = fresh_path(spark, "stream")
    docs.write.parquet(f"{path}/in")
    arriving = spark.readStream.schema(docs.schema).parquet(f"{path}/in")
    scoring.score_stream(arriving, known, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/out").select("id", "code", "reason")
