"""Queries that evaluate, mine and review: accuracy, sweeps, gold comparison, histograms, base cleaning, overlays of edits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.functions.tables import PHASE_CODES
from matchloom.operators import analytics, review
from matchloom.plans import ranking
from matchloom.plans.registry import Bank, indel_sql, table

bank = Bank()

#: crc32 of each part name, bit by bit.
CRC_OF_NAMES = """names AS (SELECT DISTINCT p_name, list_transform(string_split(p_name, ''), lambda c: CAST(ascii(c) AS BIGINT)) AS chars FROM part),
    crc AS (SELECT p_name, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(chars, lambda c: list_transform(range(8), lambda b: (c >> CAST(b AS INTEGER)) & 1)))),
      lambda crc, bit: xor(crc >> 1, 3988292384 * (xor(crc, bit) & 1))), 4294967295) AS h FROM names)"""

TWO = f"WITH {ranking.BM25}, {ranking.TFIDF}"


@bank.add(
    f"""{TWO}, w AS (SELECT id, code AS wanted, score >= 0.2 AS decided FROM ti WHERE rank = 1), h AS (SELECT w.id, w.decided, bool_or(bm.rank = 1 AND bm.code = wanted) AS one, bool_or(bm.rank <= 3 AND bm.code = wanted) AS three FROM w LEFT JOIN bm USING (id) GROUP BY ALL)
    SELECT round(avg(CASE WHEN one THEN 1.0 ELSE 0 END), 6) AS acc_1, round(avg(CASE WHEN three THEN 1.0 ELSE 0 END), 6) AS recall_3, round(avg(CASE WHEN decided THEN 1.0 ELSE 0 END), 6) AS decided, round(avg(CASE WHEN decided THEN CASE WHEN one THEN 1.0 ELSE 0 END END), 6) AS precision FROM h"""
)
def eval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the BM25 ranking agrees with the tf-idf ranking's first."""
    from matchloom.operators import candidates

    d, b = ranking.documents(spark, sf_dir), ranking.benchmark(spark, sf_dir)
    wanted = candidates.tfidf(d, b).where("rank = 1").select("id", "code", (F.col("score") >= 0.2).alias("decided"))
    found = analytics.accuracy(candidates.bm25(d, b), wanted)
    return found.select(*(F.round(c, 6).alias(c) for c in found.columns))


PCTS, GAPS = [0.0, 0.1, 0.2, 0.3, 0.4, 0.45, 0.5, 0.6, 0.7, 0.8, 0.9], [0.0, 0.02, 0.05, 0.08, 0.10, 0.15, 0.20, 0.30]
_GRID = f"g AS (SELECT * FROM (VALUES {', '.join(f'({p})' for p in PCTS)}) p(t_pct), (VALUES {', '.join(f'({g})' for g in GAPS)}) q(t_gap))"


@bank.add(
    f"""WITH s AS (SELECT o_orderpriority AS category, round(o_totalprice / 500000, 6) AS top, round(o_custkey % 100 / 100.0, 6) AS gap, o_orderstatus = 'F' AS correct FROM orders), {_GRID}
    SELECT CAST(t_pct AS DOUBLE) AS t_pct, CAST(t_gap AS DOUBLE) AS t_gap, category, count(*) AS n, count(*) FILTER (top >= t_pct AND gap >= t_gap) AS decided, round(count(*) FILTER (top >= t_pct AND gap >= t_gap AND correct) / nullif(count(*) FILTER (top >= t_pct AND gap >= t_gap), 0), 6) AS precision
    FROM s, g GROUP BY GROUPING SETS ((t_pct, t_gap, category), (t_pct, t_gap))"""
)
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("category"), F.round(F.col("o_totalprice") / 500000, 6).alias("top"), F.round(F.col("o_custkey") % 100 / 100.0, 6).alias("gap"), (F.col("o_orderstatus") == "F").alias("correct"))
    return analytics.threshold_sweep(rows, PCTS, GAPS).withColumn("precision", F.round("precision", 6))


@bank.add(
    """WITH c AS (SELECT l_orderkey AS id, l_returnflag AS code, max(l_discount) AS s1, max(l_tax) AS s2, round(max(l_quantity) / 500, 6) AS s3 FROM lineitem GROUP BY 1, 2), g AS (SELECT i / 20.0 AS a, j / 20.0 AS b, (20 - i - j) / 20.0 AS c FROM range(21) x(i), range(21) y(j) WHERE i + j <= 20),
    b AS (SELECT g.a, g.b, g.c, id, code, row_number() OVER (PARTITION BY g.a, g.b, g.c, id ORDER BY round(g.a * s1 + g.b * s2 + g.c * s3, 9) DESC, code) AS k FROM c, g)
    SELECT b.a, b.b, b.c, round(avg(CASE WHEN code = CASE o_orderstatus WHEN 'F' THEN 'A' WHEN 'O' THEN 'N' ELSE 'R' END THEN 1.0 ELSE 0 END), 6) AS accuracy FROM b JOIN orders ON o_orderkey = id WHERE k = 1 GROUP BY ALL"""
)
def weight_simplex(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("code")).agg(F.max("l_discount").alias("s1"), F.max("l_tax").alias("s2"), F.round(F.max("l_quantity") / 500, 6).alias("s3"))
    wanted = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "A").when(F.col("o_orderstatus") == "O", "N").otherwise("R").alias("code"))
    return analytics.simplex_search(rows, wanted, analytics.weight_simplex()).withColumn("accuracy", F.round("accuracy", 6))


@bank.add(
    """WITH p AS (SELECT o_custkey AS id, count(*) AS n, round(avg(o_totalprice), 2) AS v FROM orders GROUP BY 1)
    SELECT id, n, v FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.n >= p.n AND q.v >= p.v AND (q.n > p.n OR q.v > p.v))"""
)
def pareto(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 2).alias("v"))
    return analytics.pareto(points, "n", "v")


@bank.add(
    """WITH a AS (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS x, max(l_returnflag) AS y FROM lineitem GROUP BY 1, 2)
    SELECT count(*) AS common, count(*) FILTER (x = y) AS equal, round(100.0 * count(*) FILTER (x = y) / count(*), 1) AS pct FROM a"""
)
def gold_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["l_orderkey", "l_linenumber"]
    lines = table(spark, sf_dir, "lineitem")
    return analytics.compare(lines.groupBy(*keys).agg(F.min("l_returnflag").alias("code")), lines.groupBy(*keys).agg(F.max("l_returnflag").alias("code")), keys)


@bank.add(
    """WITH a AS (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS ours, max(l_returnflag) AS theirs FROM lineitem GROUP BY 1, 2)
    SELECT * FROM a WHERE ours <> theirs"""
)
def gold_divergences(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["l_orderkey", "l_linenumber"]
    lines = table(spark, sf_dir, "lineitem")
    return analytics.divergences(lines.groupBy(*keys).agg(F.min("l_returnflag").alias("code")), lines.groupBy(*keys).agg(F.max("l_returnflag").alias("code")), keys)


@bank.add("SELECT c_custkey AS k, c_mktsegment AS expected, s AS code, coalesce(s = c_mktsegment, false) AS passed FROM customer LEFT JOIN (SELECT s_suppkey, CASE WHEN s_nationkey % 2 = 0 THEN 'BUILDING' ELSE 'MACHINERY' END AS s FROM supplier) ON s_suppkey = c_custkey")
def locked_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("expected"))
    ours = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.when(F.col("s_nationkey") % 2 == 0, "BUILDING").otherwise("MACHINERY").alias("code"))
    return analytics.locked(cases, ours, ["k"])


RELIABLE = "r AS (SELECT least(floor(s * 10), 9) AS bin, count(*) AS n, avg(s) AS confidence, avg(CASE WHEN c THEN 1.0 ELSE 0 END) AS accuracy FROM (SELECT round(l_quantity / 50, 6) AS s, l_linestatus = 'O' AS c FROM lineitem) GROUP BY ALL)"


def _reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.reliability(table(spark, sf_dir, "lineitem").select(F.round(F.col("l_quantity") / 50, 6).alias("score"), (F.col("l_linestatus") == "O").alias("correct")))


@bank.add(f"WITH {RELIABLE} SELECT CAST(bin AS INTEGER) AS bin, n, round(confidence, 6) AS confidence, round(accuracy, 6) AS accuracy FROM r")
def reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reliability(spark, sf_dir).withColumns({c: F.round(c, 6) for c in ("confidence", "accuracy")})


@bank.add(f"WITH {RELIABLE} SELECT round(sum(n * abs(accuracy - confidence)) / sum(n), 6) AS ece FROM r")
def calibration_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.calibration_error(_reliability(spark, sf_dir)).withColumn("ece", F.round("ece", 6))


@bank.add("SELECT round(l_discount * 0.1, 3) AS gap, count(*) AS n, count(*) FILTER (l_returnflag = 'A') AS same FROM lineitem GROUP BY ALL")
def gap_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.gap_histogram(table(spark, sf_dir, "lineitem").select((F.col("l_discount") * 0.1).alias("gap"), (F.col("l_returnflag") == "A").alias("same")))


_TIES = ("50N", "50A1", "27", "59", "IA")


@bank.add(
    f"""WITH r AS (SELECT round(l_discount * 0.1, 3) AS gap, ({list(_TIES)})[CAST(l_partkey % 5 AS INTEGER) + 1] AS a, CASE WHEN l_linenumber <> 7 THEN ({list(_TIES)})[CAST(l_suppkey % 5 AS INTEGER) + 1] END AS b, l_returnflag AS x, l_linestatus AS y FROM lineitem),
    k AS (SELECT gap, CASE WHEN b IS NULL THEN 'alone' WHEN gap >= 0.005 THEN 'clear' WHEN x = y THEN 'same_description' WHEN regexp_extract(a, '^[0-9][0-9]') <> '' AND regexp_extract(a, '^[0-9][0-9]') = regexp_extract(b, '^[0-9][0-9]') THEN 'same_family' ELSE 'other_family' END AS kind FROM r)
    SELECT kind, count(*) AS n, round(avg(gap), 3) AS mean_gap FROM k GROUP BY kind"""
)
def tie_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why the best two codes of a line are close."""
    at = lambda c: F.element_at(F.array(*map(F.lit, _TIES)), (F.col(c) % 5 + 1).cast("int"))
    rows = table(spark, sf_dir, "lineitem").select(
        F.round(F.col("l_discount") * 0.1, 3).alias("gap"), at("l_partkey").alias("first"), F.when(F.col("l_linenumber") != 7, at("l_suppkey")).alias("second"), F.col("l_returnflag").alias("first_text"), F.col("l_linestatus").alias("second_text")
    )
    return analytics.tie_taxonomy(rows, 0.005)


@bank.add("SELECT c_mktsegment AS real, CASE WHEN s_nationkey IS NOT NULL THEN CAST(s_nationkey % 3 AS VARCHAR) END AS ours, count(*) AS n FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey GROUP BY ALL")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v"))
    right = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), (F.col("s_nationkey") % 3).cast("string").alias("v"))
    return analytics.confusion(left, right, ["k"], "v")


@bank.add("SELECT id, status FROM (SELECT o_orderkey AS id, 'decided' AS status FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT o_orderkey, 'review' FROM orders WHERE o_orderstatus = 'P')")
def quality_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus")
    return analytics.first_of_each("id", o.where("o_orderstatus <> 'P'").select("id", F.lit("decided").alias("status")), o.select("id", F.lit("review").alias("status")))


@bank.add("SELECT CASE WHEN l_discount * 10 >= 0.7 THEN 'high' WHEN l_discount * 10 >= 0.45 THEN 'middle' ELSE 'low' END AS band, l_returnflag AS sheet, count(*) AS n, count(*) FILTER (l_linestatus = 'O') AS pending FROM lineitem GROUP BY ALL")
def bands_and_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(analytics.band(F.col("l_discount") * 10).alias("band"), F.col("l_returnflag").alias("sheet")).agg(F.count("*").alias("n"), F.count_if(F.col("l_linestatus") == "O").alias("pending"))


# --- mining -----------------------------------------------------------------------------------------------


@bank.add(
    """SELECT alias || '/' || p_size AS alias, code FROM (SELECT DISTINCT p_name AS alias, p_size, p_brand AS code, count(DISTINCT p_brand) OVER (PARTITION BY p_name, p_size) AS n FROM part WHERE regexp_matches(p_name, '^[a-z]+ (ring|bolt|gear)$')) WHERE n = 1 AND code IN (SELECT 'Brand#' || n_nationkey FROM nation)"""
)
def base_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "part").select(F.concat_ws("/", "p_name", F.col("p_size").cast("string")).alias("alias"), F.col("p_brand").alias("code"))
    codes = table(spark, sf_dir, "nation").select(F.concat(F.lit("Brand#"), F.col("n_nationkey").cast("string")).alias("code"))
    return analytics.clean_base(pairs, r"^[a-z]+ (ring|bolt|gear)/", codes).select("alias", "code")


@bank.add(
    """WITH b AS (SELECT DISTINCT text, code FROM (SELECT p_type || p_size AS text, p_brand AS code FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_name || p_size, p_brand FROM part WHERE p_partkey % 2 = 1) WHERE text NOT IN (SELECT p_type || '7' FROM part))
    SELECT text, min(code) AS code FROM b GROUP BY text HAVING count(DISTINCT code) = 1"""
)
def ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    one = part.where("p_partkey % 2 = 0").select(F.concat("p_type", F.col("p_size").cast("string")).alias("text"), F.col("p_brand").alias("code"))
    two = part.where("p_partkey % 2 = 1").select(F.concat("p_name", F.col("p_size").cast("string")).alias("text"), F.col("p_brand").alias("code"))
    return analytics.ground_truth(one, two, part.select(F.concat("p_type", F.lit("7")).alias("text")))


@bank.add("SELECT l_suppkey, count(*) AS n, round(avg(CASE WHEN l_linestatus = 'O' THEN 1.0 ELSE 0 END), 6) AS share FROM lineitem GROUP BY 1 HAVING count(*) >= 20 AND avg(CASE WHEN l_linestatus = 'O' THEN 1.0 ELSE 0 END) >= 0.5")
def share_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.share_rules(table(spark, sf_dir, "lineitem"), "l_suppkey", F.col("l_linestatus") == "O", 0.5).withColumn("share", F.round("share", 6))


@bank.add(
    """WITH t AS (SELECT p_partkey AS id, p_brand AS code, unnest(list_concat(string_split(p_name, ' '), ['s' || p_size])) AS token FROM part), s AS (SELECT p_brand AS code, count(*) AS m FROM part GROUP BY 1), own AS (SELECT DISTINCT 'Brand#' || n_nationkey AS code, list_extract(['red', 'blue', 'ring', 's7', 's11'], CAST(n_nationkey % 5 + 1 AS INTEGER)) AS token FROM nation),
    f AS (SELECT code, token, count(DISTINCT id) AS n FROM t GROUP BY ALL) SELECT code, token, n, round(n / m, 6) AS share FROM f JOIN s USING (code) WHERE token NOT IN (SELECT token FROM own) AND (n >= 2 OR n / m >= 0.05)"""
)
def variant_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("code"), F.concat(F.split("p_name", " "), F.array(F.concat(F.lit("s"), F.col("p_size").cast("string")))).alias("tokens"))
    words = F.element_at(F.array(*map(F.lit, ("red", "blue", "ring", "s7", "s11"))), (F.col("n_nationkey") % 5 + 1).cast("int"))
    cat = table(spark, sf_dir, "nation").select(F.concat(F.lit("Brand#"), F.col("n_nationkey").cast("string")).alias("code"), F.array(words).alias("tokens"))
    return analytics.variants(texts, cat).withColumn("share", F.round("share", 6))


@bank.add(
    f"""WITH {CRC_OF_NAMES}, p AS (SELECT p_name AS code, p_type AS text, p_partkey AS ord, h % 4 = 0 AS missing, array_to_string(list_sort(string_split(p_name, ' ')), ' ') AS form FROM part JOIN crc USING (p_name)),
    u AS (SELECT code, form, count(*) AS n, arg_min(text, ord) AS example FROM p WHERE missing GROUP BY ALL), c AS (SELECT DISTINCT code AS known, form AS k FROM p WHERE NOT missing),
    m AS (SELECT code, known, s FROM (SELECT code, known, {indel_sql("form", "k")} AS s FROM u, c) WHERE s >= 75 QUALIFY row_number() OVER (PARTITION BY code ORDER BY s DESC, known) = 1)
    SELECT code, n, example, known AS nearest FROM u LEFT JOIN m USING (code)"""
)
def unknown_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names that the catalogue lacks (every fourth), with the most similar name it has."""
    part = table(spark, sf_dir, "part").select(F.col("p_name").alias("code"), F.col("p_type").alias("text"), F.col("p_partkey").alias("ord"))
    missing = F.crc32(F.col("code").cast("binary")) % 4 == 0
    return analytics.nearest_codes(part.where(missing), part.where(~missing).select("code"), 75.0)


# --- review -----------------------------------------------------------------------------------------------


@bank.add("SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority IN ('1-URGENT', '5-LOW') AND contains(lower(o_orderpriority), 'ur')")
def review_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("p"))
    return review.select(rows, status="P", within={"p": ["1-URGENT", "5-LOW"]}, contains={"p": "UR"}, anywhere="urg").select("id")


@bank.add("SELECT DISTINCT o_orderpriority FROM orders")
def distinct_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.values_of(table(spark, sf_dir, "orders"), "o_orderpriority")


EDITS = "e AS (SELECT event_id AS version, user_id * 7 AS id, CASE WHEN event_type = 'click' THEN 'status' ELSE 'code' END AS field, event_type AS value FROM events WHERE event_type IN ('click', 'view', 'error')), rec AS (SELECT o_orderkey AS id, o_orderstatus AS status, o_orderpriority AS code FROM orders)"


def _edits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    edits = table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "view", "error"))
    edits = edits.select(F.col("event_id").alias("version"), (F.col("user_id") * 7).alias("id"), F.when(F.col("event_type") == "click", "status").otherwise("code").alias("field"), F.col("event_type").alias("value"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("code")), edits


@bank.add(
    f"""WITH {EDITS}, l AS (SELECT id, field, arg_max(value, version) AS value FROM e GROUP BY ALL)
    SELECT rec.id, coalesce(a.value, status) AS status, coalesce(b.value, code) AS code FROM rec LEFT JOIN l a ON a.id = rec.id AND a.field = 'status' LEFT JOIN l b ON b.id = rec.id AND b.field = 'code'"""
)
def overlay_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, edits = _edits(spark, sf_dir)
    return review.edited(rows, edits, ["status", "code"])


@bank.add(
    f"""WITH {EDITS}, l AS (SELECT id, field, arg_max(value, version) AS value FROM e WHERE version < 500 GROUP BY ALL)
    SELECT rec.id, coalesce(a.value, status) AS status, coalesce(b.value, code) AS code FROM rec LEFT JOIN l a ON a.id = rec.id AND a.field = 'status' LEFT JOIN l b ON b.id = rec.id AND b.field = 'code'"""
)
def undo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The overlay as it was before version 500."""
    rows, edits = _edits(spark, sf_dir)
    return review.edited(rows, edits, ["status", "code"], before=500)


@bank.add(
    """WITH e AS (SELECT event_id AS version, user_id * 7 AS id, CASE event_type WHEN 'click' THEN 'phase' WHEN 'view' THEN 'address' ELSE 'owner' END AS field, CASE event_type WHEN 'click' THEN (['A', 'ABC', 'Q', NULL])[CAST(event_id % 4 AS INTEGER) + 1] WHEN 'view' THEN CASE WHEN event_id % 5 = 0 THEN 'x' ELSE CAST(event_id * 37 % 90000 AS VARCHAR) END ELSE event_type END AS value FROM events),
    g AS (SELECT * FROM e WHERE (field = 'phase' AND (value IS NULL OR value IN ('ABC', 'AB', 'BC', 'AC', 'A', 'B', 'C', 'N'))) OR (field = 'address' AND TRY_CAST(value AS INTEGER) BETWEEN 0 AND 65535)),
    l AS (SELECT id, field, arg_max([value], version)[1] AS value FROM g GROUP BY ALL)
    SELECT o_orderkey AS id, CASE WHEN a.id IS NOT NULL THEN a.value ELSE 'N' END AS phase, CASE WHEN b.id IS NOT NULL THEN CAST(b.value AS BIGINT) ELSE o_custkey END AS address FROM orders LEFT JOIN l a ON a.id = o_orderkey AND a.field = 'phase' LEFT JOIN l b ON b.id = o_orderkey AND b.field = 'address'"""
)
def checked_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits of phases and addresses; those that are no phase or no address change nothing."""
    kind, k = F.col("event_type"), F.col("event_id")
    phase = F.element_at(F.array(*(F.lit(v).cast("string") for v in ("A", "ABC", "Q", None))), (k % 4).cast("int") + 1)
    value = F.when(kind == "click", phase).when(kind == "view", F.when(k % 5 == 0, "x").otherwise((k * 37 % 90000).cast("string"))).otherwise(kind)
    edits = table(spark, sf_dir, "events").select(k.alias("version"), (F.col("user_id") * 7).alias("id"), F.when(kind == "click", "phase").when(kind == "view", "address").otherwise("owner").alias("field"), value.alias("value"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.lit("N").alias("phase"), F.col("o_custkey").alias("address"))
    return review.edited_if_valid(rows, edits, {"phase": lambda v: v.isin(*PHASE_CODES), "address": review.valid_address})


@bank.add(
    """WITH d AS (SELECT DISTINCT l_orderkey AS g, l_linenumber AS p FROM lineitem), r AS (SELECT *, p - row_number() OVER (PARTITION BY g ORDER BY p) AS run FROM d)
    SELECT g AS l_orderkey, min(p) AS first, max(p) AS last, count(*) AS n FROM r GROUP BY g, run"""
)
def row_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of consecutive line numbers of each order, as a table's rows are removed."""
    return review.ranges(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@bank.add("SELECT o_orderkey AS id, CASE WHEN o_orderstatus <> 'F' AND o_totalprice >= 250000 THEN 'T' || o_custkey ELSE NULL END AS code, CASE WHEN o_orderstatus = 'F' OR o_totalprice >= 250000 THEN 'decided' ELSE 'review' END AS status FROM orders")
def auto_approve(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.lit(None).cast("string").alias("code"), F.concat(F.lit("T"), F.col("o_custkey").cast("string")).alias("top_code"), F.col("o_totalprice").alias("top_score"), F.when(F.col("o_orderstatus") == "F", "decided").otherwise("review").alias("status"))
    return review.auto_approved(rows, 250000).select("id", "code", "status")


@bank.add("SELECT p_partkey AS ord, p_brand AS code, p_name AS text, CASE WHEN contains(upper(p_brand), 'RING') THEN 0 ELSE 1 END AS \"where\" FROM part WHERE contains(upper(p_name), 'RING') OR contains(upper(p_brand), 'RING') ORDER BY 4, 2, 1 LIMIT 30")
def search_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.search(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), F.col("p_brand").alias("code"), F.col("p_name").alias("text")), "ríng")


@bank.add(
    """SELECT 100 AS after, min(o_orderkey) AS id FROM orders WHERE o_orderstatus = 'P' AND o_orderkey > 100 UNION ALL SELECT 1000000000000, min(o_orderkey) FROM orders WHERE o_orderstatus = 'P'"""
)
def next_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next pending order after a place, and after the last place, where the search starts again."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("ord"), F.when(F.col("o_orderstatus") == "P", "review").otherwise("decided").alias("status"))
    here, beyond = (review.next_pending(rows, n).select(F.lit(n).cast("long").alias("after"), "id") for n in (100, 10**12))
    return here.union(beyond)
