"""Queries on sheets and records: schema discovery, structuring, group resolution, gates and output tables.

Orders, lines and events stand for sheets and records: a customer or an order is
a module, a supplier a device, a line number an address, O a command.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from matchloom.functions import text as x
from matchloom.operators import discover, gates, project, resolve, structure
from matchloom.plans.registry import Bank, indel_sql, table

bank = Bank()

COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]
CELLS = "cells AS (SELECT o_orderpriority AS sheet, o_orderkey AS row_no, unnest([0, 1, 2, 3]) AS col_no, unnest([CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR), o_orderstatus, o_orderpriority]) AS value FROM orders)"


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as one sheet for each priority."""
    o = table(spark, sf_dir, "orders")
    values = F.array(*(F.col(c).cast("string") for c in COLUMNS))
    return discover.long_cells(o.select(F.col("o_orderpriority").alias("sheet"), F.col("o_orderkey").alias("row_no"), values.alias("cells")))


@bank.add(
    f"""WITH {CELLS}, n AS (SELECT sheet, row_no, count(*) FILTER (trim(value) <> '') AS n FROM cells GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY sheet ORDER BY row_no) AS k FROM n),
    m AS (SELECT *, max(n) OVER (PARTITION BY sheet) AS most FROM r WHERE k <= 20) SELECT sheet, min(row_no) AS header_row FROM m WHERE n >= 0.8 * most GROUP BY sheet"""
)
def header_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discover.header_row(cells(spark, sf_dir))


@bank.add(
    rf"""WITH {CELLS} SELECT sheet, col_no, count(*) AS n, count(*) FILTER (regexp_matches(value, '^\s*-?\d+\s*$')) AS n_int, count(*) FILTER (regexp_matches(value, '[A-Za-z]')) AS n_text, count(DISTINCT value) AS n_distinct,
    round(avg(len(list_filter(regexp_split_to_array(value, '\s+'), lambda w: w <> ''))), 6) AS mean_words, round(avg(length(value)), 6) AS mean_length FROM cells GROUP BY ALL"""
)
def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discover.column_profile(cells(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("mean_words", "mean_length")})


@bank.add(
    rf"""WITH {CELLS}, i AS (SELECT sheet, col_no, row_no, CAST(trim(value) AS BIGINT) AS v FROM cells WHERE regexp_matches(value, '^\s*-?\d+\s*$')), s AS (SELECT *, lag(v) OVER (PARTITION BY sheet, col_no ORDER BY row_no, v) AS b FROM i),
    r AS (SELECT sheet, col_no, count(*) AS n_int, coalesce(avg(CASE WHEN b IS NOT NULL THEN CASE WHEN v > b THEN 1.0 ELSE 0 END END), 0) AS rising FROM s GROUP BY ALL), n AS (SELECT sheet, col_no, count(*) AS n FROM cells GROUP BY ALL)
    SELECT sheet, col_no, n, coalesce(n_int, 0) AS n_int, round(coalesce(rising, 0), 6) AS rising, round(coalesce(n_int / n * (0.5 + 0.5 * rising), 0), 6) AS score FROM n LEFT JOIN r USING (sheet, col_no)"""
)
def address_monotonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discover.address_score(cells(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("rising", "score")})


@bank.add(
    f"""WITH {CELLS}, d AS (SELECT sheet, col_no, CAST(value AS BIGINT) - row_no AS d, count(*) AS n FROM cells WHERE regexp_matches(value, '^-?[0-9]+$') GROUP BY ALL)
    SELECT sheet, col_no FROM d GROUP BY ALL HAVING sum(n) >= 2 AND max(n) >= 0.95 * sum(n)"""
)
def row_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discover.row_counters(cells(spark, sf_dir))


ADDRESS = rf"""i AS (SELECT sheet, col_no, row_no, CAST(trim(value) AS BIGINT) AS v FROM cells WHERE regexp_matches(value, '^\s*-?\d+\s*$')), st AS (SELECT *, lag(v) OVER (PARTITION BY sheet, col_no ORDER BY row_no, v) AS b FROM i),
ri AS (SELECT sheet, col_no, count(*) AS n_int, coalesce(avg(CASE WHEN b IS NOT NULL THEN CASE WHEN v > b THEN 1.0 ELSE 0 END END), 0) AS rising FROM st GROUP BY ALL), cn AS (SELECT sheet, col_no, count(*) AS n FROM cells GROUP BY ALL),
sc AS (SELECT sheet, col_no, coalesce(n_int / n * (0.5 + 0.5 * rising), 0) AS score FROM cn LEFT JOIN ri USING (sheet, col_no)),
ct AS (SELECT sheet, col_no FROM (SELECT sheet, col_no, v - row_no AS d, count(*) AS n FROM i GROUP BY ALL) GROUP BY ALL HAVING sum(n) >= 2 AND max(n) >= 0.95 * sum(n)),
rk AS (SELECT sc.*, row_number() OVER (PARTITION BY sheet ORDER BY score DESC, col_no) AS k FROM sc WHERE score > 0 AND NOT EXISTS (SELECT 1 FROM ct WHERE ct.sheet = sc.sheet AND ct.col_no = sc.col_no))"""


@bank.add(f"WITH {CELLS}, {ADDRESS} SELECT sheet, col_no FROM rk WHERE k = 1")
def address_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best address column of each sheet that is no row counter."""
    return discover.address_column(cells(spark, sf_dir))


WIDE = "cells AS (SELECT o_orderpriority AS sheet, o_orderkey AS row_no, unnest([0, 1, 2, 3, 4]) AS col_no, unnest([CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR), CAST(o_orderkey * 2 AS VARCHAR), CAST(o_custkey % 7 AS VARCHAR), CASE WHEN o_custkey % 2 = 0 THEN CAST(o_orderkey % 100 AS VARCHAR) ELSE o_orderstatus END]) AS value FROM orders)"


@bank.add(f"WITH {WIDE}, {ADDRESS} SELECT sheet, col_no, round(score, 6) AS score, k - 1 AS place FROM rk WHERE k BETWEEN 2 AND 6")
def address_competitors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best columns that were not chosen as the address."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    values = F.array(*(c.cast("string") for c in (key, cust, key * 2, cust % 7)), F.when(cust % 2 == 0, (key % 100).cast("string")).otherwise(F.col("o_orderstatus")))
    wide = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("sheet"), key.alias("row_no"), values.alias("cells"))
    return discover.address_competitors(discover.long_cells(wide)).withColumn("score", F.round("score", 6))


@bank.add(
    f"""WITH {CELLS}, h AS (SELECT sheet, col_no, value, upper(value) IN (SELECT DISTINCT o_orderstatus FROM orders) AS hit FROM cells WHERE col_no <> 0),
    g AS (SELECT sheet, col_no, avg(CASE WHEN hit THEN 1.0 ELSE 0 END) AS score, count(DISTINCT CASE WHEN hit THEN upper(value) END) AS n_codes, avg(CASE WHEN regexp_matches(value, '^[0-9.]+$') THEN 1.0 ELSE 0 END) AS numeric FROM h GROUP BY ALL)
    SELECT sheet, col_no, score FROM g WHERE numeric <= 0.8 AND n_codes >= 2 AND score >= 0.3 QUALIFY row_number() OVER (PARTITION BY sheet ORDER BY score DESC, col_no) = 1"""
)
def code_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = table(spark, sf_dir, "orders").select(F.lower("o_orderstatus").alias("code")).distinct()
    return discover.code_column(cells(spark, sf_dir).where("col_no <> 0"), codes)


@bank.add(
    r"""WITH cells AS (SELECT o_custkey AS sheet, o_orderkey AS row_no, unnest([0, 1, 2]) AS col_no, unnest([CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR) || CASE WHEN o_custkey % 3 = 0 THEN '' ELSE '.5' END, o_orderpriority]) AS value FROM orders WHERE o_custkey % 2 = 0 OR o_orderstatus <> 'F'),
    g AS (SELECT sheet, col_no, count(*) AS n, count(*) FILTER (regexp_matches(value, '^\s*-?\d+\s*$')) AS n_int, count(*) FILTER (regexp_matches(value, '[A-Za-z]')) AS n_text FROM cells GROUP BY ALL)
    SELECT g.sheet, bool_or(n_int >= 0.5 * n) AND bool_or(n_text >= 2) AND any_value(r.n_rows) >= 3 AS is_data FROM g JOIN (SELECT sheet, count(DISTINCT row_no) AS n_rows FROM cells GROUP BY sheet) r USING (sheet) GROUP BY g.sheet"""
)
def data_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as sheets: those of fewer than three orders hold no data."""
    o = table(spark, sf_dir, "orders").where("o_custkey % 2 = 0 or o_orderstatus <> 'F'")
    values = F.array(F.col("o_orderkey").cast("string"), F.concat(F.col("o_custkey").cast("string"), F.when(F.col("o_custkey") % 3 == 0, "").otherwise(".5")), "o_orderpriority")
    return discover.is_data_sheet(discover.long_cells(o.select(F.col("o_custkey").alias("sheet"), F.col("o_orderkey").alias("row_no"), values.alias("cells"))))


@bank.add(
    """WITH b AS (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id, event_type) AS p FROM events)
    SELECT CAST(user_id AS VARCHAR) AS sheet, 0 AS col_no, round(CASE WHEN count(*) > 1 THEN 1 - count(*) FILTER (p <> event_type) / (count(*) - 1) ELSE 0 END, 6) AS blocks,
    round(count(DISTINCT CASE WHEN event_type IN ('view', 'click') THEN event_type END) / count(DISTINCT event_type), 6) AS known FROM b GROUP BY user_id"""
)
def module_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("sheet"), F.col("event_id").alias("row_no"), F.lit(0).alias("col_no"), F.col("event_type").alias("value"))
    return discover.block_score(e, ("VIEW", "CLICK")).withColumns({c: F.round(c, 6) for c in ("blocks", "known")})


@bank.add("SELECT event_id, last_value(CASE WHEN event_type IN ('signup', 'error') THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS section FROM events")
def section_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("marker", F.when(F.col("event_type").isin("signup", "error"), F.col("event_type")))
    return e.select("event_id", structure.carry_forward(e, "marker", "user_id", "ts", "event_id").alias("section"))


@bank.add(
    """WITH r AS (SELECT o_orderkey AS id, o_custkey AS sheet, CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS canonical, CASE WHEN o_orderkey % 2 = 0 THEN 'M ' || o_orderkey ELSE '' END AS explicit FROM orders),
    n AS (SELECT sheet, canonical, count(*) AS n FROM r WHERE canonical IS NOT NULL GROUP BY ALL), m AS (SELECT sheet, canonical AS mode FROM (SELECT *, row_number() OVER (PARTITION BY sheet ORDER BY n DESC, canonical) AS k FROM n) WHERE k = 1)
    SELECT id, coalesce(canonical, mode, nullif(replace(explicit, ' ', ''), '')) AS module, CASE WHEN canonical IS NOT NULL THEN 'high' WHEN mode IS NOT NULL THEN 'sheet' WHEN replace(explicit, ' ', '') <> '' THEN 'low' ELSE 'none' END AS confidence FROM r LEFT JOIN m USING (sheet)"""
)
def module_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    canonical = F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority"))
    explicit = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("M "), F.col("o_orderkey").cast("string"))).otherwise("")
    return structure.module_identity(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("sheet"), canonical.alias("canonical"), explicit.alias("explicit")))


@bank.add(
    """SELECT o_custkey AS module, CASE WHEN bool_or(o_orderstatus = 'P') THEN 'Pending' WHEN bool_or(o_orderpriority = '1-URGENT') THEN 'Urgent' ELSE 'Outros' END AS type FROM orders GROUP BY o_custkey"""
)
def module_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("module"), F.array("o_orderstatus", "o_orderpriority").alias("tokens"))
    return structure.module_type(rows.withColumn("module", F.col("module").cast("string")), {"none": "none"}, {"P": "Pending", "1-URGENT": "Urgent"}).withColumn("module", F.col("module").cast("long"))


@bank.add(
    """WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'R' THEN l_suppkey END AS v FROM lineitem), k AS (SELECT l_orderkey, count(DISTINCT v) AS n, min(v) AS one FROM r GROUP BY 1)
    SELECT l_orderkey, l_linenumber, l_partkey, coalesce(v, CASE WHEN n = 1 THEN one END) AS device, n > 1 AS ambiguous FROM r JOIN k USING (l_orderkey)"""
)
def unique_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_returnflag") == "R", F.col("l_suppkey")).alias("device"))
    return structure.fill_unique(rows, "device", "l_orderkey")


@bank.add(
    """WITH r AS (SELECT event_id, user_id, CASE WHEN event_type = 'signup' THEN 'AT' WHEN event_type = 'error' THEN 'BT' END AS side FROM events),
    s AS (SELECT *, CASE WHEN event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) > 150 THEN 1 ELSE 0 END AS new FROM r), i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM s)
    SELECT event_id, CAST(island AS BIGINT) AS island FROM i"""
)
def islands_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.islands(table(spark, sf_dir, "events"), "user_id", "event_id", 150).select("event_id", "island")


@bank.add(
    """WITH r AS (SELECT event_id, user_id, CASE WHEN event_type = 'signup' THEN 'AT' WHEN event_type = 'error' THEN 'BT' END AS side FROM events),
    s AS (SELECT *, CASE WHEN event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) > 5 THEN 1 ELSE 0 END AS new FROM r), i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM s),
    k AS (SELECT user_id, island, count(DISTINCT side) AS n, min(side) AS one FROM i GROUP BY ALL) SELECT event_id, coalesce(side, CASE WHEN n = 1 THEN one END) AS side FROM i JOIN k USING (user_id, island)"""
)
def side_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = F.when(F.col("event_type") == "signup", "AT").when(F.col("event_type") == "error", "BT")
    return structure.spread_side(table(spark, sf_dir, "events").withColumn("side", side), "user_id", "event_id").select("event_id", "side")


# --- group resolution -------------------------------------------------------------------------------------

POINTS = "pt AS (SELECT l_orderkey AS g, l_linenumber AS address, l_linestatus AS polarity, min(l_partkey) * 2 + CASE l_linestatus WHEN 'O' THEN 1 ELSE 0 END AS ord FROM lineitem GROUP BY l_orderkey, l_linenumber, l_linestatus)"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy(F.col("l_orderkey").alias("g"), F.col("l_linenumber").alias("address"), F.col("l_linestatus").alias("polarity")).agg((F.min("l_partkey") * 2 + F.max(F.when(F.col("l_linestatus") == "O", 1).otherwise(0))).alias("ord"))


def _parity(edge: str) -> str:
    return f"""WITH {POINTS}, e AS (SELECT *, {edge} AS nx FROM pt WINDOW w AS (PARTITION BY g ORDER BY address, ord)), f AS (SELECT *, lag(nx) OVER (PARTITION BY g ORDER BY address, ord) AS pv FROM e),
    r AS (SELECT *, sum(CASE WHEN pv IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY g ORDER BY address, ord) AS run FROM f), n AS (SELECT *, row_number() OVER (PARTITION BY g, run ORDER BY address, ord) % 2 = 1 AS head FROM r)"""


FUSE = "CASE WHEN lead(address) OVER w = address + 1 AND lead(polarity) OVER w <> polarity THEN 'fuse' END"


@bank.add(
    _parity(FUSE) + " SELECT g, address, polarity, ord, CASE WHEN head AND nx IS NOT NULL THEN 'head' WHEN NOT head THEN 'tail' ELSE 'single' END AS role, CASE WHEN head AND nx IS NOT NULL THEN address || ',' || (address + 1) ELSE CAST(address AS VARCHAR) END AS indices FROM n"
)
def fuse_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve.fuse_positions(points(spark, sf_dir), ["g"])
    return found.select("g", "address", "polarity", "ord", "role", F.array_join(F.transform("indices", lambda i: i.cast("string")), ",").alias("indices"))


@bank.add(
    _parity(FUSE.replace("END", "WHEN lead(address) OVER w = address THEN 'dup' END"))
    + " SELECT g, address, polarity, ord, CASE WHEN (head AND nx = 'dup') OR (NOT head AND pv = 'dup') THEN 'duplicate_address' WHEN head AND nx = 'fuse' THEN 'fused' WHEN NOT head AND pv = 'fuse' THEN 'absorbed' ELSE 'independent' END AS status FROM n"
)
def structural_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.correct(points(spark, sf_dir), ["g"]).select("g", "address", "polarity", "ord", "status")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as records with a key of their own: a hash of the row and its turn among equal rows."""
    lines = table(spark, sf_dir, "lineitem")
    turn = F.row_number().over(W.partitionBy(*lines.columns).orderBy(F.lit(0)))
    return lines.withColumn("id", F.concat_ws("-", F.xxhash64(*lines.columns).cast("string"), turn.cast("string")))


@bank.add(
    """WITH r AS (SELECT l_orderkey AS module, l_partkey % 3 AS code, CASE l_linestatus WHEN 'O' THEN 'Output' ELSE 'Input' END AS direction FROM lineitem), k AS (SELECT *, count(*) FILTER (direction = 'Input') OVER w AS i, count(*) FILTER (direction = 'Output') OVER w AS o FROM r WINDOW w AS (PARTITION BY module, code))
    SELECT module, code, direction, count(*) AS n, CASE WHEN o = 0 THEN 'passes' WHEN i = 0 THEN 'command_without_status' WHEN i = 1 AND o = 1 THEN 'paired' ELSE 'ambiguous' END AS status FROM k GROUP BY ALL"""
)
def pair_one_to_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir).select("id", F.col("l_orderkey").alias("module"), (F.col("l_partkey") % 3).alias("code"), F.when(F.col("l_linestatus") == "O", "Output").otherwise("Input").alias("direction"))
    found = resolve.pair_one_to_one(r, ["module", "code"])
    return found.groupBy("module", "code", "direction", "status").agg(F.count("*").alias("n"))


MATCH = f"""k AS (SELECT DISTINCT o.text AS a, i.text AS b FROM r o JOIN r i ON o.g = i.g AND o.direction = 'Output' AND i.direction = 'Input'), sc AS (SELECT a, b, {indel_sql("a", "b")} AS s FROM k),
    e AS (SELECT o.g, o.id AS o, i.id AS i, s, row_number() OVER (PARTITION BY o.g ORDER BY s DESC, o.ord DESC, o.id DESC, i.ord DESC, i.id DESC) AS k FROM r o JOIN r i ON o.g = i.g AND o.direction = 'Output' AND i.direction = 'Input' JOIN sc ON a = o.text AND b = i.text WHERE s >= 60),
    t AS (SELECT g, k, o, i, s, [o, i] AS used FROM e WHERE k = 1
      UNION ALL SELECT g, k, o, i, s, used FROM (SELECT e.g, e.k, e.o, e.i, e.s, t.used || [e.o, e.i] AS used, row_number() OVER (PARTITION BY e.g ORDER BY e.k) AS turn FROM t JOIN e ON e.g = t.g AND e.k > t.k AND NOT list_contains(t.used, e.o) AND NOT list_contains(t.used, e.i)) WHERE turn = 1),
    p AS (SELECT o AS id, i AS partner, s FROM t UNION ALL SELECT i, o, s FROM t) SELECT r.id, partner, round(s, 6) AS score FROM r LEFT JOIN p USING (id)"""


@bank.add(
    f"""WITH RECURSIVE l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey, l_linestatus ORDER BY l_extendedprice, l_suppkey, l_shipdate) AS turn FROM lineitem),
    q AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_linestatus || '-' || turn AS id, l_orderkey || '/' || l_partkey % 3 AS g, CASE l_linestatus WHEN 'O' THEN 'Output' ELSE 'Input' END AS direction, l_partkey AS ord,
      array_to_string(list_sort(string_split(p_name || ' ' || p_type, ' ')), ' ') AS text FROM l JOIN part ON p_partkey = l_partkey),
    n AS (SELECT *, count(*) FILTER (direction = 'Input') OVER w AS n_in, count(*) FILTER (direction = 'Output') OVER w AS n_out FROM q WINDOW w AS (PARTITION BY g)), r AS (SELECT id, g, direction, ord, text FROM n WHERE n_in > 0 AND n_out > 0 AND n_in + n_out > 2), {MATCH}"""
)
def pair_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ambiguous groups of an order's lines, matched by the similarity of part names."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.concat_ws(" ", "p_name", "p_type").alias("text"))
    own = ["l_orderkey", "l_linenumber", "l_partkey", "l_linestatus"]
    turn = F.row_number().over(W.partitionBy(*own).orderBy("l_extendedprice", "l_suppkey", "l_shipdate"))
    r = table(spark, sf_dir, "lineitem").withColumn("id", F.concat_ws("-", *own, turn.cast("string"))).join(part, "l_partkey")
    r = r.select("id", F.col("l_orderkey").alias("module"), (F.col("l_partkey") % 3).alias("code"), F.when(F.col("l_linestatus") == "O", "Output").otherwise("Input").alias("direction"), "text", F.col("l_partkey").alias("ord"))
    ambiguous = resolve.pair_one_to_one(r, ["module", "code"]).where("status = 'ambiguous'")
    return resolve.pair_greedy(ambiguous, ["module", "code"]).withColumn("score", F.round("score", 6))


@bank.add(
    """WITH r AS (SELECT l_orderkey AS module, l_partkey, l_linenumber, l_suppkey, CASE l_linestatus WHEN 'O' THEN 'Output' ELSE 'Input' END AS direction, CASE l_partkey % 3 WHEN 0 THEN 'DJF1' WHEN 1 THEN 'SECC' ELSE 'REL' END AS code FROM lineitem),
    k AS (SELECT module, count(DISTINCT code) AS n, min(code) AS one, list(DISTINCT code) AS codes FROM r WHERE direction = 'Input' AND code <> 'REL' GROUP BY module)
    SELECT module, l_partkey, l_linenumber, l_suppkey, direction, CASE WHEN direction = 'Output' AND code <> 'REL' AND n = 1 THEN one ELSE code END AS code, CASE WHEN direction = 'Output' AND code <> 'REL' AND n > 1 AND NOT list_contains(codes, code) THEN 'position_divergent' END AS reason FROM r LEFT JOIN k USING (module)"""
)
def reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.when(F.col("l_partkey") % 3 == 0, "DJF1").when(F.col("l_partkey") % 3 == 1, "SECC").otherwise("REL")
    r = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("module"), "l_partkey", "l_linenumber", "l_suppkey", F.when(F.col("l_linestatus") == "O", "Output").otherwise("Input").alias("direction"), code.alias("code"))
    return resolve.reconcile(r, ["module"], x.t.POSITION_CODES)


@bank.add(
    """WITH r AS (SELECT o_orderkey AS id, o_custkey AS module, CASE o_orderstatus WHEN 'F' THEN 'on' WHEN 'O' THEN 'off' END AS p FROM orders), k AS (SELECT *, count(*) FILTER (p = 'on') OVER w AS n_on, count(*) FILTER (p = 'off') OVER w AS n_off FROM r WINDOW w AS (PARTITION BY module))
    SELECT id, CASE WHEN n_on = 1 AND n_off = 1 AND p IS NOT NULL THEN 'DJF1' ELSE 'OLD' END AS code FROM k"""
)
def polarity_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.when(F.col("o_orderstatus") == "F", "Disjuntor fechado").when(F.col("o_orderstatus") == "O", "Disjuntor aberto").otherwise("Disjuntor")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("module"), F.lit("Disjuntor").alias("family"), F.lit("52-1").alias("device"), said.alias("text"), F.lit("Input").alias("direction"), F.lit("OLD").alias("code"))
    return resolve.force_polarity(rows).select("id", "code")


@bank.add("SELECT CAST(o_orderkey AS VARCHAR) AS id, 'Input' AS direction, o_custkey AS idx FROM orders UNION ALL SELECT o_orderkey || ':out', 'Output', o_custkey + 1 FROM orders")
def unfuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.array("o_custkey").alias("indices"), F.array(F.col("o_custkey") + 1).alias("output_indices"))
    return resolve.unfuse(pairs).select("id", "direction", F.col("indices")[0].alias("idx"))


# --- gates ------------------------------------------------------------------------------------------------


@bank.add(
    """WITH k AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_orderkey || '-' || l_linenumber AS cid, count(*) OVER w AS n, min(l_returnflag) OVER w <> max(l_returnflag) OVER w AS several FROM lineitem WINDOW w AS (PARTITION BY l_orderkey, l_linenumber))
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN n > 1 THEN CASE WHEN several THEN 'module_in_several_sheets' ELSE 'duplicate_custom_id' END END AS reason FROM k"""
)
def gate_custom_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("cid", F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")))
    return gates.unique_id(rows, "cid", "l_returnflag").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "reason")


ADDRESSES = """a AS (SELECT l_orderkey AS module, l_linestatus AS category, 'in' AS space, l_linenumber AS idx, l_partkey AS id FROM lineitem UNION ALL SELECT l_orderkey, l_linestatus, 'out', l_linenumber + 1, l_partkey FROM lineitem),
bad AS (SELECT module, category, space, idx, list_sort(list(DISTINCT id)) AS ids FROM a GROUP BY ALL HAVING count(DISTINCT id) > 1)"""


def addressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_orderkey").alias("module"), F.col("l_linestatus").alias("category"), F.lit("Input").alias("direction"), F.array("l_linenumber").alias("indices"), F.array(F.col("l_linenumber") + 1).alias("output_indices"))


@bank.add(f"WITH {ADDRESSES} SELECT module, category, space, idx, array_to_string(ids, ',') AS ids FROM bad")
def duplicate_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = gates.duplicate_addresses(addressed(spark, sf_dir))
    return found.withColumn("ids", F.array_join(F.transform("ids", lambda i: i.cast("string")), ","))


@bank.add(f"WITH {ADDRESSES}, b AS (SELECT DISTINCT unnest(ids) AS id FROM bad) SELECT l_partkey AS id, count(*) AS n, l_partkey IN (SELECT id FROM b) AS review FROM lineitem GROUP BY l_partkey")
def gate_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, review = gates.address_gate(addressed(spark, sf_dir))
    return kept.select("id", F.lit(False).alias("review")).union(review.select("id", F.lit(True))).groupBy("id", "review").agg(F.count("*").alias("n"))


@bank.add("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_returnflag <> 'N' AND count(*) FILTER (l_returnflag <> 'N') OVER (PARTITION BY l_suppkey, l_partkey) > 1 THEN 'duplicate_type' END AS reason FROM lineitem")
def gate_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.type_gate(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_partkey", F.col("l_returnflag") == "N").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "reason")


_KINDS, _GATED = ("Status", "Local", None, "Custom", "Alarm"), ("43LR", "43TC", "86", "27")


@bank.add(
    f"""WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_suppkey % 50 * 10 + l_partkey % 10 AS device, CASE WHEN l_linestatus = 'O' THEN 'Discrete' ELSE 'Analog' END AS category, (['Status', 'Local', NULL, 'Custom', 'Alarm'])[CAST(l_orderkey % 5 AS INTEGER) + 1] AS kind,
      ({list(_GATED)})[CAST(l_partkey % 4 AS INTEGER) + 1] AS code, l_returnflag = 'R' AS protection FROM lineitem),
    k AS (SELECT *, coalesce(kind, 'Custom') <> 'Custom' AND code <> '43LR' AND NOT protection AND category = 'Discrete' AS due FROM r)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN due AND count(*) FILTER (due) OVER (PARTITION BY device, coalesce(kind, 'Custom')) > 1 THEN 'duplicate_type' END AS reason FROM k"""
)
def gate_discrete_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Devices with one type of discrete signal twice; 43LR, Custom and protection signals may repeat."""
    at = lambda values, c: F.element_at(F.array(*(F.lit(v).cast("string") for v in values)), (F.col(c) % len(values) + 1).cast("int"))
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    rows = table(spark, sf_dir, "lineitem").select(
        *keys, (F.col("l_suppkey") % 50 * 10 + F.col("l_partkey") % 10).alias("device"), F.when(F.col("l_linestatus") == "O", "Discrete").otherwise("Analog").alias("category"),
        at(_KINDS, "l_orderkey").alias("signal_type"), at(_GATED, "l_partkey").alias("code"), (F.col("l_returnflag") == "R").alias("protection"),
    )
    return gates.discrete_type_gate(rows).select(*keys, "reason")


@bank.add(
    """WITH r AS (SELECT o_custkey AS id, CASE WHEN o_orderkey % 97 = 0 THEN ' ' ELSE o_orderpriority END AS name, CASE WHEN o_orderkey % 50 = 0 THEN 'X_CMD' ELSE o_orderstatus END AS code, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus || o_orderkey % 7 END AS mm FROM orders)
    SELECT 'repeated_id' AS check, count(*) AS n FROM (SELECT id FROM r GROUP BY id HAVING count(*) > 1) UNION ALL SELECT 'outside_domain', count(*) FROM r WHERE mm NOT IN (SELECT 'F' || n_nationkey FROM nation)
    UNION ALL SELECT 'nameless', count(*) FROM r WHERE trim(name) = '' UNION ALL SELECT 'bare_command', count(*) FROM r WHERE ends_with(code, '_CMD')"""
)
def acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many output rows break each rule of acceptance."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("id"), F.lit("Discrete").alias("table"), F.when(k % 97 == 0, " ").otherwise(F.col("o_orderpriority")).alias("name"), F.when(k % 50 == 0, "X_CMD").otherwise(F.col("o_orderstatus")).alias("code"),
        F.when(k % 3 == 0, F.concat("o_orderstatus", (k % 7).cast("string"))).alias("mm"),
    )
    return gates.acceptance(rows, table(spark, sf_dir, "nation").select(F.concat(F.lit("F"), F.col("n_nationkey").cast("string")).alias("value")))


@bank.add("SELECT l_linestatus AS table, l_returnflag AS datatype, CAST(l_linenumber AS VARCHAR) AS direction, count(*) AS n FROM lineitem GROUP BY ALL")
def output_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.shapes(table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("table"), F.col("l_returnflag").alias("datatype"), F.col("l_linenumber").cast("string").alias("direction")))


@bank.add("SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def companion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.without_companion(table(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus", "P", "F")


@bank.add("SELECT o_custkey, CASE WHEN count(DISTINCT o_orderpriority) = 1 THEN min(o_orderpriority) END AS o_orderpriority FROM orders GROUP BY o_custkey")
def single_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.only_one(table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority")


@bank.add(
    """WITH b AS (SELECT o_orderkey AS id, o_orderstatus AS s, CAST(o_custkey AS VARCHAR) AS c, CASE WHEN o_orderkey % 2 = 0 THEN 'X' ELSE o_orderstatus END AS s2, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_custkey AS VARCHAR) END AS c2 FROM orders)
    SELECT id, 'status' AS field, s AS old, s2 AS new, 'INFO' AS level FROM b WHERE s <> s2 UNION ALL SELECT id, 'cust', c, c2, 'WARN' FROM b WHERE c2 IS NULL"""
)
def identity_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("cust"))
    after = before.select("id", F.when(F.col("id") % 2 == 0, "X").otherwise(F.col("status")).alias("status"), F.when(F.col("id") % 3 != 0, F.col("cust")).alias("cust"))
    return gates.identity_diff(before, after, ["status", "cust"])


@bank.add("SELECT p_partkey, p_brand FROM part WHERE p_brand NOT IN (SELECT 'Brand#' || n_nationkey FROM nation)")
def domain_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    domain = table(spark, sf_dir, "nation").select(F.concat(F.lit("Brand#"), F.col("n_nationkey").cast("string")).alias("value"))
    return gates.outside_domain(table(spark, sf_dir, "part"), "p_brand", domain).select("p_partkey", "p_brand")


@bank.add("SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '5-LOW'")
def conservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that two stages lose, as the check of conservation finds them."""
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "id")
    return gates.conserved(o, o.where("o_orderstatus <> 'P'"), o.where("o_orderpriority <> '5-LOW'"))


# --- output tables ----------------------------------------------------------------------------------------

#: Every line is a record: its keys choose module, device, bus, code, direction and the rest.
RECORDS = """
rec AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id, CASE l_orderkey % 4 WHEN 0 THEN 'AL ' || l_orderkey % 50 WHEN 1 THEN 'LT' || l_orderkey % 9 WHEN 2 THEN 'TR 1' END AS module,
  CASE l_suppkey % 5 WHEN 0 THEN '52-' || l_suppkey WHEN 1 THEN '89-' || l_suppkey WHEN 2 THEN 'TR2' END AS device, CASE l_partkey % 3 WHEN 0 THEN 'Principal' WHEN 1 THEN 'Auxiliar' END AS bus,
  CASE l_partkey % 7 WHEN 0 THEN '51N' WHEN 1 THEN 'DJF1' WHEN 2 THEN '67N1' WHEN 3 THEN 'SECC' WHEN 4 THEN '79' WHEN 5 THEN 'IA' END AS code, 'TEXTO ' || l_partkey AS text,
  CASE l_partkey % 7 WHEN 0 THEN 'SOBRECORRENTE' WHEN 2 THEN '' END AS alias, CASE l_suppkey % 4 WHEN 0 THEN 'CA' WHEN 1 THEN 'A' WHEN 2 THEN 'XY' END AS phase,
  CASE l_returnflag WHEN 'A' THEN 'Output' WHEN 'N' THEN 'InputOutput' ELSE 'Input' END AS direction, CASE WHEN l_linenumber % 2 = 0 THEN 'MultiCoord' ELSE 'SingleBit' END AS datatype,
  CASE WHEN l_linenumber % 2 = 0 THEN [l_linenumber, l_linenumber + 1] ELSE [l_linenumber] END AS indices, CASE l_suppkey % 3 WHEN 0 THEN [l_linenumber + 9] WHEN 1 THEN [l_linenumber, l_linenumber + 9] ELSE [] END AS output_indices,
  l_partkey % 2 = 0 AS double, CASE l_partkey % 7 WHEN 2 THEN 'RelayTrip' WHEN 1 THEN 'SwitchStatus' END AS signal_type, CASE WHEN l_partkey % 5 = 0 THEN 'MM' END AS mm,
  CASE l_partkey % 4 WHEN 0 THEN 'ALARME;NORMAL' WHEN 1 THEN 'NORMAL' WHEN 2 THEN 'A;B' END AS states, CASE WHEN l_partkey % 8 = 0 THEN [3] ELSE [3, 7] END AS vals, CASE WHEN l_orderkey % 3 = 0 THEN '52-9' END AS breaker,
  CASE l_partkey % 6 WHEN 0 THEN 'Corrente' WHEN 1 THEN 'Tensão' WHEN 2 THEN ' temperatura' WHEN 3 THEN 'Outra' END AS measure, CASE l_suppkey % 3 WHEN 0 THEN 'valor medido' WHEN 1 THEN 'Other' END AS kind,
  CASE l_partkey % 3 WHEN 0 THEN '-' WHEN 1 THEN 'kV' END AS unit, CASE WHEN l_partkey % 2 = 0 THEN 9 END AS normal, CASE WHEN l_suppkey % 2 = 0 THEN 'Status' ELSE '' END AS point_type, CASE WHEN l_partkey % 3 = 1 THEN 'COMTAP' END AS device_code FROM lineitem),
n AS (SELECT *, replace(module, ' ', '') AS m, CASE bus WHEN 'Principal' THEN 'P' WHEN 'Auxiliar' THEN 'A' END AS b, coalesce(regexp_matches(upper(replace(module, ' ', '')), '^AL[0-9]'), false) AS feeder,
  concat_ws('_', 'STA', replace(module, ' ', ''), coalesce(device, replace(module, ' ', '')), CASE bus WHEN 'Principal' THEN 'P' WHEN 'Auxiliar' THEN 'A' END) AS base FROM rec),
p AS (SELECT *, concat_ws('_', base, coalesce(code, '?')) AS name, CASE CASE WHEN phase = 'CA' THEN 'AC' ELSE phase END WHEN 'AC' THEN 'AC' WHEN 'A' THEN 'A' ELSE 'ABC' END AS ph, 'STA ' || CASE WHEN feeder THEN 'Distr' ELSE 'Trans' END AS aor,
  CASE WHEN code IS NOT NULL THEN coalesce(nullif(alias, ''), text) ELSE text END AS al, array_to_string(indices, ';') AS ic FROM n)"""

_SHARED = """name AS "Signal Name", al AS "Signal Alias", ph AS "Phases", 'None' AS "Side", name AS "Remote Point Name", aor AS "Signal AOR Group", 'UTR_STA_1' AS "Remote Unit", name || '_UTR_STA_1' AS "Remote Point Custom ID",
      '20260101' AS "Remote Point Alias" """


def output_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    def case(column: str, n: int, *values: Column | str | None) -> Column:
        chain = F.when(F.lit(False), F.lit(""))
        for k, v in enumerate(values):
            chain = chain if v is None else chain.when(F.col(column) % n == k, F.lit(v))
        return chain

    text = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    line, none = F.col("l_linenumber"), F.array().cast("array<int>")
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", *(F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))).alias("id"),
        case("l_orderkey", 4, text("AL ", F.col("l_orderkey") % 50), text("LT", F.col("l_orderkey") % 9), "TR 1").alias("module"),
        case("l_suppkey", 5, text("52-", F.col("l_suppkey")), text("89-", F.col("l_suppkey")), "TR2").alias("device"), case("l_partkey", 3, "Principal", "Auxiliar").alias("bus"),
        case("l_partkey", 7, "51N", "DJF1", "67N1", "SECC", "79", "IA").alias("code"), text("TEXTO ", F.col("l_partkey")).alias("text"), case("l_partkey", 7, "SOBRECORRENTE", None, "").alias("alias"),
        case("l_suppkey", 4, "CA", "A", "XY").alias("phase"), F.when(F.col("l_returnflag") == "A", "Output").when(F.col("l_returnflag") == "N", "InputOutput").otherwise("Input").alias("direction"),
        F.when(line % 2 == 0, "MultiCoord").otherwise("SingleBit").alias("datatype"), F.when(line % 2 == 0, F.array(line, line + 1)).otherwise(F.array(line)).alias("indices"),
        F.when(F.col("l_suppkey") % 3 == 0, F.array(line + 9)).when(F.col("l_suppkey") % 3 == 1, F.array(line, line + 9)).otherwise(none).alias("output_indices"),
        (F.col("l_partkey") % 2 == 0).alias("double"), case("l_partkey", 7, None, "SwitchStatus", "RelayTrip").alias("signal_type"), F.when(F.col("l_partkey") % 5 == 0, "MM").alias("mm"),
        case("l_partkey", 4, "ALARME;NORMAL", "NORMAL", "A;B").alias("states"), F.when(F.col("l_partkey") % 8 == 0, F.array(F.lit(3))).otherwise(F.array(F.lit(3), F.lit(7))).alias("values"),
        F.when(F.col("l_orderkey") % 3 == 0, "52-9").alias("breaker"), case("l_partkey", 6, "Corrente", "Tensão", " temperatura", "Outra").alias("measure"), case("l_suppkey", 3, "valor medido", "Other").alias("kind"),
        case("l_partkey", 3, "-", "kV").alias("unit"), F.when(F.col("l_partkey") % 2 == 0, 9).alias("normal"), F.when(F.col("l_suppkey") % 2 == 0, "Status").otherwise("").alias("point_type"),
        F.when(F.col("l_partkey") % 3 == 1, "COMTAP").alias("device_code"),
    )


@bank.add(
    f"""WITH {RECORDS}, w AS (SELECT *, CASE WHEN direction = 'Output' THEN CASE WHEN len(indices) = 1 AND double THEN ic || ';' || ic ELSE ic END
        WHEN direction = 'InputOutput' AND len(output_indices) > 0 THEN CASE WHEN len(output_indices) = 1 AND double THEN output_indices[1] || ';' || output_indices[1] ELSE array_to_string(output_indices, ';') END END AS oc,
      coalesce(signal_type = 'RelayTrip', false) OR coalesce(code = '51N', false) AS prot, CASE WHEN starts_with(device, '52-') THEN 'DJ' WHEN starts_with(device, '89-') THEN 'SEC' WHEN device = 'TR2' THEN 'TR' END AS sf FROM p)
    SELECT id, {_SHARED}, 'Status' AS "Measurement Type", coalesce(signal_type, 'Custom') AS "Signal Type", false AS "Output Register", 'Status' AS "Remote Point Type",
      CASE WHEN prot THEN concat_ws('_', 'STA', m, coalesce(CASE WHEN feeder THEN breaker END, m), b, 'PROT_' || coalesce(code, '?')) WHEN sf IS NOT NULL AND b IS NULL THEN base || '_' || sf ELSE base END AS "Device Mapping",
      CASE direction WHEN 'Output' THEN 'Write' WHEN 'InputOutput' THEN 'ReadWrite' ELSE 'Read' END AS "Direction", mm AS "Message Mapping", datatype AS "Input Data Type", CASE WHEN direction <> 'Output' THEN ic END AS "Input Coordinates",
      CASE WHEN oc IS NOT NULL THEN CASE WHEN len(list_distinct(string_split(oc, ';'))) = 1 THEN 'SingleCoord' ELSE 'MultiCoord' END END AS "Output Data Type", oc AS "Output Coordinates",
      CASE WHEN list_position(string_split(states, ';'), 'NORMAL') > 0 THEN vals[list_position(string_split(states, ';'), 'NORMAL')] END AS "Normal Value" FROM w"""
)
def project_discrete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project.discrete(output_records(spark, sf_dir), F.lit("STA"), "20260101")


@bank.add(
    f"""WITH {RECORDS} SELECT id, {_SHARED}, ic AS "Input Coordinates", CASE kind WHEN 'valor medido' THEN 'MeasuredValue' WHEN 'Other' THEN 'Other' ELSE 'Custom' END AS "Signal Type", 'Read' AS "Direction", false AS "Output Register", 'Analog' AS "Remote Point Type",
      concat_ws('_', 'STA', m, CASE measure WHEN 'Corrente' THEN concat_ws('_', m, 'TC') WHEN 'Tensão' THEN concat_ws('_', m, 'TP') ELSE coalesce(breaker || '_DJ', m) END) AS "Device Mapping",
      CASE measure WHEN 'Corrente' THEN 'Current' WHEN 'Tensão' THEN 'Voltage' WHEN ' temperatura' THEN 'Temperature' END AS "Measurement Type", CASE WHEN unit <> '-' THEN unit END AS "Display Unit" FROM p"""
)
def project_analog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project.analog(output_records(spark, sf_dir), F.lit("STA"), "20260101")


@bank.add(
    f"""WITH {RECORDS} SELECT id, {_SHARED}, ic AS "Input Coordinates", 'Discrete' AS "Measurement Type", coalesce(signal_type, 'Custom') AS "Signal Type", 'Read' AS "Direction", normal AS "Normal Value",
      CASE WHEN device_code IS NOT NULL AND code IS NOT NULL THEN base || '_' || device_code ELSE name END AS "Device Mapping", coalesce(nullif(point_type, ''), 'Analog') AS "Remote Point Type" FROM p"""
)
def project_discrete_analog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project.discrete_analog(output_records(spark, sf_dir), F.lit("STA"), "20260101")


@bank.add("SELECT CASE o_orderstatus WHEN 'F' THEN 'Discrete' WHEN 'O' THEN 'Analog' ELSE 'DiscreteAnalog' END AS category, count(*) AS n FROM orders GROUP BY ALL")
def split3(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("o_orderstatus")
    parts = project.split_by_category(table(spark, sf_dir, "orders").withColumn("category", F.when(s == "F", "Discrete").when(s == "O", "Analog").otherwise("DiscreteAnalog")))
    counts = [frame.groupBy("category").agg(F.count("*").alias("n")) for frame in parts.values()]
    return counts[0].union(counts[1]).union(counts[2])
