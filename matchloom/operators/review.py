"""Review as data: an overlay of edits on records. Edits are rows (version, id, field, value); the last version of a field wins."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.functions import text as x


def select(rows: DataFrame, status: str | None = None, sheet: str | None = None, within: dict[str, list[str]] | None = None, contains: dict[str, str] | None = None, anywhere: str | None = None) -> DataFrame:
    """All conditions at once; ``anywhere`` looks into every text column without regard to case."""
    checks: list[Column] = []
    checks += [F.col("status") == status] if status else []
    checks += [F.col("sheet") == sheet] if sheet else []
    checks += [F.col(c).isin(*v) for c, v in (within or {}).items()]
    checks += [F.contains(F.lower(c), F.lit(v.lower())) for c, v in (contains or {}).items()]
    if anywhere:
        texts = [c for c, kind in rows.dtypes if kind == "string"]
        checks.append(reduce(lambda a, b: a | b, (F.coalesce(F.contains(F.lower(c), F.lit(anywhere.lower())), F.lit(False)) for c in texts)))
    return rows.where(reduce(lambda a, b: a & b, checks)) if checks else rows


def values_of(rows: DataFrame, column: str) -> DataFrame:
    return rows.select(column).distinct().orderBy(column)


def edited(rows: DataFrame, edits: DataFrame, fields: list[str], key: str = "id", before: int | None = None) -> DataFrame:
    """``rows`` with the last value of each edited field; ``before`` undoes versions from that one on."""
    due = edits if before is None else edits.where(F.col("version") < before)
    last = due.groupBy(key).agg(*(F.max(F.when(F.col("field") == f, F.struct("version", "value"))).alias(f"__{f}") for f in fields))
    joined = rows.join(last, key, "left")
    return joined.select(*(F.when(F.col(f"__{c}").isNotNull(), F.col(f"__{c}.value").cast(rows.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in rows.columns))


def valid_address(value: Column) -> Column:
    return value.try_cast("int").between(0, 65535)


def validated(edits: DataFrame, checks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """``edits`` with ``valid``: whether the check of its field holds for the value. A field without a check is not editable; a check that is null fails, and null as a value clears the field."""
    ok = F.when(F.lit(False), False)
    for field, check in checks.items():
        ok = ok.when(F.col("field") == field, F.col("value").isNull() | F.coalesce(check(F.col("value")), F.lit(False)))
    return edits.withColumn("valid", F.coalesce(ok.otherwise(False), F.lit(False)))


def edited_if_valid(rows: DataFrame, edits: DataFrame, checks: dict[str, Callable[[Column], Column]], key: str = "id", before: int | None = None) -> DataFrame:
    """``rows`` with the last valid value of each field that has a check; an invalid edit leaves what was there before it."""
    return edited(rows, validated(edits, checks).where("valid").drop("valid"), list(checks), key, before)


def ranges(places: DataFrame, by: str, place: str) -> DataFrame:
    """(by, first, last, n): runs of consecutive places of each group; a place that occurs twice counts once."""
    different = places.select(by, F.col(place).alias("at")).where("at is not null").distinct()
    run = F.col("at") - F.row_number().over(Window.partitionBy(by).orderBy("at"))
    return different.withColumn("run", run).groupBy(by, "run").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count("*").alias("n")).drop("run")


def removed(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return rows.join(ids.select(key), key, "left_anti")


def added(rows: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """``rows`` and those of ``new`` whose key is not there yet; columns that ``new`` lacks are null."""
    return rows.unionByName(new.join(rows.select(key), key, "left_anti"), allowMissingColumns=True)


def ordered(rows: DataFrame, column: str, descending: bool = False, key: str = "id") -> DataFrame:
    """All rows by a column, nulls last, ties by the key."""
    return rows.orderBy(F.desc_nulls_last(column) if descending else F.asc_nulls_last(column), key)


def approved(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """The rows of ``ids`` are decided with the code they have, else with their best candidate's; without either they stay."""
    code = F.coalesce("code", "top_code")
    held = rows.join(ids.select(key).distinct().withColumn("__due", F.lit(True)), key, "left")
    due = F.coalesce("__due", F.lit(False)) & code.isNotNull()
    changed = {"code": F.when(due, code).otherwise(F.col("code")), "status": F.when(due, "decided").otherwise(F.col("status"))}
    return held.select(*(changed[c].alias(c) if c in changed else F.col(c) for c in rows.columns))


def of_modules(rows: DataFrame, modules: list[str | None]) -> DataFrame:
    """Rows of the named modules; None stands for rows without one."""
    named = [m for m in modules if m is not None]
    inside = F.coalesce(F.col("module").isin(*named), F.lit(False)) if named else F.lit(False)
    return rows.where((inside | F.col("module").isNull()) if None in modules else inside)


def suggestions(rows: DataFrame, module: str | None, column: str = "device") -> DataFrame:
    """The values of ``column`` that rows of the same module have, in order."""
    return rows.where(F.col("module").eqNullSafe(F.lit(module)) & F.col(column).isNotNull() & (F.col(column) != "")).select(column).distinct().orderBy(column)


def pair_action(selected: DataFrame) -> DataFrame:
    """One row (action): pair one Input and one Output, split one pair, or refuse."""
    way = lambda d: F.count_if(F.col("direction") == d)
    n = F.count("*")
    action = F.when((n == 1) & (way("InputOutput") == 1), "split").when((n == 2) & (way("Input") == 1) & (way("Output") == 1), "pair").otherwise("refuse")
    return selected.agg(action.alias("action"))


def formed_pairs(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(a, b, code, id, indices, problem) of wanted position pairs (a, b, code): one module, one device and one address each; the lower address leads."""
    one = lambda n: rows.select(F.col("id").alias(n), F.col("module").alias(f"m_{n}"), F.col("device").alias(f"d_{n}"), F.col("indices").alias(f"i_{n}"))
    both = wanted.join(one("a"), "a", "left").join(one("b"), "b", "left")
    problem = (
        F.when(F.col("i_a").isNull() | F.col("i_b").isNull(), "not_found").when(~F.col("m_a").eqNullSafe(F.col("m_b")), "other_module")
        .when(~F.col("d_a").eqNullSafe(F.col("d_b")), "other_device").when((F.size("i_a") != 1) | (F.size("i_b") != 1), "several_addresses")
    )
    first = F.get("i_a", F.lit(0)) <= F.get("i_b", F.lit(0))
    good = problem.isNull()
    return both.select("a", "b", "code", F.when(good, F.when(first, F.col("a")).otherwise(F.col("b"))).alias("id"), F.when(good, F.when(first, F.concat("i_a", "i_b")).otherwise(F.concat("i_b", "i_a"))).alias("indices"), problem.alias("problem"))


def split_pairs(rows: DataFrame, position_codes: tuple[str, ...]) -> DataFrame:
    """(id, part, idx, problem): the two Inputs of each position pair (id, code, direction, datatype, indices), or why it can't be split."""
    problem = (
        F.when(F.col("direction") == "InputOutput", "has_command")
        .when((F.col("direction") != "Input") | (F.col("datatype") != "MultiCoord") | (F.size("indices") != 2), "no_pair").when(~F.coalesce(F.upper("code").isin(*position_codes), F.lit(False)), "no_position")
    )
    marked = rows.select("id", F.posexplode(F.when(problem.isNull(), F.col("indices")).otherwise(F.array(F.lit(None).cast("int")))).alias("part", "idx"), problem.alias("problem"))
    return marked


def swapped_codes(rows: DataFrame, codes: DataFrame, position_codes: tuple[str, ...]) -> DataFrame:
    """``rows`` with the position codes of ``codes`` (id, new_code); other codes change nothing."""
    good = codes.where(F.upper("new_code").isin(*position_codes)).select("id", "new_code")
    held = rows.join(good, "id", "left")
    new = {"code": F.coalesce("new_code", "code"), "status": F.when(F.col("new_code").isNotNull(), "decided").otherwise(F.col("status"))}
    return held.select(*(new[c].alias(c) if c in new else F.col(c) for c in rows.columns))


def shown(rows: DataFrame) -> DataFrame:
    """Display columns of records (id, text, code, indices, output_indices, direction, score, status)."""
    listed = lambda c: F.array_join(F.transform(c, lambda i: i.cast("string")), ";")
    place = F.when(F.size("output_indices") > 0, F.concat(listed("indices"), F.lit(" / "), listed("output_indices"))).otherwise(listed("indices"))
    return rows.select(
        "id", x.display_text(F.col("text"), F.col("code")).alias("description"), F.coalesce("code", F.lit("")).alias("code"), place.alias("addresses"),
        F.coalesce(F.concat(F.round(F.col("score") * 100).cast("int").cast("string"), F.lit("%")), F.lit("")).alias("confidence"), F.when(F.col("status") == "decided", "ok").otherwise("pending").alias("state"),
    )


def checked_weights(weights: dict[str, float]) -> dict[str, float]:
    """The weights, if they add to 1."""
    if abs(sum(weights.values()) - 1) > 0.001:
        raise ValueError(f"the weights add to {sum(weights.values()):.3f}, not to 1")
    return weights


def auto_approved(rows: DataFrame, threshold: float) -> DataFrame:
    """Pending rows whose best score reaches the threshold are decided; an assigned code beats the best candidate."""
    ok = (F.col("status") != "decided") & (F.col("top_score") >= threshold)
    return rows.withColumn("code", F.when(ok, F.coalesce("code", "top_code")).otherwise(F.col("code"))).withColumn("status", F.when(ok, "decided").otherwise(F.col("status")))


def search(catalogue: DataFrame, words: str, limit: int = 30) -> DataFrame:
    """Hits in codes before hits in descriptions, without regard to case and accents; a report of ``limit`` rows."""
    wanted = x.fold(F.lit(words))
    in_code, in_text = F.contains(x.fold(F.col("code")), wanted), F.contains(x.fold(F.col("text")), wanted)
    return catalogue.withColumn("where", F.when(in_code, 0).when(in_text, 1)).where("where is not null").orderBy("where", "code", "ord").limit(limit)


def next_pending(rows: DataFrame, after: int) -> DataFrame:
    """One row: the first pending place after ``after``, from the start again beyond the end."""
    turn = F.struct((F.col("ord") <= after).alias("wrapped"), F.col("ord"))
    return rows.where("status = 'review'").agg(F.min_by("id", turn).alias("id"))
