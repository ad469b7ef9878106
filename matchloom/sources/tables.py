"""Typed tables out of sheet rows, logs and reports, and reports out of decisions."""

from __future__ import annotations

import tomllib
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchloom.functions import text as x


def by_header(sheets: DataFrame, sheet: str, names: dict[str, str], header_row: int = 1) -> DataFrame:
    """(ord, one column for each logical name) of a sheet whose header names the columns; a missing first column is an error.

    ``names`` maps logical names to titles. Rows without a value in the first
    logical column are skipped; ``#N/A`` and the like are null.
    """
    own = sheets.where(F.col("sheet") == sheet)
    header = own.where(F.col("row_no") == header_row).select("cells").first()  # one row
    titles = [x if x is None else x.strip().upper() for x in (header[0] if header else [])]
    first = next(iter(names))
    if names[first].upper() not in titles:
        raise ValueError(f"sheet {sheet} has no column {names[first]}")
    at = lambda title: x.clean_value(F.get("cells", F.lit(titles.index(title.upper())))) if title.upper() in titles else F.lit(None).cast("string")
    rows = own.where(F.col("row_no") > header_row).select(F.col("row_no").alias("ord"), *(at(t).alias(n) for n, t in names.items()))
    return rows.where(F.col(first).isNotNull())


#: Logical names and titles of the three sheets of a catalogue.
DISCRETE = {"code": "SINAL", "text": "DESCRIÇÃO NOVA", "signal_type": "SIGNAL TYPE", "direction": "DIRECTION", "mm": "MM", "states": "FUNÇÃO", "scada": "VALOR", "severity_type": "TYPE SEVERIDADE", "severity": "SEVERIDADE"}
ANALOG = {"code": "SINAL", "text": "DESCRIÇÃO NOVA", "signal_type": "SIGNAL TYPE", "flow": "DIREÇÃO DO FLUXO", "measure": "TIPO DE MEDIÇÃO", "unit": "UNIDADE DE EXIBIÇÃO", "phases": "FASES"}
DISCRETE_ANALOG = {"code": "SINAL", "text": "DESCRIÇÃO NOVA", "signal_type": "SIGNAL TYPE", "phases": "FASES", "direction": "DIRECTION", "normal": "NORMAL VALUE", "point_type": "REMOTE POINT TYPE", "data_type": "OUTPUT DATA TYPE", "device_code": "DEVICE MAPPING REF", "applies": "APLICABILIDADE"}


def numbers(cell: Column) -> Column:
    """Whole numbers joined by semicolons; an empty list if one of them is none."""
    parts = F.transform(F.filter(F.split(F.coalesce(cell, F.lit("")), ";"), lambda v: F.trim(v) != ""), lambda v: F.trim(v).try_cast("int"))
    return F.when(F.exists(parts, lambda v: v.isNull()), F.array().cast("array<int>")).otherwise(parts)


def has_sheet(sheets: DataFrame, sheet: str) -> bool:
    return bool(sheets.where(F.col("sheet") == sheet).limit(1).count())


def catalogue(sheets: DataFrame) -> DataFrame:
    """(ord, category, code, text, signal_type, mm, states, scada, phases, measure, unit, normal, point_type, device_code) of a catalogue's sheets; the third is optional."""
    parts = []
    for category, sheet, names in (("Discrete", "DiscreteSignals", DISCRETE), ("Analog", "AnalogSignals", ANALOG), ("DiscreteAnalog", "DiscreteAnalog", DISCRETE_ANALOG)):
        if category == "DiscreteAnalog" and not has_sheet(sheets, sheet):
            continue
        rows = by_header(sheets, sheet, names).withColumn("category", F.lit(category))
        typed = {"scada": numbers, "normal": lambda c: c.try_cast("int")}
        parts.append(rows.withColumns({c: f(F.col(c)) for c, f in typed.items() if c in rows.columns}))
    wanted = ("ord", "category", "code", "text", "signal_type", "mm", "states", "scada", "phases", "measure", "unit", "normal", "point_type", "device_code")
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p, allowMissingColumns=True)
    kinds = {"ord": "int", "scada": "array<int>", "normal": "int"}
    return whole.select(*(F.col(c) if c in whole.columns else F.lit(None).cast(kinds.get(c, "string")).alias(c) for c in wanted))


def renames(sheets: DataFrame, sheet: str = "DE->PARA") -> DataFrame:
    """(old, new) of the optional sheet of renamed codes: its first two columns; the last row of an old code wins."""
    rows = sheets.where((F.col("sheet") == sheet) & (F.col("row_no") > 1)).select(F.col("row_no").alias("ord"), F.get("cells", F.lit(0)).alias("old"), F.get("cells", F.lit(1)).alias("new"))
    return last_of(rows.where(x.clean_value(F.col("old")).isNotNull() & x.clean_value(F.col("new")).isNotNull()), "old", "new")


def mappings(sheets: DataFrame, sheet: str = "Message Mapping", title: str = "Name") -> DataFrame:
    """(name): the different message mappings of their sheet."""
    return by_header(sheets, sheet, {"name": title}).select("name").distinct()


def descriptions(read: Callable[[], DataFrame]) -> dict[str, str]:
    """Code to description of a small catalogue that ``read`` gives as sheets, the last row of a code; empty if it can't be read."""
    try:
        found = last_of(catalogue(read()).where(F.col("text").isNotNull()).select("ord", "code", "text"), "code", "text").collect()  # a catalogue's rows
    except (PySparkException, Py4JJavaError, ValueError, OSError):  # no such file, another format, no such columns: the texts of the rows themselves do
        return {}
    return {r["code"]: r["text"] for r in found}


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of CSV files with a header, in the types of ``schema``; a cell of another type is an error."""
    return spark.read.csv(path, header=True, schema=schema, mode="FAILFAST", enforceSchema=True)


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Objects of JSON files that hold an array, or one object each."""
    return spark.read.json(path, schema=schema, multiLine=True)


def audit_files(spark: SparkSession, folder: str, schema: str, pattern: str = "*.csv") -> DataFrame:
    """Decided rows of all audit files anywhere below a folder."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).csv(folder, header=True, schema=schema)
    return rows.where("status = 'decided'")


def event_lines(events: DataFrame) -> DataFrame:
    """(value): one line for each audit event (at, module, level, message), ready for ``write.text``."""
    return events.select(F.concat_ws(" ", F.col("at").cast("string"), F.concat(F.lit("["), "level", F.lit("]")), F.concat("module", F.lit(":")), "message").alias("value"))


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """A table as CSV files with a header; arrays are joined by semicolons."""
    flat = [F.array_join(F.transform(c, lambda v: v.cast("string")), ";").alias(c) if kind.startswith("array") else F.col(c) for c, kind in rows.dtypes]
    rows.select(*flat).write.mode("overwrite").csv(path, header=True)


def load_or_build(spark: SparkSession, folder: str, key: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table that is stored under ``key``, or what ``build`` gives, which is stored; one that can't be read is built again, one that can't be written is used all the same."""
    path = f"{folder.rstrip('/')}/{key}"
    try:
        held = spark.read.parquet(path)
        held.limit(1).count()
        return held
    except (PySparkException, Py4JJavaError):  # missing, broken or of another format: build it again
        made = build()
    try:
        made.write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)
    except (PySparkException, Py4JJavaError):  # a cache that can't be written is no reason to fail
        return made


def last_of(rows: DataFrame, key: str, value: str, order: str = "ord") -> DataFrame:
    """(key, value) where the last row of a key wins; both in upper case, trimmed."""
    clean = rows.select(F.upper(F.trim(key)).alias(key), F.upper(F.trim(value)).alias(value), order).where(F.col(key).isNotNull())
    return clean.groupBy(key).agg(F.max_by(value, order).alias(value))


def export_values(sheets: DataFrame, code_title: str, address_title: str) -> DataFrame:
    """(sheet, address, code) of exports with four header rows: titles in row 4, data from row 5; the last row of an address wins."""
    head = sheets.where("row_no = 4").select("sheet", F.posexplode("cells").alias("at", "title"))
    place = lambda t, n: F.max(F.when(F.upper(F.trim("title")) == t.upper(), F.col("at"))).alias(n)
    places = head.groupBy("sheet").agg(place(code_title, "c"), place(address_title, "a"))
    data = sheets.where("row_no >= 5").join(places, "sheet").select("sheet", "row_no", F.get("cells", F.col("c")).alias("code"), F.get("cells", F.col("a")).alias("addresses"))
    single = data.select("sheet", "row_no", "code", F.explode(x.integers(F.col("addresses"))).alias("address"))
    return single.groupBy("sheet", "address").agg(F.max_by("code", "row_no").alias("code"))


def log_events(lines: DataFrame, context: str, event: str, order: str = "line_no", by: str = "file") -> DataFrame:
    """Lines that match ``event`` with the last ``context`` (its first group) before them."""
    named = F.nullif(F.regexp_extract("value", context, 1), F.lit(""))
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    carried = lines.withColumn("context", F.last(named, ignorenulls=True).over(w))
    return carried.withColumn("event", F.nullif(F.regexp_extract("value", event, 1), F.lit(""))).where("event is not null").select(by, order, "context", "event")


def review_json(reviewed: DataFrame, candidates: DataFrame) -> DataFrame:
    """(value): one JSON object for each reviewed signal with its candidates, scores rounded to 3 digits; ready for ``write.text``."""
    listed = candidates.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "code", F.round("score", 3).alias("score")))).alias("candidates"))
    joined = reviewed.join(listed, "id", "left").select("id", "reason", F.transform(F.coalesce("candidates", F.array()), lambda c: F.struct(c["code"].alias("code"), c["score"].alias("score"))).alias("candidates"))
    return joined.select(F.to_json(F.struct("id", "reason", "candidates")).alias("value"))


def model_key(rows: DataFrame, model: str) -> DataFrame:
    """One row: the sha256 key under which what is built from a catalogue (ord, code, text) and a model is stored."""
    part = F.sha2(F.concat_ws("\x1f", "code", "text"), 256)
    # the digest of rows is by blocks of the order, so no task holds a whole catalogue
    blocks = rows.groupBy(F.floor(F.col("ord") / 10_000).alias("block")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", part.alias("d")))), lambda r: r["d"]), "").alias("d"))
    digests = blocks.select("block", F.sha2("d", 256).alias("d"))
    return digests.agg(F.sha2(F.concat(F.lit(model + "\x1d"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "d"))), lambda r: r["d"]), "")), 256).alias("key"))


def settings(text: str, allowed: dict[str, object]) -> dict[str, object]:
    """Scalars of a TOML text that ``allowed`` names, over its defaults; weights that do not add to 1 are left at their defaults."""
    found = {k: v for k, v in tomllib.loads(text).items() if k in allowed and not isinstance(v, dict | list)}
    weights = [k for k in allowed if k.startswith("weight_")]
    merged = allowed | found
    if weights and abs(sum(float(merged[k]) for k in weights) - 1) > 1e-9:
        merged |= {k: allowed[k] for k in weights}
    return merged


def settings_text(chosen: dict[str, object], defaults: dict[str, object]) -> str:
    """TOML of the settings that differ from their defaults."""
    spelt = lambda v: str(v).lower() if isinstance(v, bool) else f'"{v}"' if isinstance(v, str) else repr(v)
    return "".join(f"{k} = {spelt(v)}\n" for k, v in sorted(chosen.items()) if k in defaults and v != defaults[k])


def relative(path: str, base: str) -> str:
    """A path below ``base`` as its rest; another one as it is."""
    return path[len(base.rstrip("/")) + 1 :] if path.startswith(base.rstrip("/") + "/") else path


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value) of text files; ``line_no`` grows with the place of a line in its file.

    It is the offset of the line's split in the file and the lines before it there. A split's lines are read in order, and
    each has a byte at least, so numbers of different lines of a file differ whatever tasks read them.
    """
    rows = spark.read.text(path).select("_metadata.file_path", "_metadata.file_block_start", "value", F.monotonically_increasing_id().alias("at"))
    own = Window.partitionBy("file_path", "file_block_start")
    line = F.col("file_block_start") + F.col("at") - F.min("at").over(own)
    return rows.select(F.col("file_path").alias("file"), line.alias("line_no"), "value")


def flag(value: Column) -> Column:
    return F.upper(F.trim(value)) == "SIM"
