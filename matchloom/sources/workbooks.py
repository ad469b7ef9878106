"""Workbooks as rows and rows as workbooks.

Spark lists and reads the files (any store it knows); a task parses one workbook
at a time from its bytes. A sheet holds 1,048,576 rows at most by its format,
which bounds a task.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Names of the file format.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
MAX_ROWS = 1_048_576
ROWS = "file string, sheet string, row_no int, cells array<string>"


def column_number(reference: str) -> int:
    """0 for A1, 26 for AA1."""
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def column_name(number: int) -> str:
    name = ""
    number += 1
    while number:
        number, rest = divmod(number - 1, 26)
        name = chr(65 + rest) + name
    return name


def parsed(content: bytes, max_rows: int | None = None) -> Iterator[tuple[str, int, list[str | None]]]:
    """(sheet, row, cells) of a workbook; styles are ignored, formulas give their stored values."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = ["".join(t.text or "" for t in si.iter(f"{MAIN}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{MAIN}si")] if "xl/sharedStrings.xml" in names else []
        targets = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{MAIN}sheet"):
            target = targets[sheet.get(RELATION)].lstrip("/")
            with z.open(target if target.startswith("xl/") else f"xl/{target}") as f:
                for _, row in ElementTree.iterparse(f):
                    if row.tag != f"{MAIN}row":
                        continue
                    number = int(row.get("r", "0"))
                    if max_rows is not None and number > max_rows:
                        break
                    cells: list[str | None] = []
                    for c in row.iter(f"{MAIN}c"):
                        at = column_number(c.get("r", "")) if c.get("r") else len(cells)
                        cells += [None] * (at - len(cells))
                        value, kind = c.find(f"{MAIN}v"), c.get("t")
                        text = None if value is None else value.text
                        if kind == "s" and text is not None:
                            text = shared[int(text)]
                        elif kind == "inlineStr":
                            text = "".join(t.text or "" for t in c.iter(f"{MAIN}t"))
                        cells.append(text)
                    yield sheet.get("name", ""), number, cells
                    row.clear()


def read(spark: SparkSession, path: str, max_rows: int | None = None) -> DataFrame:
    """(file, sheet, row_no, cells) of every workbook under ``path``; of the first ``max_rows`` rows of each sheet, if given."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.xlsx").load(path).select("path", "content")

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                held: list[tuple] = []
                for sheet, number, cells in parsed(bytes(content), max_rows):
                    held.append((name, sheet, number, cells))
                    if len(held) == 5000:
                        yield pd.DataFrame(held, columns=["file", "sheet", "row_no", "cells"])
                        held = []
                if held:
                    yield pd.DataFrame(held, columns=["file", "sheet", "row_no", "cells"])

    return files.mapInPandas(rows, ROWS)


def built(sheets: dict[str, list[list[str | None]]]) -> bytes:
    """A workbook of text cells."""
    out = io.BytesIO()
    kinds = "http://schemas.openxmlformats.org"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{n}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for n in range(1, len(sheets) + 1))
        z.writestr("[Content_Types].xml", f'<Types xmlns="{kinds}/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{parts}</Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="{kinds}/package/2006/relationships"><Relationship Id="r1" Type="{kinds}/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        links = "".join(f'<Relationship Id="r{n}" Type="{kinds}/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet{n}.xml"/>' for n in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{kinds}/package/2006/relationships">{links}</Relationships>')
        entries = "".join(f'<sheet name="{escape(name, {chr(34): "&quot;"})}" sheetId="{n}" r:id="r{n}"/>' for n, name in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN[1:-1]}" xmlns:r="{kinds}/officeDocument/2006/relationships"><sheets>{entries}</sheets></workbook>')
        for n, rows in enumerate(sheets.values(), 1):
            if len(rows) > MAX_ROWS:
                raise ValueError(f"a sheet holds at most {MAX_ROWS} rows")
            lines = (f'<row r="{r}">' + "".join(f'<c r="{column_name(c)}{r}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>' for c, v in enumerate(row) if v is not None) + "</row>" for r, row in enumerate(rows, 1))
            z.writestr(f"xl/worksheets/sheet{n}.xml", f'<worksheet xmlns="{MAIN[1:-1]}"><sheetData>{"".join(lines)}</sheetData></worksheet>')
    return out.getvalue()


def workbooks(rows: DataFrame, key: str, order: str, columns: list[str], sheet: str = "Sheet1", head: list[list[str]] | None = None) -> DataFrame:
    """(key, content): one workbook for each key, with the lines of ``head``, a header and the rows in ``order``."""
    top = list(head or [])

    def build(group: pd.DataFrame) -> pd.DataFrame:
        body = group.sort_values("__order")
        cells = [[None if pd.isna(v) else str(v) for v in r] for r in body[columns].itertuples(index=False, name=None)]
        return pd.DataFrame({"key": [body["__key"].iloc[0]], "content": [built({sheet: [*top, list(columns), *cells]})]})

    slim = rows.select(F.col(key).cast("string").alias("__key"), F.col(order).alias("__order"), *(F.col(c).cast("string").alias(c) for c in columns))
    return slim.groupBy("__key").applyInPandas(build, "key string, content binary")


def save(made: DataFrame, path: str) -> None:
    """Writes each workbook of (key, content) as ``key.xlsx`` to the folder ``path`` that all executors see; a repeated attempt writes the same file again."""

    def put(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for frame in frames:
            for key, content in zip(frame["key"], frame["content"], strict=True):
                where, at = fs.FileSystem.from_uri(path)
                where.create_dir(at, recursive=True)
                with where.open_output_stream(f"{at}/{key}.xlsx") as f:
                    f.write(bytes(content))
            yield frame[["key"]]

    made.mapInPandas(put, "key string").count()
