"""Workbooks as a data source, and templates of workbooks as a sink.

``spark.read.format("workbook").load(path)`` gives (file, sheet, row_no, cells), one partition for each sheet of each file;
``maxRows`` stops the parser early. ``rows.write.format("workbook_template")`` fills a sheet of a template: tasks
write their rows as parts, the commit streams the parts into a copy of the template, in which nothing
but that sheet's rows and the ranges that must reach its last row changes; an abort leaves no file.
"""

from __future__ import annotations

import datetime
import io
import json
import posixpath
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from typing import IO
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import Row, StructType

from matchloom.sources.workbooks import MAIN, MAX_ROWS, RELATION, ROWS, column_name, column_number

# Number formats of the file format that show dates or times, and the days that its two calendars count from.
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
EPOCHS = {False: datetime.datetime(1899, 12, 30), True: datetime.datetime(1904, 1, 1)}
#: Rows of a template: titles, and the first row of data.
TITLE_ROW, FIRST_ROW = 4, 5


def is_date_format(code: str) -> bool:
    """Whether a number format shows a date or a time: letters of one outside quotes, brackets and escapes."""
    bare = re.sub(r'"[^"]*"|\[(?![hms]+\])[^\]]*\]|\\.', "", code.lower()).split(";")[0]
    return bool(re.search(r"[ymdhs]", bare)) and "general" not in bare


@dataclass
class Book:
    """What the cells of a workbook refer to."""

    archive: zipfile.ZipFile

    def __post_init__(self) -> None:
        names = set(self.archive.namelist())
        self.sheets: dict[str, str] = {}
        targets = {r.get("Id"): r.get("Target", "") for r in self._tree("xl/_rels/workbook.xml.rels")}
        book = self._tree("xl/workbook.xml")
        for sheet in book.iter(f"{MAIN}sheet"):
            target = targets[sheet.get(RELATION)]
            self.sheets[sheet.get("name", "")] = target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"xl/{target}")
        properties = book.find(f"{MAIN}workbookPr")
        self.epoch = EPOCHS[properties is not None and properties.get("date1904") in ("1", "true")]
        self.shared = ["".join(t.text or "" for t in si.iter(f"{MAIN}t")) for si in self._tree("xl/sharedStrings.xml").iter(f"{MAIN}si")] if "xl/sharedStrings.xml" in names else []
        self.dates: set[int] = set()
        if "xl/styles.xml" in names:
            styles = self._tree("xl/styles.xml")
            own = {int(f.get("numFmtId", "0")) for f in styles.iter(f"{MAIN}numFmt") if is_date_format(f.get("formatCode", ""))}
            formats = styles.find(f"{MAIN}cellXfs")
            for k, xf in enumerate(formats if formats is not None else ()):
                if int(xf.get("numFmtId", "0")) in DATE_FORMATS | own:
                    self.dates.add(k)

    def _tree(self, name: str) -> ElementTree.Element:
        return ElementTree.fromstring(self.archive.read(name))

    def text(self, cell: ElementTree.Element) -> str | None:
        """What a cell shows: strings as they are, TRUE or FALSE, dates in ISO form, whole numbers without a point."""
        value, kind = cell.find(f"{MAIN}v"), cell.get("t", "n")
        if kind == "inlineStr":
            return "".join(t.text or "" for t in cell.iter(f"{MAIN}t"))
        if value is None or value.text is None:
            return None
        raw = value.text
        if kind == "s":
            return self.shared[int(raw)]
        if kind == "b":
            return "TRUE" if raw.strip() in ("1", "true") else "FALSE"
        if kind != "n":
            return raw  # texts of formulas, errors, ISO dates
        number = float(raw)
        if int(cell.get("s", "0")) in self.dates:
            moment = self.epoch + datetime.timedelta(seconds=round(number * 86400))
            if number < 1:
                return moment.strftime("%H:%M:%S")
            return moment.strftime("%Y-%m-%d" if number == int(number) else "%Y-%m-%d %H:%M:%S")
        return str(int(number)) if number == int(number) and abs(number) < 1e15 else repr(number)

    def rows(self, sheet: str, max_rows: int | None = None) -> Iterator[tuple[int, list[str | None]]]:
        """(row, cells) of a sheet, read as a stream and no further than ``max_rows``."""
        if max_rows is not None and max_rows < 1:
            return
        last = 0
        with self.archive.open(self.sheets[sheet]) as f:
            for _, row in ElementTree.iterparse(f):
                if row.tag != f"{MAIN}row":
                    continue
                last = int(row.get("r") or last + 1)
                if max_rows is not None and last > max_rows:
                    return
                cells: list[str | None] = []
                for c in row.iter(f"{MAIN}c"):
                    at = column_number(c.get("r", "")) if c.get("r") else len(cells)
                    cells += [None] * (at - len(cells))
                    cells.append(self.text(c))
                yield last, cells
                row.clear()


def _files(path: str) -> Iterator[tuple[str, str]]:
    """(uri, name within its file system) of each workbook at or below ``path``."""
    from pyarrow import fs

    where, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    info = where.get_file_info(at)
    found = [info] if info.type == fs.FileType.File else where.get_file_info(fs.FileSelector(at, recursive=True))
    for f in sorted(found, key=lambda f: f.path):
        if f.type == fs.FileType.File and f.path.endswith(".xlsx"):
            yield path, f.path


def _opened(path: str, at: str) -> IO[bytes]:
    from pyarrow import fs

    where = fs.FileSystem.from_uri(path)[0] if "://" in path else fs.LocalFileSystem()
    return where.open_input_file(at)  # seekable, so that an archive is not read whole


class Sheet(InputPartition):
    def __init__(self, file: str, sheet: str):
        self.file, self.sheet = file, sheet


class WorkbookReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.only = options.get("sheet")
        self.max_rows = int(options["maxrows"]) if "maxrows" in options else None

    def partitions(self) -> list[InputPartition]:
        found = []
        for path, at in _files(self.path):
            with _opened(path, at) as f, zipfile.ZipFile(f) as z:
                found += [Sheet(at, s) for s in Book(z).sheets if self.only in (None, s)]
        return found

    def read(self, partition: Sheet | None) -> Iterator[tuple]:
        if partition is None:
            return
        with _opened(self.path, partition.file) as f, zipfile.ZipFile(f) as z:
            for number, cells in Book(z).rows(partition.sheet, self.max_rows):
                yield partition.file, partition.sheet, number, cells


class WorkbookSource(DataSource):
    """Options: ``path`` of a file or folder, ``sheet`` for one sheet of each file, ``maxRows`` for the first rows of each sheet."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema: StructType) -> DataSourceReader:
        return WorkbookReader({k.lower(): v for k, v in self.options.items()})


# --- templates ---------------------------------------------------------------------------------------------


def grown(ranges: str, last: int, first: int = FIRST_ROW) -> str:
    """Ranges that begin in row ``first`` and have no other row reach to ``last``; others stay."""

    def one(token: str) -> str:
        m = re.fullmatch(rf"(\$?[A-Z]+\$?){first}(?::(\$?[A-Z]+\$?){first})?", token)
        return f"{m[1]}{first}:{m[2] or m[1]}{last}" if m else token

    return " ".join(map(one, ranges.split()))


def _cell(at: str, style: str | None, value: object) -> str:
    s = f' s="{style}"' if style else ""
    if isinstance(value, bool):
        return f'<c r="{at}"{s} t="b"><v>{int(value)}</v></c>'
    if isinstance(value, int | float) and value == value and abs(value) != float("inf"):
        return f'<c r="{at}"{s}><v>{value!r}</v></c>'
    clean = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]", "", str(value))  # no place for these in the format
    return f'<c r="{at}"{s} t="inlineStr"><is><t xml:space="preserve">{escape(clean)}</t></is></c>'


def fill(template: IO[bytes], out: IO[bytes], sheet: str, titles: list[str], rows: Iterator[list], width: int | None = None) -> int:
    """Writes ``template`` to ``out`` with ``rows`` from row ``FIRST_ROW`` of ``sheet``; gives the number of the last row.

    A value goes to the column whose title (in row ``TITLE_ROW``) has its name and takes the style of the template's first row of data there; columns
    without a value keep that row's cell. The sheet's table, conditional formats and validations reach to the last row.
    Everything else in the file stays as it is, byte for byte. Titles that the template lacks and another ``width`` are errors.
    """
    with zipfile.ZipFile(template) as z, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as made:
        book = Book(z)
        if sheet not in book.sheets:
            raise ValueError(f"the template has no sheet {sheet}")
        part = book.sheets[sheet]
        heads = {c: k for n, cells in book.rows(sheet, TITLE_ROW) if n == TITLE_ROW for k, c in enumerate(cells) if c}
        found = max([len(cells) for _, cells in book.rows(sheet, TITLE_ROW)], default=0)
        if width is not None and found != width:
            raise ValueError(f"{sheet} has {found} columns, not {width}")
        if missing := [t for t in titles if t not in heads]:
            raise ValueError(f"{sheet} lacks {', '.join(missing)}")
        xml = z.read(part).decode("utf-8")
        m = re.search(r"<sheetData\s*/>|<sheetData[^>]*>(.*?)</sheetData>", xml, re.S)
        if not m:
            raise ValueError(f"{sheet} has no rows")
        kept = [r for r in re.findall(r"<row\b[^>]*?/>|<row\b.*?</row>", m[1] or "", re.S)]
        number = lambda r: int(re.search(r'\br="(\d+)"', r)[1])
        above = "".join(r for r in kept if number(r) < FIRST_ROW)
        model = next((r for r in kept if number(r) == FIRST_ROW), "")
        cells = {column_number(c[1]): c for c in re.finditer(rf'<c\b[^>]*?\br="([A-Z]+){FIRST_ROW}"[^>]*?(?:/>|>.*?</c>)', model, re.S)}
        style = {k: s[1] for k, c in cells.items() if (s := re.search(r'\bs="(\d+)"', c[0]))}
        still = {k: c[0] for k, c in cells.items() if re.search(r"<(?:v|is|f)\b", c[0])}
        columns = [heads[t] for t in titles]
        order = sorted({*columns, *style})
        body = z.open  # the parts are copied below
        # the rows come first, since their number decides the ranges; a sheet's rows are bounded by the format
        last = FIRST_ROW - 1
        spool = io.StringIO()
        for row in rows:
            last += 1
            if last > MAX_ROWS:
                raise ValueError(f"a sheet holds at most {MAX_ROWS} rows")
            values = dict(zip(columns, row, strict=True))
            spool.write(f'<row r="{last}">')
            for k in order:
                at = f"{column_name(k)}{last}"
                if values.get(k) is not None:
                    spool.write(_cell(at, style.get(k), values[k]))
                elif k in still:
                    spool.write(re.sub(rf'\br="[A-Z]+{FIRST_ROW}"', f'r="{at}"', still[k], count=1))
                elif k in style:
                    spool.write(f'<c r="{at}" s="{style[k]}"/>')
            spool.write("</row>")
        end = max(last, FIRST_ROW)
        head, tail = xml[: m.start()], xml[m.end() :]
        head = re.sub(r'(<dimension ref="[A-Z]+\d+:[A-Z]+)\d+"', rf'\g<1>{end}"', head)
        if last >= FIRST_ROW:
            tail = re.sub(r'\bsqref="([^"]*)"', lambda s: f'sqref="{grown(s[1], last)}"', tail)
            tail = re.sub(r"(<(?:\w+:)?sqref>)([^<]*)(</)", lambda s: s[1] + grown(s[2], last) + s[3], tail)
        rows_xml = above + (spool.getvalue() if last >= FIRST_ROW else model)
        links = f"{posixpath.dirname(part)}/_rels/{posixpath.basename(part)}.rels"
        tables = set()
        if links in z.namelist():
            for r in ElementTree.fromstring(z.read(links)):
                if r.get("Type", "").endswith("/table"):
                    target = r.get("Target", "")
                    tables.add(target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(posixpath.dirname(part), target)))
        for info in z.infolist():
            if info.filename == part:
                made.writestr(info.filename, f"{head}<sheetData>{rows_xml}</sheetData>{tail}".encode(), zipfile.ZIP_DEFLATED)
            elif info.filename in tables:
                table = z.read(info).decode("utf-8")
                made.writestr(info.filename, re.sub(rf'(\bref="\$?[A-Z]+\$?{TITLE_ROW}:\$?[A-Z]+\$?)\d+"', rf'\g<1>{end}"', table).encode(), zipfile.ZIP_DEFLATED)
            else:
                with body(info) as source, made.open(zipfile.ZipInfo(info.filename, info.date_time), "w") as target:
                    while chunk := source.read(1 << 20):
                        target.write(chunk)
        return last


class Part(WriterCommitMessage):
    def __init__(self, name: str | None, order: int):
        self.name, self.order = name, order


class TemplateWriter(DataSourceWriter):
    """Tasks write parts beside the result; the commit fills the template with them in the order of partitions."""

    def __init__(self, options: dict[str, str], schema: StructType):
        self.template, self.path, self.sheet = options["template"], options["path"], options["sheet"]
        self.width = int(options["width"]) if "width" in options else None
        self.titles = schema.fieldNames()
        self.parts = f"{self.path}.parts-{uuid.uuid4().hex}"

    def _where(self, path: str):  # noqa: ANN202
        from pyarrow import fs

        return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        order, name, out = TaskContext.get().partitionId(), None, None
        where, at = self._where(self.parts)
        for row in iterator:
            if out is None:
                where.create_dir(at, recursive=True)
                name = f"{at}/{order}-{uuid.uuid4().hex}.jsonl"  # an attempt that is repeated writes another part
                out = where.open_output_stream(name)
            out.write((json.dumps([v if v is None or isinstance(v, bool | int | float | str) else str(v) for v in row]) + "\n").encode())
        if out is not None:
            out.close()
        return Part(name, order)

    def _clear(self) -> None:
        from pyarrow import fs

        where, at = self._where(self.parts)
        if where.get_file_info(at).type == fs.FileType.Directory:
            where.delete_dir(at)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        where, _ = self._where(self.parts)

        def rows() -> Iterator[list]:
            for part in sorted((m for m in messages if m is not None and m.name), key=lambda m: m.order):
                with where.open_input_stream(part.name) as f:
                    for line in io.TextIOWrapper(f, encoding="utf-8"):
                        yield json.loads(line)

        (source, template), (target, result) = self._where(self.template), self._where(self.path)
        draft = f"{result}.draft-{uuid.uuid4().hex}"
        try:
            with source.open_input_file(template) as f, target.open_output_stream(draft) as out:
                fill(f, out, self.sheet, self.titles, rows(), self.width)
            target.move(draft, result)
        except BaseException:
            target.delete_file(draft)
            raise
        finally:
            self._clear()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear()


class TemplateSink(DataSource):
    """Options: ``template``, ``path`` of the result, ``sheet``, ``width`` that the sheet must have. Columns of the frame are titles; rows go out in the order of partitions."""

    @classmethod
    def name(cls) -> str:
        return "workbook_template"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return TemplateWriter({k.lower(): v for k, v in self.options.items()}, schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WorkbookSource)
    spark.dataSource.register(TemplateSink)


def read(spark: SparkSession, path: str, max_rows: int | None = None, sheet: str | None = None) -> DataFrame:
    """(file, sheet, row_no, cells) of the workbooks at or below ``path``."""
    register(spark)
    reader = spark.read.format("workbook")
    for name, value in (("maxRows", max_rows), ("sheet", sheet)):
        reader = reader.option(name, str(value)) if value is not None else reader
    return reader.load(path)


def fill_template(rows: DataFrame, template: str, path: str, sheet: str, order: list[str], width: int | None = None) -> None:
    """Fills a template's sheet with ``rows`` in ``order``; columns in ``order`` that are no titles must be dropped from ``rows`` before."""
    register(rows.sparkSession)
    writer = rows.orderBy(*order).write.format("workbook_template").mode("append").option("template", template).option("path", path).option("sheet", sheet)
    (writer.option("width", str(width)) if width is not None else writer).save()
