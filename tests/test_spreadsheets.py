"""The workbook source and the template sink on files that the library's own writer did not make."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from matchloom.sources import spreadsheets, tables

NS = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PKG = "http://schemas.openxmlformats.org/package/2006/relationships"


def archive(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def book(sheets, styles="", shared="", date1904=False, more=None):
    names = "".join(f'<sheet name="{n}" sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(sheets, 1))
    links = "".join(f'<Relationship Id="rId{k}" Type="{REL}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k, _ in enumerate(sheets, 1))
    parts = {
        "xl/workbook.xml": f'<workbook xmlns="{NS}" xmlns:r="{REL}"><workbookPr date1904="{int(date1904)}"/><sheets>{names}</sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{PKG}">{links}</Relationships>',
        "xl/styles.xml": f'<styleSheet xmlns="{NS}">{styles}</styleSheet>',
    }
    if shared:
        parts["xl/sharedStrings.xml"] = f'<sst xmlns="{NS}">{shared}</sst>'
    return archive(parts | {f"xl/worksheets/sheet{k}.xml": xml for k, xml in enumerate(sheets.values(), 1)} | (more or {}))


def sheet(rows, before="", after=""):
    return f'<worksheet xmlns="{NS}">{before}<sheetData>{rows}</sheetData>{after}</worksheet>'


@pytest.fixture
def folder(tmp_path):
    styles = '<numFmts><numFmt numFmtId="170" formatCode="dd/mm/yyyy hh:mm"/><numFmt numFmtId="171" formatCode="0.00 &quot;days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/><xf numFmtId="21"/></cellXfs>'
    shared = "<si><t>plain</t></si><si><r><t>ri</t></r><r><t>ch é</t></r></si>"
    cells = (
        '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c><c r="D1" t="inlineStr"><is><t>in</t></is></c></row>'
        '<row r="3"><c r="A3"><v>12</v></c><c r="B3"><v>12.50</v></c><c r="C3"><v>1.2E3</v></c><c r="D3" t="b"><v>1</v></c><c r="E3" t="b"><v>0</v></c><c r="F3" t="e"><v>#N/A</v></c></row>'
        '<row r="4"><c r="A4" s="1"><v>45292</v></c><c r="B4" s="2"><v>45292.75</v></c><c r="C4" s="3"><v>2.5</v></c><c r="D4" s="4"><v>0.5</v></c><c r="E4" t="str"><f>A1</f><v>plain</v></c><c r="F4"/></row>'
        "<row><c><v>1</v></c><c><v>2</v></c></row>"
    )
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.xlsx").write_bytes(book({"One": sheet(cells), "Two": sheet("")}, styles, shared))
    (tmp_path / "in" / "deep" / "b.xlsx").write_bytes(book({"Old": sheet('<row r="1"><c r="B1" s="1"><v>1</v></c></row>')}, styles, date1904=True))
    (tmp_path / "in" / "note.txt").write_text("no workbook")
    return tmp_path


def test_cells_of_every_kind(spark, folder):
    found = spreadsheets.read(spark, str(folder / "in"))
    assert found.rdd.getNumPartitions() == 3  # a partition for each sheet of each file
    rows = {(r["sheet"], r["row_no"]): r["cells"] for r in found.collect()}
    assert rows == {
        ("One", 1): ["plain", None, "rich é", "in"],
        ("One", 3): ["12", "12.5", "1200", "TRUE", "FALSE", "#N/A"],
        ("One", 4): ["2024-01-01", "2024-01-01 18:00:00", "2.5", "12:00:00", "plain", None],
        ("One", 5): ["1", "2"],
        ("Old", 1): [None, "1904-01-02"],
    }


def test_limits_reach_the_reader(spark, folder):
    found = spreadsheets.read(spark, str(folder / "in"), max_rows=3).collect()
    assert sorted((r["sheet"], r["row_no"]) for r in found) == [("Old", 1), ("One", 1), ("One", 3)]
    assert not spreadsheets.read(spark, str(folder / "in"), sheet="Two").collect()
    assert spreadsheets.read(spark, str(folder / "in" / "a.xlsx"), sheet="One").count() == 4


def test_date_formats():
    assert all(map(spreadsheets.is_date_format, ("yyyy-mm-dd", "hh:mm", "[h]:mm", "d mmm", '"on" d/m')))
    assert not any(map(spreadsheets.is_date_format, ("General", "0.00", '0 "days"', "#,##0;[Red]-#,##0", r"0\d", "@")))


TEMPLATE_ROWS = (
    '<row r="1"><c r="A1" s="3" t="inlineStr"><is><t>Title</t></is></c></row>'
    '<row r="4" ht="20"><c r="A4" s="1" t="inlineStr"><is><t>Name</t></is></c><c r="B4" t="inlineStr"><is><t>Count</t></is></c><c r="C4" t="inlineStr"><is><t>Fixed</t></is></c><c r="D4" t="inlineStr"><is><t>Other</t></is></c></row>'
    '<row r="5"><c r="A5" s="7"/><c r="B5" s="8"/><c r="C5" s="9" t="inlineStr"><is><t>None</t></is></c></row>'
    '<row r="6"><c r="A6" t="inlineStr"><is><t>stale</t></is></c></row>'
)
TAIL = (
    '<conditionalFormatting sqref="A5"><cfRule type="expression" priority="1"><formula>A5=1</formula></cfRule></conditionalFormatting><conditionalFormatting sqref="B5:C5 A1"><cfRule type="duplicateValues" priority="2"/></conditionalFormatting>'
    '<dataValidations count="2"><dataValidation type="list" sqref="B5 D5"><formula1>Info!$A$1:$A$5</formula1></dataValidation><dataValidation type="whole" sqref="A2:A3"/></dataValidations>'
    '<tableParts count="1"><tablePart xmlns:r="x" r:id="rId1"/></tableParts>'
)


@pytest.fixture
def template(tmp_path):
    more = {
        "xl/worksheets/_rels/sheet1.xml.rels": f'<Relationships xmlns="{PKG}"><Relationship Id="rId1" Type="{REL}/table" Target="../tables/table1.xml"/></Relationships>',
        "xl/tables/table1.xml": f'<table xmlns="{NS}" id="1" name="Data" ref="A4:D5"><autoFilter ref="A4:D5"/></table>',
        "xl/media/logo.png": b"\x89PNG\x00\xff",
    }
    path = tmp_path / "template.xlsx"
    path.write_bytes(book({"Data": sheet(TEMPLATE_ROWS, '<dimension ref="A1:D6"/>', TAIL), "Info": sheet('<row r="1"><c r="A1"><v>1</v></c></row>')}, "<fonts/>", more=more))
    return path


def test_template_fill(spark, template, tmp_path):
    rows = spark.range(2500).select(F.concat(F.lit("row <"), F.col("id")).alias("Name"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("Count")).repartition(5)
    out = tmp_path / "filled.xlsx"
    spreadsheets.fill_template(rows.withColumn("Other", F.col("Count") > 9), str(template), str(out), "Data", ["Count", "Name"], width=4)
    made, before = zipfile.ZipFile(out), zipfile.ZipFile(template)
    assert made.namelist() == before.namelist()
    changed = {n for n in made.namelist() if made.read(n) != before.read(n)}
    assert changed == {"xl/worksheets/sheet1.xml", "xl/tables/table1.xml"}
    last = 2504
    xml = made.read("xl/worksheets/sheet1.xml").decode()
    assert f'ref="A1:D{last}"' in xml and f'sqref="A5:A{last}"' in xml and f'sqref="B5:C{last} A1"' in xml and f'sqref="B5:B{last} D5:D{last}"' in xml and 'sqref="A2:A3"' in xml
    assert made.read("xl/tables/table1.xml").decode().count(f'ref="A4:D{last}"') == 2 and '<row r="4" ht="20">' in xml and "stale" not in xml
    found = {r["row_no"]: r["cells"] for r in spreadsheets.read(spark, str(out), sheet="Data").collect()}
    assert len(found) == 2502 and found[4] == ["Name", "Count", "Fixed", "Other"]
    assert found[5][1] is None  # nulls come first
    assert [found[k][0] for k in range(5, 1255)] == sorted(f"row <{k}" for k in range(2500) if k % 2)
    assert found[5][1] is None and found[5][2] == "None" and found[last] == ["row <2498", "2498", "None", "TRUE"]
    assert '<c r="A5" s="7" t="inlineStr">' in xml and '<c r="B2504" s="8"><v>2498</v></c>' in xml and '<c r="B5" s="8"/>' in xml
    assert [p.name for p in tmp_path.iterdir() if "parts" in p.name or "draft" in p.name] == []


def test_template_of_no_rows_and_errors(spark, template, tmp_path):
    rows = spark.createDataFrame([], "Name string")
    spreadsheets.fill_template(rows, str(template), str(tmp_path / "empty.xlsx"), "Data", ["Name"])
    assert max(r["row_no"] for r in spreadsheets.read(spark, str(tmp_path / "empty.xlsx"), sheet="Data").collect()) == 5
    for bad, options in ((spark.range(3).withColumnRenamed("id", "Nobody"), {}), (spark.range(3).withColumnRenamed("id", "Name"), {"width": 43})):
        with pytest.raises(Exception, match="lacks Nobody|columns, not 43"):
            spreadsheets.fill_template(bad, str(template), str(tmp_path / "bad.xlsx"), "Data", bad.columns, **options)
    failing = spark.range(10).select(F.raise_error(F.lit("broken row")).cast("string").alias("Name"))
    with pytest.raises(Exception, match="broken row"):
        spreadsheets.fill_template(failing, str(template), str(tmp_path / "bad.xlsx"), "Data", ["Name"])
    assert {p.name for p in tmp_path.iterdir()} == {"template.xlsx", "empty.xlsx"}


def test_grown_ranges():
    assert spreadsheets.grown("A5 B5:C5 $D$5 E5:E9 F6 A15", 70) == "A5:A70 B5:C70 $D$5:$D$70 E5:E9 F6 A15"


def test_lines_of_several_splits_keep_their_order(spark, tmp_path):
    lines = [f"FILE part{k // 1000}" if k % 1000 == 0 else f"event {k}" if k % 7 == 0 else "x" * (k % 50) for k in range(20_000)]
    (tmp_path / "log.txt").write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        read = tables.lines_of(spark, str(tmp_path / "log.txt"))
        assert spark.read.text(str(tmp_path / "log.txt")).rdd.getNumPartitions() > 4
        rows = sorted((r["line_no"], r["value"]) for r in read.collect())
        assert [v for _, v in rows] == lines and len({n for n, _ in rows}) == len(lines)
        found = {r["event"]: r["context"] for r in tables.log_events(read, r"FILE (\S+)", r"event (\d+)").collect()}
        assert found == {str(k): f"part{k // 1000}" for k in range(20_000) if k % 7 == 0 and k % 1000}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
