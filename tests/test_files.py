"""Broken lines read in parallel, and workbooks written here by hand."""

from __future__ import annotations

import csv
import io
import random
import zipfile

import pytest

from ledgerline.sources import delimited, workbook


def table(seed, n=60):
    r = random.Random(seed)
    cell = lambda: r.choice(["", "a", "x,y", 'say "hi"', "two\nlines", "three\n\n\"lines\"\n", ",\n,", "é" * r.randrange(5), "12.5", '"'])
    return [["id", "note", "more"]] + [[str(i), cell(), cell()] for i in range(n)]


@pytest.mark.parametrize("split", ["100", "128m"])
def test_records_over_splits(spark, tmp_path, split):
    """Whatever the splits, records are those of a reader of whole files, in two files."""
    want = []
    for k in (1, 2):
        rows = table(k)
        buffer = io.StringIO()
        csv.writer(buffer, lineterminator="\n").writerows(rows)
        (tmp_path / f"{k}.csv").write_text(buffer.getvalue(), encoding="utf-8")
        want += [tuple(x or None for x in r) for r in rows[1:]]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        found = delimited.records(spark, f"file://{tmp_path}")
        assert found.count() == len(want) + 2
        df = delimited.read_delimited(spark, f"file://{tmp_path}")
        assert df.columns == ["id", "note", "more"]
        got = [tuple(x or None for x in r) for r in df.collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted(got, key=str) == sorted(want, key=str)


def test_a_wide_row_of_broken_cells_keeps_them_all(spark, tmp_path):
    wide = ",".join(['"a\nb"'] * 30)
    (tmp_path / "w.csv").write_text("one,two\n" + "1,2\n" * 12 + f"{wide}\n", encoding="utf-8")
    df = delimited.read_delimited(spark, f"file://{tmp_path}/w.csv")
    assert df.columns[:3] == ["one", "two", "col_3"] and len(df.columns) == 30
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == 13 and ("a\nb",) * 30 in rows


def test_a_quote_that_never_closes(spark, tmp_path):
    (tmp_path / "q.csv").write_text('a,b\n1,2\n3,"x\ny\nz\n', encoding="utf-8")
    assert sorted(r.record for r in delimited.records(spark, f"file://{tmp_path}/q.csv").collect()) == ["1,2", '3,"x\ny\nz', "a,b"]


MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def book(path, sheets, strings=(), styles="", props=""):
    with zipfile.ZipFile(path, "w") as z:
        tags = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f"<workbook {MAIN}>{props}<sheets>{tags}</sheets></workbook>")
        links = "".join(f'<Relationship Id="rId{i}" Type="t" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
        if strings:
            z.writestr("xl/sharedStrings.xml", f"<sst {MAIN}>{''.join(strings)}</sst>")
        if styles:
            z.writestr("xl/styles.xml", f"<styleSheet {MAIN}>{styles}</styleSheet>")
        for i, body in enumerate(sheets.values(), 1):
            z.writestr(f"xl/worksheets/sheet{i}.xml", f"<worksheet {MAIN}><sheetData>{body}</sheetData></worksheet>")


STYLES = '<numFmts count="2"><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd hh:mm"/><numFmt numFmtId="165" formatCode="0.00 &quot;days&quot;"/></numFmts><cellXfs count="4"><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs>'


@pytest.fixture
def sales(tmp_path):
    sales = (
        '<row r="1"><c r="A1" t="inlineStr"><is><t>Report</t></is></c></row>'
        '<row r="3"><c r="A3" t="s"><v>0</v></c><c r="B3" t="s"><v>1</v></c><c r="D3" t="str"><f>1+1</f><v>Sum</v></c></row>'
        '<row r="4"><c r="A4" s="1"><v>45292</v></c><c r="B4"><v>12.5</v></c><c r="C4" t="b"><v>1</v></c><c r="D4" s="2"><v>45292.5</v></c></row>'
        '<row r="5"><c r="A5" t="e"><v>#DIV/0!</v></c><c r="B5" s="3"><v>7.0</v></c><c r="D5"/></row><row r="6"/>'
    )
    book(tmp_path / "b.xlsx", {"Ventes": sales, "Vide": "", "Far": '<row><c r="AB1"><v>1</v></c></row><row><c><v>2</v></c></row>'}, ["<si><t>Date</t></si>", "<si><r><t>Mon</t></r><r><t>tant</t></r><rPh><t>no</t></rPh></si>"], STYLES)
    return f"file://{tmp_path}/b.xlsx"


def test_workbook_rows(spark, sales, tmp_path):
    got = {(r.sheet, r.row): r.cells for r in workbook.sheet_rows(spark, sales).collect()}
    assert got["Ventes", 3] == ["Date", "Montant", None, "Sum"] and got["Ventes", 4] == ["2024-01-01", "12.5", "true", "2024-01-01 12:00:00"] and got["Ventes", 5] == ["#DIV/0!", "7", None, None]
    assert got["Vide", 0] == [] and len(got["Far", 1]) == 28 and got["Far", 2] == ["2"]
    assert workbook.sheet_rows(spark, sales).rdd.getNumPartitions() == 3
    book(tmp_path / "c.xlsx", {"Other": '<row r="1"><c s="1"><v>0</v></c></row>'}, styles=STYLES, props='<workbookPr date1904="1"/>')
    folder = workbook.sheet_rows(spark, f"file://{tmp_path}")
    assert {(r.file.rsplit("/", 1)[1], r.sheet) for r in folder.collect()} == {("b.xlsx", "Ventes"), ("b.xlsx", "Vide"), ("b.xlsx", "Far"), ("c.xlsx", "Other")}
    assert [r.cells for r in folder.filter("sheet = 'Other'").collect()] == [["1904-01-01"]]


def test_workbook_frames(spark, sales):
    frames = workbook.read_workbook(spark, sales)
    assert set(frames) == {"Ventes", "Far"}  # nothing to name in an empty sheet
    df = frames["Ventes"]
    assert df.columns == ["Date", "Montant", "col_3", "Sum"]
    assert sorted(tuple(r) for r in df.collect()) == [("#DIV/0!", "7", None, None), ("2024-01-01", "12.5", "true", "2024-01-01 12:00:00")]


def test_many_columns(spark, tmp_path):
    (tmp_path / "m.csv").write_text(";".join(f"Col {i}" for i in range(60)) + "\n" + ";".join(map(str, range(60))) + "\n;;\n", encoding="utf-8")
    df = delimited.read_delimited(spark, f"file://{tmp_path}/m.csv")
    assert df.columns[59] == "Col 59" and [r[59] for r in df.collect()] == ["59"]
