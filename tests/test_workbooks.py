"""Workbooks: the format by hand, as a source and as a sink."""

import io
import os
import zipfile
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from veridoc.sources import sheets, workbooks

MAIN = workbooks.MAIN


def by_hand(path, sheet, shared="", styles=""):
    """A workbook with one sheet, its XML given."""
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{workbooks.LINKS}"><sheets><sheet name="One" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{workbooks.PACKAGE}"><Relationship Id="r1" Target="/xl/worksheets/s.xml"/></Relationships>')
        z.writestr("xl/worksheets/s.xml", f'<worksheet xmlns="{MAIN}"><sheetData>{sheet}</sheetData></worksheet>')
        if shared:
            z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}">{shared}</sst>')
        if styles:
            z.writestr("xl/styles.xml", f'<styleSheet xmlns="{MAIN}">{styles}</styleSheet>')


def test_kinds_of_cells(tmp_path):
    """Shared, rich and inline texts, results of formulas, truth values, errors, dates by built-in and own formats, numbers."""
    path = f"{tmp_path}/a.xlsx"
    shared = "<si><t>plain</t></si><si><r><t>rich </t></r><r><t>text</t></r><rPh sb='0' eb='1'><t>reading</t></rPh></si>"
    styles = '<numFmts><numFmt numFmtId="170" formatCode="yyyy&quot;x&quot;"/><numFmt numFmtId="171" formatCode="0.00&quot;days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs>'
    cells = '<c t="s"><v>0</v></c><c t="s"><v>1</v></c><c t="inlineStr"><is><t>in_x0041_line</t></is></c><c t="str"><f>A1</f><v>result</v></c><c t="b"><v>1</v></c><c t="e"><v>#N/A</v></c><c s="1"><v>45296</v></c><c s="2"><v>45296.5</v></c><c s="3"><v>45296</v></c><c><v>12</v></c><c><v>1.50</v></c><c><v>3E2</v></c>'
    by_hand(path, f'<row r="4">{cells}<c r="AA4"><v>7</v></c></row><row/><row><c><v>1</v></c></row>', shared, styles)
    book = workbooks.Workbook(path)
    assert list(book.rows(book.sheets[0][1])) == [
        (4, {0: "plain", 1: "rich text", 2: "inAline", 3: "result", 4: "true", 6: "2024-01-05", 7: "2024-01-05 12:00:00", 8: "45296", 9: "12", 10: "1.5", 11: "300", 26: "7"}), (6, {0: "1"}),
    ]


def test_values_round_trip():
    rows = [(1, "a & <b> \x07 _x0041_ \n\r é  ", 2.5, date(2024, 1, 5), None, True, 10**17), (2, "", float("nan"), datetime(1900, 1, 5), "x", False, -3)]
    file = io.BytesIO()
    assert workbooks.write_workbook(file, iter(rows), list("ABCDEFG"), "My & sheet") == 2
    book = workbooks.Workbook(file)
    assert book.sheets[0][0] == "My & sheet"
    assert list(book.rows(book.sheets[0][1]))[1:] == [
        (2, {0: "1", 1: rows[0][1], 2: "2.5", 3: "2024-01-05", 5: "true", 6: str(10**17)}), (3, {0: "2", 2: "nan", 3: "1900-01-05 00:00:00", 4: "x", 5: "false", 6: "-3"}),
    ]


def test_full_sheets_go_on(monkeypatch):
    monkeypatch.setattr(workbooks, "SHEET_ROWS", 4)
    file = io.BytesIO()
    workbooks.write_workbook(file, ((i,) for i in range(8)), ["n"], "S")
    book = workbooks.Workbook(file)
    assert [[cells[0] for _, cells in book.rows(t)] for _, t in book.sheets] == [["n", "0", "1", "2"], ["n", "3", "4", "5"], ["n", "6", "7"]]


def test_references():
    for n in (0, 25, 26, 701, 702, 16383):
        assert workbooks.column_number(workbooks.cell_reference(n, 12)) == n
    assert workbooks.cell_reference(27, 3) == "AB3"


def test_a_table_comes_back(spark, tmp_path):
    df = spark.range(5000).select("id", F.concat(F.lit("t"), "id").alias("Some Text"), (F.col("id") / 4).alias("q"), F.date_add(F.lit(date(2020, 1, 1)), F.col("id").cast("int") % 1000).alias("day"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("half"))
    path = f"{tmp_path}/table"
    workbooks.write_workbooks(df.repartition(5), path)
    assert len([f for f in os.listdir(path) if f.endswith(".xlsx")]) == 5 and not [f for f in os.listdir(path) if f.startswith("_temporary")]
    back = workbooks.read_workbooks(spark, path, {"id": "ID", "text": "some-text", "q": "Q", "day": "day", "half": "half"}, permissive=False)
    typed = back.select(F.col("id").cast("long"), "text", F.col("q").cast("double"), F.col("day").cast("date"), F.col("half").cast("long"))
    assert sorted(typed.collect(), key=lambda r: r[0]) == df.orderBy("id").collect()
    assert back.agg(F.max("row")).first()[0] == 1001 and back.select("file").distinct().count() == 5
    # again, in place of what was there; the headers are the schema where none is given
    workbooks.write_workbooks(df.where("id < 3").coalesce(1), path)
    again = spark.read.format("workbook").load(path)
    assert again.columns == ["file", "row", "problem", "id", "Some Text", "q", "day", "half"] and again.count() == 3


def test_an_empty_table(spark, tmp_path):
    workbooks.write_workbooks(spark.range(0).repartition(3), f"{tmp_path}/none")
    rows = workbooks.read_workbooks(spark, f"{tmp_path}/none", {"id": "id"}).collect()
    assert [r["problem"] for r in rows] == ["the sheet has no rows"]


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    path = f"{tmp_path}/failed"
    workbooks.write_workbooks(spark.range(3).coalesce(1), path)
    before = sorted(os.listdir(path))
    bad = spark.range(100).repartition(4).select(F.when(F.col("id") == 50, F.raise_error(F.lit("no"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="no"):
        workbooks.write_workbooks(bad, path)
    assert sorted(os.listdir(path)) == before


def test_bad_files_and_rows(spark, tmp_path):
    headers = {"claimId": "Claim ID", "invoiceDate": "Invoice Date", "remarks": "Remarks"}
    row = lambda *texts: "<row>" + "".join(f'<c t="inlineStr"><is><t>{t}</t></is></c>' for t in texts) + "</row>"
    by_hand(f"{tmp_path}/a.xlsx", row("remarks", "CLAIM id", "Invoice-Date", "Claim ID") + row("r", "C1", "5/1/2024", "zz") + row("r", "", "") + row(" ", " ", " ") + row("", "C2", "never") + row("", "C1", ""))
    by_hand(f"{tmp_path}/b.xlsx", row("Claim ID", "Remarks") + row("C3", "x"))
    with open(f"{tmp_path}/c.xlsx", "w") as f:
        f.write("no zip")
    with open(f"{tmp_path}/d.xlsx", "wb") as f:
        f.write(b"PK\x03\x04 broken")
    by_hand(f"{tmp_path}/e.xlsx", row("Claim ID", "Remarks", "Invoice Date"))
    os.makedirs(f"{tmp_path}/_temporary-1")
    by_hand(f"{tmp_path}/_temporary-1/f.xlsx", row("Claim ID", "Remarks", "Invoice Date") + row("C9", "", ""))
    got = {(r["file"][-6:-5], r["row"]): (r["claimId"], r["problem"]) for r in sheets.observations(spark, str(tmp_path), headers).collect()}
    assert got == {
        ("a", 2): ("C1", None), ("a", 3): (None, "Claim ID is empty"), ("a", 5): ("C2", "Invoice Date is no date"), ("a", 6): ("C1", "Claim ID stands in an earlier row"),
        ("b", 0): (None, "the sheet has no column Invoice Date"), ("c", 0): (None, "the file is not a workbook"), ("d", 0): (None, "the file can't be read as a workbook"), ("e", 0): (None, "the sheet has no rows"),
    }
    with pytest.raises(Exception, match="not a workbook"):
        workbooks.read_workbooks(spark, f"{tmp_path}/c.xlsx", headers, permissive=False).collect()


def test_rows_beyond_the_most(spark, tmp_path, monkeypatch):
    workbooks.write_workbooks(spark.range(30).coalesce(1), f"{tmp_path}/many")
    got = workbooks.read_workbooks(spark, f"{tmp_path}/many", {"id": "id"}, most=20).collect()
    assert sum(r["problem"] is None for r in got) == 20 and [r["problem"] for r in got if r["row"] == 0] == ["the sheet has more than 20 rows; only the first 20 were read"]
