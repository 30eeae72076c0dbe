"""Workbooks: a round trip, sheets as other programs write them, blank rows."""

from __future__ import annotations

import zipfile

from pyspark.sql import functions as F

from rollcall.sources import workbooks

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def test_round_trip_of_three_sheets(spark, tmp_path):
    n, path = 100_000, str(tmp_path / "out.xlsx")
    rows = spark.range(n).select(
        ((F.col("id") * 7919) % n).alias("at"), F.concat(F.lit("회사 <&> \u0001\""), "id").alias("업체명"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("https://www.s"), "id", F.lit(".com/?a=1&b=\"2\""))).alias("사이트"),
        F.when(F.col("id") % 2 == 0, " padded ").otherwise("").alias("국가"), F.lit("x").alias("other"),
    )
    workbooks.write_workbook(rows, path, "at", links=("사이트",), sheet_rows=40_000)
    got = workbooks.read_workbooks(spark, path).cache()
    assert {r.sheet: r.n for r in got.groupBy("sheet").agg(F.count("*").alias("n")).collect()} == {0: 40_000, 1: 40_000, 2: 20_000}
    back = got.select((F.col("sheet") * 40_000 + F.col("row") - 2).alias("at"), *(F.try_element_at("cells", F.lit(c)).alias(c) for c in ("name", "domain", "country", "other")))
    want = rows.toDF("at", "name", "domain", "country", "other").withColumn("name", F.replace("name", F.lit("\u0001"), F.lit("")))
    same = lambda df: df.select("at", *(F.coalesce(c, F.lit("")).alias(c) for c in ("name", "domain", "country", "other")))
    assert same(back).exceptAll(same(want)).count() == 0 and back.count() == n
    with zipfile.ZipFile(path) as book:
        sheet = book.read("xl/worksheets/sheet2.xml").decode()
        assert sheet.count("<hyperlink ") == book.read("xl/worksheets/_rels/sheet2.xml.rels").decode().count("https://www.s") > 26_000
        assert 'name="기업 리스트 3"' in book.read("xl/workbook.xml").decode() and book.testzip() is None


def _file(path, *sheets: str, shared: str | None = None) -> str:
    with zipfile.ZipFile(path, "w") as book:
        for name, text in workbooks._frame(len(sheets), "t"):
            book.writestr(name, text)
        for n, body in enumerate(sheets, 1):
            book.writestr(f"xl/worksheets/sheet{n}.xml", f"<worksheet {MAIN}><sheetData>{body}</sheetData></worksheet>")
        if shared:
            book.writestr("xl/sharedStrings.xml", f"<sst {MAIN}>{shared}</sst>")
    return str(path)


def test_sheets_as_others_write_them(spark, tmp_path):
    shared = "<si><t>업체명</t></si><si><t>site</t></si><si><r><t>Ac</t></r><r><t>me</t></r><rPh><t>reading</t></rPh></si>"
    one = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c><c r="D1" t="inlineStr"><is><t> 국가 </t></is></c></row><row r="3"><c r="A3" t="s"><v>2</v></c><c r="C3" t="str"><v>acme.com</v></c><c r="D3" t="b"><v>1</v></c><c r="E3"><v>5</v></c></row><row r="4"><c r="C4"/></row><row r="5"><c r="A5"><v>12</v></c><c r="C5"><v>1.50</v></c></row>'
    two = "<row><c t=\"inlineStr\"><is><t>회사명</t></is></c><c t=\"inlineStr\"><is><t>이메일</t></is></c></row><row><c t=\"inlineStr\"><is><t>Beta</t></is></c><c t=\"inlineStr\"><is><t> ir@b.com </t></is></c></row>"
    _file(tmp_path / "a.xlsx", one, "", two, shared=shared)
    got = workbooks.read_workbooks(spark, str(tmp_path)).orderBy("sheet", "row").collect()
    assert [(r.sheet, r.row, r.cells) for r in got] == [
        (0, 3, {"name": "Acme", "": "", "domain": "acme.com", "country": "True"}), (0, 5, {"name": "12", "": "", "domain": "1.5"}), (2, 2, {"name": "Beta", "email": " ir@b.com "}),
    ]
    found = {r.key: (r.name, r.email) for r in workbooks.read_imported(spark, str(tmp_path)).collect()}
    assert found == {"dom:acme.com": ("Acme", None), "dom:1.5": ("12", None), "name::beta": ("Beta", "ir@b.com")}


def test_runs_of_blank_rows_end_a_sheet(spark, tmp_path):
    row = lambda n: f'<row r="{n}"><c r="A{n}" t="inlineStr"><is><t>x{n}</t></is></c></row>'
    head = '<row r="1"><c r="A1" t="inlineStr"><is><t>name</t></is></c></row>'
    blank = "".join(f'<row r="{n}"><c r="A{n}"/></row>' for n in range(3, 900))
    _file(tmp_path / "a.xlsx", head + row(2) + row(201) + row(401), head + row(2) + row(203), head + row(2) + blank + row(900), row(2))
    got = workbooks.read_workbooks(spark, str(tmp_path / "a.xlsx")).select("sheet", "row").collect()
    assert sorted(map(tuple, got)) == [(0, 2), (0, 201), (0, 401), (1, 2), (2, 2), (3, 2)]


def test_empty_workbooks(spark, tmp_path):
    path = str(tmp_path / "none.xlsx")
    workbooks.write_workbook(spark.createDataFrame([], "at int, name string"), path, "at")
    assert workbooks.read_workbooks(spark, path).count() == 0 and workbooks.read_imported(spark, path).count() == 0
