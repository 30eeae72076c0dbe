"""Workbooks (XLSX) as a source and a sink.

A file is read through Spark's own reader, so it may lie wherever Spark reads; its sheets are then read apart, each by
a task that walks through the sheet's XML and hands rows on as they come. Sheets are written in pieces of some thousand
rows, each by a task, and the driver only strings the finished pieces together in one file, a few at a time.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.sources.registers import HEADERS, in_place, imported
from rollcall.session import materialise, release

#: Blank rows in a row that end a sheet; rows of a written sheet (a sheet can hold 1,048,576 with its header).
BLANK_RUN, SHEET_ROWS = 200, 500_000
#: Rows of a read sheet that are handed on together, and of a written one that are one piece.
_BATCH = 5000
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_LINK = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACK = "http://schemas.openxmlformats.org/package/2006/relationships"
_CELLS = "file string, sheet int, row int, cells map<string,string>"


def _sheets(book: zipfile.ZipFile) -> list[str]:
    """The parts of the workbook's sheets, in the workbook's order."""
    links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    listed = ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{{{_MAIN}}}sheet")
    targets = [links.get(s.get(f"{{{_LINK}}}id")) for s in listed]
    return ["xl/" + t.lstrip("/").removeprefix("xl/") for t in targets if t and "worksheets" in t]


def _text(node: ElementTree.Element) -> str:
    """The text of a string, runs of other formats joined, without readings."""
    return "".join(t.text or "" for c in node if c.tag != f"{{{_MAIN}}}rPh" for t in ([c] if c.tag == f"{{{_MAIN}}}t" else c.iter(f"{{{_MAIN}}}t")))


def _column(reference: str | None, after: int) -> int:
    letters = re.match("[A-Z]+", reference or "")
    if not letters:
        return after
    n = 0
    for c in letters.group():
        n = n * 26 + ord(c) - 64
    return n - 1


def _value(cell: ElementTree.Element, shared: list[str]) -> str:
    kind, raw = cell.get("t", "n"), cell.findtext(f"{{{_MAIN}}}v")
    if kind == "inlineStr":
        inside = cell.find(f"{{{_MAIN}}}is")
        return "" if inside is None else _text(inside)
    if raw is None:
        return ""
    if kind == "s":
        return shared[int(raw)]
    if kind == "b":
        return str(raw == "1")
    if kind == "n":
        return str(float(raw)) if re.search("[.eE]", raw) else str(int(raw))
    return raw


def _rows(book: zipfile.ZipFile, part: str, shared: list[str]) -> Iterator[tuple[int, list[str]]]:
    """(number from 1, values) of a sheet's rows; rows without cells may be missing."""
    number = 0
    with book.open(part) as f:
        rows = None
        for event, node in ElementTree.iterparse(f, ("start", "end")):
            if event == "start":
                rows = node if node.tag == f"{{{_MAIN}}}sheetData" else rows
            elif node.tag == f"{{{_MAIN}}}row":
                number = int(node.get("r") or number + 1)
                values: list[str] = []
                for cell in node.iter(f"{{{_MAIN}}}c"):
                    at = _column(cell.get("r"), len(values))
                    values += [""] * (at + 1 - len(values))
                    values[at] = _value(cell, shared)
                node.clear()
                if rows is not None:
                    rows.clear()  # or the sheet's empty rows would stay
                yield number, values


def sheet_records(book: zipfile.ZipFile, part: str, shared: list[str]) -> Iterator[tuple[int, dict[str, str]]]:
    """(row, {header: value}): the first row names the columns, blank rows are left out, and BLANK_RUN of them end the sheet."""
    headers, last = None, 1
    for number, values in _rows(book, part, shared):
        if headers is None:
            headers = [HEADERS.get(h.strip(), h.strip()) for h in values] if number == 1 else []
            if number == 1:
                continue
        if not any(v.strip() for v in values):
            continue
        if number - last > BLANK_RUN:
            return
        last = number
        yield number, dict(zip(headers, values, strict=False))


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """file, sheet (from 0), row (from 1), cells: the rows of all sheets of one workbook or several (a folder or a pattern).

    Headers are those that `imported` knows, or as the sheet writes them; each sheet has its own. Numbers and truth values are
    texts as Python writes them, formulas their last value, dates the numbers that the file holds. A file that is no
    workbook raises.
    """
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                parts = _sheets(_opened(content))
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(parts)), pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.string())], ["file", "sheet", "part"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, sheet, part, content in zip(*(c.to_pylist() for c in batch.columns[:3]), batch.column(3), strict=True):
                book = _opened(content)
                shared = [_text(s) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in book.namelist() else []
                held: list[tuple[int, dict[str, str]]] = []
                for record in sheet_records(book, part, shared):
                    held.append(record)
                    if len(held) == _BATCH:
                        yield _batch(file, sheet, held)
                        held = []
                if held:
                    yield _batch(file, sheet, held)

    sheets = files.mapInArrow(listed, "file string, sheet int, part string")
    return sheets.join(files, "file").select("file", "sheet", "part", "content").repartition("file", "sheet").mapInArrow(read, _CELLS)


def _opened(content: pa.BinaryScalar) -> zipfile.ZipFile:
    """A workbook read where its bytes lie, without a copy."""
    return zipfile.ZipFile(pa.BufferReader(content.as_buffer()))


def _batch(file: str, sheet: int, held: list[tuple[int, dict[str, str]]]) -> pa.RecordBatch:
    cells = pa.array([list(c.items()) for _, c in held], pa.map_(pa.string(), pa.string()))
    return pa.RecordBatch.from_arrays(
        [pa.array([file] * len(held)), pa.array([sheet] * len(held), pa.int32()), pa.array([n for n, _ in held], pa.int32()), cells], ["file", "sheet", "row", "cells"]
    )


def read_imported(spark: SparkSession, path: str) -> DataFrame:
    """Companies of imported workbooks: key, name, country, domain, email; see registers.imported."""
    rows = read_workbooks(spark, path)
    return imported(rows.select(*(F.try_element_at("cells", F.lit(f)).alias(f) for f in ("name", "country", "domain", "email"))))


# ---------------------------------------------------------------- writing

_UNWRITABLE = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f]")


def _letters(n: int) -> str:
    out = ""
    n += 1
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


_HEAD = f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{_MAIN}" xmlns:r="{_LINK}"><sheetData>'
_RELATIONS = f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{_PACK}">'


def _rows_xml(rows: Iterator[tuple], first: int, links: tuple[int, ...]) -> tuple[str, str, str]:
    """Rows of a sheet, numbered from `first`, with their hyperlinks and relations: texts as inline strings, addresses in the columns
    `links` as hyperlinks (not in the header)."""
    body, refs, relations = io.StringIO(), io.StringIO(), io.StringIO()
    for number, values in enumerate(rows, first):
        body.write(f'<row r="{number}">')
        for at, value in enumerate(values):
            if value is None or value == "":
                continue
            cell, text = f"{_letters(at)}{number}", _UNWRITABLE.sub("", str(value))
            body.write(f'<c r="{cell}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>')
            if at in links and number > 1 and text.startswith(("http://", "https://")):
                refs.write(f'<hyperlink ref="{cell}" r:id="r{cell}"/>')
                relations.write(f'<Relationship Id="r{cell}" Type="{_LINK}/hyperlink" Target={quoteattr(text)} TargetMode="External"/>')
        body.write("</row>")
    return body.getvalue(), refs.getvalue(), relations.getvalue()


class _Out(io.RawIOBase):
    """A stream of the file system that Spark writes to."""

    def __init__(self, stream):
        self._stream = stream

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self._stream.write(bytearray(data))
        return len(data)

    def close(self) -> None:
        if not self.closed:
            self._stream.close()
        super().close()


def write_workbook(rows: DataFrame, path: str, order: str, title: str = "기업 리스트", links: tuple[str, ...] = (), sheet_rows: int = SHEET_ROWS) -> None:
    """One workbook of the rows in the order of a column, which is not written: a header and up to sheet_rows rows to a sheet, the
    title and then the title with a number their names.

    Nulls are empty cells; characters that XML can't hold are left out; addresses in the columns `links` can be followed. Without
    rows there is a sheet with the header alone. The file is written under another name and renamed at the end.
    """
    spark, names = rows.sparkSession, [c for c in rows.columns if c != order]
    dealt = rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("_part", F.spark_partition_id())
    dealt = materialise(dealt, "ordered")  # so that a partition's number stays what it was
    placed = in_place(dealt, "_part", order).withColumn("_sheet", F.floor(F.col("pos") / sheet_rows).cast("int"))
    at = tuple(names.index(c) for c in links)

    def piece(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        first = table["pos"][0].as_py() % sheet_rows + 2  # after the header
        made = _rows_xml(zip(*(table[c].to_pylist() for c in names), strict=True), first, at)
        return pa.table([pa.array([table[c][0].as_py()], pa.int32()) for c in ("_sheet", "_piece")] + [pa.array([x]) for x in made], names=["sheet", "piece", "xml", "refs", "relations"])

    texts = placed.select("_sheet", F.floor(F.col("pos") % sheet_rows / _BATCH).cast("int").alias("_piece"), "pos", *(F.col(c).cast("string").alias(c) for c in names))
    pieces = texts.groupBy("_sheet", "_piece").applyInArrow(piece, "sheet int, piece int, xml string, refs string, relations string")
    made = materialise(pieces, "sheets")
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    draft = target.suffix(".part")
    with _Out(files.create(draft, True)) as raw, zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as book:
        count = max(1, made.select("sheet").distinct().count())
        for n in range(count):
            of = made.where(F.col("sheet") == n)

            def put(out, column: str, of: DataFrame = of) -> None:
                for row in of.orderBy("piece").select(column).toLocalIterator():  # a partition at a time
                    out.write(row[0].encode())

            linked = not of.where("refs <> ''").isEmpty()
            with book.open(f"xl/worksheets/sheet{n + 1}.xml", "w", force_zip64=True) as out:
                out.write((_HEAD + _rows_xml(iter([tuple(names)]), 1, ())[0]).encode())
                put(out, "xml")
                out.write(b"</sheetData>")
                if linked:
                    out.write(b"<hyperlinks>")
                    put(out, "refs")
                    out.write(b"</hyperlinks>")
                out.write(b"</worksheet>")
            with book.open(f"xl/worksheets/_rels/sheet{n + 1}.xml.rels", "w", force_zip64=True) as out:
                out.write(_RELATIONS.encode())
                put(out, "relations")
                out.write(b"</Relationships>")
        for name, text in _frame(count, title):
            book.writestr(name, text)
    files.delete(target, False)
    if not files.rename(draft, target):
        raise OSError(f"{path} could not be put in place")
    release(made)
    release(dealt)


def _frame(count: int, title: str) -> list[tuple[str, str]]:
    """The parts of a workbook beside its sheets."""
    head, kind = '<?xml version="1.0" encoding="UTF-8"?>', "application/vnd.openxmlformats-officedocument.spreadsheetml"
    numbers = range(1, count + 1)
    sheets = "".join(f'<sheet name={quoteattr(title if n == 1 else f"{title} {n}")} sheetId="{n}" r:id="rId{n}"/>' for n in numbers)
    parts = "".join(f'<Override PartName="/xl/worksheets/sheet{n}.xml" ContentType="{kind}.worksheet+xml"/>' for n in numbers)
    return [
        ("xl/workbook.xml", f'{head}<workbook xmlns="{_MAIN}" xmlns:r="{_LINK}"><sheets>{sheets}</sheets></workbook>'),
        ("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{_PACK}">' + "".join(f'<Relationship Id="rId{n}" Type="{_LINK}/worksheet" Target="worksheets/sheet{n}.xml"/>' for n in numbers) + "</Relationships>"),
        ("_rels/.rels", f'{head}<Relationships xmlns="{_PACK}"><Relationship Id="rId1" Type="{_LINK}/officeDocument" Target="xl/workbook.xml"/></Relationships>'),
        ("[Content_Types].xml", f'{head}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>{parts}</Types>'),
    ]
