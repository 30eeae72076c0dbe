"""A sheet is read without keeping the rows that were read."""

from __future__ import annotations

import io
import tracemalloc
import zipfile

from rollcall.sources import workbooks


def test_rows_that_were_read_do_not_stay():
    n, held = 60_000, io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as book:
        rows = "".join(f'<row r="{k}"><c t="n"><v>{k}</v></c></row>' for k in range(1, n + 1))
        book.writestr("s.xml", f'<worksheet xmlns="{workbooks._MAIN}"><sheetData>{rows}</sheetData></worksheet>')
    tracemalloc.start()
    assert sum(1 for _ in workbooks._rows(zipfile.ZipFile(held), "s.xml", [])) == n
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2_000_000
