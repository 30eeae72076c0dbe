"""Every query with SQL equals it on the smallest tables; the others give rows."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from rollcall.plans import captures, catalogue, crawl_queries, desk_queries, merge_queries, run_queries  # noqa: F401  (they register their queries)

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the generated tables are not here")


def _cell(x):
    if isinstance(x, float):
        return None if x != x else round(x, 6)
    if x is None or x is pd.NaT or (not hasattr(x, "__len__") and pd.isna(x)):
        return None
    return str(x)


def _rows(df: pd.DataFrame) -> list[str]:
    return sorted(repr([_cell(x) for x in r]) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", catalogue.QUERIES)
def test_query(spark, name):
    got = catalogue.QUERIES[name](spark, str(DATA)).toPandas()
    if name not in catalogue.ORACLE_SQL:
        assert len(got) > 0
        return
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    want = con.sql(catalogue.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)
