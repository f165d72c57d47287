from pathlib import Path

import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from brightloom.plans import queries as core

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no test tables here")


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_imports_nothing_of_the_subpackage():
    root = Path(entry.__file__).parent / "brightloom"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "brightloom.llm" not in p.read_text(encoding="utf-8"), p


def plain(value):
    if value is None or (not isinstance(value, (list, tuple, np.ndarray)) and pd.isna(value)):
        return None
    if isinstance(value, (list, tuple, np.ndarray)):
        return tuple(plain(x) for x in value)
    return round(float(value), 5) + 0.0 if isinstance(value, (int, float, np.number)) and not isinstance(value, bool) else str(value)


@pytest.fixture(scope="module")
def database():
    con = pytest.importorskip("duckdb").connect()
    con.execute("set timezone = 'UTC'")
    for p in SF.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(core.ORACLES))
def test_same_rows_as_sql(spark, database, name):
    want = database.execute(core.ORACLES[name]).df()
    got = core.QUERIES[name](spark, str(SF)).toPandas()[list(want.columns)]
    rows = lambda df: sorted(repr([plain(x) for x in r]) for r in df.itertuples(index=False, name=None))
    assert len(got) == len(want) and (len(want) or name.startswith("answer_citation"))  # so small a table has no citations
    assert rows(got) == rows(want)


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
