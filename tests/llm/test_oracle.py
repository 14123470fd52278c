"""Each training-data query against its SQL on the small test tables, where both are there."""

import glob
import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")
pytest.importorskip("quillrank.llm")
FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")

from quillrank.llm.oracle import ORACLE  # noqa: E402
from quillrank.llm.queries import QUERIES  # noqa: E402


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for p in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return str(v)


@pytest.mark.parametrize("name", sorted(set(QUERIES) & set(ORACLE)))
def test_query_equals_sql(spark, tables, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    rel = tables.execute(ORACLE[name])
    own = [d[0] for d in rel.description]
    assert sorted(own) == columns
    assert got == sorted(tuple(plain(r[own.index(c)]) for c in columns) for r in rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() >= 0
