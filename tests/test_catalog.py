"""Every query of the catalogue against its SQL on the smallest tables."""

import glob
import os
from numbers import Number

import duckdb
import pytest

from lexloom.plans import catalog, load

load()
FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def other():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def rows(frame, cols):
    # a long column with nulls may come as floats from one engine and as integers from the other
    plain = lambda v: None if v is None or v != v else round(float(v), 5) if isinstance(v, Number) and not isinstance(v, bool) else v if isinstance(v, str) else str(v)
    out = [tuple(plain(v) for v in r) for r in frame[cols].astype(object).where(frame[cols].notna(), None).itertuples(index=False)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_matches_sql(spark, other, name):
    ours, theirs = catalog.QUERIES[name](spark, FOLDER).toPandas(), other.execute(catalog.SQL[name]).fetchdf()
    cols = sorted(theirs.columns)
    assert sorted(ours.columns) == cols
    assert rows(ours, cols) == rows(theirs, cols)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_nothing_but_the_entry_knows_llm():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for path in glob.glob(f"{root}/lexloom/**/*.py", recursive=True):
        if "/llm/" not in path:
            assert "lexloom.llm" not in open(path).read(), path
