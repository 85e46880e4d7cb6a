"""Every query over FITS against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from heliograph.plans import structure  # noqa: F401
from heliograph.plans.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def plain(frame):
    def text(v):
        if v is None or v != v:
            return ""
        if isinstance(v, float) and v == int(v):
            return str(int(v))
        return str(v)

    return sorted(tuple(text(row[c]) for c in sorted(frame.columns)) for row in frame.astype(object).where(frame.notna(), None).to_dict("records"))


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got, want = QUERIES[name](spark, DATA).toPandas(), con.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_entry_lists_them():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())
