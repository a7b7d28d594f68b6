import duckdb
import pytest

import __spark_entry__
from corpusmill.plans import catalogue

SF = "/root/testdata/sf0.001"


def rows_of(frame):
    return sorted(tuple("" if v is None else str(v) for v in r) for r in frame)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_its_sql(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in catalogue.SQL:
        assert rows
        return
    cur = con.execute(catalogue.SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = rows_of([[r[names.index(c)] for c in sorted(names)] for r in cur.fetchall()])
    assert rows_of([[r[c] for c in sorted(names)] for r in rows]) == want


def test_entry(spark):
    assert __spark_entry__.entry(spark).first().n > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
