import os

import duckdb
import pytest

import __spark_entry__ as entry
from corvane import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings labels".split()


def rows(columns, values):
    keep = lambda v: round(v, 9) + 0.0 if isinstance(v, float) else v
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(keep(r[i]) for i in order) for r in values), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    got = rows(df.columns, df.collect())
    assert got
    if name in catalogue.SQL:
        want = duck.sql(catalogue.SQL[name])
        assert sorted(df.columns) == sorted(want.columns)
        assert got == rows(want.columns, want.fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", ["recall_at_k", "ivf_ip_recall", "pq_recall", "ivfpq_recall"])
def test_indexes_find_nine_tenths(spark, name):
    found = [r["recall"] for r in catalogue.QUERIES[name](spark, SF).collect()]
    assert sum(found) / len(found) >= 0.9


def test_entry(spark):
    assert entry.entry(spark).columns == ["qid", "rank", "vec_id", "distance"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
