import duckdb
import pytest

import __spark_entry__ as entry
from stratavec.plans import queries as core

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings events operations index_requests embedding_data".split()


def rows(names, values):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(str([v[k] for k in order]) for v in values)


@pytest.mark.parametrize("name", sorted(core.ORACLE_SQL))
def test_sql_agrees(spark, name):
    con = duckdb.connect()
    con.execute("SET timezone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, cur.fetchall())


def test_every_sql_has_its_query():
    assert set(core.ORACLE_SQL) <= set(core.QUERIES) and all(core.ORACLE_SQL.values())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
