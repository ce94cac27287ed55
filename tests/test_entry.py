import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_catalogue():
    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q) and len(q) >= 50


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_queries_match_their_sql(spark):
    """Every query of the library itself that has SQL, on the smallest tables."""
    duckdb = pytest.importorskip("duckdb")
    from kithline.plans.queries import QUERIES, SQL

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")

    def norm(v):
        return float(f"{v:.8g}") + 0.0 if isinstance(v, float) else v

    for name, sql in SQL.items():
        df = QUERIES[name](spark, SF)
        cols = sorted(df.columns)
        want = con.sql(sql)
        at = [want.columns.index(c) for c in cols]
        a = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
        b = sorted((tuple(norm(r[i]) for i in at) for r in want.fetchall()), key=repr)
        assert a == b, name
    assert entry.entry(spark).count() > 0
