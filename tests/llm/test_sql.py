import duckdb
import pytest

from lumenframe.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    want = con.execute(ORACLE[name])
    names = [d[0] for d in want.description]
    got = QUERIES[name](spark, folder)
    assert sorted(got.columns) == sorted(names)
    assert sorted(repr([r[n] for n in names]) for r in got.collect()) == sorted(repr(list(r)) for r in want.fetchall())
