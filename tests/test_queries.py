import duckdb
import pytest

import __spark_entry__ as entry

from .conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(found, columns):
    number = lambda v: round(float(v), 6) if v is not None and not isinstance(v, (str, bool)) else v
    return sorted(repr([number(r[c]) for c in columns]) for r in found)


@pytest.mark.parametrize("name", sorted(n for n in entry.ORACLE))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got = entry.queries()[name](spark, DATA)
    want = con.execute(entry.ORACLE[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert rows([r.asDict() for r in got.collect()], sorted(names)) == rows([dict(zip(names, r, strict=True)) for r in want.fetchall()], sorted(names))


@pytest.mark.parametrize("name", ["fits_table_read", "fits_column_stats", "fits_image_and_cells", "fits_select_stats", "fits_export_csv", "plot_fits_scatter"])
def test_fits_without_pushdown(plain, name):
    test_against_sql(plain, name)


def test_entry(spark):
    assert entry.entry(spark).count() == 1
