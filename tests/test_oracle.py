"""Every query of the library against its SQL, over the smallest tables."""

from __future__ import annotations

from collections import Counter

import duckdb
import pytest

from tessera.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(table) -> tuple[list[str], Counter]:
    names = sorted(table.column_names)
    return names, Counter(tuple(round(v, 6) if isinstance(v, float) else v for v in (r[n] for n in names)) for r in table.to_pylist())


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, oracle, name):
    got = rows(catalog.queries()[name](spark, SF).toArrow())
    sql = catalog.oracle_sql().get(name)
    if sql:
        assert got == rows(oracle.execute(sql).to_arrow_table())
    else:
        assert got[1]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
