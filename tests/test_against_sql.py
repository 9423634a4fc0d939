"""Queries against their SQL over rows that the given tables lack."""

from __future__ import annotations

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.operators import access
from tessera.plans import catalog


def both(spark, folder, name, **tables) -> tuple[list, list]:
    """What the query and its SQL give over these tables."""
    con = duckdb.connect()
    con.execute("set threads = 1")
    for table, df in tables.items():
        df.coalesce(1).write.parquet(f"{folder}/{table}.parquet")
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    got = catalog.queries()[name](spark, str(folder))
    return sorted(map(tuple, got.collect())), sorted(con.execute(catalog.oracle_sql()[name]).fetchall())


def test_a_customer_without_orders_has_no_list(spark, tmp_path):
    customer = spark.createDataFrame([(1,), (2,), (3,)], "c_custkey long")
    orders = spark.createDataFrame([(12, 1), (3, 1), (None, 1), (None, 3), (7, None)], "o_orderkey long, o_custkey long")
    got, wanted = both(spark, tmp_path, "085_reverse_pointer", customer=customer, orders=orders)
    assert got == wanted == [(1, "3,12"), (2, None), (3, None)]


JOBS = "o_orderkey long, o_orderstatus string, o_orderpriority string, o_orderdate timestamp_ntz"


def test_the_first_of_tied_jobs_is_the_least_id(spark, tmp_path):
    day = dt.datetime(1995, 1, 1)
    orders = spark.createDataFrame([(k, "O", "3-MEDIUM", day) for k in (9, 4, 7, 5)] + [(1, "O", "5-LOW", day), (2, "F", "3-MEDIUM", day), (3, "O", "1-URGENT", day)], JOBS)
    for parts in (1, 3):
        orders.repartition(parts).sortWithinPartitions("o_orderdate", "o_orderpriority", (orders["o_orderkey"] * -1)).write.parquet(str(tmp_path / str(parts) / "orders.parquet"))
        assert catalog.queries()["234_235_next_job"](spark, str(tmp_path / str(parts))).collect() == [(4,)]


def test_nulls_make_no_job_due(spark, tmp_path):
    early = dt.datetime(1990, 1, 1)
    orders = spark.createDataFrame([(1, "O", "3-MEDIUM", None), (2, "O", None, early), (3, None, "3-MEDIUM", early), (4, "F", "5-LOW", None), (5, "O", "5-LOW", dt.datetime(1995, 1, 1))], JOBS)
    got, wanted = both(spark, tmp_path, "234_235_next_job", orders=orders)
    assert got == wanted == [(5,)]


@pytest.mark.parametrize("ways", [1 << 20, 0])
def test_tasks_of_a_role_closure_follow_its_pairs(spark, monkeypatch, ways):
    """Users in one role of a chain, in two of it, in one of a cycle, in one that none holds, and in none."""
    monkeypatch.setattr(access, "PAIRS", 100, raising=False)
    monkeypatch.setattr(access, "WAYS", ways, raising=False)
    held = {r: set(range(r + 1)) for r in range(12)} | {20: {20, 21}, 21: {20, 21}, 30: {30}, None: {None}}
    own = [(u, u % 12) for u in range(300)] + [(u, u % 7) for u in range(0, 300, 2)] + [(400, 20), (401, 30), (402, None), (None, 1), (None, 2), (5, 5)]
    members = spark.createDataFrame(own, "user long, role int")
    roles = spark.createDataFrame([(r - 1, r) for r in range(1, 12)] + [(20, 21), (21, 20)], "role int, holds int")
    got = access.inherited_roles(members, roles).select("user", "role", F.spark_partition_id().alias("task")).collect()
    wanted = {(u, to) for u, r in own for to in held[r]}
    assert len(got) == len(wanted) and {(r["user"], r["role"]) for r in got} == wanted
    each = [sum(r["task"] == t for r in got) for t in {r["task"] for r in got}]
    assert len(each) > len(wanted) / 200 and max(each) < 400
