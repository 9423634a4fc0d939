"""Cases in which queries once left rows out."""

from __future__ import annotations

from tessera.functions import predicates as P
from tessera.plans import catalog


def test_streams_read_every_file_of_a_table(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    for name, where in (("227_live_query", "event_type = 'click' and value > 5"), ("228_live_acl", "user_id % 2 = 0")):
        got = sorted(r["event_id"] for r in catalog.queries()[name](spark, str(tmp_path)).collect())
        assert got == sorted(r["event_id"] for r in events.where(where).collect())


def test_a_null_in_a_long_list_finds_nulls(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b"), (5000, "c"), (2, None)], "k long, v string")
    for size in (P.LIST_LIMIT - 1, P.LIST_LIMIT, P.LIST_LIMIT + 1, P.LIST_LIMIT + 2):
        known = list(range(1, size))
        assert sorted(r["v"] or "" for r in P.keep_listed(df, "k", [*known, None]).collect()) == ["", "a", "b"]
        assert sorted(r["v"] or "" for r in P.keep_listed(df, "k", [*known, 0]).collect()) == ["", "a"]
