"""Rules that the queries over the given tables do not reach."""

from __future__ import annotations

import datetime as dt
import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tessera.operators import aggregates, matching, relations, updates
from tessera.sources import codec, tables
from tessera.streaming import changes


def test_counts_of_any_name_are_zero_without_children(spark):
    parents = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    children = spark.createDataFrame([(1, "de"), (1, "fr")], "parent long, land string")
    got = matching.group_matches(parents, "id", children, "all", n=aggregates.count(), country=F.max("land")).select("id", "name", "all.*").collect()
    assert sorted(map(tuple, got)) == [(1, "a", 2, "fr"), (2, "b", 0, None)]


def test_columns_of_any_name_stay(spark):
    left = spark.createDataFrame([(1, "x", 5)], "id long, _key string, _p int")
    right = spark.createDataFrame([(1, "y", "z")], "id long, _key string, _old string")
    assert relations.with_pointer(left, "id", right, "id", "to").select("id", "_key", "_p", "to._key").collect() == [(1, "x", 5, "y")]
    assert relations.having_some(left, "id", right.withColumnRenamed("id", "parent"), F.lit(True)).collect() == [(1, "x", 5)]
    assert [tuple(r) for r in changes.changes(right, right.withColumn("_old", F.lit("new")), "id").collect()] == [("update", 1, "y", "new")]
    ranked = spark.createDataFrame([(1, 9)], "parent long, rank int")
    with pytest.raises(ValueError):
        matching.match(ranked, sort=[F.col("rank")])
    assert matching.match(ranked, sort=[F.col("rank")], rank="number").collect() == [(1, 9, 1)]


def test_objects_on_the_wire():
    me = codec.Object("User", {"name": "a", "at": dt.datetime(2020, 1, 1, tzinfo=dt.timezone.utc), "$odd": [Decimal("1.5")]})
    me.attributes["friends"] = [{"of": me}]
    sent = json.loads(codec.serialize({"user": me}))
    assert sent["user"]["$object"]["className"] == "User" and sent["user"]["$object"]["attributes"]["friends"] == [{"of": {"$ref": 1}}]
    back = codec.deserialize(codec.serialize({"user": me}))["user"]
    assert back.attributes["friends"][0]["of"] is back and back.attributes["$odd"] == [Decimal("1.5")] and back.attributes["at"] == me.attributes["at"]


def test_rows_on_the_wire_are_tagged_at_any_depth(spark):
    row = spark.sql("select named_struct('at', timestamp'1970-01-01 00:00:01', 'list', array(1.5bd, null), 'm', map('$k', date'1970-01-02')) as s, 1 as `$n`")
    assert json.loads(row.select(codec.wire_row(row)).first()[0]) == {"s": {"at": {"$date": 1000}, "list": [{"$decimal": "1.5"}, None], "m": {"$$k": {"$date": 86400000}}}, "$$n": 1}


def test_one_operator_for_each_key(spark):
    df = spark.createDataFrame([(3, 4)], "a int, b int")
    columns = {c: F.col(c) for c in df.columns}
    assert df.select(*(c.alias(n) for n, c in updates.applied(columns, {"a": {"$inc": 2}, "b": {"$set": 9}}).items())).collect() == [(5, 9)]
    for wrong in ({"a": {"$inc": 1, "$mul": 2}}, {"a": {}}, {"a": {"$nope": 1}}):
        with pytest.raises(ValueError):
            updates.applied(columns, wrong)
    with pytest.raises(ValueError):
        aggregates.group(df, F.col("a"), (F.col("b"), F.sum("a")), "nested")


def test_payloads_carry_system_columns_only(spark):
    log = spark.createDataFrame([("create", "1", "hidden")], "event string, _id string, secret string")
    assert changes.published(log).columns == ["event", "_id"]


def test_a_database_table_is_read_in_ranges(spark):
    url, driver = "jdbc:derby:memory:rules;create=true", "org.apache.derby.jdbc.EmbeddedDriver"
    spark.range(100).write.jdbc(url, "numbers", mode="overwrite", properties={"driver": driver})
    found = tables.read_jdbc(spark, url, "numbers", "id", 0, 100, 4, fetch=10, driver=driver)
    assert found.rdd.getNumPartitions() == 4 and sorted(r[0] for r in found.collect()) == list(range(100))
