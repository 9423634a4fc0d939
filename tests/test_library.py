"""Cases that the queries do not reach: nulls, empties, wire values, files, permissions, pages, streams."""

from __future__ import annotations

import datetime as dt
import re
import zlib
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tessera.functions import expressions as E
from tessera.functions import predicates as P
from tessera.functions import vectors as V
from tessera.operators import access, aggregates, matching, mutations, ordering, relations, updates
from tessera.sources import codec, files, tables
from tessera.streaming import changes


def values(df, c) -> list:
    return [r[0] for r in df.select(c).collect()]


def test_wire_values_survive():
    x = {"$d": dt.datetime(2024, 5, 1, 12, 0, 0, 123000, tzinfo=dt.timezone.utc), "n": Decimal("0.002"), "big": codec.BigInt(2**70), "l": [1, None, {"$x": True}], "r": re.compile("^a", re.IGNORECASE)}
    y = codec.deserialize(codec.serialize(x))
    assert y == x and isinstance(y["big"], codec.BigInt)
    assert codec.nfd({"é": ["é"]}) == {"é": ["é"]}


def test_nfd_column(spark):
    df = spark.createDataFrame([("é",), ("plain",), (None,)], "s string")
    assert values(df, codec.nfd_column(F.col("s"))) == ["é", "plain", None]


def test_array_predicates_on_nulls(spark):
    df = spark.createDataFrame([(1, [1, 2, None]), (2, []), (3, None), (4, [1])], "id int, a array<int>")
    keep = lambda c: sorted(r[0] for r in df.where(c).select("id").collect())
    a = F.col("a")
    assert keep(P.subset(a, [1, 2])) == [2, 4] and keep(P.subset(a, [])) == [2]
    assert keep(P.superset(a, [])) == [1, 2, 3, 4] and keep(P.superset(a, [1])) == [1, 4]
    assert keep(P.intersects(a, [1, 7])) == [1, 4] and keep(P.intersects(a, [])) == []
    assert keep(P.disjoint(a, [7])) == [1, 2, 4]
    assert keep(P.every(a, lambda x: x > 0)) == [1, 2, 3, 4] and keep(P.some(a, lambda x: x > 1)) == [1]
    assert keep(P.array_size(a, 0)) == [2, 3] and keep(P.empty(a)) == [2, 3] and keep(P.empty(a, False)) == [1, 4]
    assert values(df.orderBy("id"), P.at(a, 1)) == [2, None, None, None]


def test_array_updates(spark):
    df = spark.createDataFrame([([1, 2, 3],)], "a array<int>")
    a = F.col("a")
    added = updates.add_to_set(a, [2, 3, 4])
    assert values(df, added) == [[1, 2, 3, 4]]
    assert values(df, updates.push(added, [4, 5])) == [[1, 2, 3, 4, 4, 5]]
    assert values(df, updates.remove_all(F.array(*map(F.lit, [1, 2, 3, 4, 4, 5])), [4])) == [[1, 2, 3, 5]]
    assert values(df, updates.pop_first(a)) == [[2, 3]] and values(df, updates.pop_last(a, 2)) == [[1]] and values(df, updates.pop_last(a, 9)) == [[]]
    assert values(df, updates.push(a, [3, 9], relation=True)) == [[1, 2, 3, 9]]


def test_decimal_updates(spark):
    df = spark.createDataFrame([(Decimal("0.002"),)], "d decimal(18,9)")
    assert [str(v) for v in values(df, updates.inc(F.col("d"), 1))] == ["1.002000000"]


def test_row_comparison(spark):
    df = spark.createDataFrame([(i, Decimal(i)) for i in range(1, 10)], "n int, d decimal(10,2)")
    assert values(df.where(E.row(F.col("n"), F.col("d").cast("double")) > E.row(3, 2.0)), "n") == list(range(3, 10))


def test_json(spark):
    df = spark.createDataFrame([('{"a":{"$decimal":"1.5"},"t":"x","d":{"$date":0}}',), ('{"a":2,"t":7}',), ("broken",), (None,)], "j string")
    j = F.col("j")
    assert values(df, P.json_number(P.json_path(j, "a"))) == [1.5, 2.0, None, None]
    assert values(df, P.json_string(P.json_path(j, "t"))) == ["x", None, None, None]
    assert values(df, P.json_date(P.json_path(j, "d")))[0] == dt.datetime(1970, 1, 1)


def test_vectors(spark):
    df = spark.createDataFrame([([0.0, 1.0, 2.0],), ([0.0, 0.0, 0.0],), ([1.0],)], "v array<double>")
    origin = [0, None, 0]
    assert [round(x, 4) if x is not None else None for x in values(df, V.distance(F.col("v"), origin))] == [2.2361, 0.0, None]
    assert values(df, V.cosine_distance(F.col("v"), [0, 1, 2])) [1:] == [None, None]


def test_percentiles_and_mode(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 6)], "x double")
    assert aggregates.percentile_discrete(df, [], "x", 0.5, "p").first()["p"] == 3
    assert aggregates.percentile_discrete(df, [], "x", 0.2, "p").first()["p"] == 1
    assert df.agg(aggregates.percentile_continuous("x", 0.2)).first()[0] == pytest.approx(1.8)
    assert spark.createDataFrame([(3,), (5,), (5,), (5,), (7,)], "x int").agg(aggregates.most("x")).first()[0] == 5


def test_ranks_over_ranges(spark):
    """Against sorted lists: null and rare groups, ties, null values, very frequent values, texts, and no rows."""
    rows = [(None if k % 7 == 0 else "a" if k % 3 else "b", None if k % 11 == 0 else float(k * k % 50) if k % 2 else 7.0) for k in range(900)] + [("one", 4.0), ("none", None)]
    df, groups = spark.createDataFrame(rows, "g string, x double").repartition(5), {}
    for g, v in rows:
        if v is not None:
            groups.setdefault(g, []).append(v)
    for p in (0.0, 0.3, 0.5, 1.0):
        got = {r["g"]: r["p"] for r in aggregates.percentile_discrete(df, ["g"], "x", p, "p").collect()}
        assert got == {g: sorted(v)[max(-int(-p * len(v) // 1), 1) - 1] for g, v in groups.items()}
        got = {r["g"]: r["p"] for r in aggregates.percentile_continuous_of(df, ["g"], "x", p, "p").collect()}
        for g, v in groups.items():
            v, at = sorted(v), p * (len(v) - 1)
            low = int(at)
            assert got[g] == pytest.approx(v[low] + (v[min(low + 1, len(v) - 1)] - v[low]) * (at - low))
    whole = sorted(v for own in groups.values() for v in own)
    assert aggregates.percentile_continuous_of(df, [], "x", 0.5, "p").first()["p"] == pytest.approx((whole[(len(whole) - 1) // 2] + whole[len(whole) // 2]) / 2)
    assert {r["g"]: r["m"] for r in aggregates.most_of(df, ["g"], "x", "m").collect()} == {g: min(set(v), key=lambda u: (-v.count(u), u)) for g, v in groups.items()}
    assert aggregates.percentile_discrete(spark.createDataFrame([("x",), ("y",), ("z",)], "s string"), [], "s", 0.5, "p").first()["p"] == "y"
    assert aggregates.percentile_discrete(df.limit(0), ["g"], "x", 0.5, "p").collect() == [] and aggregates.percentile_discrete(df.limit(0), [], "x", 0.5, "p").first()["p"] is None


def test_references_of_no_class(spark):
    lone = spark.createDataFrame([(1,)], "id int")
    assert relations.refs({"Lone": (lone, "id", [], [])}, 1).collect() == [] and relations.nonrefs(lone, "id", {"Lone": (lone, "id", [], [])}).count() == 1


def test_wire_rows(spark):
    df = spark.createDataFrame([(1, dt.datetime(1970, 1, 1, 0, 0, 1), Decimal("0.5"), "é"), (None, None, None, None)], "n int, t timestamp, d decimal(9,3), s string")
    assert values(df, codec.wire_row(df)) == ['{"n":1,"t":{"$date":1000},"d":{"$decimal":"0.500"},"s":"é"}', "{}"]


def test_group_find_of_nothing(spark):
    df = spark.createDataFrame([], "k string, v double")
    r = aggregates.group_find(df, {"n": aggregates.count(), "s": F.sum("v")}, {"g": (F.col("k"), F.sum("v"))}).first()
    assert (r["n"], r["s"], r["g"]) == (0, None, [])


def test_match_and_dangling(spark):
    parents = spark.createDataFrame([(1,), (2,)], "id int")
    children = spark.createDataFrame([(i, 1, float(i)) for i in range(1, 6)], "cid int, parent_id int, number double")
    expanded = relations.expand(relations.by_pointer(children, "parent_id", "cid"), children, "cid")
    top = matching.match(expanded, F.col("number") > 1, [matching.ascending("cid")], limit=1)
    out = relations.with_children(parents, "id", top.select("parent", "cid"), "kids").orderBy("id").collect()
    assert [[k["cid"] for k in r["kids"]] for r in out] == [[2], []]
    stored = spark.createDataFrame([(1, [2, 99, 2])], "id int, ids array<int>")
    assert [r["cid"] for r in relations.expand(relations.by_ids(stored, "id", "ids"), children, "cid").collect()] == [2]
    with pytest.raises(ValueError):
        matching.match(expanded, limit=1)


def test_random_by_weight_and_pages(spark):
    df = spark.createDataFrame([(i, float(i % 3)) for i in range(30)], "id int, w double")
    last = values(ordering.shuffled(df, "w", seed=1), "w")[-10:]
    assert last == [0.0] * 10
    assert [len(b) for b in ordering.batches(df.where("id < 5"), ["id"], 2)] == [2, 2, 1]
    assert ordering.page(df, limit=0).count() == 0


def test_mutations(spark):
    t = spark.createDataFrame([(1, "a", 0), (2, None, 3)], "id int, s string, __v int")
    after, returned = mutations.update(t, F.col("s") == "a", {"s": F.lit("b")})
    assert sorted(map(tuple, after.collect())) == [(1, "b", 1), (2, None, 3)] and returned.count() == 1
    after, gone = mutations.delete(t, F.col("s") == "a")
    assert values(after, "id") == [2] and values(gone, "id") == [1]
    rows = mutations.prepared(spark.createDataFrame([(None, "x")], "n double, s string"), required=["s"], defaults={"n": 42.0})
    assert rows.first()["n"] == 42.0 and rows.first()["_rperm"] == ["*"]
    with pytest.raises(Exception, match="required"):
        mutations.prepared(spark.createDataFrame([(None,)], "s string"), required=["s"]).collect()
    dup = spark.createDataFrame([(1,), (1,), (None,), (None,)], "u int")
    assert [tuple(r) for r in mutations.duplicates(dup, ["u"]).collect()] == [(1, 2)]


def test_permissions(spark):
    rules = access.Rules(class_level={"find": ["role:admin"]}, field_level={"secret": {"read": ["role:admin"]}})
    with pytest.raises(PermissionError):
        access.check_class(access.Viewer(), rules, "find")
    access.check_class(access.Viewer(names=("admin",)), rules, "find")
    df = spark.createDataFrame([(1, "x", ["role:admin"], "u1", ["r1", None]), (2, "y", None, None, None)], "id int, secret string, _rperm array<string>, owner string, teams array<string>")
    assert access.readable_fields(df, access.Viewer(), rules) == ["id", "_rperm", "owner", "teams"]
    with pytest.raises(PermissionError):
        access.readable_fields(df, access.Viewer(), rules, ["secret"])
    see = lambda v, r=access.Rules(): values(access.visible(df, v, r), "id")
    assert see(access.Viewer()) == [] and see(access.Viewer(names=("admin",))) == [1]
    assert see(access.Viewer(user="u1"), access.Rules(user_fields={"read": ["owner"]})) == [1]
    assert see(access.Viewer(roles=("r1",)), access.Rules(role_fields={"read": ["teams"]})) == [1]


def test_files(spark, tmp_path):
    body = bytes(range(256)) * 200
    df = spark.createDataFrame([("t", bytearray(body)), ("u", bytearray(b"")), ("n", None)], "token string, content binary")
    chunks = files.chunked(df, 1000).cache()
    assert chunks.count() == 52 and chunks.agg(F.sum("size")).first()[0] == len(body)
    parts = sorted((r["start"], bytes(r["data"])) for r in files.read_range(chunks, "t", 1500, 3100).collect())
    assert b"".join(p for _, p in parts) == body[1500:3100]
    (tmp_path / "tok").mkdir()
    (tmp_path / "tok" / "0.chunk").write_bytes(zlib.compress(b"hello"))
    r = files.chunk_folder(spark, str(tmp_path)).first()
    assert (r["token"], r["start"], zlib.decompress(bytes(r["data"]))) == ("tok", 0, b"hello")


def test_tables(spark):
    df = spark.createDataFrame([(1, "2")], "a int, b string")
    schema = spark.createDataFrame([], "b int, c string").schema
    assert tuple(tables.rebuilt(df, schema).first()) == (2, None)
    assert tables.catalog(spark)["version"] == [spark.version]
    tables.create(spark, "made_here", schema, bucketed=(2, "b"))
    assert "made_here" in tables.catalog(spark)["tables"]
    spark.sql("drop table made_here")


def test_handlers_of_events(spark, tmp_path):
    log = spark.createDataFrame([("create", 1), ("update", 2), ("create", 3)], "event string, id int")
    log.write.parquet(str(tmp_path / "log"))
    seen: dict[str, list] = {"create": [], "update": []}
    stream = spark.readStream.schema(log.schema).parquet(str(tmp_path / "log"))
    q = changes.on_events(stream, str(tmp_path / "cp"), {k: (lambda df, k=k: seen[k].extend(values(df, "id"))) for k in seen}, once=True)
    q.awaitTermination()
    assert sorted(seen["create"]) == [1, 3] and seen["update"] == [2]


def test_inherited_roles(spark):
    members = spark.createDataFrame([("u", "a"), ("v", "c"), ("w", "lone"), ("w", None), ("u", "a")], "user string, role string")
    roles = spark.createDataFrame([("b", "a"), ("c", "b"), ("a", "c"), ("d", "c"), (None, "d"), ("e", None)], "role string, holds string")
    got = sorted(map(tuple, access.inherited_roles(members, roles).where("role is not null").collect()))
    assert got == sorted([("u", r) for r in "abcd"] + [("v", r) for r in "abcd"] + [("w", "lone")])
    assert access.inherited_roles(members, roles.limit(0)).count() == 4
