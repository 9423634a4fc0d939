"""Queries for joins, sub-queries, aggregates, sorts, mutations, access rules, files and streams, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions.vectors import distance
from ..operators import access, aggregates, matching, mutations, ordering, relations
from ..operators.updates import element, field
from ..sources import codec, files, tables
from ..streaming import changes
from .scalar import HERE, here

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of (spark, table), table reading one of the driver's tables by name."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            def table(name: str) -> DataFrame:
                return tables.read(spark, f"{sf_dir}/{name}.parquet")

            table.folder = sf_dir
            return f(spark, table)

        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return run

    return add


def _money(c):
    return F.round(c, 2) + 0.0


def _items_of_orders(t) -> DataFrame:
    return relations.owned(t("orders"), "o_custkey")


@query("030_group_find", "select o_orderstatus as key, round(sum(o_totalprice), 2) + 0.0 as value from orders where o_totalprice > 100000 group by 1")
def status_totals(spark, t):
    return t("orders").where(F.col("o_totalprice") > 100000).groupBy(F.col("o_orderstatus").alias("key")).agg(_money(F.sum("o_totalprice")).alias("value"))


@query("001_class_scan", "select n_nationkey, n_name, n_regionkey from nation")
def _(spark, t):
    return t("nation")


@query("002_relation_scan", "select o_orderkey from orders where o_custkey = 7")
def _(spark, t):
    return _items_of_orders(t).where(F.col("parent") == 7).select("o_orderkey")


@query("021_find", "select c_custkey, c_name from customer where c_acctbal > 500 and c_mktsegment = 'BUILDING'")
def _(spark, t):
    return t("customer").where((F.col("c_acctbal") > 500) & P.equal(F.col("c_mktsegment"), "BUILDING")).select("c_custkey", "c_name")


@query("022_first", "select c_custkey from customer order by c_custkey limit 1")
def _(spark, t):
    return ordering.page(ordering.sort(t("customer"), ("c_custkey", 1)), limit=1).select("c_custkey")


@query("023_get", "select c_custkey, c_name from customer where c_custkey = 11")
def _(spark, t):
    return t("customer").where(P.equal(F.col("c_custkey"), 11)).limit(1).select("c_custkey", "c_name")


@query("024_count", "select count(*) as n from orders where o_orderstatus = 'F'")
def _(spark, t):
    return t("orders").where("o_orderstatus = 'F'").agg(aggregates.count().alias("n"))


@query("025_exists", "select true as any_f, false as any_q")
def _(spark, t):
    found = [ordering.exists(t("orders").where(F.col("o_orderstatus") == s)) for s in ("F", "Q")]
    return spark.createDataFrame([tuple(found)], "any_f boolean, any_q boolean")


@query("027_random", "select c_custkey from customer")
def _(spark, t):
    return ordering.shuffled(t("customer")).select("c_custkey")


@query("028_random_weighted", "select p_partkey from part")
def _(spark, t):
    return ordering.shuffled(t("part"), weight="p_retailprice").select("p_partkey")


@query("031_refs", "select distinct 'Order' as class, o_orderkey::varchar as id from orders where o_custkey = 5 union select 'Vip', c_custkey::varchar from customer where c_nationkey = 5")
def _(spark, t):
    return relations.refs({"Order": (t("orders"), "o_orderkey", ["o_custkey"], []), "Vip": (t("customer"), "c_custkey", ["c_nationkey"], [])}, 5)


@query("032_nonrefs", "select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 300000)")
def _(spark, t):
    return relations.nonrefs(t("customer"), "c_custkey", {"Order": (t("orders").where("o_totalprice > 300000"), "o_orderkey", ["o_custkey"], [])}).select("c_custkey")


@query("033_batches", "select o_orderkey from orders where (o_custkey, o_orderkey) > (100, 50)")
def _(spark, t):
    return ordering.after(t("orders"), ["o_custkey", "o_orderkey"], [100, 50]).select("o_orderkey")


@query("035_sort", "select p_partkey from (select p_partkey, row_number() over (order by p_size desc, p_partkey) as r from part) where r <= 50")
def _(spark, t):
    return ordering.page(ordering.sort(t("part"), ("p_size", -1), ("p_partkey", 1)), limit=50).select("p_partkey")


@query("037_skip_limit", "select o_orderkey from orders order by o_totalprice, o_orderkey limit 10 offset 20")
def _(spark, t):
    return ordering.page(ordering.sort(t("orders"), ("o_totalprice", 1), ("o_orderkey", 1)), skip=20, limit=10).select("o_orderkey")


@query("038_includes", "select o_orderkey, c_name as customer_name, n_name as nation from orders left join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey")
def _(spark, t):
    people = relations.with_pointer(t("customer"), "c_nationkey", t("nation"), "n_nationkey", "nation")
    out = relations.with_pointer(t("orders"), "o_custkey", people, "c_custkey", "customer")
    return out.select("o_orderkey", F.col("customer.c_name").alias("customer_name"), F.col("customer.nation.n_name").alias("nation"))


@query("039_match", "select parent, o_orderkey, rank from (select o_custkey as parent, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey)::int as rank from orders where o_orderstatus <> 'P') where rank between 2 and 3")
def _(spark, t):
    found = matching.match(_items_of_orders(t), F.col("o_orderstatus") != "P", [matching.descending("o_totalprice"), matching.ascending("o_orderkey")], skip=1, limit=2)
    return found.select("parent", "o_orderkey", "rank")


@query("040_group_matches", "select c_custkey, coalesce(n, 0) as n, total from customer left join (select o_custkey, count(*) as n, round(sum(o_totalprice), 2) + 0.0 as total from orders where o_totalprice > 200000 group by 1) on o_custkey = c_custkey")
def _(spark, t):
    found = matching.match(_items_of_orders(t), F.col("o_totalprice") > 200000)
    out = matching.group_matches(t("customer"), "c_custkey", found, "big", count=aggregates.count(), total=_money(F.sum("o_totalprice")))
    return out.select("c_custkey", F.col("big.count").alias("n"), "big.total")


@query("062_set_on_relation", "select o_custkey as parent from orders group by 1 having list_has_any(list(o_orderpriority), ['1-URGENT'])")
def _(spark, t):
    return _items_of_orders(t).where(P.contained_in(F.col("o_orderpriority"), ["1-URGENT"])).select("parent").distinct()


@query("073_every_relation", "select c_custkey from customer where c_custkey not in (select o_custkey from orders where not o_totalprice > 20000)")
def _(spark, t):
    return relations.having_every(t("customer"), "c_custkey", _items_of_orders(t), F.col("o_totalprice") > 20000).select("c_custkey")


@query("074_some_relation", "select c_custkey from customer where c_custkey in (select o_custkey from orders where o_totalprice > 450000) or c_acctbal < 0")
def _(spark, t):
    flagged = relations.with_some(t("customer"), "c_custkey", _items_of_orders(t), F.col("o_totalprice") > 450000, "rich")
    return flagged.where(F.col("rich") | (F.col("c_acctbal") < 0)).select("c_custkey")


@query("074_some_relation_semi", "select c_custkey from customer where c_custkey in (select o_custkey from orders where o_totalprice > 450000)")
def _(spark, t):
    return relations.having_some(t("customer"), "c_custkey", _items_of_orders(t), F.col("o_totalprice") > 450000).select("c_custkey")


@query("070_empty_relation", "select c_custkey from customer left join (select o_custkey, count(*) as n from orders where o_totalprice > 400000 group by 1) on c_custkey = o_custkey where n is null")
def _(spark, t):
    big = _items_of_orders(t).where("o_totalprice > 400000")
    return relations.with_size(t("customer"), "c_custkey", big, "n").where("n = 0").select("c_custkey")


@query("081_ttl", "select event_id from events where ts > timestamp '2024-01-10'")
def _(spark, t):
    late = t("events").withColumn("_expired_at", F.when(F.col("ts") <= F.lit("2024-01-10").cast("timestamp"), F.col("ts")))
    return access.visible(late, access.Viewer(master=True)).select("event_id")


@query("082_pointer", "select c_custkey, n_name from customer left join nation on c_nationkey = n_nationkey")
def _(spark, t):
    return relations.with_pointer(t("customer"), "c_nationkey", t("nation"), "n_nationkey", "nation").select("c_custkey", "nation.n_name")


@query("083_pointer_chain", "select c_custkey, r_name from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey")
def _(spark, t):
    nations = relations.with_pointer(t("nation"), "n_regionkey", t("region"), "r_regionkey", "region")
    return relations.with_pointer(t("customer"), "c_nationkey", nations, "n_nationkey", "nation").select("c_custkey", "nation.region.r_name")


def _stored(t) -> DataFrame:
    """Customers with a stored list of the ids of their orders, and one that leads nowhere."""
    ids = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_list("o_orderkey").alias("ids"))
    return ids.withColumn("ids", F.concat("ids", F.array(F.lit(-1).cast("long"))))


@query("084_stored_relation", "select o_custkey as parent, count(*) as n, round(sum(o_totalprice), 2) + 0.0 as total from orders group by 1")
def _(spark, t):
    pairs = relations.by_ids(_stored(t), "c_custkey", "ids")
    return relations.expand(pairs, t("orders"), "o_orderkey").groupBy("parent").agg(aggregates.count().alias("n"), _money(F.sum("o_totalprice")).alias("total"))


@query("085_reverse_pointer", "select c_custkey, array_to_string(list(o_orderkey order by o_orderkey), ',') as orders from customer left join orders on c_custkey = o_custkey group by 1")
def _(spark, t):
    people = relations.with_children(t("customer"), "c_custkey", _items_of_orders(t).select("parent", "o_orderkey"), "orders")
    joined = F.array_join(F.transform("orders", lambda o: o["o_orderkey"].cast("string")), ",")
    return people.select("c_custkey", F.nullif(joined, F.lit("")).alias("orders"))  # null for a customer without orders


@query("086_reverse_relation", "select o_orderkey as parent, o_custkey as child from orders")
def _(spark, t):
    return relations.by_ids_of_child(_stored(t).withColumn("ids", F.filter("ids", lambda i: i >= 0)), "c_custkey", "ids")


@query("087_multi_hop", "select n_regionkey as parent, count(distinct o_orderkey) as n from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1")
def _(spark, t):
    ways = relations.through(relations.by_pointer(t("nation"), "n_regionkey", "n_nationkey"), relations.by_pointer(t("customer"), "c_nationkey", "c_custkey"), relations.by_pointer(t("orders"), "o_custkey", "o_orderkey"))
    return ways.groupBy("parent").agg(aggregates.count().alias("n"))


@query("088_virtual_hop", "select distinct o_custkey as parent, l_partkey as child from orders join lineitem on l_orderkey = o_orderkey")
def _(spark, t):
    return relations.through(relations.by_pointer(t("orders"), "o_custkey", "o_orderkey"), t("lineitem").select(F.col("l_orderkey").alias("parent"), F.col("l_partkey").alias("child")))


@query("089_lateral", "select o_custkey as parent, o_orderkey, o_orderpriority from orders")
def _(spark, t):
    return relations.expand(relations.by_ids(_stored(t), "c_custkey", "ids"), t("orders"), "o_orderkey").select("parent", "o_orderkey", "o_orderpriority")


@query("090_relation_in_shape", "select c_custkey, n_name from customer join nation on c_nationkey = n_nationkey")
def _(spark, t):
    shaped = t("customer").select("c_custkey", F.struct("c_nationkey").alias("home")).withColumn("_home", F.col("home.c_nationkey"))
    return relations.with_pointer(shaped, "_home", t("nation"), "n_nationkey", "nation").select("c_custkey", "nation.n_name")


@query("091_related_by", "select o_orderkey from orders where o_custkey = 3")
def _(spark, t):
    pairs = relations.by_ids(_stored(t), "c_custkey", "ids")
    return relations.related_by(t("orders"), "o_orderkey", pairs, 3).select("o_orderkey")


@query("094_hidden_side", "select o_orderkey, case when c_acctbal > 0 then c_name end as customer from orders left join customer on o_custkey = c_custkey")
def _(spark, t):
    people = t("customer").withColumn("_rperm", F.when(F.col("c_acctbal") > 0, F.array(F.lit("*"))).otherwise(F.array(F.lit("role:admin"))))
    seen = access.visible(people, access.Viewer()).drop("_rperm")
    return relations.with_pointer(t("orders"), "o_custkey", seen, "c_custkey", "c").select("o_orderkey", F.col("c.c_name").alias("customer"))


@query("095_dangling", "select o_custkey as parent, o_orderkey as child from orders")
def _(spark, t):
    return mutations.only_known_ids(relations.by_ids(_stored(t), "c_custkey", "ids"), t("orders"), "o_orderkey").select("parent", "child")


@query("096_long_list", "select o_orderkey from orders where o_custkey % 7 = 0 and o_custkey < 10500")
def _(spark, t):
    return P.keep_listed(t("orders"), "o_custkey", list(range(0, 10500, 7))).select("o_orderkey")


@query("100_match_list", "select c_custkey, coalesce(array_to_string(list(o_orderkey order by r), ','), '') as top from customer left join (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) as r from orders) on c_custkey = o_custkey and r <= 3 group by 1")
def _(spark, t):
    found = matching.match(_items_of_orders(t), sort=[matching.descending("o_orderdate"), matching.ascending("o_orderkey")], limit=3)
    out = relations.with_children(t("customer"), "c_custkey", found.select("parent", "rank", "o_orderkey"), "top", ["rank"])
    return out.select("c_custkey", F.array_join(F.transform("top", lambda o: o["o_orderkey"].cast("string")), ",").alias("top"))


@query("101_nested_match", "select n_nationkey as parent, count(*) as n from nation join customer on c_nationkey = n_nationkey join (select o_custkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as r from orders) on o_custkey = c_custkey and r <= 1 group by 1")
def _(spark, t):
    inner = matching.match(_items_of_orders(t), sort=[matching.descending("o_totalprice"), matching.ascending("o_orderkey")], limit=1)
    outer = relations.through(relations.by_pointer(t("customer"), "c_nationkey", "c_custkey"), inner.select("parent", F.col("o_orderkey").alias("child")))
    return outer.groupBy("parent").agg(aggregates.count().alias("n"))


@query("102_default_match", "select o_custkey as parent, count(*) as n from orders where o_orderstatus = 'O' and o_totalprice > 100000 group by 1")
def _(spark, t):
    options = matching.merged({"where": F.col("o_orderstatus") == "F"}, {"where": F.col("o_orderstatus") == "O"}, {"where": F.col("o_totalprice") > 100000})
    return matching.match(_items_of_orders(t), **options).groupBy("parent").agg(aggregates.count().alias("n"))


@query("104_sort_joined", "select o_orderkey from (select o_orderkey, row_number() over (order by c_acctbal desc, o_orderkey) as r from orders join customer on o_custkey = c_custkey) where r <= 25")
def _(spark, t):
    joined = relations.with_pointer(t("orders"), "o_custkey", t("customer"), "c_custkey", "customer")
    return ordering.page(ordering.sort(joined, ("customer.c_acctbal", -1), ("o_orderkey", 1)), limit=25).select("o_orderkey")


@query("105_sort_by_aggregate", "select o_custkey as c_custkey from (select o_custkey, row_number() over (order by count(*) desc, o_custkey) as r from orders group by 1) where r <= 20")
def _(spark, t):
    out = matching.group_matches(t("customer"), "c_custkey", _items_of_orders(t), "orders", count=aggregates.count())
    return ordering.page(ordering.sort(out, ("orders.count", -1), ("c_custkey", 1)), limit=20).select("c_custkey")


@query("106_top_k", "select o_orderkey from (select o_orderkey, row_number() over (order by o_totalprice desc, o_orderkey) as r from orders) where r <= 100")
def _(spark, t):
    return ordering.page(ordering.sort(t("orders"), ("o_totalprice", -1), ("o_orderkey", 1)), limit=100).select("o_orderkey")


@query("107_vector_top_k", f"select vec_id from (select vec_id, row_number() over (order by sqrt(list_sum(list_transform(list_zip(embedding::double[], {here}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))), vec_id) as r from embeddings) where r <= 10")
def _(spark, t):
    return ordering.nearest(t("embeddings"), distance(F.col("embedding"), HERE), 10, "vec_id").select("vec_id")


@query("108_fetch_limit", "select c_custkey from customer order by c_custkey limit 1000")
def _(spark, t):
    return ordering.page(ordering.sort(t("customer"), ("c_custkey", 1)), limit=5000, most=1000).select("c_custkey")


@query("109_null_order", "select c_custkey from (select c_custkey, row_number() over (order by case when c_acctbal > 0 then c_nationkey end desc nulls first, c_custkey) as r from customer) where r <= 40")
def _(spark, t):
    key = F.when(F.col("c_acctbal") > 0, F.col("c_nationkey"))
    return ordering.page(ordering.sort(t("customer"), (key, -1), ("c_custkey", 1)), limit=40).select("c_custkey")


_PLAIN = "select count(*) as n, round(sum(o_totalprice), 2) as total, round(avg(o_totalprice), 2) as mean, min(o_orderpriority) as least, max(o_orderdate) as latest from orders where o_totalprice > 1000"


@query("115_119_plain", _PLAIN)
def _(spark, t):
    c = "o_totalprice"
    plain = {"n": aggregates.count(), "total": F.round(F.sum(c), 2), "mean": F.round(F.avg(c), 2), "least": F.min("o_orderpriority"), "latest": F.max("o_orderdate")}
    return aggregates.group_find(t("orders").where("o_totalprice > 1000"), plain)


@query("120_most", "select n_regionkey, min(seg) as most from (select n_regionkey, c_mktsegment as seg, rank() over (partition by n_regionkey order by count(*) desc) as r from customer join nation on c_nationkey = n_nationkey group by 1, 2) where r = 1 group by 1")
def _(spark, t):
    joined = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return aggregates.most_of(joined, ["n_regionkey"], "c_mktsegment", "most")


@query("120_most_inline", "select c_nationkey, min(seg) as most from (select c_nationkey, c_mktsegment as seg, rank() over (partition by c_nationkey order by count(*) desc) as r from customer group by 1, 2) where r = 1 group by 1")
def _(spark, t):
    return t("customer").groupBy("c_nationkey").agg(aggregates.most("c_mktsegment").alias("most"))


@query("121_124_spread", "select o_orderstatus, round(stddev_pop(o_totalprice), 2) as sp, round(stddev_samp(o_totalprice), 2) as ss, round(var_pop(o_totalprice / 1000), 2) as vp, round(var_samp(o_totalprice / 1000), 2) as vs from orders group by 1")
def _(spark, t):
    c = F.col("o_totalprice")
    return t("orders").groupBy("o_orderstatus").agg(*(F.round(f(v), 2).alias(n) for n, f, v in (("sp", F.stddev_pop, c), ("ss", F.stddev_samp, c), ("vp", F.var_pop, c / 1000), ("vs", F.var_samp, c / 1000))))


@query("125_percentile_continuous", "select o_orderstatus, round(quantile_cont(o_totalprice, 0.3), 2) as value from orders group by 1")
def _(spark, t):
    found = aggregates.percentile_continuous_of(t("orders"), ["o_orderstatus"], "o_totalprice", 0.3, "value")
    return found.withColumn("value", F.round("value", 2))


@query("125_percentile_inline", "select o_orderpriority, round(quantile_cont(o_totalprice, 0.3), 2) as value from orders group by 1")
def _(spark, t):
    return t("orders").groupBy("o_orderpriority").agg(F.round(aggregates.percentile_continuous("o_totalprice", 0.3), 2).alias("value"))


@query("126_percentile_of_all", "select min(o_totalprice) as value from (select o_totalprice, row_number() over (order by o_totalprice) as r, count(*) over () as n from orders) where r >= ceil(0.9 * n)")
def _(spark, t):
    return aggregates.percentile_discrete(t("orders"), [], "o_totalprice", 0.9, "value")


@query("126_percentile_discrete", "select o_orderstatus, list_sort(list(o_orderpriority))[greatest(ceil(0.3 * count(o_orderpriority)), 1)::bigint] as value from orders group by 1")
def _(spark, t):
    return aggregates.percentile_discrete(t("orders"), ["o_orderstatus"], "o_orderpriority", 0.3, "value")


@query("127_group", "select array_to_string(list(k || '=' || n order by k), ',') as groups from (select o_orderpriority as k, count(*) as n from orders group by 1)")
def _(spark, t):
    found = aggregates.group_find(t("orders"), groups={"by": (F.col("o_orderpriority"), aggregates.count())})
    return found.select(F.array_join(F.transform("by", lambda g: F.concat_ws("=", g["key"], g["value"].cast("string"))), ",").alias("groups"))


@query("128_group_by_array", "select count(*) as n, max(n) as most from (select [o_orderstatus, o_orderpriority] as k, count(*) as n from orders group by 1)")
def _(spark, t):
    found = aggregates.group_find(t("orders"), groups={"by": (F.array("o_orderstatus", "o_orderpriority"), aggregates.count())})
    return found.select(F.size("by").cast("long").alias("n"), F.array_max(F.transform("by", lambda g: g["value"])).alias("most"))


@query("130_several", "select count(*) as n, (select count(distinct o_orderstatus) from orders) as kinds from orders")
def _(spark, t):
    found = aggregates.group_find(t("orders"), {"n": aggregates.count()}, {"by": (F.col("o_orderstatus"), F.max("o_totalprice"))})
    return found.select("n", F.size("by").cast("long").alias("kinds"))


@query("042_insert", "select c_custkey from customer union all select -1")
def _(spark, t):
    rows = mutations.prepared(spark.createDataFrame([(-1, "New")], "c_custkey long, c_name string"), required=["c_name"], defaults={"c_acctbal": 0.0})
    return mutations.insert(t("customer"), rows)[0].select("c_custkey")


@query("043_update", "select c_custkey, round(case when c_mktsegment = 'BUILDING' then c_acctbal + 10 else c_acctbal end, 2) + 0.0 as c_acctbal from customer")
def _(spark, t):
    return mutations.update(t("customer"), F.col("c_mktsegment") == "BUILDING", {"c_acctbal": F.col("c_acctbal") + 10})[0].select("c_custkey", _money(F.col("c_acctbal")).alias("c_acctbal"))


@query("043_update_returned", "select c_custkey, 'X' as c_mktsegment from customer where c_acctbal < 0")
def _(spark, t):
    return mutations.update(t("customer"), F.col("c_acctbal") < 0, {"c_mktsegment": F.lit("X")})[1].select("c_custkey", "c_mktsegment")


@query("044_upsert", "select c_custkey from customer union all select -2")
def _(spark, t):
    new = spark.createDataFrame([(-2,)], "c_custkey long")
    return mutations.upsert(t("customer"), F.col("c_custkey") == -2, {"c_name": F.lit("x")}, new)[0].select("c_custkey")


@query("045_delete", "select c_custkey from customer where not c_acctbal < 0")
def _(spark, t):
    return mutations.delete(t("customer"), F.col("c_acctbal") < 0)[0].select("c_custkey")


@query("046_gc", "select event_id from events where value <= 20")
def _(spark, t):
    aged = t("events").withColumn("_expired_at", F.when(F.col("value") > 20, F.col("ts")))
    return mutations.delete(aged, F.col("_expired_at") < F.current_timestamp())[0].select("event_id")


@query("110_union_classes", "select c_nationkey as nation from customer union select s_nationkey from supplier")
def _(spark, t):
    return t("customer").select(F.col("c_nationkey").alias("nation")).unionByName(t("supplier").select(F.col("s_nationkey").alias("nation"))).distinct()


@query("214_unique", "select l_orderkey, l_linenumber, count(*) as n from lineitem group by 1, 2 having count(*) > 1")
def _(spark, t):
    return mutations.duplicates(t("lineitem"), ["l_orderkey", "l_linenumber"])


_SIGNED = lambda t: t("customer").withColumns({"_rperm": F.when(F.col("c_custkey") % 3 == 0, F.array(F.lit("*"))).otherwise(F.array(F.concat(F.lit("role:"), F.lower("c_mktsegment")))), "_wperm": F.array(F.lit("role:admin")), "owner": F.col("c_nationkey").cast("string")})


@query("218_read_acl", "select c_custkey from customer where c_custkey % 3 = 0 or c_mktsegment = 'BUILDING'")
def _(spark, t):
    return access.visible(_SIGNED(t), access.Viewer(user="u1", names=("building",))).select("c_custkey")


@query("219_write_acl", "select c_custkey from customer where false")
def _(spark, t):
    return access.visible(_SIGNED(t), access.Viewer(user="u1", names=("building",)), action="update").select("c_custkey")


@query("220_owner_fields", "select c_custkey from customer where c_custkey % 3 = 0 or c_nationkey = 4")
def _(spark, t):
    return access.visible(_SIGNED(t), access.Viewer(user="4"), access.Rules(user_fields={"read": ["owner"]})).select("c_custkey")


@query("221_additional", "select c_custkey from customer")
def _(spark, t):
    return access.visible(_SIGNED(t), access.Viewer(names=("system",)), access.Rules(additional={"read": ["role:system"]})).select("c_custkey")


@query("223_fields", "select c_custkey, c_name from customer")
def _(spark, t):
    rules = access.Rules(field_level={"c_acctbal": {"read": ["role:admin"]}}, secure_fields=("c_nationkey", "c_mktsegment"))
    return t("customer").select(*access.readable_fields(t("customer"), access.Viewer(), rules))


@query("226_master", "select c_custkey from customer")
def _(spark, t):
    return access.visible(_SIGNED(t), access.Viewer(master=True)).select("c_custkey")


@query("225_role_closure", "with recursive up(u, r) as (select c_custkey, c_nationkey from customer union select u, r - 1 from up where r > 0) select u as \"user\", r as role from up")
def _(spark, t):
    members = t("customer").select(F.col("c_custkey").alias("user"), F.col("c_nationkey").alias("role"))
    return access.inherited_roles(members, t("nation").where("n_nationkey > 0").select((F.col("n_nationkey") - 1).alias("role"), F.col("n_nationkey").alias("holds")))


@query("010_settings", "select c_mktsegment as key, max(c_custkey)::varchar as value from customer group by 1")
def _(spark, t):
    rows = t("customer").select(F.col("c_mktsegment").alias("key"), F.col("c_custkey").cast("string").alias("value"), F.timestamp_seconds("c_custkey").alias("at"))
    return tables.latest(rows.where("c_mktsegment = 'none'"), rows).select("key", "value")


@query("013_017_file_chunks", "select doc_id::varchar as token, sha256(coalesce(text, '')) as sha256 from documents")
def _(spark, t):
    docs = t("documents").select(F.col("doc_id").cast("string").alias("token"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("content"))
    chunks = files.chunked(docs)
    inflated = chunks.mapInArrow(_inflated, "token string, start long, body binary")
    whole = inflated.groupBy("token").agg(F.expr("listagg(body, X'') within group (order by start)").alias("body"))
    return docs.select("token").join(whole, "token", "left").select("token", F.sha2(F.coalesce("body", F.lit(b"").cast("binary")), 256).alias("sha256"))


def _inflated(batches):
    import zlib

    import pyarrow as pa

    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("token"), b.column("start"), pa.array([zlib.decompress(x) for x in b.column("data").to_pylist()], pa.binary())], ["token", "start", "body"])


@query("017_file_range", "select sum(octet_length(encode(text)))::bigint as n from (select substring(text, 1, 1) as text from documents where doc_id = 3)")
def _(spark, t):
    docs = t("documents").where("doc_id = 3").select(F.col("doc_id").cast("string").alias("token"), F.col("text").cast("binary").alias("content"))
    return files.read_range(files.chunked(docs, 64), "3", 0, 1).agg(F.sum(F.octet_length("data")).cast("long").alias("n"))


@query("227_live_query", "select event_id, user_id from events where event_type = 'click' and value > 5")
def _(spark, t):
    return _streamed(spark, t, lambda s: changes.live(s.withColumn("event", F.lit("create")), "create", (F.col("event_type") == "click") & (F.col("value") > 5)).select("event_id", "user_id"))


@query("228_live_acl", "select event_id from events where user_id % 2 = 0")
def _(spark, t):
    perms = F.when(F.col("user_id") % 2 == 0, F.array(F.lit("*"))).otherwise(F.array(F.lit("role:admin")))
    return _streamed(spark, t, lambda s: changes.live(s.withColumns({"event": F.lit("create"), "_rperm": perms}), "create", grants=["*"]).select("event_id"))


@query("230_listen", "select event_id from events where (props::json->>'$.k')::double > 90")
def _(spark, t):
    return _streamed(spark, t, lambda s: changes.listen(s.withColumnRenamed("props", "payload"), F.try_variant_get("data", "$.k", "double") > 90).select("event_id"))


@query("229_published", "select 'create' as event, event_id as _id from events")
def _(spark, t):
    log = t("events").select(F.lit("create").alias("event"), F.col("event_id").alias("_id"), "props", "event_type")
    return changes.published(log)


def _streamed(spark, t, select) -> DataFrame:
    """The rows a stream of the events table gives, read back from the table it was written to."""
    path = tables.scratch(spark)
    out = select(changes.stream_of(spark, t.folder, "events"))
    query = changes.to_table(out, path, path + "-checkpoint")
    query.awaitTermination()
    return spark.read.schema(out.schema).parquet(path)


@query("232_233_changes", "select 'delete' as event, c_custkey from customer where c_acctbal < 0 union all select 'update', c_custkey from customer where c_acctbal >= 9000 union all select 'create', -1")
def _(spark, t):
    before = t("customer").select("c_custkey", "c_acctbal")
    after = mutations.update(mutations.delete(before, F.col("c_acctbal") < 0)[0], F.col("c_acctbal") >= 9000, {"c_acctbal": F.lit(0.0)})[0]
    after = mutations.insert(after, spark.createDataFrame([(-1, 1.0)], "c_custkey long, c_acctbal double"))[0]
    return changes.changes(before, after, "c_custkey").select("event", "c_custkey")


@query("234_235_next_job", "select o_orderkey from orders where o_orderstatus = 'O' and o_orderpriority not in ('1-URGENT', '2-HIGH') order by o_orderdate, o_orderpriority limit 1")
def _(spark, t):
    jobs = t("orders").select("o_orderkey", F.col("o_orderpriority").alias("name"), F.col("o_orderdate").alias("created_at"), F.lit(None).cast("timestamp").alias("started_at"), F.when(~F.col("o_orderstatus").eqNullSafe("O"), F.coalesce("o_orderdate", F.current_timestamp())).alias("completed_at"))
    scopes = spark.createDataFrame([("1-URGENT", "s"), ("2-HIGH", "s"), ("5-LOW", "other")], "name string, scope string")
    locks = spark.range(1).select(F.lit("s").alias("scope"), F.current_timestamp().alias("updated_at"))
    first = changes.next_job(jobs, locks, scopes, ties=("o_orderkey",))
    return first.select("o_orderkey")


@query("003_insecure_scan", "select c_custkey, c_nationkey from customer")
def _(spark, t):
    rules = access.Rules(secure_fields=("c_nationkey",))
    return t("customer").select(*access.readable_fields(t("customer"), access.Viewer(master=True), rules, ["c_custkey", "c_nationkey"]))


@query("007_rebuilt_columns", "select n_nationkey::double as n_nationkey, n_name, null::varchar as extra from nation")
def _(spark, t):
    return tables.rebuilt(t("nation"), spark.createDataFrame([], "n_nationkey double, n_name string, extra string").schema)


@query("009_catalog", "select unnest(['version', 'databases', 'views', 'columns']) as kind, true as some")
def _(spark, t):
    view = f"catalog_{uuid.uuid4().hex}"
    t("nation").createTempView(view)
    try:
        found = tables.catalog(spark)
    finally:
        spark.catalog.dropTempView(view)
    some = {"version": bool(found["version"]), "databases": "default" in found["databases"], "views": view in found["views"], "columns": f"{view}.n_name" in found["columns"]}
    return spark.createDataFrame(list(some.items()), "kind string, some boolean")


@query("026_explain", "select true as pushed")
def _(spark, t):
    return spark.createDataFrame([("PushedFilters: [IsNotNull(c_acctbal)" in ordering.explained(t("customer").where("c_acctbal > 5")),)], "pushed boolean")


@query("029_random_one", "select 1::bigint as n")
def _(spark, t):
    one = ordering.page(ordering.shuffled(t("customer")), limit=1)
    return one.join(t("customer").select("c_custkey"), "c_custkey", "left_semi").agg(aggregates.count().alias("n"))


@query("036_sort_by_expression", "select c_custkey from (select c_custkey, row_number() over (order by abs(c_acctbal - 1000), c_custkey) as r from customer) where r <= 30")
def _(spark, t):
    return ordering.page(ordering.sort(t("customer"), (F.abs(F.col("c_acctbal") - 1000), 1), ("c_custkey", 1)), limit=30).select("c_custkey")


@query("222_class_permission", "select 'find' as action, false as allowed union all select 'get', true")
def _(spark, t):
    rules, seen = access.Rules(class_level={"find": ["role:admin"]}), []
    for action in ("find", "get"):
        try:
            access.check_class(access.Viewer(user="u1"), rules, action)
            seen.append((action, True))
        except PermissionError:
            seen.append((action, False))
    return spark.createDataFrame(seen, "action string, allowed boolean")


@query("006_create_table", "select 'key' as name, 'bigint' as kind union all select 'label', 'string'")
def _(spark, t):
    name = f"made_{uuid.uuid4().hex}"
    tables.create(spark, name, spark.createDataFrame([], "key long, label string").schema, bucketed=(4, "key"))
    try:
        found = spark.table(name).dtypes
    finally:
        spark.sql(f"drop table {name}")
    return spark.createDataFrame(found, "name string, kind string")


@query("011_wire_rows", """select o_orderkey, '{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '","o_orderdate":{"$date":' || epoch_ms(o_orderdate) || '},"price":{"$decimal":"' || o_totalprice::decimal(18, 2) || '"}}' as wire from orders""")
def _(spark, t):
    rows = t("orders").select("o_orderkey", "o_orderstatus", "o_orderdate", F.col("o_totalprice").cast("decimal(18,2)").alias("price"))
    return rows.select("o_orderkey", codec.wire_row(rows).alias("wire"))


@query("012_json_value", "select event_id, json(props)::varchar as props from events")
def _(spark, t):
    return t("events").select("event_id", F.to_json(F.try_parse_json("props")).alias("props"))


@query("034_filters", "select c_custkey from customer where c_acctbal > 0 and c_nationkey < 10 and c_mktsegment <> 'BUILDING'")
def _(spark, t):
    return t("customer").where(F.col("c_acctbal") > 0).where(F.col("c_nationkey") < 10).where(P.not_equal(F.col("c_mktsegment"), "BUILDING")).select("c_custkey")


@query("044_upsert_existing", "select c_custkey, case when c_nationkey = 3 then 'x' else c_name end as c_name from customer")
def _(spark, t):
    new = spark.createDataFrame([(-2,)], "c_custkey long")
    return mutations.upsert(t("customer"), F.col("c_nationkey") == 3, {"c_name": F.lit("x")}, new)[0].select("c_custkey", "c_name")


@query("048_fetch_with_include", "select c_custkey, n_name from customer join nation on c_nationkey = n_nationkey where c_custkey = 12")
def _(spark, t):
    one = t("customer").where(P.equal(F.col("c_custkey"), 12)).limit(1)
    return relations.with_pointer(one, "c_nationkey", t("nation"), "n_nationkey", "nation").select("c_custkey", "nation.n_name")


@query("062_subset_on_relation", "select o_custkey as parent from orders group by 1 having list_has_all(['1-URGENT', '2-HIGH', '3-MEDIUM'], list(distinct o_orderpriority))")
def _(spark, t):
    items = _items_of_orders(t)
    return relations.having_every(items.select("parent").distinct(), "parent", items, P.contained_in(F.col("o_orderpriority"), ["1-URGENT", "2-HIGH", "3-MEDIUM"])).select("parent")


@query("092_anti_join", "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority = '1-URGENT')")
def _(spark, t):
    urgent = _items_of_orders(t).where(F.col("o_orderpriority") == "1-URGENT")
    return relations.having_every(t("customer"), "c_custkey", urgent, F.lit(False)).select("c_custkey")


@query("093_returned_with_includes", "select c_custkey, (select n_name from nation where n_nationkey = 0) as n_name from customer where c_acctbal < 0")
def _(spark, t):
    returned = mutations.update(t("customer"), F.col("c_acctbal") < 0, {"c_nationkey": F.lit(0)})[1]
    return relations.with_pointer(returned, "c_nationkey", t("nation"), "n_nationkey", "nation").select("c_custkey", "nation.n_name")


@query("099_match_filter", "select o_custkey as parent, o_orderkey from orders where o_totalprice > 250000")
def _(spark, t):
    return matching.match(_items_of_orders(t), F.col("o_totalprice") > 250000).select("parent", "o_orderkey")


@query("103_merged_matches", "select parent, o_orderkey from (select o_custkey as parent, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as r from orders where o_orderstatus = 'F' and o_totalprice > 50000) where r <= 2")
def _(spark, t):
    by_price = [matching.descending("o_totalprice"), matching.ascending("o_orderkey")]
    options = matching.merged({}, {"where": F.col("o_orderstatus") == "F", "sort": by_price, "limit": 5}, {"where": F.col("o_totalprice") > 50000, "limit": 2})
    return matching.match(_items_of_orders(t), **options).select("parent", "o_orderkey")


@query("201_set_in_vector", "select vec_id, round(list_sum(list_transform(embedding::double[], lambda x, i: case when i = 3 then 1.0 else x end)), 4) + 0.0 as value from embeddings")
def _(spark, t):
    changed = element(F.col("embedding").cast("array<double>"), 2, lambda x: F.lit(1.0))
    return t("embeddings").select("vec_id", (F.round(F.aggregate(changed, F.lit(0.0), lambda s, x: s + x), 4) + 0.0).alias("value"))


@query("201_set_in_shape", "select c_custkey, c_name, 'none' as segment from customer")
def _(spark, t):
    shaped = t("customer").select("c_custkey", F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")).alias("shape"))
    after = mutations.update(shaped, F.lit(True), {"shape": field(F.col("shape"), "segment", F.lit("none"))})[0]
    return after.select("c_custkey", F.col("shape.name").alias("c_name"), "shape.segment")


@query("215_taken_ids", "select c_custkey from customer where c_custkey < 20")
def _(spark, t):
    rows = spark.range(-10, 20).select(F.col("id").alias("c_custkey"))
    return mutations.taken(t("customer"), rows, "c_custkey")


@query("223_fields_to_write", "select 'create' as action, true as allowed union all select 'update', false")
def _(spark, t):
    rules, seen = access.Rules(field_level={"c_acctbal": {"update": ["role:admin"]}}), []
    for action in ("create", "update"):
        try:
            access.check_fields(access.Viewer(user="u1"), rules, ["c_name", "c_acctbal"], action)
            seen.append((action, True))
        except PermissionError:
            seen.append((action, False))
    return spark.createDataFrame(seen, "action string, allowed boolean")


@query("224_joined_rules", "select n_nationkey, count(c_custkey) as n from nation left join customer on c_nationkey = n_nationkey and (c_custkey % 3 = 0 or c_mktsegment = 'BUILDING') group by 1")
def _(spark, t):
    seen = access.visible(_SIGNED(t), access.Viewer(user="u1", names=("building",)))
    return relations.with_size(t("nation"), "n_nationkey", relations.owned(seen, "c_nationkey"), "n").select("n_nationkey", "n")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
