"""One query for each scalar expression, predicate, update operator and distance, over a whole table."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions.expressions import OPERATORS as O
from ..functions.expressions import row
from ..functions.vectors import DISTANCES
from ..operators.updates import OPERATORS as U
from ..operators.updates import element


#: Columns are made when a session is there, not on import.
X, N, S, K = (lambda c=c: F.col(c) for c in ("c_acctbal", "c_name", "c_mktsegment", "c_custkey"))
POS, UNIT = lambda: F.abs(X()) + 1, (lambda: X() / 10000)
x, pos, unit = "c_acctbal", "(abs(c_acctbal) + 1)", "(c_acctbal / 10000)"

#: name: (Column, SQL) of a number, compared to four places.
NUMBERS = {
    "149_add": (lambda: O["$add"](X(), K(), 1.5), f"{x} + c_custkey + 1.5"),
    "150_multiply": (lambda: O["$multiply"](O["$add"](X(), 1), 0.7310585, UNIT()), f"({x} + 1) * 0.7310585 * {unit}"),
    "151_subtract": (lambda: O["$subtract"](X(), K()), f"{x} - c_custkey"),
    "152_divide": (lambda: O["$divide"](X(), POS()), f"{x} / {pos}"),
    "153_abs": (lambda: O["$abs"](X()), f"abs({x})"),
    "154_neg": (lambda: O["$neg"](X()), f"-{x}"),
    "155_sqrt": (lambda: O["$sqrt"](POS()), f"sqrt({pos})"),
    "156_cbrt": (lambda: O["$cbrt"](X()), f"cbrt({x})"),
    "157_ceil": (lambda: O["$ceil"](X()), f"ceil({x})"),
    "158_floor": (lambda: O["$floor"](X()), f"floor({x})"),
    "159_round": (lambda: O["$round"](X() / 2), f"round_even({x} / 2, 0)"),
    "160_exp": (lambda: O["$exp"](UNIT()), f"exp({unit})"),
    "161_ln": (lambda: O["$ln"](POS()), f"ln({pos})"),
    "162_log2": (lambda: O["$log2"](POS()), f"log2({pos})"),
    "163_log10": (lambda: O["$log10"](POS()), f"log10({pos})"),
    "164_log": (lambda: O["$log"](POS(), F.lit(3.0)), f"ln({pos}) / ln(3.0)"),
    "165_pow": (lambda: O["$pow"](POS(), F.lit(0.4)), f"pow({pos}, 0.4)"),
    "166_sin": (lambda: O["$sin"](X()), f"sin({x})"),
    "167_cos": (lambda: O["$cos"](X()), f"cos({x})"),
    "168_tan": (lambda: O["$tan"](UNIT()), f"tan({unit})"),
    "169_asin": (lambda: O["$asin"](UNIT()), f"asin({unit})"),
    "170_acos": (lambda: O["$acos"](UNIT()), f"acos({unit})"),
    "171_atan": (lambda: O["$atan"](X()), f"atan({x})"),
    "172_atan2": (lambda: O["$atan2"](X(), POS()), f"atan2({x}, {pos})"),
    "173_asinh": (lambda: O["$asinh"](X()), f"asinh({x})"),
    "174_acosh": (lambda: O["$acosh"](POS()), f"acosh({pos})"),
    "175_atanh": (lambda: O["$atanh"](UNIT() / 2), f"atanh({unit} / 2)"),
    "176_sinh": (lambda: O["$sinh"](UNIT()), f"sinh({unit})"),
    "177_cosh": (lambda: O["$cosh"](UNIT()), f"cosh({unit})"),
    "178_tanh": (lambda: O["$tanh"](UNIT()), f"tanh({unit})"),
    "179_degrees": (lambda: O["$degrees"](UNIT()), f"degrees({unit})"),
    "180_radians": (lambda: O["$radians"](X()), f"radians({x})"),
    "181_sign": (lambda: O["$sign"](X()), f"sign({x})"),
    "182_size": (lambda: O["$size"](N()), "length(c_name)"),
    "136_cond": (lambda: O["$cond"]([(X() > 5000, 2.0), (X() > 0, 1.0)], 0.0), f"case when {x} > 5000 then 2 when {x} > 0 then 1 else 0 end"),
    "195_if_null": (lambda: O["$ifNull"](F.when(X() > 0, X()), F.lit(7.0)), f"coalesce(case when {x} > 0 then {x} end, 7)"),
    "134_value": (lambda: F.lit(2.5), "2.5"),
    "202_inc": (lambda: U["$inc"](X(), 3), f"{x} + 3"),
    "203_dec": (lambda: U["$dec"](X(), 3), f"{x} - 3"),
    "204_mul": (lambda: U["$mul"](X(), 3), f"{x} * 3"),
    "205_div": (lambda: U["$div"](X(), 4), f"{x} / 4"),
    "206_max": (lambda: U["$max"](X(), 500.0), f"greatest({x}, 500)"),
    "207_min": (lambda: U["$min"](X(), 500.0), f"least({x}, 500)"),
}
#: name: (Column, SQL) of a text.
TEXTS = {
    "133_key": (lambda: N(), "c_name"),
    "183_lower": (lambda: O["$lower"](N()), "lower(c_name)"),
    "184_upper": (lambda: O["$upper"](N()), "upper(c_name)"),
    "185_trim": (lambda: O["$trim"](S(), F.lit("ABE")), "trim(c_mktsegment, 'ABE')"),
    "186_ltrim": (lambda: O["$ltrim"](S(), F.lit("ABH")), "ltrim(c_mktsegment, 'ABH')"),
    "187_rtrim": (lambda: O["$rtrim"](S(), F.lit("EYD")), "rtrim(c_mktsegment, 'EYD')"),
    "188_first": (lambda: O["$first"](N(), 5), "substring(c_name, 1, 5)"),
    "189_last": (lambda: O["$last"](N(), 5), "right(c_name, 5)"),
    "190_ldrop": (lambda: O["$ldrop"](N(), 5), "substring(c_name, 6)"),
    "191_rdrop": (lambda: O["$rdrop"](S(), 9), "substring(c_mktsegment, 1, greatest(length(c_mktsegment) - 9, 0))"),
    "192_lpad": (lambda: O["$lpad"](S(), 10, "*"), "lpad(c_mktsegment, 10, '*')"),
    "193_rpad": (lambda: O["$rpad"](S(), 10, "*"), "rpad(c_mktsegment, 10, '*')"),
    "194_concat": (lambda: O["$concat"](S(), F.when(X() > 0, N()), F.lit("!")), "concat(c_mktsegment, case when c_acctbal > 0 then c_name end, '!')"),
    "201_set": (lambda: U["$set"](S(), "SET"), "'SET'"),
}
TAGS = lambda: F.array("c_mktsegment", (F.col("c_nationkey") % 5).cast("string"), F.when(X() > 0, F.lit("rich")))
tags = "[c_mktsegment, (c_nationkey % 5)::varchar, case when c_acctbal > 0 then 'rich' end]"
#: name: (Column, SQL) of an array, compared as text.
ARRAYS = {
    "135_array": (lambda: O["$array"](S(), N()), "[c_mktsegment, c_name]"),
    "208_add_to_set": (lambda: U["$addToSet"](F.array_compact(TAGS()), ["1", "new"]), f"list_filter({tags}, lambda t: t is not null) || list_filter(['1', 'new'], lambda t: t <> c_mktsegment and t <> (c_nationkey % 5)::varchar)"),
    "209_push": (lambda: U["$push"](F.array_compact(TAGS()), ["1", "new"]), f"list_filter({tags}, lambda t: t is not null) || ['1', 'new']"),
    "210_remove_all": (lambda: U["$removeAll"](F.array_compact(TAGS()), ["1", "BUILDING"]), f"list_filter({tags}, lambda t: t is not null and t not in ('1', 'BUILDING'))"),
    "211_pop_first": (lambda: U["$popFirst"](F.array_compact(TAGS()), 2), f"(list_filter({tags}, lambda t: t is not null))[3:]"),
    "212_pop_last": (lambda: U["$popLast"](F.array_compact(TAGS()), 2), f"list_filter({tags}, lambda t: t is not null)[:len(list_filter({tags}, lambda t: t is not null)) - 2]"),
}
CN = lambda: F.when(X() > 0, F.col("c_nationkey"))
cn = "(case when c_acctbal > 0 then c_nationkey end)"
#: name: (Column, SQL) of a condition on customers.
FILTERS = {
    "049_eq": (lambda: P.equal(S(), "BUILDING"), "c_mktsegment = 'BUILDING'"),
    "049_eq_null": (lambda: P.equal(CN(), None), f"{cn} is null"),
    "050_ne": (lambda: P.not_equal(CN(), 3), f"{cn} is distinct from 3"),
    "051_lt": (lambda: CN() < 5, f"{cn} < 5"),
    "052_gt": (lambda: CN() > 5, f"{cn} > 5"),
    "053_lte": (lambda: CN() <= 5, f"{cn} <= 5"),
    "054_gte": (lambda: CN() >= 5, f"{cn} >= 5"),
    "056_in": (lambda: P.contained_in(CN(), [1, 2, None]), f"{cn} in (1, 2) or {cn} is null"),
    "056_in_empty": (lambda: P.contained_in(CN(), []), "false"),
    "057_nin": (lambda: P.not_contained_in(CN(), [1, 2]), f"{cn} not in (1, 2)"),
    "057_nin_one": (lambda: P.not_contained_in(CN(), [1]), f"{cn} is distinct from 1"),
    "057_nin_null": (lambda: P.not_contained_in(CN(), [1, None]), f"{cn} is not null and {cn} <> 1"),
    "058_subset": (lambda: P.subset(F.array_compact(TAGS()), ["BUILDING", "1", "2", "rich"]), f"list_has_all(['BUILDING', '1', '2', 'rich'], list_filter({tags}, lambda t: t is not null))"),
    "059_superset": (lambda: P.superset(TAGS(), ["BUILDING", "rich"]), f"list_has_all({tags}, ['BUILDING', 'rich'])"),
    "060_intersect": (lambda: P.intersects(TAGS(), ["BUILDING", "1"]), f"list_has_any({tags}, ['BUILDING', '1'])"),
    "061_disjoint": (lambda: P.disjoint(TAGS(), ["BUILDING", "1"]), f"not list_has_any({tags}, ['BUILDING', '1'])"),
    "061_not_superset": (lambda: P.not_superset(TAGS(), ["BUILDING", "rich"]), f"not list_has_all({tags}, ['BUILDING', 'rich'])"),
    "063_not": (lambda: ~(CN() > 5), f"not {cn} > 5"),
    "064_pattern_text": (lambda: P.pattern(N(), "00001"), "contains(c_name, '00001')"),
    "065_pattern_regex": (lambda: P.pattern(N(), re.compile(r"^CUSTOMER#[[:digit:]]+7$", re.IGNORECASE)), "regexp_matches(c_name, '^CUSTOMER#[0-9]+7$', 'i')"),
    "066_starts": (lambda: P.starts(S(), "BU"), "starts_with(c_mktsegment, 'BU')"),
    "067_ends": (lambda: P.ends(S(), "NG"), "ends_with(c_mktsegment, 'NG')"),
    "069_size": (lambda: P.array_size(F.array_compact(TAGS()), 3), f"len(list_filter({tags}, lambda t: t is not null)) = 3"),
    "070_empty": (lambda: P.empty(F.when(X() > 0, S()), text=True), "c_acctbal <= 0 or c_mktsegment = ''"),
    "071_every": (lambda: P.every(TAGS(), lambda t: t != "1"), f"coalesce(list_bool_and(list_transform({tags}, lambda t: coalesce(t <> '1', true))), true)"),
    "072_some": (lambda: P.some(TAGS(), lambda t: t == "1"), f"list_contains({tags}, '1')"),
    "075_self": (lambda: P.some(TAGS(), lambda t: t.startswith("r")), f"list_bool_or(list_transform({tags}, lambda t: coalesce(starts_with(t, 'r'), false)))"),
    "076_and": (lambda: O["$and"](X() > 0, S() == "BUILDING"), "c_acctbal > 0 and c_mktsegment = 'BUILDING'"),
    "077_or": (lambda: O["$or"](X() > 9000, S() == "BUILDING"), "c_acctbal > 9000 or c_mktsegment = 'BUILDING'"),
    "078_nor": (lambda: O["$nor"](X() > 9000, S() == "BUILDING"), "not c_acctbal > 9000 and not c_mktsegment = 'BUILDING'"),
    "079_expr": (lambda: O["$gt"](O["$multiply"](X(), 2), K()), "c_acctbal * 2 > c_custkey"),
    "080_path": (lambda: P.at(F.array(F.struct(X().alias("a"))), 0, "a") > 100, "c_acctbal > 100"),
    "137_not": (lambda: O["$not"](X() > 0), "not c_acctbal > 0"),
    "138_and": (lambda: O["$and"](X() > 0, K() > 10), "c_acctbal > 0 and c_custkey > 10"),
    "139_or": (lambda: O["$or"](X() < 0, K() < 10), "c_acctbal < 0 or c_custkey < 10"),
    "140_nor": (lambda: O["$nor"](X() < 0, K() < 10), "not c_acctbal < 0 and not c_custkey < 10"),
    "141_eq": (lambda: O["$eq"](CN(), F.lit(3)), f"{cn} is not distinct from 3"),
    "142_ne": (lambda: O["$ne"](CN(), F.lit(3)), f"{cn} is distinct from 3"),
    "143_gt": (lambda: O["$gt"](row(F.col("c_nationkey"), K()), row(5, F.lit(100).cast("long"))), "(c_nationkey, c_custkey) > (5, 100)"),
    "144_gte": (lambda: O["$gte"](X(), 100), "c_acctbal >= 100"),
    "145_lt": (lambda: O["$lt"](X(), 100), "c_acctbal < 100"),
    "146_lte": (lambda: O["$lte"](X(), 100), "c_acctbal <= 100"),
}
PROPS = lambda: F.col("props")
#: name: (Column, SQL) of a condition on events.
EVENT_FILTERS = {
    "055_json_range": (lambda: P.json_number(P.json_path(PROPS(), "k")) > 50, "(props::json->>'$.k')::double > 50"),
    "068_json_text": (lambda: P.json_string(P.json_path(PROPS(), "k")).startswith("5"), "json_type(props::json, '$.k') = 'VARCHAR' and starts_with(props::json->>'$.k', '5')"),
    "079_date": (lambda: F.col("ts") >= F.lit("2024-01-02").cast("timestamp"), "ts >= timestamp '2024-01-02'"),
}
HERE = [0.1, -0.2, 0.0, 0.3] * 16
here = "[0.1, -0.2, 0.0, 0.3" + ", 0.1, -0.2, 0.0, 0.3" * 15 + "]::double[]"
VECTOR_SQL = {
    "$distance": "sqrt(list_sum(list_transform(list_zip(e, h), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))",
    "$innerProduct": "list_sum(list_transform(list_zip(e, h), lambda p: p[1] * p[2]))",
    "$negInnerProduct": "-list_sum(list_transform(list_zip(e, h), lambda p: p[1] * p[2]))",
    "$cosineDistance": "1 - list_sum(list_transform(list_zip(e, h), lambda p: p[1] * p[2])) / sqrt(list_sum(list_transform(e, lambda v: v * v)) * list_sum(list_transform(h, lambda v: v * v)))",
    "$rectilinearDistance": "list_sum(list_transform(list_zip(e, h), lambda p: abs(p[1] - p[2])))",
}
VECTOR_NAMES = {"$distance": "196_distance", "$innerProduct": "197_inner_product", "$negInnerProduct": "198_neg_inner_product", "$cosineDistance": "199_cosine_distance", "$rectilinearDistance": "200_rectilinear_distance"}


def _of(table: str, *columns):
    """A query of columns, each a name or a function that makes one."""
    return lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*(c if isinstance(c, str) else c() for c in columns))


def _where(table: str, key: str, condition):
    return lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/{table}.parquet").where(condition()).select(key)


def _value(make, finish):
    return lambda: finish(make()).alias("value")


def _rounded(c):
    return F.round(c.cast("double"), 4) + 0.0


def queries() -> dict:
    out = {n: _of("customer", "c_custkey", _value(c, _rounded)) for n, (c, _) in NUMBERS.items()}
    out |= {n: _of("customer", "c_custkey", _value(c, lambda x: x)) for n, (c, _) in TEXTS.items()}
    out |= {n: _of("customer", "c_custkey", _value(c, lambda x: F.concat_ws("|", x))) for n, (c, _) in ARRAYS.items()}
    out |= {n: _where("customer", "c_custkey", c) for n, (c, _) in FILTERS.items()}
    out |= {n: _where("events", "event_id", c) for n, (c, _) in EVENT_FILTERS.items()}
    out |= {VECTOR_NAMES[n]: _of("embeddings", "vec_id", _value(lambda f=f: f(F.col("embedding"), HERE), _rounded)) for n, f in DISTANCES.items()}
    out["202_inc_element"] = _of("embeddings", "vec_id", _value(lambda: element(F.col("embedding").cast("array<double>"), 1, lambda v: v + 1)[1], _rounded))
    out["147_now"] = _now
    out["148_rand"] = _of("customer", "c_custkey", _value(lambda: O["$rand"]().between(0, 1), lambda x: x))
    return out


def _now(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/region.parquet").select("r_regionkey", (O["$now"]() > F.lit("2020-01-01").cast("timestamp")).alias("value"))


def oracle_sql() -> dict[str, str]:
    out = {n: f"select c_custkey, round(({s})::double, 4) + 0.0 as value from customer" for n, (_, s) in NUMBERS.items()}
    out |= {n: f"select c_custkey, {s} as value from customer" for n, (_, s) in TEXTS.items()}
    out |= {n: f"select c_custkey, array_to_string({s}, '|') as value from customer" for n, (_, s) in ARRAYS.items()}
    out |= {n: f"select c_custkey from customer where {s}" for n, (_, s) in FILTERS.items()}
    out |= {n: f"select event_id from events where {s}" for n, (_, s) in EVENT_FILTERS.items()}
    out |= {VECTOR_NAMES[n]: f"select vec_id, round({s}, 4) + 0.0 as value from (select vec_id, embedding::double[] as e, {here} as h from embeddings)" for n, s in VECTOR_SQL.items()}
    out["202_inc_element"] = "select vec_id, round(embedding[2]::double + 1, 4) + 0.0 as value from embeddings"
    out["147_now"] = "select r_regionkey, true as value from region"
    out["148_rand"] = "select c_custkey, true as value from customer"
    return out
