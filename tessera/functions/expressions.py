"""Scalar expressions of the query language as Column functions.

Numbers are doubles unless an operand is a decimal; nesting is algebraic.  Everything compiles to built-in expressions,
so it stays inside whole-stage code generation and filters made of it reach the scan where Spark can push them.
"""

from __future__ import annotations

from functools import reduce
from operator import add as _add
from operator import and_, or_
from operator import mul as _mul

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x) -> Column:
    """A Column as it is, anything else as a literal."""
    return x if isinstance(x, Column) else F.lit(x)


def all_of(*xs) -> Column:
    return reduce(and_, map(col, xs), F.lit(True))


def any_of(*xs) -> Column:
    return reduce(or_, map(col, xs), F.lit(False))


def none_of(*xs) -> Column:
    """Every operand is false; one that is null makes the result null, as in SQL."""
    return reduce(and_, (~col(x) for x in xs), F.lit(True))


def choose(branches: list[tuple], default) -> Column:
    """The first branch (case, then) whose case is true; a null case is not."""
    out = None
    for case, then in branches:
        out = F.when(case, col(then)) if out is None else out.when(case, col(then))
    return col(default) if out is None else out.otherwise(col(default))


def add(*xs) -> Column:
    return reduce(_add, map(col, xs))


def multiply(*xs) -> Column:
    return reduce(_mul, map(col, xs))


def subtract(a, b) -> Column:
    return col(a) - col(b)


def divide(a, b) -> Column:
    """Raises on a zero divisor, in ANSI mode, as the reference's database does."""
    return col(a) / col(b)


def ceil(x) -> Column:
    return F.ceil(x).cast("double")


def floor(x) -> Column:
    return F.floor(x).cast("double")


def round_half_even(x) -> Column:
    return F.rint(x)


def log(x, base) -> Column:
    """The logarithm of the first operand to the base of the second."""
    return F.ln(x) / F.ln(base)


def now() -> Column:
    return F.date_trunc("MILLISECOND", F.current_timestamp())


def first(x, n: int) -> Column:
    """The first n characters; ldrop, last and rdrop likewise.  Counts are of code points."""
    return F.substring(x, 1, n)


def last(x, n: int) -> Column:
    return F.right(x, F.lit(n))


def ldrop(x, n: int) -> Column:
    return F.substr(x, F.lit(n + 1))


def rdrop(x, n: int) -> Column:
    return F.substr(x, F.lit(1), F.greatest(F.length(x) - n, F.lit(0)))


def concat(*xs) -> Column:
    """Nulls are passed over."""
    return F.concat_ws("", *xs)


def row(*xs) -> Column:
    """A value to be compared in the order of its parts, which must not be null."""
    return F.struct(*(col(x).alias(f"_{i}") for i, x in enumerate(xs)))


#: The query language's names.  Those that differ by operand count take as many Columns.
OPERATORS = {
    "$array": lambda *xs: F.array(*map(col, xs)), "$cond": choose,
    "$not": lambda x: ~x, "$and": all_of, "$or": any_of, "$nor": none_of,
    "$eq": lambda a, b: col(a).eqNullSafe(b), "$ne": lambda a, b: ~col(a).eqNullSafe(b),
    "$gt": lambda a, b: a > b, "$gte": lambda a, b: a >= b, "$lt": lambda a, b: a < b, "$lte": lambda a, b: a <= b,
    "$now": now, "$rand": F.rand,
    "$add": add, "$multiply": multiply, "$subtract": subtract, "$divide": divide,
    "$abs": F.abs, "$neg": F.negative, "$sqrt": F.sqrt, "$cbrt": F.cbrt, "$ceil": ceil, "$floor": floor, "$round": round_half_even,
    "$exp": F.exp, "$ln": F.ln, "$log2": F.log2, "$log10": F.log10, "$log": log, "$pow": F.pow,
    "$sin": F.sin, "$cos": F.cos, "$tan": F.tan, "$asin": F.asin, "$acos": F.acos, "$atan": F.atan, "$atan2": F.atan2,
    "$asinh": F.asinh, "$acosh": F.acosh, "$atanh": F.atanh, "$sinh": F.sinh, "$cosh": F.cosh, "$tanh": F.tanh,
    "$degrees": F.degrees, "$radians": F.radians, "$sign": F.signum,
    "$size": F.length, "$lower": F.lower, "$upper": F.upper, "$trim": F.btrim, "$ltrim": F.ltrim, "$rtrim": F.rtrim,
    "$first": first, "$last": last, "$ldrop": ldrop, "$rdrop": rdrop, "$lpad": F.lpad, "$rpad": F.rpad,
    "$concat": concat, "$ifNull": F.coalesce,
}
