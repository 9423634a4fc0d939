"""Update operators: each gives the new value of a column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.expressions import col


def _array(values: list, like: Column) -> Column:
    return F.array(*(col(v) for v in values)) if values else F.slice(like, 1, 0)


def element(c: Column, index: int, change) -> Column:
    """A vector with one element changed."""
    return F.transform(c, lambda x, i: F.when(i == index, change(x)).otherwise(x))


def field(c: Column, name: str, value: Column) -> Column:
    """A struct with one field changed."""
    return c.withField(name, value)


def inc(c: Column, v) -> Column:
    return c + v


def dec(c: Column, v) -> Column:
    return c - v


def mul(c: Column, v) -> Column:
    return c * v


def div(c: Column, v) -> Column:
    return c / v


def most(c: Column, v) -> Column:
    """The larger; a null is passed over."""
    return F.greatest(c, col(v))


def least(c: Column, v) -> Column:
    return F.least(c, col(v))


def add_to_set(c: Column, values: list) -> Column:
    """What is not there yet comes last; repeats that are there stay."""
    c = F.coalesce(c, F.slice(c, 1, 0)) if not values else F.coalesce(c, F.slice(_array(values, c), 1, 0))
    return F.concat(c, F.filter(F.array_distinct(_array(values, c)), lambda x: ~F.array_contains(c, x)))


def push(c: Column, values: list, relation: bool = False) -> Column:
    """Values come last; in a relation only those that are not there yet."""
    return add_to_set(c, values) if relation else F.concat(F.coalesce(c, F.slice(_array(values, c), 1, 0)), _array(values, c))


def remove_all(c: Column, values: list) -> Column:
    return F.filter(c, lambda x: ~F.coalesce(F.array_contains(_array(values, c), x), F.lit(False))) if values else c


def pop_first(c: Column, n: int = 1) -> Column:
    return F.slice(c, n + 1, F.greatest(F.size(c) - n, F.lit(0)))


def pop_last(c: Column, n: int = 1) -> Column:
    return F.slice(c, 1, F.greatest(F.size(c) - n, F.lit(0)))


OPERATORS = {"$set": lambda _, v: col(v), "$inc": inc, "$dec": dec, "$mul": mul, "$div": div, "$max": most, "$min": least, "$addToSet": add_to_set, "$push": push, "$removeAll": remove_all, "$popFirst": pop_first, "$popLast": pop_last}


def applied(columns: dict[str, Column], changes: dict[str, dict]) -> dict[str, Column]:
    """New values by column of changes {column: {operator: operand}}.  A column takes one operator at a time, known here."""
    out = {}
    for name, change in changes.items():
        if len(change) != 1:
            raise ValueError(f"{name}: one operator for each key, not {len(change)}")
        ((operator, value),) = change.items()
        if operator not in OPERATORS:
            raise ValueError(f"{name}: no operator {operator}")
        out[name] = OPERATORS[operator](columns[name], value)
    return out
