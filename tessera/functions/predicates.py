"""Field predicates of the query language.  A predicate that is null drops the row, as in a filter."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .expressions import col

#: Over so many values a list is a table to join with, not a condition.
LIST_LIMIT = 1000
POSIX = {"alpha": r"\p{Alpha}", "digit": r"\p{Digit}", "alnum": r"\p{Alnum}", "upper": r"\p{Upper}", "lower": r"\p{Lower}", "punct": r"\p{Punct}", "space": r"\s", "xdigit": r"\p{XDigit}"}


def equal(c: Column, v) -> Column:
    return c.eqNullSafe(v)


def not_equal(c: Column, v) -> Column:
    return ~c.eqNullSafe(v)


def contained_in(c: Column, values: Iterable) -> Column:
    """In the list; a null in the list finds nulls; no list finds nothing."""
    values = list(values)
    known = [v for v in values if v is not None]
    found = c.isin(known) if known else F.lit(False)
    return (c.isNull() | found) if len(known) < len(values) else found


def not_contained_in(c: Column, values: Iterable) -> Column:
    """Not in the list.  Nulls pass an empty list or a single value, not a longer list or one with a null in it."""
    values = list(values)
    known = [v for v in values if v is not None]
    if not values:
        return F.lit(True)
    if len(known) < len(values):
        return c.isNotNull() & ~c.isin(known) if known else c.isNotNull()
    return ~c.eqNullSafe(known[0]) if len(known) == 1 else ~c.isin(known)


def keep_listed(df: DataFrame, key: str, values: list) -> DataFrame:
    """Rows whose key is in the list: a condition for a short list, a semi-join with the list's table for a long one."""
    if len(values) <= LIST_LIMIT:
        return df.where(contained_in(F.col(key), values))
    kind = df.schema[key].dataType.simpleString()
    listed = df.sparkSession.createDataFrame([(v,) for v in values if v is not None], f"`{key}` {kind}")
    if all(v is not None for v in values):
        return df.join(listed, key, "left_semi")
    # A null in the list finds nulls; no listed value is null, so no row is found twice.
    return df.join(listed, key, "left_semi").select(*df.columns).unionByName(df.where(F.col(key).isNull()))


def _array(values: Iterable, like: Column) -> Column:
    return F.array(*(col(v) for v in values)) if values else F.slice(like, 1, 0)


def subset(c: Column, values: list) -> Column:
    """Every element is in the list."""
    return F.size(F.array_except(c, _array(values, c))) == 0


def superset(c: Column, values: list) -> Column:
    """Every element of the list is in the array; an empty list is in all."""
    return F.size(F.array_except(_array(values, c), c)) == 0 if values else F.lit(True)


def intersects(c: Column, values: list) -> Column:
    return F.coalesce(F.arrays_overlap(c, _array(values, c)), F.when(c.isNotNull(), F.lit(False))) if values else F.lit(False)


def not_superset(c: Column, values: list) -> Column:
    """The list is not wholly in the array; null arrays drop."""
    return c.isNotNull() & ~superset(c, values)


def disjoint(c: Column, values: list) -> Column:
    return c.isNotNull() & ~intersects(c, values)


def pattern(c: Column, p: str | re.Pattern) -> Column:
    """A string is found as it stands; a compiled pattern as a regular expression, POSIX classes included."""
    if isinstance(p, str):
        return c.contains(p)
    body = re.sub(r"\[:(\w+):\]", lambda m: POSIX[m[1]], p.pattern)
    return c.rlike(("(?i)" if p.flags & re.IGNORECASE else "") + body)


def starts(c: Column, s: str) -> Column:
    return c.startswith(s)


def ends(c: Column, s: str) -> Column:
    return c.endswith(s)


def text_size(c: Column, n: int) -> Column:
    """A null has size 0."""
    return F.coalesce(F.length(c), F.lit(0)) == n


def array_size(c: Column, n: int) -> Column:
    return F.coalesce(F.size(c), F.lit(0)) == n if n else (c.isNull() | (F.size(c) <= 0))


def empty(c: Column, yes: bool = True, text: bool = False) -> Column:
    size = F.coalesce(F.length(c) if text else F.when(c.isNotNull(), F.size(c)), F.lit(0))
    return size == 0 if yes else size != 0


def every(c: Column, test: Callable[[Column], Column]) -> Column:
    """No element fails the test; a null outcome does not fail; a null array has no element."""
    return F.coalesce(F.forall(c, lambda x: F.coalesce(test(x), F.lit(True))), F.lit(True))


def some(c: Column, test: Callable[[Column], Column]) -> Column:
    return F.coalesce(F.exists(c, lambda x: F.coalesce(test(x), F.lit(False))), F.lit(False))


def at(c: Column, *path: str | int) -> Column:
    """A nested value: names go into structs, numbers into arrays from 0; out of range is null."""
    for step in path:
        c = F.get(c, F.lit(step)) if isinstance(step, int) else c[step]
    return c


def json_path(c: Column, *path: str | int) -> tuple[Column, str]:
    """A variant and the path in it, for the json_* functions.  Text is parsed; broken text is null."""
    return F.try_parse_json(c), "$" + "".join(f"[{s}]" if isinstance(s, int) else f"['{s}']" for s in path)


def json_number(value: tuple[Column, str]) -> Column:
    """A number, or a tagged {"$decimal": "..."} as a double."""
    c, path = value
    return F.coalesce(F.try_variant_get(c, path, "double"), F.try_variant_get(c, f"{path}['$decimal']", "string").try_cast("double"))


def json_date(value: tuple[Column, str]) -> Column:
    """A tagged {"$date": ...}, ISO text or milliseconds."""
    c, path = value
    return F.coalesce(F.timestamp_millis(F.try_variant_get(c, f"{path}['$date']", "bigint")), F.try_variant_get(c, f"{path}['$date']", "string").try_cast("timestamp"))


def json_string(value: tuple[Column, str]) -> Column:
    """A string; other kinds are null, not turned into text."""
    c, path = value
    part = F.try_variant_get(c, path, "variant")
    return F.when(F.schema_of_variant(part) == "STRING", F.try_variant_get(c, path, "string"))
