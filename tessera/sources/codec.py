"""The wire form of values: JSON with tags for what JSON lacks; names that start with $ have it doubled."""

from __future__ import annotations

import datetime as dt
import json
import re
import unicodedata
from dataclasses import dataclass, field
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DateType, DecimalType, MapType, StringType, StructType, TimestampNTZType, TimestampType


class BigInt(int):
    """An integer to be sent as such, not as a number."""


@dataclass(eq=False)
class Object:
    """A whole object: its class and its attributes, which may lead back to it."""

    cls: str
    attributes: dict = field(default_factory=dict)


_FLAGS = {"i": re.IGNORECASE, "m": re.MULTILINE, "s": re.DOTALL}


def tagged(x, above: tuple = ()):
    """x in the wire form.  What holds itself is written as the depth, from the outermost, of the holder it leads back to."""
    if isinstance(x, BigInt):
        return {"$integer": str(int(x))}
    if isinstance(x, dt.datetime):
        aware = x if x.tzinfo else x.replace(tzinfo=dt.timezone.utc)
        return {"$date": (aware - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)) // dt.timedelta(milliseconds=1)}
    if isinstance(x, Decimal):
        return {"$decimal": str(x)}
    if isinstance(x, re.Pattern):
        return {"$regex": x.pattern, "$options": "".join(f for f, bit in _FLAGS.items() if x.flags & bit)}
    if not isinstance(x, (dict, list, tuple, Object)):
        return x
    for depth, holder in enumerate(above):
        if holder is x:
            return {"$ref": depth}
    inner = (*above, x)
    if isinstance(x, Object):
        return {"$object": {"className": x.cls, "attributes": {k: tagged(v, inner) for k, v in x.attributes.items()}}}
    if isinstance(x, dict):
        return {f"${k}" if k.startswith("$") else k: tagged(v, inner) for k, v in x.items()}
    return [tagged(v, inner) for v in x]


def untagged(x, above: tuple = ()):
    if isinstance(x, list):
        items: list = []
        items.extend(untagged(v, (*above, items)) for v in x)
        return items
    if not isinstance(x, dict):
        return x
    if x.get("$date") is not None:
        return dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(milliseconds=x["$date"])
    if x.get("$regex") is not None:
        return re.compile(x["$regex"], sum(_FLAGS.get(f, 0) for f in x.get("$options") or ""))
    if x.get("$integer") is not None:
        return BigInt(x["$integer"])
    if x.get("$decimal") is not None:
        return Decimal(x["$decimal"])
    if x.get("$ref") is not None:
        return above[x["$ref"]]
    if x.get("$object") is not None:
        whole = Object(x["$object"]["className"])
        whole.attributes.update((k, untagged(v, (*above, whole))) for k, v in x["$object"]["attributes"].items())
        return whole
    out: dict = {}
    out.update((k[1:] if k.startswith("$") else k, untagged(v, (*above, out))) for k, v in x.items())
    return out


def serialize(x) -> str:
    return json.dumps(tagged(x), ensure_ascii=False)


def deserialize(s: str):
    return untagged(json.loads(s))


def wire_row(df: DataFrame) -> Column:
    """Each row as JSON text in the wire form: timestamps, days and decimals tagged at any depth, names that start with $
    doubled, other kinds as they are, nulls left out."""

    def part(c: Column, kind: DataType) -> Column:
        if isinstance(kind, (TimestampType, TimestampNTZType, DateType)):
            return F.when(c.isNotNull(), F.struct(F.unix_millis(c.cast("timestamp")).alias("$date")))
        if isinstance(kind, DecimalType):
            return F.when(c.isNotNull(), F.struct(c.cast("string").alias("$decimal")))
        if isinstance(kind, StructType):
            return F.when(c.isNotNull(), F.struct(*(named(c.getField(f.name), f.name, f.dataType) for f in kind.fields)))
        if isinstance(kind, ArrayType):
            return F.transform(c, lambda x: part(x, kind.elementType))
        if isinstance(kind, MapType) and isinstance(kind.keyType, StringType):
            doubled = F.transform_keys(c, lambda k, _: F.when(k.startswith("$"), F.concat(F.lit("$"), k)).otherwise(k))
            return F.transform_values(doubled, lambda _, v: part(v, kind.valueType))
        return c

    def named(c: Column, name: str, kind: DataType) -> Column:
        return part(c, kind).alias(f"${name}" if name.startswith("$") else name)

    return F.to_json(F.struct(*(named(F.col(f"`{f.name}`"), f.name, f.dataType) for f in df.schema.fields)))


def nfd(x):
    """Text, also within lists and objects, in the decomposed form in which it is stored and compared."""
    if isinstance(x, str):
        return unicodedata.normalize("NFD", x)
    if isinstance(x, dict):
        return {nfd(k): nfd(v) for k, v in x.items()}
    return [nfd(v) for v in x] if isinstance(x, list) else x


@F.pandas_udf(StringType())
def _nfd(s: pd.Series) -> pd.Series:
    return s.str.normalize("NFD")


def nfd_column(c: Column) -> Column:
    """A text column in decomposed form; plain ASCII, the usual case, does not leave the JVM's column."""
    return F.when(c.rlike(r"[^\x00-\x7F]"), _nfd(c)).otherwise(c)
