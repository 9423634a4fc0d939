"""Sorting, top-k, random order, and pages by key."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import redirect_stdout
from io import StringIO

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .matching import ascending, descending


def sort(df: DataFrame, *keys: tuple[str | Column, int]) -> DataFrame:
    """By (path or expression, 1 or -1); nulls last when ascending, first when descending."""
    return df.orderBy(*(ascending(k) if d > 0 else descending(k) for k, d in keys))


def page(df: DataFrame, skip: int = 0, limit: int | None = None, most: int | None = None) -> DataFrame:
    """Skip, then limit; 0 gives no rows; `most` caps what any query returns."""
    df = df.offset(skip) if skip else df
    caps = [x for x in (limit, most) if x is not None]
    return df.limit(min(caps)) if caps else df


def nearest(df: DataFrame, by: Column, k: int, *ties: str) -> DataFrame:
    """The k rows with the least distance: each task keeps k, no full sort."""
    return df.withColumn("distance", by).orderBy(F.col("distance").asc_nulls_last(), *ties).limit(k)


def shuffled(df: DataFrame, weight: str | None = None, seed: int | None = None) -> DataFrame:
    """Random order; with a weight, as drawn without replacement in proportion to it.  Rows of no weight come last."""
    u = F.rand(seed) if seed is not None else F.rand()
    return df.orderBy(u if weight is None else F.when(F.col(weight) > 0, -F.ln(1 - u) / F.col(weight)).asc_nulls_last())


def after(df: DataFrame, keys: list[str], last: list, direction: int = 1) -> DataFrame:
    """The rows beyond the last one seen, in the order of the keys, which must not be null and all go one way."""
    seen = F.struct(*(F.lit(v).alias(k) for k, v in zip(keys, last)))
    here = F.struct(*keys)
    return df.where(here > seen if direction > 0 else here < seen)


def batches(df: DataFrame, keys: list[str], size: int = 100) -> Iterator[list[Row]]:
    """Batches in the order of unique keys, each read as a page beyond the one before."""
    last = None
    while rows := (df if last is None else after(df, keys, last)).orderBy(*keys).limit(size).collect():
        yield rows
        last = [rows[-1][k] for k in keys]
        if len(rows) < size:
            return


def explained(df: DataFrame, mode: str = "formatted") -> str:
    """The text that df.explain(mode) prints."""
    text = StringIO()
    with redirect_stdout(text):
        df.explain(mode)
    return text.getvalue()


def exists(df: DataFrame) -> bool:
    return not df.limit(1).isEmpty()
