"""Accumulators.  Nulls are passed over; nothing counts 0 and sums to null."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written


def count() -> Column:
    return F.count(F.lit(1))


def most(c: str) -> Column:
    """The most frequent value; of several the smallest.  One task holds a group's distinct values; where these may be
    very many, take most_of."""
    return F.mode(c, deterministic=True)


def most_of(df: DataFrame, by: list[str], value: str, into: str) -> DataFrame:
    """most() for each group, from counts that are added up before they meet: no task holds a group's values."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_value")).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*by).agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col("_value").alias("v"))).getField("v").alias(into))


def percentile_continuous(c: str, p: float) -> Column:
    """One task holds a group's distinct values; where these may be very many, take percentile_continuous_of."""
    return F.expr(f"percentile_cont({p}) within group (order by `{c}`)")


def _at_ranks(df: DataFrame, by: list[str], value: str, low: Callable[[Column], Column], high: Callable[[Column], Column]) -> DataFrame:
    """For each group its size `_all` and the values `_low` and `_high` at two neighbouring ranks, from 1, that are made of
    the size.

    Values are counted, then dealt to ranges of (group, value).  A row of sums for each group and range tells in which
    range a rank falls, and only that one is ranked, so neither a group nor the whole table meets in a task."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_value")).agg(F.count(F.lit(1)).alias("_n"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(counts.repartitionByRange(parts, *by, "_value").withColumn("_part", F.spark_partition_id()))
    own = Window.partitionBy(*(by or [F.lit(0)]))
    sums = ranged.groupBy(*by, "_part").agg(F.sum("_n").alias("_in"))
    sums = sums.withColumns({"_all": F.sum("_in").over(own), "_before": F.sum("_in").over(own.orderBy("_part")) - F.col("_in")})
    first, last = low(F.col("_all")), high(F.col("_all"))
    there = sums.where((F.col("_before") < last) & (F.col("_before") + F.col("_in") >= first)).select(*(F.col(c).alias(f"_by{i}") for i, c in enumerate(by)), F.col("_part").alias("_in_part"), "_all", "_before")
    on = F.col("_part") == F.col("_in_part")
    for i, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    found = ranged.join(there, on)
    upto = F.col("_before") + F.sum("_n").over(Window.partitionBy(*by, "_part").orderBy("_value"))
    found = found.withColumn("_upto", upto)
    return found.groupBy(*by).agg(F.max("_all").alias("_all"), *(F.min(F.when(F.col("_upto") >= r, F.col("_value"))).alias(n) for n, r in (("_low", first), ("_high", last))))


def percentile_discrete(df: DataFrame, by: list[str], value: str, p: float, into: str) -> DataFrame:
    """For each group the smallest value, of any ordered kind, that a share p of the values does not exceed."""
    rank = lambda n: F.greatest(F.ceil(F.lit(p) * n), F.lit(1))
    return _at_ranks(df, by, value, rank, rank).select(*by, F.col("_low").alias(into))


def percentile_continuous_of(df: DataFrame, by: list[str], value: str, p: float, into: str) -> DataFrame:
    """For each group the value at the share p of the way through its sorted numbers, between two of them by proportion."""
    at = lambda n: F.lit(p) * (n - 1)
    found = _at_ranks(df, by, value, lambda n: F.floor(at(n)) + 1, lambda n: F.ceil(at(n)) + 1)
    part = at(F.col("_all")) - F.floor(at(F.col("_all")))
    return found.select(*by, (F.col("_low") + (F.col("_high") - F.col("_low")) * part).alias(into))


def group(df: DataFrame, key: Column, value: Column, into: str) -> DataFrame:
    """One row with an array of {key, value}, sorted by key; [] for no rows.  An array may be a key.  A group within a group
    is refused: value is one accumulator."""
    if isinstance(value, (tuple, list, dict)):
        raise ValueError("a group holds one accumulator, not another group")
    rows = df.groupBy(key.alias("key")).agg(value.alias("value"))
    return rows.agg(F.sort_array(F.collect_list(F.struct("key", "value"))).alias(into))


def group_find(df: DataFrame, plain: dict[str, Column] | None = None, groups: dict[str, tuple[Column, Column]] | None = None) -> DataFrame:
    """One row: the plain accumulators in one pass, and each group (key, value) as an array in a pass of its own."""
    out = df.agg(*(c.alias(n) for n, c in plain.items())) if plain else None
    for name, (key, value) in (groups or {}).items():
        one = group(df, key, value, name)
        out = one if out is None else out.join(one)  # each side is one row
    if out is None:
        raise ValueError("no accumulator")
    return out
