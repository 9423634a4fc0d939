"""Sub-queries for each parent: filter, sort, skip and limit its children, then list or aggregate them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ascending(c: str | Column) -> Column:
    """Nulls last, as the reference's database sorts."""
    return (F.col(c) if isinstance(c, str) else c).asc_nulls_last()


def descending(c: str | Column) -> Column:
    """Nulls first."""
    return (F.col(c) if isinstance(c, str) else c).desc_nulls_first()


def match(expanded: DataFrame, where: Column | None = None, sort: list[Column] | None = None, skip: int = 0, limit: int | None = None, rank: str = "rank") -> DataFrame:
    """The children (parent, ...) of each parent that a sub-query keeps, numbered in its order by a column named by `rank`.

    With a limit, Spark keeps only the first skip + limit of each parent in every task before it shuffles, so a parent
    with very many children is no large group.
    """
    if where is not None:
        expanded = expanded.where(where)
    if not sort:
        if skip or limit is not None:
            raise ValueError("skip and limit need a sort")
        return expanded
    if rank in expanded.columns:
        raise ValueError(f"the children have a column {rank}: name another for their number")
    number = F.row_number().over(Window.partitionBy("parent").orderBy(*sort))
    out = expanded.withColumn(rank, number)
    if limit is not None:
        out = out.where(F.col(rank) <= skip + limit)
    return out.where(F.col(rank) > skip) if skip else out


def merged(default: dict, *given: dict) -> dict:
    """The options of a relation's default sub-query and of those given, later ones last: filters are joined, others
    replaced.  Something given replaces the default's filter too."""
    out = {} if given else dict(default)
    for options in given:
        both = [w for w in (out.get("where"), options.get("where")) if w is not None]
        out = out | options | ({"where": both[0] if len(both) == 1 else both[0] & both[1]} if both else {})
    return {**{k: v for k, v in default.items() if k not in out and k != "where"}, **out}


def group_matches(df: DataFrame, key: str, matched: DataFrame, into: str, **aggregates: Column) -> DataFrame:
    """df with a struct of aggregates over each row's matched children.  Where there are none each is what it is over no
    rows at all: 0 for counts of any name, null for others."""
    named = [c.alias(n) for n, c in aggregates.items()]
    found = matched.groupBy(F.col("parent").alias("__tessera_p")).agg(F.struct(*named).alias("__tessera_found"))
    none = matched.where(F.lit(False)).agg(F.struct(*named).alias("__tessera_none"))  # one row
    both = df.join(found, df[key] == F.col("__tessera_p"), "left").join(F.broadcast(none))
    return both.select(*(df[c] for c in df.columns), F.coalesce("__tessera_found", "__tessera_none").alias(into))
