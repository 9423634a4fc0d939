"""Changes to a class as new tables: insert, update, upsert, delete.

Each gives (table after, rows returned).  Tables are immutable; who keeps them writes the new one beside the old and
then lets readers see it, as any Spark job does.  System columns that a table has are kept up; others are not invented.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import now


def prepared(rows: DataFrame, required: list[str] = (), defaults: dict | None = None, relations: list[str] = ()) -> DataFrame:
    """Rows to insert: defaults where a value is missing, relations without repeats, and system columns.

    Raises, when read, if a required value is missing."""
    for name, value in (defaults or {}).items():
        rows = rows.withColumn(name, F.coalesce(F.col(name), F.lit(value)) if name in rows.columns else F.lit(value))
    for name in required:
        rows = rows.withColumn(name, F.coalesce(F.col(name), F.raise_error(F.lit(f"Attribute is required: {name}")).cast(rows.schema[name].dataType)))
    for name in relations:
        rows = rows.withColumn(name, F.array_distinct(name))
    star = F.array(F.lit("*"))
    system = {"_id": F.expr("uuid()"), "__v": F.lit(0), "_created_at": now(), "_updated_at": now(), "_rperm": star, "_wperm": star}
    return rows.withColumns({k: v for k, v in system.items() if k not in rows.columns})


def insert(table: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    return table.unionByName(rows, allowMissingColumns=True), rows


def update(table: DataFrame, where: Column, changes: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Changes are made from the values before; the returned rows have those after."""
    if "__v" in table.columns:
        changes = changes | {"__v": F.col("__v") + 1}
    if "_updated_at" in table.columns:
        changes = changes | {"_updated_at": now()}
    hit = F.coalesce(where, F.lit(False))
    after = table.select(*(F.when(hit, changes[c]).otherwise(F.col(c)).cast(table.schema[c].dataType).alias(c) if c in changes else F.col(c) for c in table.columns))
    returned = table.where(hit).select(*(changes[c].cast(table.schema[c].dataType).alias(c) if c in changes else F.col(c) for c in table.columns))
    return after, returned


def upsert(table: DataFrame, where: Column, changes: dict[str, Column], on_insert: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Updates all that match; if none does, inserts on_insert."""
    return insert(table, on_insert) if table.where(where).limit(1).isEmpty() else update(table, where, changes)


def delete(table: DataFrame, where: Column) -> tuple[DataFrame, DataFrame]:
    hit = F.coalesce(where, F.lit(False))
    return table.where(~hit), table.where(hit)


def collect_garbage(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the rows that have expired."""
    return delete(table, F.col("_expired_at") < F.current_timestamp())


def taken(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows to insert whose id the table has already; they need another id."""
    return rows.join(table.select(F.col(key).alias("_k")), rows[key] == F.col("_k"), "left_semi")


def duplicates(table: DataFrame, keys: list[str]) -> DataFrame:
    """Values of a unique index that occur more than once; rows with a null in them are not indexed."""
    known = table
    for k in keys:
        known = known.where(F.col(k).isNotNull())
    return known.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def only_known_ids(pairs: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """Relation pairs (parent, child) whose child exists; a write drops dangling ids."""
    return pairs.join(targets.select(F.col(key).alias("_k")), pairs["child"] == F.col("_k"), "left_semi")
