"""Relations between classes as equi-joins: pointers, lists of ids, reverse and multi-hop relations, existence tests.

Array membership is always exploded into an equi-join; a join on array_contains would compare every pair.  Relations are
frames of (parent, child) pairs, so a hub's many children stay ordinary rows; lists of objects are made only on request.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_pointer(df: DataFrame, key: str, target: DataFrame, target_key: str, into: str) -> DataFrame:
    """df with the row its key points to as a struct; null if there is none, or none that may be seen."""
    there = target.select(F.col(target_key).alias("__tessera_key"), F.struct(*target.columns).alias(into))
    return df.join(there, df[key] == there["__tessera_key"], "left").drop("__tessera_key")


def by_pointer(children: DataFrame, pointer: str, child: str) -> DataFrame:
    """Pairs (parent, child) of the relation that a pointer of the child makes, seen from the parent."""
    return children.where(F.col(pointer).isNotNull()).select(F.col(pointer).alias("parent"), F.col(child).alias("child"))


def owned(children: DataFrame, pointer: str) -> DataFrame:
    """(parent, all columns of the child) of a pointer's reverse relation: what expand(by_pointer(...)) gives, without a
    join, as the child's own row names its parent."""
    return children.where(F.col(pointer).isNotNull()).select(F.col(pointer).alias("parent"), "*")


def by_ids(parents: DataFrame, parent: str, ids: str) -> DataFrame:
    """Pairs (parent, child) of a stored list of ids, with position; repeated ids once."""
    return parents.select(F.col(parent).alias("parent"), F.posexplode(F.array_distinct(ids)).alias("position", "child"))


def by_ids_of_child(children: DataFrame, child: str, ids: str) -> DataFrame:
    """Pairs (parent, child) of a list of parents that the child stores."""
    return by_ids(children, child, ids).select(F.col("child").alias("parent"), F.col("parent").alias("child"))


def through(*hops: DataFrame) -> DataFrame:
    """Pairs at the ends of a chain of relations, each once however many ways lead there."""
    out = hops[0].select("parent", "child")
    for hop in hops[1:]:
        step = hop.select(F.col("parent").alias("__tessera_via"), F.col("child").alias("__tessera_to"))
        out = out.join(step, out["child"] == step["__tessera_via"]).select("parent", F.col("__tessera_to").alias("child"))
    return out.dropDuplicates()


def expand(pairs: DataFrame, children: DataFrame, child: str) -> DataFrame:
    """(parent, all columns of the child): pairs whose child is missing or hidden fall away."""
    ids = pairs.select("parent", F.col("child").alias("__tessera_child"))
    return ids.join(children, F.col("__tessera_child") == children[child]).drop("__tessera_child")


def with_children(df: DataFrame, key: str, expanded: DataFrame, into: str, order: list[str] | None = None) -> DataFrame:
    """df with the children of each row as an array of structs, in the order of the named columns; empty if none."""
    names = [c for c in expanded.columns if c != "parent"]
    lead = [F.col(c).alias(f"__tessera_{c}") for c in order or names]
    rows = expanded.groupBy(F.col("parent").alias("__tessera_parent")).agg(F.sort_array(F.collect_list(F.struct(*lead, F.struct(*names).alias("__tessera_row")))).alias("__tessera_all"))
    rows = rows.select("__tessera_parent", F.transform("__tessera_all", lambda x: x["__tessera_row"]).alias(into))
    kind = rows.schema[into].dataType.simpleString()
    return df.join(rows, df[key] == rows["__tessera_parent"], "left").drop("__tessera_parent").withColumn(into, F.coalesce(into, F.array().cast(kind)))


def related_by(children: DataFrame, child: str, pairs: DataFrame, parent) -> DataFrame:
    """Children that one parent's relation holds."""
    return children.join(pairs.where(F.col("parent") == F.lit(parent)).select(F.col("child").alias("__tessera_c")), F.col(child) == F.col("__tessera_c"), "left_semi")


def having_some(df: DataFrame, key: str, expanded: DataFrame, test: Column) -> DataFrame:
    """Rows with a child for which the test is true."""
    return df.join(expanded.where(test).select(F.col("parent").alias("__tessera_p")), df[key] == F.col("__tessera_p"), "left_semi")


def having_every(df: DataFrame, key: str, expanded: DataFrame, test: Column) -> DataFrame:
    """Rows without a child for which the test is false; a null outcome is not false."""
    return df.join(expanded.where(~F.coalesce(test, F.lit(True))).select(F.col("parent").alias("__tessera_p")), df[key] == F.col("__tessera_p"), "left_anti")


def with_some(df: DataFrame, key: str, expanded: DataFrame, test: Column, into: str) -> DataFrame:
    """df with a flag, whether some child passes; for use under OR and NOT."""
    found = expanded.where(test).select(F.col("parent").alias("__tessera_p")).dropDuplicates()
    return df.join(found, df[key] == F.col("__tessera_p"), "left").withColumn(into, F.col("__tessera_p").isNotNull()).drop("__tessera_p")


def with_size(df: DataFrame, key: str, expanded: DataFrame, into: str) -> DataFrame:
    """df with the number of children, 0 if none; for size and emptiness tests."""
    n = expanded.groupBy(F.col("parent").alias("__tessera_p")).agg(F.count(F.lit(1)).alias(into))
    return df.join(n, df[key] == F.col("__tessera_p"), "left").drop("__tessera_p").withColumn(into, F.coalesce(into, F.lit(0)))


def references(classes: dict[str, tuple[DataFrame, str, list[str], list[str]]]) -> DataFrame:
    """Every reference there is, once: (class, id, target) from each class's (frame, id, pointers, lists of ids)."""
    out = None
    for name, (df, key, pointers, lists) in classes.items():
        for column in (*pointers, *lists):
            to = F.explode(column) if column in lists else F.col(column)
            one = df.select(F.lit(name).alias("class"), F.col(key).cast("string").alias("id"), to.cast("string").alias("target")).where("target is not null")
            out = one if out is None else out.unionByName(one)
    if out is None:  # no class refers to any
        return next(iter(classes.values()))[0].sparkSession.createDataFrame([], "class string, id string, target string")
    return out.dropDuplicates()


def refs(classes: dict, target) -> DataFrame:
    """(class, id) of all objects that point to the target."""
    return references(classes).where(F.col("target") == str(target)).select("class", "id").dropDuplicates()


def nonrefs(df: DataFrame, key: str, classes: dict) -> DataFrame:
    """Rows that nothing points to."""
    return df.join(references(classes).select("target"), df[key].cast("string") == F.col("target"), "left_anti")
