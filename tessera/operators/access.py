"""Access rules as predicates, put on every class before it is joined, so that hidden targets are null."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import written


@dataclass(frozen=True)
class Viewer:
    """Who asks: the user's id, the ids and the names of their roles; a master sees all."""

    user: str | None = None
    roles: tuple[str, ...] = ()
    names: tuple[str, ...] = ()
    master: bool = False

    @property
    def grants(self) -> list[str]:
        return ["*", *([self.user] if self.user else []), *(f"role:{n}" for n in self.names)]


@dataclass(frozen=True)
class Rules:
    """A class's permissions.  Field lists name pointers (strings) or relations (arrays) to users or roles."""

    class_level: dict[str, list[str]] = field(default_factory=dict)
    field_level: dict[str, dict[str, list[str]]] = field(default_factory=dict)
    secure_fields: tuple[str, ...] = ()
    user_fields: dict[str, list[str]] = field(default_factory=dict)  # by "read" and "update"
    role_fields: dict[str, list[str]] = field(default_factory=dict)
    additional: dict[str, list[str]] = field(default_factory=dict)


def alive() -> Column:
    """Not expired."""
    return F.col("_expired_at").isNull() | (F.col("_expired_at") > F.current_timestamp())


def allowed(df: DataFrame, viewer: Viewer, rules: Rules = Rules(), action: str = "read") -> Column:
    """Rows that may be read, or changed (action "update").  A table without permission columns is public."""
    if viewer.master or set(rules.additional.get(action, ())) & set(viewer.grants):
        return F.lit(True)
    perms = "_rperm" if action == "read" else "_wperm"
    grants = F.array(*map(F.lit, viewer.grants))
    ways = [F.arrays_overlap(F.col(perms), grants) if perms in df.columns else F.lit(True)]
    for name in rules.user_fields.get(action, ()) if viewer.user else ():
        ways.append(_holds(df, name, [viewer.user]))
    for name in rules.role_fields.get(action, ()) if viewer.roles else ():
        ways.append(_holds(df, name, list(viewer.roles)))
    return reduce(or_, (F.coalesce(w, F.lit(False)) for w in ways))


def _holds(df: DataFrame, name: str, ids: list[str]) -> Column:
    if df.schema[name].dataType.typeName() == "array":
        return F.arrays_overlap(F.col(name), F.array(*map(F.lit, ids)))
    return F.col(name).isin(ids)


def check_class(viewer: Viewer, rules: Rules, action: str) -> None:
    """get, find, count, create, update or delete; what is not listed is open to all."""
    if not viewer.master and not set(rules.class_level.get(action, ["*"])) & set(viewer.grants):
        raise PermissionError("No permission")


def readable_fields(df: DataFrame, viewer: Viewer, rules: Rules, asked: list[str] | None = None) -> list[str]:
    """The columns for "*", or those asked for; asking for one that may not be read raises."""

    def open_(name: str) -> bool:
        return viewer.master or name not in rules.secure_fields and bool(set(rules.field_level.get(name, {}).get("read", ["*"])) & set(viewer.grants))

    if asked is None:
        return [c for c in df.columns if open_(c)]
    for name in asked:
        if not open_(name):
            raise PermissionError(f"No permission: {name}")
    return list(asked)


def check_fields(viewer: Viewer, rules: Rules, names: list[str], action: str) -> None:
    """Raises if one of the fields may not be set on "create" or "update"."""
    for name in names if not viewer.master else ():
        if name in rules.secure_fields or not set(rules.field_level.get(name, {}).get(action, ["*"])) & set(viewer.grants):
            raise PermissionError(f"No permission: {name}")


def visible(df: DataFrame, viewer: Viewer, rules: Rules = Rules(), action: str = "read") -> DataFrame:
    """df without the rows that have expired or are not allowed.  Apply it to each side before a join."""
    if "_expired_at" in df.columns:
        df = df.where(alive())
    return df.where(allowed(df, viewer, rules, action))


#: Pairs of a user and a role, repeats included, for each task that makes them, on average.
PAIRS = 1 << 20

#: Ways between roles that are broadcast; more are joined by shuffles.
WAYS = 1 << 20


def inherited_roles(members: DataFrame, roles: DataFrame) -> DataFrame:
    """(user, role): roles a user is in, and all that hold those roles, to any depth.

    members has (role, user), roles has (role, holds): a role and one whose members it takes in.  Ways between roles double
    in length with each round, so a chain of a thousand roles takes ten; rounds end when one finds no new pair, so cycles
    do no harm.  Members are joined once, when all ways are known.  Users are dealt over as many tasks as there are PAIRS
    in the pairs made, and a user's repeats are dropped there, so that no task's memory grows with the members."""
    ways = written(roles.select(F.col("holds").alias("from"), F.col("role").alias("to")).where("`from` is not null and `to` is not null").dropDuplicates())
    n = ways.count()
    while True:
        on = ways.select(F.col("from").alias("to"), F.col("to").alias("end"))
        longer = ways.join(on, "to").select("from", F.col("end").alias("to"))
        ways, before = written(ways.unionByName(longer).dropDuplicates()), n
        n = ways.count()
        if n == before:
            break
    own = members.select("user", "role")
    above = ways.groupBy("from").agg(F.count(F.lit(1)).alias("n"))
    pairs = own.join(above, own["role"] == above["from"], "left").agg(F.sum(F.coalesce("n", F.lit(0)) + 1)).first()[0] or 1
    tasks = -(-pairs // PAIRS)
    ways = ways.unionByName(ways.select("from", F.col("from").alias("to"))).dropDuplicates()
    few = n <= WAYS
    own = own.repartition(tasks, "user") if few else own
    all_ = own.join(F.broadcast(ways) if few else ways, own["role"] == ways["from"], "left").select("user", F.coalesce("to", "role").alias("role"))
    return (all_ if few else all_.repartition(tasks, "user")).dropDuplicates()
