"""Checks that give each request row an outcome.

Every check adds one column and filters nothing, so the caller decides which failure
counts first. Parents are joined on their key, one row at most per request; a parent
that is small enough is broadcast by Spark after measuring it, a request key that holds
a large share of the rows is split by adaptive execution (`session.SKEW_SETTINGS`).
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.rules import Rule, first_broken

OK = 200
BAD_REFERENCE = 400
UNAUTHENTICATED = 401
FORBIDDEN = 403
NOT_FOUND = 404
CONFLICT = 409


@dataclass(frozen=True)
class Reference:
    """A column that must name an existing row of `parent`."""

    column: str
    parent: DataFrame
    parent_key: str


def check_rows(df: DataFrame, rules: Iterable[Rule], into: str = "failed_rule") -> DataFrame:
    """Name of the first broken rule, or null."""
    return df.withColumn(into, first_broken(rules))


def mark_existing(df: DataFrame, column: str, parent: DataFrame, key: str, into: str) -> DataFrame:
    """Boolean `into`: the value of `column` is a key of `parent`. Null is not."""
    known = parent.select(F.col(key).alias("_parent_key"), F.lit(True).alias("_known"))
    return (
        df.join(known, df[column] == known["_parent_key"], "left")
        .withColumn(into, F.col("_known").isNotNull())
        .drop("_parent_key", "_known")
    )


def check_fk(
    requests: DataFrame, parent: DataFrame, fk: str, pk: str, outcome: str = "fk_code"
) -> DataFrame:
    """400 in `outcome` where `fk` names no row of `parent`, else null."""
    marked = mark_existing(requests, fk, parent, pk, "_exists")
    return marked.withColumn(outcome, F.when(~F.col("_exists"), BAD_REFERENCE)).drop("_exists")


def check_references(
    requests: DataFrame, refs: Iterable[Reference], into: str = "bad_reference"
) -> DataFrame:
    """Column of the first missing reference in the order given, or null."""
    refs = list(refs)
    marked, missing = requests, []
    for i, ref in enumerate(refs):
        marked = mark_existing(marked, ref.column, ref.parent, ref.parent_key, f"_exists{i}")
        missing.append(F.when(~F.col(f"_exists{i}"), F.lit(ref.column)))
    first = F.coalesce(*missing, F.lit(None).cast("string"))
    return marked.withColumn(into, first).drop(*[f"_exists{i}" for i in range(len(refs))])


def resolve_actor(
    events: DataFrame, members: DataFrame, sub: str = "sub", key: str = "member_id",
    into: str = "actor_id",
) -> DataFrame:
    """Turn a text subject into the member it names; `actor_code` is 401 when there is none.

    Surrounding space and a sign are accepted, as in an integer literal; digits grouped
    by underscores are not.
    """
    kind = members.schema[key].dataType.simpleString()
    known = members.select(F.col(key).alias(into))
    parsed = events.withColumn("_actor", F.col(sub).try_cast(kind))
    return (
        parsed.join(known, parsed["_actor"] == known[into], "left")
        .drop("_actor")
        .withColumn("actor_code", F.when(F.col(into).isNull(), UNAUTHENTICATED))
    )


def check_owner(
    events: DataFrame, actor: str = "actor_id", target: str = "target_id",
    into: str = "owner_code",
) -> DataFrame:
    """403 where the actor is not the target."""
    return events.withColumn(into, F.when(F.col(actor) != F.col(target), FORBIDDEN))


def first_of(*pairs: tuple[Column, int, Column | str]) -> Column:
    """Struct (code, detail) of the first condition that holds, else null.

    A condition that is null counts as not holding.
    """
    cases = [
        F.when(
            cond,
            F.struct(
                F.lit(code).alias("code"),
                (F.lit(d) if isinstance(d, str) else d).cast("string").alias("detail"),
            ),
        )
        for cond, code, d in pairs
    ]
    return F.coalesce(*cases)
