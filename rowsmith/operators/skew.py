"""Joining many rows to derived facts by a key that may be hot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Integer types from narrow to wide.
INTEGERS = [T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType()]


def same_type(a: Column, kind_a: T.DataType, b: Column, kind_b: T.DataType) -> tuple[Column, Column]:
    """Both columns in one type, the wider of two integer types; other pairs are refused."""
    if kind_a in INTEGERS and kind_b in INTEGERS:
        wide = max(kind_a, kind_b, key=INTEGERS.index)
        return a.cast(wide), b.cast(wide)
    if isinstance(kind_a, T.StringType) and isinstance(kind_b, T.StringType):
        return a, b
    if kind_a != kind_b:
        raise TypeError(f"{kind_a.simpleString()} and {kind_b.simpleString()} are not comparable keys")
    return a, b


def join_facts(
    rows: DataFrame, facts: DataFrame, left: list[str], right: list[str], how: str = "inner"
) -> DataFrame:
    """Join on left = right so that adaptive execution can split a hot key of `rows`.

    Spark splits a partition only where both inputs come straight from an exchange made
    for the join. Facts that were grouped by the same key need no such exchange and would
    keep the hot key in one task. Asking for the key's hash as well makes the grouping
    insufficient, and the facts, one row per key, are the cheap side to move again.

    Hashes of one number differ between integer types, so both sides are compared and hashed
    in the wider of their types. Text under a collation is compared, not hashed.
    """
    pairs, hashed = [], []
    for a, b in zip(left, right):
        kinds = rows.schema[a].dataType, facts.schema[b].dataType
        pairs.append(same_type(rows[a], kinds[0], facts[b], kinds[1]))
        if all(not isinstance(k, T.StringType) or k == T.StringType() for k in kinds):
            hashed.append(pairs[-1])
    same = pairs[0][0] == pairs[0][1]
    for a, b in pairs[1:]:
        same = same & (a == b)
    if hashed:
        same = (F.xxhash64(*[a for a, _ in hashed]) == F.xxhash64(*[b for _, b in hashed])) & same
    return rows.join(facts, same, how)
