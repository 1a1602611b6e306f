"""Bulk partial update with one outcome per request."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.patches import NEW, SET, nothing_set, parse_patch
from ..functions.rules import DATA_ERROR, INVALID, Rule, first_broken
from ..session import Stage, no_stage
from .checks import (
    BAD_REFERENCE, CONFLICT, FORBIDDEN, NOT_FOUND, OK, UNAUTHENTICATED, Reference,
    check_owner, first_of, mark_existing, resolve_actor,
)
from .inserts import Changes, Unique, as_now
from .claims import settle_claims


def fold_patches(
    patches: DataFrame, columns: Iterable[str], target: str = "target_id", seq: str = "seq"
) -> DataFrame:
    """One row per target: for each column a struct (v) of the last value set, or null.

    The struct keeps a value of null apart from a column that no patch set. The smallest
    and largest value set (`_lo_`, `_hi_`) tell whether a column held anything else on the way.
    Everything is a partial aggregate, so a row patched very often costs no more.
    """
    out = []
    for c in columns:
        was_set, value = F.col(SET + c), F.struct(F.col(NEW + c).alias("v"))
        out.append(F.max_by(value, F.when(was_set, F.col(seq))).alias(f"_last_{c}"))
        out.append(F.min(F.when(was_set, value)).alias(f"_lo_{c}"))
        out.append(F.max(F.when(was_set, value)).alias(f"_hi_{c}"))
    return patches.groupBy(target).agg(*out)


def apply_patches(
    table: DataFrame, patches: DataFrame, key: str, columns: Iterable[str],
    touch: str | None = None, now: datetime | str | Column | None = None,
    target: str = "target_id", seq: str = "seq",
) -> DataFrame:
    """Write accepted patches: per row and column the last one that set the column.

    `touch` is refreshed to `now` only where some patch really changed a value, by binary
    comparison. A value changed and then changed back within the batch counts, as it
    would one request at a time.
    """
    columns = list(columns)
    fold = fold_patches(patches, columns, target, seq).withColumnRenamed(target, "_target")
    both = table.join(fold, table[key] == fold["_target"], "left")
    values, changed = {}, F.lit(False)
    for c in columns:
        last, lo, hi = F.col(f"_last_{c}"), F.col(f"_lo_{c}"), F.col(f"_hi_{c}")
        new = last["v"].cast(table.schema[c].dataType)
        values[c] = F.when(last.isNotNull(), new).otherwise(table[c])
        moved = (lo != hi) | ~new.eqNullSafe(table[c])
        changed = changed | (last.isNotNull() & F.coalesce(moved, F.lit(True)))
    if touch is not None:
        values[touch] = F.when(changed, as_now(now)).otherwise(table[touch])
    return both.select(*[values.get(c, table[c]).alias(c) for c in table.columns])


def _column_errors(
    fields: Iterable[T.StructField], required: set[str], lengths: Mapping[str, int],
    text_bytes: Mapping[str, int], null_code: int,
) -> list[tuple[Column, int, str]]:
    """What the store refuses, column by column in table order."""
    errors = []
    for f in fields:
        was_set, new = F.col(SET + f.name), F.col(NEW + f.name)
        if f.name in required:
            errors.append((was_set & new.isNull(), null_code, f"{f.name} must not be null"))
        if f.name in lengths:
            n = lengths[f.name]
            errors.append((F.char_length(new) > n, DATA_ERROR, f"{f.name} is longer than {n}"))
        if f.name in text_bytes:
            n = text_bytes[f.name]
            errors.append((F.octet_length(new) > n, DATA_ERROR, f"{f.name} is longer than {n} bytes"))
        if isinstance(f.dataType, T.IntegerType):
            over = new.isNotNull() & new.try_cast("int").isNull()
            errors.append((over, DATA_ERROR, f"{f.name} is out of range"))
    return errors


def judge_patches(
    table: DataFrame, requests: DataFrame, *, key: str, columns: Iterable[str],
    required: Iterable[str] = (), lengths: Mapping[str, int] | None = None,
    text_bytes: Mapping[str, int] | None = None,
    rules: Iterable[Rule] = (), fks: Iterable[Reference] = (), unique: Unique | None = None,
    members: DataFrame | None = None, null_code: int = CONFLICT,
    missing: str = "not found", target: str = "target_id", body: str = "body",
    sub: str = "sub", seq: str = "seq", stage: Stage = no_stage,
) -> DataFrame:
    """Parsed patches with their (code, detail) in `_verdict`; null means write it.

    With `members` the request carries a subject, and only the owner may patch: not JSON
    422, no such actor 401, wrong value 422, other owner 403. Without: 422, then unknown
    row 404. Both go on with: nothing set 200, reference 400, value the store refuses,
    unique value taken 409.
    """
    fields = [table.schema[c] for c in columns]
    names = [f.name for f in fields]
    parsed = parse_patch(requests, body, T.StructType(fields))
    broken = first_broken(rules)
    not_json = (~F.col("is_json"), INVALID, "body is not JSON")
    bad_value = (~F.col("body_ok"), INVALID, "body has a value of the wrong type")
    bad_rule = (broken.isNotNull(), INVALID, broken)
    if members is not None:
        parsed = check_owner(resolve_actor(parsed, members, sub, key), "actor_id", target)
        gate = [
            not_json,
            (F.col("actor_code").isNotNull(), UNAUTHENTICATED, "unknown actor"),
            bad_value,
            bad_rule,
            (F.col("owner_code").isNotNull(), FORBIDDEN, "not the owner"),
        ]
    else:
        parsed = mark_existing(parsed, target, table, key, "_found")
        gate = [not_json, bad_value, bad_rule, (~F.col("_found"), NOT_FOUND, missing)]
    gate.append((nothing_set(names), OK, F.lit(None)))
    for i, ref in enumerate(fks):
        new = F.col(NEW + ref.column)
        parsed = mark_existing(parsed, NEW + ref.column, ref.parent, ref.parent_key, f"_ref{i}")
        # A reference set to null is not looked up; a required column refuses it below.
        gate.append((new.isNotNull() & ~F.col(f"_ref{i}"), BAD_REFERENCE, f"Invalid {ref.column}"))
    gate += _column_errors(fields, set(required), lengths or {}, text_bytes or {}, null_code)
    judged = parsed.withColumn("_verdict", first_of(*gate)).select(
        seq, target, *[p + n for n in names for p in (SET, NEW)], "_verdict"
    )
    judged = stage(judged)
    if unique is None:
        return judged
    (column,) = unique.columns
    asks = F.col("_verdict").isNull() & F.col(SET + column)
    claims = judged.where(asks).select(seq, target, F.col(NEW + column).alias(column))
    granted = settle_claims(
        claims, table, column, key, target, seq, column in unique.text, None if stage is no_stage else stage
    ).withColumn("_granted", F.lit(True))
    refused = first_of((asks & F.col("_granted").isNull(), CONFLICT, unique.detail))
    return (
        judged.join(granted, seq, "left")
        .withColumn("_verdict", F.coalesce(F.col("_verdict"), refused))
        .drop("_granted")
    )


def patch_rows(
    table: DataFrame, requests: DataFrame, *, key: str, columns: Iterable[str],
    touch: str | None = None, now: datetime | str | Column | None = None,
    target: str = "target_id", seq: str = "seq", **checks,
) -> Changes:
    """Check the patches (`judge_patches` has the order and the options) and apply them.

    Equal to applying them one at a time by `seq`. With a unique column among those that are
    patched, jobs run at once (`settle_claims`); `stage` then saves judging twice.
    """
    columns = list(columns)
    judged = judge_patches(
        table, requests, key=key, columns=columns, target=target, seq=seq, **checks
    )
    accepted = judged.where(F.col("_verdict").isNull())
    outcomes = judged.select(
        F.col(seq),
        F.coalesce(F.col("_verdict")["code"], F.lit(OK)).alias("code"),
        F.col("_verdict")["detail"].alias("detail"),
        F.col(target).cast(table.schema[key].dataType).alias("id"),
    )
    return Changes(
        apply_patches(table, accepted, key, columns, touch, now, target, seq), outcomes
    )
