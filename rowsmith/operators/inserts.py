"""Bulk insert with one outcome per request."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from datetime import datetime
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.rules import DATA_ERROR, INVALID, Rule, first_broken
from ..session import Stage, no_stage
from .checks import BAD_REFERENCE, CONFLICT, OK, Reference, check_references, first_of
from .ids import assign_ids, next_id
from .unique import new_keys


class Changes(NamedTuple):
    """New content of a table, (seq, code, detail, id) per request, and for inserts the new rows."""

    table: DataFrame
    outcomes: DataFrame
    added: DataFrame | None = None


@dataclass(frozen=True)
class Unique:
    """A unique key; columns in `text` compare without case and accents."""

    columns: tuple[str, ...]
    text: tuple[str, ...] = ()
    detail: str = "already exists"


def as_now(now: datetime | str | Column) -> Column:
    """The job's time stamp, whole seconds, without zone."""
    now = now if isinstance(now, Column) else F.lit(now)
    return F.date_trunc("second", now.cast("timestamp_ntz")).cast("timestamp_ntz")


def insert_rows(
    table: DataFrame,
    requests: DataFrame,
    *,
    key: str,
    rules: Iterable[Rule] = (),
    fks: Iterable[Reference] = (),
    unique: Unique | None = None,
    now: datetime | str | Column | None = None,
    stamps: Iterable[str] = (),
    defaults: Mapping[str, Column] | None = None,
    seq: str = "seq",
    stage: Stage = no_stage,
) -> Changes:
    """Insert the acceptable requests; equal to inserting them one at a time by `seq`.

    Checks in order: row rules with code 422, references 400 (in the order given),
    over-long values 500, unique key 409. New keys continue from the largest one in
    arrival order without gaps. Columns named in `stamps` get `now`, columns missing from
    the requests get their default or null.

    `stage` may write the checked requests and the accepted ones to shared storage, so that the
    unique check, the new table and the outcomes do not each repeat the checks.
    """
    rules = list(rules)
    extra = dict(defaults or {}) | {c: as_now(now) for c in stamps}
    judged = check_references(
        requests.withColumn("_rule", first_broken([r for r in rules if r.code == INVALID]))
        .withColumn("_data", first_broken([r for r in rules if r.code == DATA_ERROR])),
        fks,
        "_ref",
    )
    judged = judged.withColumn(
        "_fail",
        first_of(
            (F.col("_rule").isNotNull(), INVALID, F.col("_rule")),
            (F.col("_ref").isNotNull(), BAD_REFERENCE, F.concat(F.lit("Invalid "), "_ref")),
            (F.col("_data").isNotNull(), DATA_ERROR, F.col("_data")),
        ),
    )
    judged = stage(judged.drop("_rule", "_ref", "_data"))
    passed = judged.where(F.col("_fail").isNull())
    if unique is not None:
        accepted = new_keys(passed, table, unique.columns, seq, unique.text)
    else:
        accepted = passed.select(seq)
    numbered = assign_ids(accepted, next_id(table, key), seq, "_id", stage=stage)
    judged = judged.join(numbered, seq, "left")

    conflict = unique.detail if unique else ""
    fail = F.coalesce(F.col("_fail"), first_of((F.col("_id").isNull(), CONFLICT, conflict)))
    kind = table.schema[key].dataType
    outcomes = judged.select(
        F.col(seq),
        F.coalesce(fail["code"], F.lit(OK)).alias("code"),
        fail["detail"].alias("detail"),
        F.col("_id").cast(kind).alias("id"),
    )
    rows = judged.where(F.col("_id").isNotNull()).select(
        *[_new_value(f, key, requests, extra) for f in table.schema.fields]
    )
    return Changes(table.unionByName(rows), outcomes, rows)


def _new_value(field, key: str, requests: DataFrame, extra: Mapping[str, Column]) -> Column:
    fallback = extra.get(field.name, F.lit(None))
    if field.name == key:
        value = F.col("_id")
    elif field.name in requests.columns:
        value = F.coalesce(F.col(field.name), fallback)
    else:
        value = fallback
    return value.cast(field.dataType).alias(field.name)
