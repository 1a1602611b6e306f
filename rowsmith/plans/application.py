"""The application's operations as bulk jobs over its six tables.

Every function takes the tables as a mapping of DataFrames by name. Change jobs return
the new content of the one table they change and the outcome of every request.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import replace
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.patches import NEW
from ..functions.rules import Rule, between, max_bytes, max_length, required
from ..operators.checks import Reference
from ..operators.deletes import cascade_delete, delete_rows, restrict_delete
from ..operators.inserts import Changes, insert_rows
from ..operators.patching import patch_rows
from ..operators.reads import list_rows, lookup, lookup_ci, public_view
from ..operators.upserts import renumber, upsert
from ..schemas import EDGES, PARENT_OF, TABLES, TEXT_BYTES, Table
from ..session import Stage, no_stage

Tables = Mapping[str, DataFrame]


def listing(tables: Tables, name: str, value: int | None = None) -> DataFrame:
    """All rows in the table's order, or those of one member or category."""
    spec = TABLES[name]
    if value is not None and spec.filter_by is None:
        raise ValueError(f"{name} has no list filter")
    equals = {spec.filter_by: value} if spec.filter_by else {}
    shown = public_view(tables[name], spec.read)
    return list_rows(shown, spec.key, spec.newest_first, **equals)


def find(tables: Tables, name: str, requests: DataFrame, on: str = "target_id") -> DataFrame:
    """Rows by key: 200 with the row, or 404."""
    spec = TABLES[name]
    if not spec.lookups:
        raise ValueError(f"{name} has no lookup by key")
    return lookup(requests, public_view(tables[name], spec.read), spec.key, on)


def find_account(tables: Tables, requests: DataFrame, on: str = "email") -> DataFrame:
    """Stored password and id for a login's e-mail address, or 401."""
    accounts = tables["member"].select("member_id", "email", "password")
    return lookup_ci(requests, accounts, "email", on)


def create_rules(spec: Table) -> list[Rule]:
    rules = [required(c) for c in spec.create if c in spec.required]
    rules += [between(*r) for r in spec.ranges]
    rules += [max_length(c, spec.lengths[c]) for c in spec.create if c in spec.lengths]
    return rules + [max_bytes(c, TEXT_BYTES) for c in spec.create if c in spec.texts]


def _references(spec: Table, tables: Tables) -> list[Reference]:
    return [Reference(c, tables[PARENT_OF[c]], c) for c in spec.references]


def create(
    tables: Tables, name: str, requests: DataFrame, now: datetime | str | Column,
    seq: str = "seq", stage: Stage = no_stage,
) -> Changes:
    """Insert requests (seq and the table's create columns; absent ones count as null)."""
    spec = TABLES[name]
    wanted = [
        F.col(c) if c in requests.columns else F.lit(None).cast(spec.schema[c].dataType).alias(c)
        for c in spec.create
    ]
    return insert_rows(
        tables[name], requests.select(seq, *wanted), key=spec.key, rules=create_rules(spec),
        fks=_references(spec, tables), unique=spec.unique, now=now, stamps=spec.stamps,
        seq=seq, stage=stage,
    )


def patch(
    tables: Tables, name: str, requests: DataFrame, now: datetime | str | Column | None = None,
    seq: str = "seq", stage: Stage = no_stage,
) -> Changes:
    """Apply patch requests (seq, target_id, body; for members also sub)."""
    spec = TABLES[name]
    if not spec.patch:
        raise ValueError(f"{name} cannot be patched")
    unique = spec.unique
    if unique and spec.conflict_on_patch:
        unique = replace(unique, detail=spec.conflict_on_patch)
    return patch_rows(
        tables[name], requests, key=spec.key, columns=spec.patch, touch=spec.touch, now=now,
        required=spec.required, lengths=spec.lengths,
        text_bytes={c: TEXT_BYTES for c in spec.patch if c in spec.texts},
        rules=[between(NEW + c, low, high) for c, low, high in spec.ranges],
        fks=[r for r in _references(spec, tables) if r.column in spec.patch],
        unique=unique, members=tables[name] if spec.owned else None,
        null_code=spec.null_code, missing=spec.missing, seq=seq, stage=stage,
    )


def delete(tables: Tables, name: str, requests: DataFrame, seq: str = "seq") -> Changes:
    """Delete by key (seq, target_id)."""
    spec = TABLES[name]
    if not spec.deletes:
        raise ValueError(f"{name} rows are not deleted by request")
    return delete_rows(tables[name], requests, spec.key, seq=seq, missing=spec.missing)


def put(
    tables: Tables, name: str, src: DataFrame, update_cols: list[str], seq: str = "seq",
    stage: Stage = no_stage,
) -> Changes:
    """Upsert on the table's unique key."""
    spec = TABLES[name]
    return upsert(
        tables[name], src, spec.unique.columns, update_cols, key=spec.key,
        text=spec.unique.text, required=[c for c in spec.create if c in spec.required], seq=seq, stage=stage,
    )


def remove_with_children(tables: Tables, name: str, keys: DataFrame) -> dict[str, DataFrame]:
    """Delete rows and what refers to them; categories are restricted, see `remove_category`."""
    return cascade_delete(tables, name, keys, EDGES, TABLES[name].key)


def remove_category(tables: Tables, requests: DataFrame, seq: str = "seq") -> Changes:
    """Delete categories that have no items."""
    return restrict_delete(
        tables["restriction_category"], tables["restriction_items"], requests,
        "category_id", "category_id", seq=seq,
    )


def renumber_keys(tables: Tables, name: str, mapping: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """Change keys of a parent table and all references to them."""
    return renumber(tables, name, TABLES[name].key, mapping, EDGES)
