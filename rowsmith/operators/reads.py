"""Lists, lookups and navigation."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

from pyspark.sql import DataFrame, functions as F

from ..functions.collation import match_spellings
from .checks import NOT_FOUND, OK, UNAUTHENTICATED
from .ids import assign_ids
from .skew import join_facts

# Children of one parent in one array. With rows of 64 KB, the most a text column holds, an array
# has 64 MB at most.
CHILD_RANGE = 1024


def public_view(df: DataFrame, read_columns: Iterable[str]) -> DataFrame:
    """Only the columns that leave the system, in their order."""
    return df.select(*read_columns)


def list_rows(df: DataFrame, order_by: str, desc: bool = False, **equals: Any) -> DataFrame:
    """Rows by key, filtered by equality; a filter of None means no filter."""
    for column, value in equals.items():
        if value is not None:
            df = df.where(F.col(column) == value)
    return df.orderBy(F.desc(order_by) if desc else F.asc(order_by))


def lookup(
    requests: DataFrame, table: DataFrame, key: str, on: str = "target_id",
    missing: int = NOT_FOUND,
) -> DataFrame:
    """Each request with the row it asks for, and 200 or `missing` in `code`.

    A column of the table whose name the requests have as well comes as `stored_<name>`.
    """
    asked = table.withColumns({"_key": F.col(key), "_found": F.lit(True)})
    both = requests.join(asked, requests[on] == asked["_key"], "left")
    return _looked_up(both, requests, asked, table.columns, missing)


def lookup_ci(
    requests: DataFrame, table: DataFrame, column: str, on: str | None = None,
    missing: int = UNAUTHENTICATED,
) -> DataFrame:
    """Lookup by text without regard to case and accents; columns as in `lookup`."""
    on = on or column
    carry = [*[F.col(c) for c in table.columns], F.lit(True).alias("_found")]
    hits = match_spellings(requests, on, table, column, carry)
    both = join_facts(requests, hits, [on], ["_spelling"], "left")
    return _looked_up(both, requests, hits, table.columns, missing)


def _looked_up(
    both: DataFrame, requests: DataFrame, found: DataFrame, columns: list[str], missing: int
) -> DataFrame:
    code = F.when(F.col("_found"), OK).otherwise(missing)
    taken = [
        found[c].alias(f"stored_{c}") if c in requests.columns else found[c] for c in columns
    ]
    return both.select(*[requests[c] for c in requests.columns], *taken, code.alias("code"))


def follow(df: DataFrame, *hops: tuple[str, DataFrame, str]) -> DataFrame:
    """Walk references to their parents: each hop is (reference, parent, parent key).

    Later hops may use columns that earlier parents brought in.
    """
    for fk, parent, pk in hops:
        if fk == pk:
            df = df.join(parent, fk)
        else:
            df = df.join(parent, F.col(fk) == F.col(pk))
    return df


def member_restriction_view(
    member: DataFrame, member_restrictions: DataFrame, restriction_items: DataFrame,
    restriction_category: DataFrame,
) -> DataFrame:
    """Member, restriction item and category in one flat row per assignment."""
    return follow(
        member_restrictions,
        ("member_id", member.select("member_id", "email", "nickname"), "member_id"),
        ("item_id", restriction_items, "item_id"),
        ("category_id", restriction_category, "category_id"),
    ).select(
        "member_restrictions_id", "member_id", "email", "nickname", "item_id",
        "item_label_ko", "item_label_en", "category_id", "category_label_ko",
        "category_label_en",
    )


def nest_children(
    parent: DataFrame, child: DataFrame, key: str, order: str, fk: str | None = None,
    into: str = "children", width: int = CHILD_RANGE, part: str = "part",
) -> DataFrame:
    """Parents with their children as arrays sorted by the integer child key `order`.

    A parent of n children has ceil(n / width) rows, numbered from 0 in `part`, each with the next
    `width` children, whatever their keys; one without children has one row and an empty array.
    Child keys are distinct. Ranks come from totals per range of keys, so neither an array nor a
    window over rows holds more than `width` children of a parent (`width` a power of two, or less
    than twice as many).
    """
    fk = fk or key
    fields = [order, *[c for c in child.columns if c not in (fk, order)]]
    held = child.where(child[fk].isNotNull()).select(
        child[fk].alias("_fk"), child[order].cast("bigint").alias("_order"),
        F.struct(*[child[c].alias(c) for c in fields]).alias("_child"),
    )
    ranked = assign_ids(held, 0, "_order", "_nth", max(width - 1, 1).bit_length(), ["_fk"])
    parts = ranked.select("_fk", F.expr(f"_nth div {width}").alias(part), "_child")
    nested = parts.groupBy("_fk", part).agg(F.array_sort(F.collect_list("_child")).alias(into))
    both = parent.join(nested, parent[key] == nested["_fk"], "left")
    empty = F.array().cast(nested.schema[into].dataType)
    return both.select(
        *[parent[c] for c in parent.columns],
        F.coalesce(part, F.lit(0).cast("bigint")).alias(part),
        F.coalesce(into, empty).alias(into),
    )
