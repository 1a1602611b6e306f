"""Unique-key checks inside a batch and against the table.

A key may hold any share of the requests: the batch is reduced to one row per key by a
partial aggregation before the shuffle, and verdicts come back through the distinct
arrival numbers rather than through the key.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.collation import match_columns, match_names
from .skew import join_facts


def absent_from(
    firsts: DataFrame, table_keys: DataFrame, on: list[str], seq: str = "seq"
) -> DataFrame:
    """Rows of `firsts` (one per key, distinct `seq`) whose key is not in the table.

    The table is matched first and the hits are taken away by `seq`. The batch is normally
    far smaller than the table, and this way round it is the side that can be broadcast;
    both uses of `firsts` need the same columns, so it is computed once.
    """
    held = table_keys.join(firsts.select(*on, seq), on).select(seq)
    return firsts.join(held, seq, "left_anti")


def new_keys(
    requests: DataFrame, table: DataFrame, key: Iterable[str], seq: str = "seq",
    text: Iterable[str] = (),
) -> DataFrame:
    """Arrival numbers whose key is new: absent from the table and first in the batch.

    Pass only requests that got through the earlier checks, since a request that fails
    for another reason must not shadow a later one. A key with a null part is never a
    duplicate. Columns named in `text` compare without case and accents.
    """
    key, text = list(key), list(text)
    on = match_names(key)
    groups = []
    optional = [c for c in key if requests.schema[c].nullable]
    asked = requests.select(*key, F.col(seq))
    if optional:
        hole = F.lit(False)
        for c in optional:
            hole = hole | F.col(c).isNull()
        # Each key with a null part is a group of its own.
        asked = asked.withColumn("_own", F.when(hole, F.col(seq)))
        groups.append("_own")
    if text:
        # Equal spellings are reduced by hash first; comparing under a collation needs a
        # sort, which then only sees the distinct ones.
        asked = asked.groupBy(*key, *groups).agg(F.min(seq).alias(seq))
    asked = asked.select(*match_columns(asked, key, text), *groups, F.col(seq))
    firsts = asked.groupBy(*on, *groups).agg(F.min(seq).alias(seq))
    return absent_from(firsts, table.select(*match_columns(table, key, text)), on, seq).select(seq)


def free_claims(
    claims: DataFrame, table: DataFrame, column: str, key: str, row: str = "target_id",
    seq: str = "seq", text: bool = True,
) -> DataFrame:
    """Arrival numbers of claims on a unique column that are granted.

    `claims` holds (seq, row, column). The row that holds a value before the batch comes first
    of all, then the claims by `seq`. Claims by the first row are granted until another row
    claims the value, and after that as well if the first row claims no other value in the
    batch, since it then holds the value all the time. Two deviations from one-at-a-time
    processing: a value given up in this batch becomes free only in the next one, and an
    earlier claim that failed still blocks a row that claims several values.
    """
    text_columns = [column] if text else []
    # Equal spellings are reduced by hash first, as in `new_keys`.
    spelled = (
        claims.where(F.col(column).isNotNull())
        .groupBy(column, F.col(row).alias("_row"))
        .agg(F.min(seq).alias("_at"))
    )
    classed = spelled.select("*", match_columns(spelled, [column], text_columns, "_v")[0])
    by_row = classed.groupBy("_v0", "_row").agg(F.min("_at").alias("_at"))
    held = match_columns(table, [column], text_columns, "_v")[0]
    held = table.select(held, F.col(key).alias("_row"))
    # Holders are the earliest claimers; only those of values that are asked for count.
    holders = held.join(by_row.select("_v0"), "_v0", "left_semi").withColumn("_at", F.lit(None))
    order = Window.partitionBy("_v0").orderBy(F.col("_at").asc_nulls_first())
    # The first row and the first claim by any other decide a value. Keeping few rows per
    # value happens before the shuffle, too; a holder's own claim is the third at most.
    leaders = by_row.unionByName(holders).withColumn("_place", F.row_number().over(order))
    decided = leaders.where("_place <= 3").groupBy("_v0").agg(
        F.min_by("_row", "_place").alias("_first"),
        F.sort_array(F.collect_list(F.struct("_place", "_row", "_at"))).alias("_all"),
    )
    others = F.filter("_all", lambda x: x["_row"] != F.col("_first"))
    decided = decided.select("_v0", F.col("_first").alias("_row"), F.get(others, 0)["_at"].alias("_rival"))
    counts = by_row.groupBy("_row").agg((F.count(F.lit(1)) == 1).alias("_steady"))
    # The collation is applied to distinct spellings only; the claims follow by bytes.
    won = classed.join(decided, ["_v0", "_row"]).join(counts, "_row").select(
        F.col(column).alias("_text"), "_row", "_rival", "_steady"
    )
    return (
        join_facts(claims, won, [column, row], ["_text", "_row"])
        .where(F.col("_rival").isNull() | (F.col(seq) < F.col("_rival")) | F.col("_steady"))
        .select(seq)
    )
