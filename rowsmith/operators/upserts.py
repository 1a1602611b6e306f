"""Upsert on a unique key, label lookup, and renumbering of keys."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, functions as F

from ..functions.collation import match_columns, match_names, match_spellings
from .checks import CONFLICT, NOT_FOUND, OK
from .deletes import Edge
from .ids import assign_ids, next_id
from .inserts import Changes
from ..session import Stage, no_stage
from .skew import join_facts


def resolve_label(
    df: DataFrame, parent: DataFrame, label: str, parent_label: str, parent_key: str,
    into: str,
) -> DataFrame:
    """Id of the parent with this label, without regard to case and accents; null if none."""
    hits = match_spellings(df, label, parent, parent_label, [F.col(parent_key).alias(into)])
    both = join_facts(df, hits, [label], ["_spelling"], "left")
    return both.select(*[df[c] for c in df.columns], into)


def upsert(
    table: DataFrame, src: DataFrame, unique: Iterable[str], update_cols: Iterable[str], *,
    key: str, text: Iterable[str] = (), required: Iterable[str] = (), seq: str = "seq",
    stage: Stage = no_stage,
) -> Changes:
    """Insert new keys and update the listed columns of known ones.

    A known row keeps its id and the spelling of its key. Inside the batch a new key takes
    its spelling and its other columns from its first request and the update columns from
    its last. Requests with null in a required column are refused with 409. Doing the
    same upsert again changes nothing.

    The table meets the folded requests once, in a full outer join; `stage` may write its
    result, from which the new table, the next id and the outcomes are all taken. Then the table
    is read once. It may also write the new ranks.
    """
    unique, update_cols = list(unique), list(update_cols)
    on = match_names(unique)
    given = [c for c in table.columns if c in src.columns and c != key]
    hole = F.coalesce(
        *[F.when(F.col(c).isNull(), F.lit(c)) for c in required], F.lit(None).cast("string")
    )
    checked = src.select(F.col(seq), *given, hole.alias("_hole"))
    # Equal spellings are folded first; the fold under a collation then has few rows to sort.
    spelled = (
        checked.where(F.col("_hole").isNull())
        .groupBy(*unique)
        .agg(
            F.min_by(F.struct(*given), seq).alias("_first"),
            F.max_by(F.struct(*update_cols), seq).alias("_last"),
            F.min(seq).alias("_seq"),
            F.max(seq).alias("_until"),
        )
    )
    fold = (
        spelled.select("_first", "_last", "_seq", "_until", *match_columns(spelled, unique, text))
        .groupBy(*on)
        .agg(
            F.min_by("_first", "_seq").alias("_first"),
            F.max_by("_last", "_until").alias("_last"),
            F.min("_seq").alias("_seq"),
        )
    )
    known = match_columns(table, unique, text)
    # A key with a null part equals nothing, on either side.
    joined = stage(table.select(F.lit(True).alias("_have"), F.struct(*table.columns).alias("_row"), *known).join(fold, on, "full_outer"))
    kept = joined.where("_have").select(
        *[
            (
                F.when(F.col("_last").isNotNull(), F.col("_last")[c]).otherwise(F.col("_row")[c])
                if c in update_cols
                else F.col("_row")[c]
            ).cast(table.schema[c].dataType).alias(c)
            for c in table.columns
        ]
    )
    fresh = joined.where("_have IS NULL").select(*on, "_first", "_last", "_seq")
    top = joined.where("_have").select(F.col("_row")[key].alias(key))
    fresh = assign_ids(fresh, next_id(top, key), "_seq", "_id", stage=stage)

    def value(c: str):
        if c == key:
            return F.col("_id")
        if c in update_cols:
            return F.col("_last")[c]
        return F.col("_first")[c] if c in given else F.lit(None)

    added = fresh.select(
        *[value(f.name).cast(f.dataType).alias(f.name) for f in table.schema.fields]
    )
    ids = joined.where("_have AND _seq IS NOT NULL").select(
        *on, F.col("_row")[key].alias("id"), F.lit(None).cast("bigint").alias("_born")
    )
    ids = ids.unionByName(
        fresh.select(
            *on, F.col("_id").cast(table.schema[key].dataType).alias("id"),
            F.col("_seq").cast("bigint").alias("_born"),
        )
    )
    by_spelling = spelled.select(*unique, *match_columns(spelled, unique, text))
    names = match_names(unique, "_u")
    by_spelling = by_spelling.join(ids, on).select(
        *[F.col(c).alias(n) for c, n in zip(unique, names)], "id", "_born"
    )
    refused = F.col("_hole").isNotNull()
    outcomes = join_facts(checked, by_spelling, unique, names, "left").select(
        F.col(seq),
        F.when(refused, CONFLICT).otherwise(OK).alias("code"),
        F.when(refused, F.concat("_hole", F.lit(" must not be null")))
        .when(F.col("_born") == F.col(seq), "inserted")
        .otherwise("updated")
        .alias("detail"),
        F.when(~refused, F.col("id")).alias("id"),
    )
    return Changes(kept.unionByName(added), outcomes)


def renumber(
    tables: Mapping[str, DataFrame], root: str, key: str, mapping: DataFrame,
    edges: Iterable[Edge],
) -> tuple[dict[str, DataFrame], DataFrame]:
    """Give rows of `root` new keys and carry every reference along.

    `mapping` has (old, new). Refused are unknown old keys (404) and mappings that
    collide (409): an old or new key that occurs twice, or a new key that a row holds
    before the change, even if that row moves too. Returns all tables and (old, new, code).
    """
    kind = tables[root].schema[key].dataType
    keys = tables[root].select(F.col(key).alias("old"))
    olds = mapping.groupBy("old").agg(F.count(F.lit(1)).alias("_olds"))
    news = mapping.groupBy("new").agg(F.count(F.lit(1)).alias("_news"))
    held = keys.withColumnRenamed("old", "new").join(mapping.select("new"), "new", "left_semi")
    present = keys.join(mapping.select("old"), "old", "left_semi")
    judged = (
        mapping.join(olds, "old", "left")
        .join(news, "new", "left")
        .join(held.withColumn("_held", F.lit(True)), "new", "left")
        .join(present.withColumn("_present", F.lit(True)), "old", "left")
    )
    free = F.col("_held").isNull() | (F.col("old") == F.col("new"))
    code = (
        F.when(F.col("_present").isNull(), NOT_FOUND)
        .when((F.col("_olds") > 1) | (F.col("_news") > 1) | ~free, CONFLICT)
        .otherwise(OK)
    )
    outcomes = judged.select("old", "new", code.alias("code"))
    moves = outcomes.where(F.col("code") == OK).select(
        F.col("old").alias("_old"), F.col("new").cast(kind).alias("_new")
    )

    def moved(table: DataFrame, column: str) -> DataFrame:
        both = join_facts(table, moves, [column], ["_old"], "left")
        new = F.coalesce(F.col("_new"), table[column]).cast(table.schema[column].dataType)
        return both.select(*[new.alias(c) if c == column else table[c] for c in table.columns])

    out = dict(tables)
    out[root] = moved(tables[root], key)
    for edge in edges:
        if edge.parent == root and edge.pk == key:
            out[edge.child] = moved(out[edge.child], edge.fk)
    return out, outcomes
