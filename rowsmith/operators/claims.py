"""Claims on a unique column, granted exactly as one at a time.

A row leaves its value when it is granted another one, and from then on the value is free for
the next claim. So verdicts depend on earlier verdicts, over chains of releases and claims.

Most values need no chain: if nobody who may hold a value is granted another one later, its holder,
or else its first claimer, keeps it to the end. These are decided by partial aggregates, however many
requests claim them. Only values that somebody may leave go through rounds: each round takes the
verdicts of the last one as given, tells for every claim when its row would leave, and passes
through each value's claims in order. A verdict depends on earlier requests only, so after n rounds all
verdicts with chains of n steps are right, and the first round that changes nothing ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.collation import match_columns, plain
from ..session import Stage, round_stage
from .skew import join_facts


def _named(claims: DataFrame, table: DataFrame, column: str, key: str, text: list[str]) -> tuple[DataFrame, DataFrame]:
    """Spellings with a plain name of their class, and the holders of these classes.

    The collation is applied to distinct spellings only.
    """
    spellings = claims.select(F.col("_text").alias(column)).distinct()
    classed = spellings.select(F.col(column).alias("_text"), *match_columns(spellings, [column], text, "_c"))
    classes = classed.groupBy("_c0").agg(F.min(plain("_text")).alias("_v"))
    held = table.select(*match_columns(table, [column], text, "_c"), F.col(key).alias("_row"))
    return classed.join(classes, "_c0").select("_text", "_v"), held.join(classes, "_c0").select("_v", "_row")


def _decided(by_row: DataFrame, holders: DataFrame) -> DataFrame:
    """(_v, _first, _open): who has the value first, and whether somebody may leave it to another row."""
    last = Window.partitionBy("_row").orderBy(F.desc("_last"))
    leading = by_row.withColumn("_place", F.row_number().over(last)).where("_place <= 2")
    # The last two values that a row claims: the last one other than a given value is one of them.
    latest = leading.groupBy("_row").agg(
        F.max_by("_v", "_last").alias("_v1"), F.max("_last").alias("_last1"), F.min("_last").alias("_last2"),
        F.count("*").alias("_values"),
    )
    marks = by_row.select("_v", "_row", "_at", F.lit(None).cast("boolean").alias("_holds"))
    marks = marks.unionByName(holders.select("_v", "_row", F.lit(None).cast("bigint").alias("_at"), F.lit(True).alias("_holds")))
    parties = marks.groupBy("_v", "_row").agg(F.min("_at").alias("_at"), F.max("_holds").alias("_holds"))
    other = F.when(F.col("_v1") != F.col("_v"), F.col("_last1")).when(F.col("_values") > 1, F.col("_last2"))
    leaves = other.isNotNull() & (F.col("_holds") | (other > F.col("_at")))
    parties = join_facts(parties, latest.withColumnRenamed("_row", "_of"), ["_row"], ["_of"], "left")
    return parties.groupBy("_v").agg(
        F.coalesce(F.max(F.when(F.col("_holds"), F.col("_row"))), F.min_by("_row", "_at")).alias("_first"),
        ((F.count("*") > 1) & F.max(F.coalesce(leaves, F.lit(False)))).alias("_open"),
    )


def _pass(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Claims ordered by value and arrival, the holder's start first: who holds the value when.

    State is one holder, so a value of any number of claims is passed in batches.
    """
    value = holder = leaves = None
    for frame in frames:
        granted = []
        columns = zip(frame["_v"], frame["_row"], frame["_seq"], frame["_leave"], frame["_start"])
        for v, row, seq, leave, start in columns:
            if v != value:
                value, holder, leaves = v, None, None
            free = holder is None or row == holder or (leaves is not None and leaves < seq)
            if start or free:
                holder, leaves = row, None if pd.isna(leave) else leave
            granted.append(bool(start or free))
        frame["_new"] = granted
        yield frame[["_seq", "_row", "_v", "_start", "_granted", "_new"]]


def settle_claims(
    claims: DataFrame, table: DataFrame, column: str, key: str, row: str = "target_id",
    seq: str = "seq", text: bool = True, stage: Stage | None = None,
) -> DataFrame:
    """Arrival numbers of the claims that are granted, as if processed one at a time by `seq`.

    `claims` holds (seq, row, column) of distinct integers `seq`. A claim is granted if no other row
    holds the value then; the row leaves the value it had. Null claims nothing and is not granted
    here. The claims are computed once and cut by `stage` (`round_stage` if none is given). Rounds are run at
    once, and each is cut as well; without values that somebody may leave there is none.
    """
    cut = stage or round_stage(claims.sparkSession)
    text_columns = [column] if text else []
    asked = claims.where(F.col(column).isNotNull()).select(
        F.col(seq).cast("bigint").alias("_seq"), F.col(row).cast(table.schema[key].dataType).alias("_row"), F.col(column).alias("_text")
    )
    # What follows reads the claims several times, and what they are made of may be costly.
    asked = cut(asked)
    spelled = asked.groupBy("_text", "_row").agg(F.min("_seq").alias("_at"), F.max("_seq").alias("_last"))
    names, holders = _named(asked, table, column, key, text_columns)
    by_row = join_facts(spelled, names.withColumnRenamed("_text", "_spelling"), ["_text"], ["_spelling"])
    by_row = by_row.groupBy("_v", "_row").agg(F.min("_at").alias("_at"), F.max("_last").alias("_last"))
    facts = names.join(_decided(by_row, holders), "_v").select(F.col("_text").alias("_spelling"), "_v", "_first", "_open")
    judged = join_facts(asked, facts, ["_text"], ["_spelling"]).select(
        "_seq", "_row", "_v", "_open", (~F.col("_open") & (F.col("_row") == F.col("_first"))).alias("_granted")
    )
    judged = cut(judged)
    firm = judged.where("NOT _open AND _granted")
    opened = judged.where("_open")
    if opened.isEmpty():
        return firm.select(F.col("_seq").alias(seq))
    starts = holders.join(opened.select("_v").distinct(), "_v", "left_semi").select(
        F.lit(None).cast("bigint").alias("_seq"), "_row", "_v", F.lit(True).alias("_start"), F.lit(True).alias("_granted")
    )
    moving = opened.select("_row").union(starts.select("_row")).distinct()
    fixed = join_facts(firm, moving.withColumnRenamed("_row", "_of"), ["_row"], ["_of"]).select(
        "_seq", "_row", "_v", F.lit(False).alias("_start"), "_granted"
    )
    fixed, starts = cut(fixed), cut(starts)
    state = opened.select("_seq", "_row", "_v", F.lit(False).alias("_start"), "_granted")
    later = Window.partitionBy("_row").orderBy(F.col("_seq").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    kinds = f"_seq bigint, _row {table.schema[key].dataType.simpleString()}, _v string, _start boolean, _granted boolean, _new boolean"
    while True:
        events = state.select("*", F.lit(True).alias("_asks")).unionByName(starts.withColumn("_asks", F.lit(True)))
        events = events.unionByName(fixed.withColumn("_asks", F.lit(False)))
        timed = events.withColumn("_leave", F.min(F.when(F.col("_granted"), F.col("_seq"))).over(later)).where("_asks").drop("_asks")
        passed = timed.repartition("_v").sortWithinPartitions("_v", F.col("_seq").asc_nulls_first()).mapInPandas(_pass, kinds)
        passed = cut(passed.where("NOT _start"))
        state = passed.select("_seq", "_row", "_v", "_start", F.col("_new").alias("_granted"))
        if passed.where("_new <> _granted").isEmpty():
            return firm.select("_seq").union(state.where("_granted").select("_seq")).withColumnRenamed("_seq", seq)
