"""Dense ids in arrival order without a window over the whole batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import Stage, no_stage

# A window group never holds more than 2**BUCKET_BITS rows: the arrival numbers are
# distinct integers, so that many at most share their leading bits.
BUCKET_BITS = 16


def next_id(table: DataFrame, key: str) -> Column:
    """Largest key plus one, as a scalar subquery; 1 for an empty table."""
    top = table.agg(F.max(key).cast("bigint").alias("top")).scalar()
    return F.coalesce(top, F.lit(0).cast("bigint")) + 1


def assign_ids(
    df: DataFrame, start: Column | int, seq: str = "seq", into: str = "id",
    bucket_bits: int = BUCKET_BITS, by: Sequence[str] = (), stage: Stage = no_stage,
) -> DataFrame:
    """Number the rows start, start+1, ... in the order of the distinct integers `seq`.

    Rows are ranked inside buckets of neighbouring numbers, and each bucket is shifted by
    the row count of those before it. The shift is a running sum inside groups of
    buckets plus a running sum over the groups, so with the default width the only
    ungrouped window sees one row per 2**32 arrival numbers, whatever the batch size.

    With `by`, rows of each value of these columns (null goes with nothing and is left out) are
    numbered for themselves, however many share a value.

    `stage` may write the ranked rows, which are read for the sizes and for the result.
    """
    start, by = F.lit(start) if isinstance(start, int) else start, list(by)
    bucket, group = F.col("_bucket"), F.col("_group")
    ranked = df.withColumn("_bucket", F.shiftright(F.col(seq).cast("bigint"), bucket_bits))
    ranked = ranked.withColumn(
        "_rank", F.row_number().over(Window.partitionBy(*by, bucket).orderBy(seq))
    )
    ranked = stage(ranked)
    # The bucket sizes come from the ranked rows, so both sides share one exchange.
    sizes = ranked.groupBy(*by, bucket).agg(F.max("_rank").cast("bigint").alias("_n"))
    sizes = sizes.withColumn("_group", F.shiftright(bucket, BUCKET_BITS))
    groups = sizes.groupBy(*by, group).agg(F.sum("_n").alias("_gn"))

    def before(total: str, window) -> Column:
        return F.sum(total).over(window) - F.col(total)

    all_groups = Window.partitionBy(*by).orderBy(group).rowsBetween(Window.unboundedPreceding, 0)
    in_group = Window.partitionBy(*by, group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, 0)
    groups = groups.select(*by, group, before("_gn", all_groups).alias("_gshift"))
    shifts = (
        sizes.withColumn("_shift", before("_n", in_group))
        .join(groups, [*by, "_group"])
        .select(*by, bucket, (F.col("_shift") + F.col("_gshift")).alias("_shift"))
    )
    return (
        ranked.join(shifts, [*by, "_bucket"])
        .withColumn(into, start + F.col("_shift") + F.col("_rank") - 1)
        .select(*[ranked[c] for c in df.columns], into)
    )
