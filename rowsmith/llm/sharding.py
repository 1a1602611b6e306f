"""Contiguous shards of near equal bytes from global prefix sums.

Documents stand in the order of doc_id (nulls last; equal ids by checksum, then size; ids that are
no integers go by hash). Each
document lies at an offset: the bytes of all before it. The offsets come from the totals of
order buckets: a running sum over the few buckets, plus a running sum inside each. Shard i
takes the documents whose middle lies in the i-th equal part of all bytes, so shards are
contiguous and differ from the target by at most one document.

Equal texts are the groups of the contract: law `bytes` binds sizes only, so they may lie in
different shards.

Nulls: a null text has size 1, a null id is last. Repeated rows are rows of their own. A
document larger than a target leaves shards empty. An empty table gives an empty result.
Other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import bounds, bucket, free_name, order_key, table, text_or_empty

SHARDS = 16


def byte_size(text: str = "text") -> Column:
    """UTF-8 bytes of the text and one for its end; null has no bytes."""
    return (F.octet_length(text_or_empty(text)) + 1).cast("bigint")


def checksum(text: str = "text") -> Column:
    return F.crc32(text_or_empty(text).cast("binary")).cast("bigint")


def shard(
    df: DataFrame, size: Column, tie: Column, shards: int = SHARDS, key: str = "doc_id"
) -> DataFrame:
    """All columns of df, and size, shard and slot (gapless from 0).

    size is at least 1 for every row; tie, a 32-bit checksum, orders rows of the same key. A new column whose name
    df has already gets underscores before it.
    """
    rows = df.select(
        F.struct(*[df[c] for c in df.columns]).alias("row"),
        order_key(df, key).alias("_key"), size.alias("_size"), tie.alias("_tie"),
        bucket(order_key(df, key), bounds(df, key), tie).alias("_bucket"),
    )
    totals = rows.groupBy("_bucket").agg(F.sum("_size").alias("_bytes"), F.count("*").alias("_rows"))
    # One row per order bucket.
    ahead = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    shifts = totals.select(
        F.col("_bucket").alias("_of"),
        F.coalesce(F.sum("_bytes").over(ahead), F.lit(0)).alias("_bytes_before"),
        F.coalesce(F.sum("_rows").over(ahead), F.lit(0)).alias("_rows_before"),
        F.sum("_bytes").over(whole).alias("_all"),
    )
    order = Window.partitionBy("_bucket").orderBy(F.col("_key").asc_nulls_last(), "_tie", "_size")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    inside = rows.select(
        "*", F.sum("_size").over(upto).alias("_upto"), F.row_number().over(order).alias("_rank")
    )
    placed = inside.join(F.broadcast(shifts), F.col("_bucket") == F.col("_of")).select(
        "row", "_size",
        F.expr(
            f"int(least({shards - 1}, ((2 * (_bytes_before + _upto) - _size) * {shards}) div (2 * _all)))"
        ).alias("_shard"),
        (F.col("_rows_before") + F.col("_rank") - 1).alias("_at"),
    )
    # One row per shard.
    firsts = placed.groupBy(F.col("_shard").alias("_of")).agg(F.min("_at").alias("_first"))
    return placed.join(F.broadcast(firsts), F.col("_shard") == F.col("_of")).select(
        *[F.col(f"row.`{c}`").alias(c) for c in df.columns],
        F.col("_size").alias(free_name(df, "size")), F.col("_shard").alias(free_name(df, "shard")),
        (F.col("_at") - F.col("_first")).cast("bigint").alias(free_name(df, "slot")),
    )


def op5_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """Size, checksum, shard and slot of every document.

    The text is not carried through the shuffle: its size and checksum stand for it.
    """
    docs = table(spark, folder, "documents")
    docs = docs.select("doc_id", byte_size().alias("bytes"), checksum().alias("text_crc32"))
    return shard(docs, F.col("bytes"), F.col("text_crc32")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
