"""Tables, the shared folder, order buckets and hashes used by several operators."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

#: Order buckets are searched in levels of STEP; rows of a bucket, about, beyond STEP ** 2 buckets.
STEP, ROWS = 32, 1 << 16
#: Ranges of the tie that a heavy key is parted into, as a power of two.
TIE_BITS = 10


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write an intermediate result to the cluster's shared folder and go on from there.

    The folder is the one in spark.checkpoint.dir. Only a local session without one (as in tests)
    gets a folder below its warehouse, which a cluster's executors could not see. Files of results
    that nothing refers to any more are removed by Spark if spark.cleaner.referenceTracking.cleanCheckpoints
    is set, which a session does when it starts.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder first")
        spark.sparkContext.setCheckpointDir(folder or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints")
    return df.checkpoint(eager=True)


class Cuts(NamedTuple):
    """Increasing values that part an order, and those of them that very many rows have."""

    values: tuple[int, ...]
    heavy: tuple[int, ...]


def order_key(df: DataFrame, name: str) -> Column:
    """The order of a key of any type as a long: integers are themselves, others go by hash; null stays null."""
    column = df[name]
    if isinstance(df.schema[name].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return column.cast("bigint")
    return F.when(column.isNotNull(), F.xxhash64(column))


def bounds(df: DataFrame, key: str) -> Cuts:
    """Approximate quantiles of the order key, one for about ROWS rows, STEP ** 2 to STEP ** 3 of them.

    Any values part the order correctly; even ones only share out the work. A key that is several
    quantiles at once gets a bucket of its own.
    """
    parts = STEP**2

    def quantiles() -> Column:
        return F.percentile_approx(order_key(df, key), [i / parts for i in range(1, parts)], 10 * parts)

    rows, found = df.select(F.count(F.lit(1)), quantiles()).first()
    if rows > parts * ROWS:
        parts = min(STEP**3, rows // ROWS)
        found = df.select(quantiles()).first()[0]
    found = found or []
    heavy = {v for v, after in zip(found, found[1:]) if v == after}
    values = set(found) | {v + 1 for v in heavy if v < (1 << 63) - 1}
    return Cuts(tuple(sorted(values)), tuple(sorted(heavy)))


def _listed(values: Sequence) -> str:
    if isinstance(values[0], (list, tuple)):
        return f"array({', '.join(map(_listed, values))})"
    return f"array({', '.join(f'{v}L' for v in values)})"


def bucket(key: Column, cuts: Cuts, tie: Column) -> Column:
    """A number that grows with the key, for null keys the largest; the rows of one are a task's work.

    Rows of a null or heavy key are parted by tie, 32 bits that are even over different texts. So a bucket
    holds about one in STEP ** 2 of all rows, or one in 2 ** TIE_BITS of those of its key; only rows equal in key and tie
    always stay together. The cuts are found in short searches, one per level.
    """
    values = cuts.values
    depth = 1
    while STEP**depth < len(values):
        depth += 1

    def below(found: Column) -> Column:
        return F.size(F.filter(found, lambda x: x <= key))

    def firsts(part: Sequence[int], level: int, to: int):
        """The first values of the groups of a level, nested as the levels above it."""
        size = STEP ** (depth - 1 - level)
        groups = [part[i : i + size] for i in range(0, len(part), size)]
        return [g[0] for g in groups] if level == to else [firsts(g, level + 1, to) for g in groups]

    place, chosen = F.lit(0), []
    for level in range(depth if values else 0):
        found = F.expr(_listed(firsts(values, 0, level)))
        for at in chosen:
            found = F.element_at(found, at)
        here = below(found)
        chosen.append(F.greatest(here, F.lit(1)))
        # Before the last level, the group that the key lies in; in it, the values not above the key.
        last = level == depth - 1
        place = place + (here if last else (chosen[-1] - 1) * STEP ** (depth - 1 - level))
    whole = F.when(key.isNull(), len(values) + 1).otherwise(place).cast("bigint")
    many = key.isNull() | key.isin(*cuts.heavy) if cuts.heavy else key.isNull()
    return whole * (1 << TIE_BITS) + F.when(many, F.shiftrightunsigned(tie.cast("bigint"), 32 - TIE_BITS)).otherwise(0)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def crc_fold(key: str, parts: int) -> Column:
    """crc32 of the key as text, modulo parts; a null key counts as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % parts


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the input does not have, whatever case it is written in."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
