"""Change requests that arrive as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.inserts import Changes
from ..session import Stage
from ..sources.tables import (
    FOLD, fold_versions, read_growing, read_version, remove_folded, remove_versions, write_version,
)

Operation = Callable[[DataFrame, DataFrame, Stage], Changes]


def batch_stage(spark: SparkSession, folder: str, version: int) -> Stage:
    """A stage that writes what it is given below `folder`, in the order of the calls.

    A batch that is run again makes the same calls and rewrites the same folders; the folders of
    the version before go with `remove_versions`.
    """
    calls = 0

    def stage(df: DataFrame) -> DataFrame:
        nonlocal calls
        calls += 1
        target = f"{folder.rstrip('/')}/version={version}/call-{calls}"
        df.write.mode("overwrite").parquet(target)
        return spark.read.schema(df.schema).parquet(target)

    return stage


def _stages(spark: SparkSession, outcomes: str, version: int) -> Stage:
    folder = f"{outcomes.rstrip('/')}.stage"
    fs = spark._jvm.org.apache.hadoop.fs
    old = fs.Path(f"{folder}/version={version - 1}")
    old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
    return batch_stage(spark, folder, version)


def apply_stream(
    stream: DataFrame, op: Operation, table: str, outcomes: str, checkpoint: str,
    first_version: int = 0, keep: int | None = None, **trigger,
) -> StreamingQuery:
    """Apply each micro-batch of requests to the current version of a table.

    `op(table, requests, stage)` is one kind of change: an insert, a patch or a delete. What it
    gives to `stage` (the judged requests) is written once per batch beside the outcomes, and read
    by outcomes and table. Batch n reads version first_version + n below `table` and writes the
    next one, so a batch that is run again after a failure reads and rewrites the same versions;
    outcomes go to the folder of the same number. Every version is a whole table, which suits
    patches and deletes; see `apply_inserts` for inserts. With `keep`, so many versions before the
    new one stay (at least one, which a replay reads); older ones are removed. There must be one
    writer per table. The order between kinds of change is not kept, as each has its own stream.
    """
    if keep is not None and keep < 1:
        raise ValueError("a replay reads the version before")

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark, version = batch.sparkSession, first_version + batch_id
        current = read_version(spark, table, version)
        batch = batch.persist()
        try:
            changes = op(current, batch, _stages(spark, outcomes, version + 1))
            write_version(changes.outcomes, outcomes, version + 1)
            write_version(changes.table, table, version + 1)
        finally:
            batch.unpersist()
        if keep is not None:
            remove_versions(spark, table, version + 1 - keep)

    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def apply_inserts(
    stream: DataFrame, op: Operation, table: str, outcomes: str, checkpoint: str,
    first_version: int = 0, keep: int | None = None, fold: int = FOLD, **trigger,
) -> StreamingQuery:
    """Apply each micro-batch of insert requests, writing only the rows that it adds.

    Batch n reads the versions up to first_version + n (`read_growing`) and writes its new rows
    as the next one, so a batch that is run again rewrites its own folder only. Every `fold`
    versions are folded into one run, and so many runs into a longer one, so that a batch reads a
    number of folders that grows with the logarithm of the number of batches. With `keep`, folders
    that only older versions than the last `keep` are read from are removed.
    """
    if keep is not None and keep < 1:
        raise ValueError("a replay reads the version before")

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark, version = batch.sparkSession, first_version + batch_id
        batch = batch.persist()
        try:
            current = read_growing(spark, table, version, fold=fold)
            changes = op(current, batch, _stages(spark, outcomes, version + 1))
            write_version(changes.outcomes, outcomes, version + 1)
            write_version(changes.added, table, version + 1)
        finally:
            batch.unpersist()
        fold_versions(spark, table, version + 1, fold)
        if keep is not None:
            remove_folded(spark, table, version + 1, keep, fold)

    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
