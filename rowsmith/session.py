"""Session settings the jobs rely on, and the shared folder for cutting lineage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

# A lookup join on a key that holds a large share of the rows is split at run time.
# `force` lets Spark split it even where that costs one more exchange, which is the
# case when the next step groups by the same key.
SKEW_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}

# Keys compress well, so that partitions joined up to the default 64 MB hold some ten million of
# them, and a fixed number of partitions grows with the input. From many small ones Spark makes as few
# as fit these sizes, so a task's rows are bounded.
SIZE_SETTINGS = {
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "160",
}

# Of a key that a JSON body repeats, the last value counts.
JSON_SETTINGS = {"spark.sql.variant.allowDuplicateKeys": "true"}

Stage = Callable[[DataFrame], DataFrame]


def tune(spark: SparkSession) -> SparkSession:
    """Apply the settings for skewed keys, partition sizes and JSON bodies to a session that already exists."""
    for name, value in {**SKEW_SETTINGS, **SIZE_SETTINGS, **JSON_SETTINGS}.items():
        spark.conf.set(name, value)
    return spark


def no_stage(df: DataFrame) -> DataFrame:
    """Keep the plan lazy: small batches are cheaper to compute twice than to write."""
    return df


def checkpoint_stage(spark: SparkSession) -> Stage:
    """A stage that writes an intermediate result to the cluster's shared folder.

    The folder comes from `spark.checkpoint.dir`; a session without one must set it
    before calling (there is no machine-local default on purpose).
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if spark.sparkContext.getCheckpointDir() is None:
        if not folder:
            raise ValueError("set spark.checkpoint.dir to a shared folder first")
        spark.sparkContext.setCheckpointDir(folder)
    return lambda df: df.checkpoint(eager=True)


def round_stage(spark: SparkSession) -> Stage:
    """A stage for the rounds of an iterative job, whose plans must not grow from round to round.

    The shared folder if the session has one. Without one (as in tests) the rows are kept by
    Spark, which computes lost ones anew.
    """
    if spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return checkpoint_stage(spark)
    return lambda df: df.persist()
