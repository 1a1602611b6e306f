"""A training-data pipeline over `documents`: each stage works on what the one before kept.

Stages take (spark, docs, sf_dir) and return documents with all their columns, also columns
beyond the usual five; the last adds size, shard and slot. Null and empty texts have no letter
and go with the first stage. Empty tables stay empty. Rows of a null doc_id are documents too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rowsmith.llm import lang_id, spelling
from rowsmith.llm.common import crc_fold, cut, table
from rowsmith.llm.decontamination import contaminated
from rowsmith.llm.jaccard_join import deduplicate
from rowsmith.llm.mixing import mix, word_count
from rowsmith.llm.sharding import byte_size, checksum, shard

#: Documents with a smaller share of familiar words are noise, or of a language that was not learned.
#: Of the given documents none is below 0.5; Russian, Japanese and typed noise are below 0.1.
LEAST_FAMILIAR = 0.3


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the learned languages. Those without a letter go, and those that are spelled like none."""
    learned = docs.where(crc_fold("doc_id", lang_id.FOLDS) != lang_id.HELD_OUT).select("doc_id", "text", "lang")
    label = lang_id.labeller(spark, lang_id.fit_all(learned))
    familiar = spelling.scorer(spark, spelling.fit(learned))
    rows = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"), label(F.col("text")).alias("found"),
        familiar(F.col("text")).alias("familiar"),
    )
    known = rows.where((F.col("found.lang") != "und") & (F.col("familiar") >= LEAST_FAMILIAR))
    return known.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest doc_id."""
    return deduplicate(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, whole or edited."""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.xxhash64("doc_id", "text").alias("key"))
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("doc_id"), "text")
    gone = contaminated(keyed, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("key")).distinct()
    return rows.join(gone, "key", "left_anti").select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix; one that is taken twice comes twice."""
    return mix(docs, word_count(), checksum())


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its size, shard and slot."""
    return shard(docs, byte_size(), checksum())


STAGES = [
    ("language_id", language_stage),
    ("near_duplicates", duplicates_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: The language model and the alignment are not SQL; the tests hold the rows against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage keeps is written before the next reads it several times."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
