"""Toxicity of whole texts: FTRL-proximal on hashed words, pairs and skip-grams.

Words are runs of letters, digits and bytes beyond ASCII, in lower case A-Z. Features are
the words, their first STEMS bytes (inflected forms share a stem), neighbours, and words with
one or two others between. Each distinct feature counts one whatever the length of the text:
one insult in a long text is an insult. The L1 term leaves few weights, which are broadcast.

Null and empty texts have no features: their score is that of the bias. Without labelled
rows every score is 0.5. Repeated rows get equal scores, rows of a null id are scored but not learned
from. Very long texts are scored whole. An empty table gives an empty result. Other columns are not
read, so they may have any name.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import crc_fold, table
from .linear import Settings, distinct, fit, grams, scorer
from .quality import _kinds
from .words import hashed, lowered, spans

SETTINGS = Settings(alpha=1.0, l1=6.0, l2=0.0, epochs=5, unit=False)
STEMS = (4, 5, 6, 7)
FOLDS, HELD_OUT = 5, 0


def features(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    data = lowered(data)
    starts, ends = spans((_kinds[data] == 1).view(np.uint8), offsets)
    of = np.searchsorted(offsets, starts, "right") - 1
    words = hashed(data, starts, ends)
    found = [grams(words, of, steps, kind) for kind, steps in enumerate(((), (1,), (2,), (3,)))]
    for size in STEMS:
        longer = ends - starts > size
        first = starts[longer]
        found.append(grams(hashed(data, first, first + size), of[longer], (), 10 + size))
    return distinct([a for a, _ in found], [b for _, b in found], bits)


def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Score and label of every document; labels of the held-out fifth are never read."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    fold = crc_fold("doc_id", FOLDS) == HELD_OUT
    weights = fit(docs, table(spark, folder, "labels").where(~fold), "toxic", features, SETTINGS)
    score = scorer(docs, weights, features, SETTINGS)
    return docs.select("doc_id", fold.alias("held_out"), score(F.col("text")).alias("score")).select(
        "*", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )
