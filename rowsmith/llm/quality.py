"""Quality of whole texts: logistic regression on hashed word n-grams, trained by FTRL.

Words are runs of letters and digits, and runs of other signs. Features are the words and
pairs of neighbours, and the same of their shapes, in runs of one to three: what kind of
signs a word has, its length class, whether it repeats the word before or an earlier one of
the same text. Each distinct feature counts once and the features of a text have length one, so
scores of short and long texts compare.

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
from .words import hashed, mixed, spans

SETTINGS = Settings(alpha=0.5, l1=0.05, l2=0.05, epochs=4)
FOLDS, HELD_OUT = 3, 1

_kinds = np.full(256, 3, np.uint8)  # other signs
_kinds[[9, 10, 11, 12, 13, 32]] = 0
for _first, _last in (("0", "9"), ("A", "Z"), ("a", "z")):
    _kinds[ord(_first) : ord(_last) + 1] = 1
_kinds[128:] = 1


def features(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    starts, ends = spans(_kinds[data], offsets)
    of = np.searchsorted(offsets, starts, "right") - 1
    words = hashed(data, starts, ends)
    sign = _kinds[data[starts]] == 3 if len(starts) else np.zeros(0, bool)

    def count(low: str, high: str) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum((data >= ord(low)) & (data <= ord(high)))])
        return total[ends] - total[starts]

    upper, digits, length = count("A", "Z"), count("0", "9"), ends - starts
    shape = np.where(sign, 10, np.where(digits > 0, 20, np.where(upper == 0, 30, np.where(upper > 1, 40, 50))))
    shape = shape + np.minimum(9, np.log2(np.maximum(1, length)).astype(np.int64))
    again = np.zeros(len(words), np.int64)
    if len(words) > 1:
        # A word that stood before in the same text, not counting the short ones.
        order = np.lexsort((np.arange(len(words)), words, of))
        same = (words[order][1:] == words[order][:-1]) & (of[order][1:] == of[order][:-1])
        again[order[1:][same]] = 1
        again[length < 4] = 0
        again[1:][(words[1:] == words[:-1]) & (of[1:] == of[:-1])] = 2
    shapes = mixed((shape + 100 * again).astype(np.uint64))
    found = [grams(words, of, (), 1), grams(words, of, (1,), 2)]
    found += [grams(shapes, of, steps, 3 + len(steps)) for steps in ((), (1,), (1, 2))]
    return distinct([a for a, _ in found], [b for _, b in found], bits)


def op2_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Score and label of every document; labels of the held-out third are never read."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    fold = crc_fold("doc_id", FOLDS) == HELD_OUT
    weights = fit(docs, table(spark, folder, "labels").where(~fold), "quality", features, SETTINGS)
    score = scorer(docs, weights, features, SETTINGS)
    return docs.select("doc_id", fold.alias("held_out"), score(F.col("text")).alias("score")).select(
        "*", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )
