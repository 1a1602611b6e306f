"""How much of a text is spelled like the labelled ones: noise and languages that were not learned are not.

A classifier must choose one of its languages, so its score says nothing about texts of none. Here
every byte's probability given the two before it is taken from counts over all labelled
documents (backed off to one byte before it). A word is familiar if its mean in bits is at most STRANGE
below theirs; a text's score is the share of its bytes in familiar words, so that a secret or
an address in a short text is only its own part. Letters count without case, digits and other ASCII
signs as one each. DRAWN more familiar bytes are counted, as little speaks against a very short text.

Null and empty texts score 1. Repeated rows get equal scores. Very long texts are read whole. Without
labelled rows every text scores 1. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .words import buffers, runs, spans, white

CLASSES = 128
#: What is added to counts: of a byte, and shares of the shorter context's probability.
FLOOR, BACKOFF = 0.1, 2.0
#: A word's mean may be so many bits a byte below that of the labelled documents.
STRANGE = 4.0
DRAWN = 4

_of = np.zeros(256, np.int64)
for _byte in range(256):
    _char = chr(_byte).lower()
    if "a" <= _char <= "z":
        _of[_byte] = 1 + ord(_char) - ord("a")
    elif _char in "0123456789":
        _of[_byte] = 27
    elif 33 <= _byte < 128:
        _of[_byte] = 28
    elif 128 <= _byte < 224:
        _of[_byte] = _byte - 128 + 29
    elif _byte >= 224:
        _of[_byte] = 125 + min((_byte - 224) // 16, 2)


def triples(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The class triple that ends at each byte; a text begins after white space."""
    classes = _of[data]
    before, earlier = np.zeros_like(classes), np.zeros_like(classes)
    before[1:], earlier[2:] = classes[:-1], classes[:-2]
    starts = offsets[:-1][np.diff(offsets) > 0]
    before[starts] = earlier[starts] = 0
    second = starts[starts + 1 < len(classes)] + 1
    earlier[second] = 0
    return (earlier * CLASSES + before) * CLASSES + classes


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often a task's texts have each triple."""
    counts = np.zeros(CLASSES**3, np.int64)
    for batch in batches:
        data, offsets = buffers(batch.column("text"))
        for first, last in runs(offsets):
            part = offsets[first : last + 1]
            counts += np.bincount(triples(data[part[0] : part[-1]], part - part[0]), minlength=len(counts))
    each = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(each), pa.array(counts[each])], names=["triple", "n"])


def bits(counts: np.ndarray) -> np.ndarray:
    """Log probabilities of all triples, less their mean."""
    three = counts.astype(float).reshape(CLASSES, CLASSES, CLASSES)
    two = three.sum(0)
    one = (two + FLOOR) / (two.sum(1, keepdims=True) + FLOOR * CLASSES)
    table = np.log2((three + BACKOFF * one) / (three.sum(2, keepdims=True) + BACKOFF))
    return (table - (three * table).sum() / max(1.0, three.sum())).astype(np.float32).ravel()


def fit(docs: DataFrame) -> np.ndarray | None:
    """Learn from all rows of (text, lang) whose lang and text are not null.

    The workers count; at most CLASSES ** 3 counts come to the driver.
    """
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("text")
    found = known.mapInArrow(counted, "triple bigint, n bigint").groupBy("triple").agg(F.sum("n").alias("n")).toArrow()
    if not len(found):
        return None
    counts = np.zeros(CLASSES**3, np.int64)
    counts[found.column("triple").to_numpy()] = found.column("n").to_numpy()
    return bits(counts)


def scores(table: np.ndarray, column: pa.Array) -> Iterator[np.ndarray]:
    """The share of familiar bytes of each text."""
    data, offsets = buffers(column)
    for first, last in runs(offsets):
        part = offsets[first : last + 1]
        own, at = data[part[0] : part[-1]], part - part[0]
        sums = np.concatenate([[0.0], np.cumsum(table[triples(own, at)], dtype=np.float64)])
        starts, ends = spans((~white(own)).view(np.uint8), at)
        familiar = sums[ends] - sums[starts] >= -STRANGE * (ends - starts)
        words = np.searchsorted(starts, at)
        good, all_ = (np.concatenate([[0], np.cumsum((ends - starts) * w)])[words] for w in (familiar, 1))
        yield (np.diff(good) + DRAWN) / (np.diff(all_) + DRAWN)


def scorer(spark: SparkSession, table: np.ndarray | None) -> Callable[[Column], Column]:
    """A function from a text column to the share of its bytes in familiar words."""
    if table is None:
        return lambda text: F.lit(1.0)
    shared = spark.sparkContext.broadcast(table.astype(np.float16))

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([np.zeros(0), *scores(shared.value.astype(np.float32), column)]))

    return score
