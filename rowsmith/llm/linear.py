"""Hashed sparse logistic regression: FTRL-proximal training, and scores as sparse products.

Shared by the quality and the toxicity classifier, which differ in their features. Features
are hashed into 2**bits places. Training walks over a bounded sample of labelled documents;
the weights that are not zero are broadcast (2**bits at most, whatever the input), and every
text is scored whole, batch by batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from .words import buffers, runs

#: Of bytes and offsets: the text of each feature and its place below 2**bits, sorted, distinct.
Features = Callable[[np.ndarray, np.ndarray, int], tuple[np.ndarray, np.ndarray]]


@dataclass(frozen=True)
class Settings:
    bits: int = 20
    alpha: float = 0.1
    beta: float = 1.0
    l1: float = 1.0
    l2: float = 1.0
    epochs: int = 3
    #: About so many labelled rows are learned from; those with the smallest hashes of the key.
    sample: int = 8192
    #: Features of a text share length one if true, else each counts one.
    unit: bool = True


@dataclass(frozen=True)
class Weights:
    bias: float
    places: np.ndarray
    values: np.ndarray


def train(examples: list[tuple[np.ndarray, int]], s: Settings) -> Weights:
    """FTRL-proximal with per-coordinate rates, over the examples in their order.

    Without examples every score is 0.5; with one class the bias alone learns it.
    """
    z, n = np.zeros(1 << s.bits), np.zeros(1 << s.bits)
    bias = np.zeros(2)
    for _ in range(s.epochs):
        for places, label in examples:
            value = 1 / np.sqrt(max(1, len(places))) if s.unit else 1.0
            zs, ns = z[places], n[places]
            roots = np.sqrt(ns)
            w = (np.sign(zs) * s.l1 - zs) / ((s.beta + roots) / s.alpha + s.l2)
            w[np.abs(zs) <= s.l1] = 0
            b = -bias[0] / ((s.beta + np.sqrt(bias[1])) / s.alpha)
            error = 1 / (1 + np.exp(-np.clip(b + w.sum() * value, -35, 35))) - label
            g = error * value
            z[places] = zs + g - (np.sqrt(ns + g * g) - roots) / s.alpha * w
            n[places] = ns + g * g
            step = (np.sqrt(bias[1] + error * error) - np.sqrt(bias[1])) / s.alpha
            bias += (error - step * b, error * error)
    used = np.flatnonzero(np.abs(z) > s.l1)
    value = (np.sign(z[used]) * s.l1 - z[used]) / ((s.beta + np.sqrt(n[used])) / s.alpha + s.l2)
    b = -bias[0] / ((s.beta + np.sqrt(bias[1])) / s.alpha)
    return Weights(float(b), used.astype(np.int32), value.astype(np.float32))


def each_text(column: pa.Array, features: Features, bits: int) -> Iterator[np.ndarray]:
    """The feature places of each text."""
    data, offsets = buffers(column)
    for first, last in runs(offsets):
        part = offsets[first : last + 1]
        of, places = features(data[part[0] : part[-1]], part - part[0], bits)
        yield from np.split(places, np.searchsorted(of, np.arange(1, last - first)))


def fit(
    docs: DataFrame, labels: DataFrame, label: str, features: Features, s: Settings, key: str = "doc_id"
) -> Weights:
    """Learn from documents that have a label 0 or 1; rows with other labels don't count.

    The sample is a hash threshold set from a count of all labelled rows, so it is the same
    at every run and holds about s.sample rows at any input size. Only feature places of the
    sample come to the driver.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(
        F.col(key).alias("_key"), F.col(label).cast("int").alias("_label"),
        F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1 << 30)).alias("_order"),
    ).distinct()
    total = known.count()
    known = known.where(F.col("_order") < int((1 << 30) * min(1.0, s.sample / max(1, total))))
    # About s.sample rows, by the threshold.
    chosen = docs.select(key, "text").join(F.broadcast(known), F.col(key) == F.col("_key"))
    bits = s.bits

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(each_text(batch.column("text"), features, bits))
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.int32), *found]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_order"), batch.column("_label"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                names=["_order", "_label", "places"],
            )

    schema = StructType([*chosen.select("_order", "_label").schema.fields, StructField("places", ArrayType(IntegerType()))])
    rows = chosen.select("_order", "_label", "text").mapInArrow(places, schema).toArrow()
    column = rows.column("places").combine_chunks()
    flat, ends = column.flatten().to_numpy(), np.cumsum([0, *column.value_lengths().to_pylist()])
    order = np.lexsort((np.diff(ends), rows.column("_label").to_numpy(), rows.column("_order").to_numpy()))
    label_of = rows.column("_label").to_numpy()
    return train([(flat[ends[i] : ends[i + 1]], int(label_of[i])) for i in order], s)


def scorer(docs: DataFrame, weights: Weights, features: Features, s: Settings) -> Callable[[Column], Column]:
    """A function from a text column to the probability of label 1; null scores as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    bits, unit = s.bits, s.unit

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        w = shared.value
        dense = np.zeros(1 << bits, np.float32)
        dense[w.places] = w.values
        data, offsets = buffers(column)
        out = np.zeros(len(column))
        for first, last in runs(offsets):
            part = offsets[first : last + 1]
            of, places = features(data[part[0] : part[-1]], part - part[0], bits)
            total = np.bincount(of, dense[places], last - first)
            if unit:
                total /= np.sqrt(np.maximum(1, np.bincount(of, minlength=last - first)))
            out[first:last] = total
        return pa.array(1 / (1 + np.exp(-np.clip(out + w.bias, -35, 35))))

    return score


def distinct(of: list[np.ndarray], hashes: list[np.ndarray], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct (text, place) from texts and hashes of features."""
    key = np.concatenate(of).astype(np.uint64) << np.uint64(bits)
    key |= np.concatenate(hashes) >> np.uint64(64 - bits)
    key.sort()
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    return (key >> np.uint64(bits)).astype(np.int64), (key & np.uint64((1 << bits) - 1)).astype(np.int64)


def grams(hashes: np.ndarray, of: np.ndarray, steps: tuple[int, ...], kind: int) -> tuple[np.ndarray, np.ndarray]:
    """Combined hashes of words at the given distances from each word, inside one text."""
    from .words import FACTOR, mixed

    n = max(0, len(hashes) - max(steps, default=0))
    total = hashes[:n] + np.uint64(kind * 0xC2B2AE3D27D4EB4F % (1 << 64))
    for step in steps:
        total = total * np.uint64(FACTOR) + hashes[step : step + n]
    last = max(steps, default=0)
    inside = of[:n] == of[last : last + n]
    return of[:n][inside], mixed(total)[inside]
