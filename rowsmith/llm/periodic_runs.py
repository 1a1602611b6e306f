"""Periodic runs of words: maximal stretches that repeat with a smallest period.

Words are runs of bytes other than white space. A run [start, start + length) has the smallest
period q, is not extended by a neighbouring word, and has at least `least` words and two periods.

The dictionary of basic factors names every block of 2**k words of a document, level by level:
a block is the pair of the names of its halves. A block whose halves are not both repeated in
its document is unique and drops out, so ordinary prose is done after a few levels.

On each level, with blocks of L words, every block's successor (its next occurrence) is known
from one sort by name. Occurrences that follow each other by L / 2 or less lie one period of the
block apart: an arithmetic progression. From a block, the progressions within 2 L propose
periods: the distance to their first and to their last member. Either is enough to meet
each run of a period from L to 2 L - 1: where both ends of the run cut the progressions, these would
have grown together, and where one does not, its copy one period later ends alike.

Proposals of one period at neighbouring words are one run and are reduced to the first. Each is
extended to both sides by descending the levels (blocks of equal names are equal). A run whose period
is not its smallest has the same ends as the run of the smallest one and is dropped.

Words are compared by 64-bit hashes, names are exact. Memory per document: four bytes a word and
level. Null and empty texts have no words and no runs; repeated rows give the same runs; very long
texts are taken whole. An empty table gives an empty result. Only the given columns are read,
so others may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import table
from .words import buffers, mixed, runs, words

LEAST = 12


def repeated(keys: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose key occurs again, ordered by key and position, and the number of their key."""
    if not len(keys):
        return at, np.zeros(0, np.int32)
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    same = ordered[1:] == ordered[:-1]
    several = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    first = np.concatenate([[True], ~same])
    return at[order[several]], (np.cumsum(first[several]) - 1).astype(np.int32)


def proposals(at: np.ndarray, name: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(position, period) from the occurrences of blocks of `size` words, ordered by name and position."""
    near = (name[1:] == name[:-1]) & (2 * (at[1:] - at[:-1]) <= size)
    place = np.arange(len(at))
    # The last member of the progression that an occurrence is in.
    ends = np.concatenate([np.where(near, len(at), place[:-1]), place[-1:]])
    ends = np.minimum.accumulate(ends[::-1])[::-1]
    here, last = place, ends
    while len(here):
        inside = last + 1 < len(at)
        here, first = here[inside], last[inside] + 1
        far = at[first] - at[here]
        inside = (name[first] == name[here]) & (far < 2 * size)
        here, first, far = here[inside], first[inside], far[inside]
        fits = far >= size
        yield at[here[fits]], far[fits]
        last = ends[first]
        far = at[last] - at[here]
        fits = (last > first) & (far >= size) & (far < 2 * size)
        yield at[here[fits]], far[fits]


def extended(
    start: np.ndarray, period: np.ndarray, levels: list[np.ndarray], lo: np.ndarray, hi: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """First and last + 1 word of the stretch around `start` that keeps the period inside [lo, hi)."""
    first, last = start.copy(), start.copy()
    for k in range(len(levels) - 1, -1, -1):
        names, size = levels[k], 1 << k
        x = np.where(last + period + size <= hi, last, 0)
        y = np.where(last + period + size <= hi, last + period, 0)
        last += np.where((names[x] >= 0) & (names[x] == names[y]) & (y > 0), size, 0)
        fits = first - size >= lo
        x = np.where(fits, first - size, 0)
        first -= np.where(fits & (names[x] >= 0) & (names[x] == names[x + period]), size, 0)
    return first, last + period


def find_runs(hashes: np.ndarray, at: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs, ordered; words of document d are at[d] to at[d + 1] - 1."""
    none = np.zeros(0, np.int64)
    if not len(hashes):
        return none, none, none
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    own = mixed(hashes + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    size, levels, found = 1, [], []
    active, name = repeated(own, np.arange(len(hashes), dtype=np.int64))
    while len(active):
        names = np.full(len(hashes), -1, np.int32)
        names[active] = name
        levels.append(names)
        found += proposals(active, name, size)
        # Blocks of twice the size: both halves are repeated blocks of the same document.
        active = np.sort(active)
        active = active[active + 2 * size <= at[doc[active] + 1]]
        active = active[names[active + size] >= 0]
        pairs = names[active].astype(np.int64) << np.int64(32) | names[active + size]
        active, name = repeated(pairs, active)
        size *= 2
    start = np.concatenate([f[0] for f in found]) if found else none
    period = np.concatenate([f[1] for f in found]) if found else none
    keys = np.unique(period * np.int64(len(hashes) + 1) + start)
    keys = keys[np.diff(keys, prepend=-2) > 1]
    period, start = np.divmod(keys, len(hashes) + 1)
    first, last = extended(start, period, levels, at[doc[start]], at[doc[start] + 1])
    long = last - first >= np.maximum(least, 2 * period)
    first, last, period = first[long], last[long], period[long]
    order = np.lexsort((period, last, first))
    first, last, period = first[order], last[order], period[order]
    new = np.ones(len(first), bool)
    new[1:] = (first[1:] != first[:-1]) | (last[1:] != last[:-1])
    first, last, period = first[new], last[new], period[new]
    order = np.lexsort((period, first))
    return first[order], last[order], period[order]


def repeats(words_at: np.ndarray, crc: np.ndarray | None) -> np.ndarray:
    """For each word, the word that stands there after the change that depends on the document's crc."""
    index = np.arange(words_at[-1], dtype=np.int64)
    if crc is None:
        return index
    for d in np.flatnonzero((crc >= 0) & (crc % 10 == 0) & (np.diff(words_at) > 0)).tolist():
        n, g = int(words_at[d + 1] - words_at[d]), int(crc[d]) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        index[words_at[d] + a : words_at[d + 1]] = words_at[d] + a + np.arange(n - a) % p
    return index


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of each document with one blank after each, and the offsets of the documents."""
    sizes = ends - starts + 1
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    source = np.repeat(starts - offsets[:-1], sizes) + np.arange(offsets[-1])
    source[offsets[1:] - 1] = 0
    out = data[source] if len(data) else np.zeros(0, np.uint8)
    out[offsets[1:] - 1] = 32
    return out, offsets[at]


RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_found = pa.struct([("runs", pa.list_(_run)), ("collapsed", pa.string())])


def _texts(column: pa.Array, crc: pa.Array | None, least: int, digests: bool) -> Iterator[dict]:
    data, offsets = buffers(column)
    crcs = None if crc is None else crc.cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False)
    for lo, hi in runs(offsets):
        cut = offsets[lo : hi + 1]
        part = data[cut[0] : cut[-1]]
        hashes, at, starts, ends = words(part, cut - cut[0], lower=False)
        index = repeats(at, None if crcs is None else crcs[lo:hi])
        hashes, starts, ends = hashes[index], starts[index], ends[index]
        first, last, period = find_runs(hashes, at, least)
        # A word goes if it lies in a run behind the run's first period.
        depth = np.zeros(len(hashes) + 1, np.int64)
        np.add.at(depth, first + period, 1)
        np.add.at(depth, last, -1)
        kept = np.cumsum(depth[:-1]) == 0
        kept_at = np.concatenate([[0], np.cumsum(kept)])[at]
        text, bounds = joined(part, starts[kept], ends[kept], kept_at)
        text, of = text.tobytes(), np.searchsorted(first, at)
        for d in range(hi - lo):
            a, b = int(of[d]), int(of[d + 1])
            base = int(at[d])
            told = list(zip((first[a:b] - base).tolist(), (last[a:b] - first[a:b]).tolist(), period[a:b].tolist()))
            rest = text[bounds[d] : max(bounds[d], bounds[d + 1] - 1)]
            yield {
                "runs": [dict(zip(("start", "length", "period"), r)) for r in told],
                "collapsed": hashlib.sha256(rest).hexdigest() if digests else rest.decode(),
            }


def run_finder(least: int = LEAST, digests: bool = False):
    """A function of a text column (and a crc column) that gives struct<runs, collapsed>.

    `collapsed` is the text without the repetitions of its runs, one blank between words, or with
    `digests` its SHA-256. With a crc column, the words of a document whose crc ends in 0 are
    made periodic first (`repeats`); a null crc changes nothing.
    """
    kind = f"struct<runs:{RUNS},collapsed:string>"

    @F.arrow_udf(kind)
    def plain(column: pa.Array) -> pa.Array:
        return pa.array(_texts(column, None, least, digests), _found)

    @F.arrow_udf(kind)
    def changed(column: pa.Array, crc: pa.Array) -> pa.Array:
        return pa.array(_texts(column, crc, least, digests), _found)

    return lambda text, crc=None: plain(text) if crc is None else changed(text, crc)


def periodic_runs(df: DataFrame, text: str = "text", least: int = LEAST) -> DataFrame:
    """All columns of df in struct `row`, with the runs and the collapsed text of each document."""
    found = run_finder(least)(F.col(text))
    return df.select(F.struct(*[df[c] for c in df.columns]).alias("row"), found.alias("found")).select(
        "row", "found.runs", "found.collapsed"
    )


def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Number of runs, the longest one and digests of every document, after the planted repeats."""
    docs = table(spark, folder, "documents")
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    found = docs.select("doc_id", run_finder(digests=True)(F.col("text"), crc).alias("found"))
    found = found.select("doc_id", F.col("found.runs").alias("runs"), F.col("found.collapsed").alias("collapsed"))

    def first_of(a: Column, b: Column) -> Column:
        key = lambda x: F.struct(-x["length"], x["start"], x["period"])
        return F.when(key(a) <= key(b), a).otherwise(b)

    longest = F.aggregate("runs", F.get("runs", F.lit(0)), first_of)
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    listed = F.concat_ws("", F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))))
    return found.withColumn("best", longest).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("(best.length * 1000) div best.period").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.col("collapsed").alias("collapsed_sha256"),
    )
