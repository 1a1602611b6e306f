"""Packing tokenized documents into sequences of fixed length by minimum bin slack.

1. Every document becomes its token ids and an end id, cut into pieces of `size` tokens; only
   longer documents are cut. Words between ASCII white space are tokenized one by one: the
   tokenizer's pieces never cross white space, so the ids are those of the whole text. Equal words
   of a task are tokenized once. A task counts its pieces per length as it goes; pieces are
   written to the shared folder, as numbers only.
2. Pieces of one length are alike, so bins are filled from the number of pieces per length, at most
   `size` numbers whatever the input. Per bin, the longest piece left is fixed, and a subset-sum
   program over the lengths left (one bit per reachable sum, counts bounded) finds the fullest
   combination, that of the longest pieces among the full ones. It is removed, as often as it can be:
   one bin at a time would find the same combination again until a length of it runs out. So there
   are few different combinations, whatever the number of bins.
3. The rank of a piece among those of its length (pieces in earlier tasks, and before it in its
   own) tells the combination, the bin and the place. No group is ever collected.

Null and empty texts are the end id alone. Repeated rows are documents of their own, so are rows
of a null id; ids of any type pass through. Very long texts are cut into full pieces and a rest; a
task holds the words of one run of texts (about 1 MB, or one longer text). An empty table gives an
empty result. Only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from tokenizers import Tokenizer

from .common import cut, table
from .words import buffers, hashed, lowered, runs, spans, white

VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"
SIZE = 2048
END = 0
#: Ids of known words that a task keeps; beyond that it starts anew.
KEPT_IDS = 1 << 22
RANK_BITS = 48
#: Classes of bytes; digits have two, by the parity of their place.
LETTER, PUNCTUATION, WHOLE, DIGIT = 1, 2, 3, 4

_classes = np.zeros(256, np.uint8)
_classes[33:128] = PUNCTUATION
for _first, _last, _class in (("0", "9", DIGIT), ("A", "Z", LETTER), ("a", "z", LETTER)):
    _classes[ord(_first) : ord(_last) + 1] = _class


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """The bytes in lower case A-Z, start and end of the parts that are tokenized one by one, and
    which of them are whole words of several pieces.

    The tokenizer's pieces are runs of letters, single digits and runs of other signs. Words of
    ASCII and the letters U+00C0 to U+00FF are parted there, so that words are known whatever
    signs are around them; words with an apostrophe (which may go with letters) or other characters
    stay whole, as they are.
    """
    classes = _classes[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
    classes[lead] = classes[lead + 1] = LETTER
    word = ~white(data)
    starts, ends = spans(word.view(np.uint8), offsets)
    odd = np.concatenate([[0], np.cumsum((word & (classes == 0)) | (data == 39))])
    whole = odd[ends] > odd[starts]
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts[whole]] = 1
    inside[ends[whole]] -= 1
    inside = np.cumsum(inside[:-1], dtype=np.int8) > 0
    # Neighbouring digits differ, so each is a part.
    classes = np.where(classes == DIGIT, DIGIT + (np.arange(len(data)) & 1).astype(np.uint8), classes)
    classes[inside] = WHOLE
    starts, ends = spans(classes, offsets)
    return np.where(inside, data, lowered(data)), starts, ends, classes[starts] == WHOLE


class WordIds:
    """Token ids of words and their parts, kept by hash."""

    def __init__(self, vocabulary: str):
        # One thread per task; Spark runs as many tasks as there are cores.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.encode_special_tokens = True
        self.merges = self.tokenizer.model
        # The characters by which byte-level vocabularies show bytes: printable ones show themselves,
        # the others follow from U+0100 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in shown]
        self.shown = {b: 256 + i for i, b in enumerate(rest)}
        self.forget()

    def forget(self) -> None:
        self.places: dict[int, int] = {}
        self.starts, self.ids = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def ids_of(self, text: str, whole: bool) -> list[int]:
        """A part that is one piece goes to the merges at once, in the form they are written in."""
        if whole:
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        if not text.isascii() or "\x7f" in text:
            text = text.lower().encode().decode("latin-1").translate(self.shown)
        return [t.id for t in self.merges.tokenize(text)]

    def learn(self, hashes: list[int], found: list[list[int]]) -> range:
        """The places of words that are not known yet."""
        places = range(len(self.starts) - 1, len(self.starts) - 1 + len(found))
        self.places.update(zip(hashes, places))
        ends = self.starts[-1] + np.cumsum(list(map(len, found)))
        self.starts = np.concatenate([self.starts, ends])
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(found), np.uint32)])
        return places

    def encoded(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, END after each, and the n + 1 offsets of the texts in them."""
        if len(self.ids) > KEPT_IDS:
            self.forget()
        data, starts, ends, whole = units(data, offsets)
        at = np.searchsorted(starts, offsets)
        which, each = pd.factorize(hashed(data, starts, ends))
        first = np.empty(len(each), np.int64)
        first[which[::-1]] = np.arange(len(which))[::-1]
        each = each.tolist()
        places = list(map(self.places.get, each))
        new = [i for i, p in enumerate(places) if p is None]
        if new:
            parts = zip(*(x[first[new]].tolist() for x in (starts, ends, whole)))
            found = [self.ids_of(data[a:b].tobytes().decode(), w) for a, b, w in parts]
            for i, place in zip(new, self.learn([each[i] for i in new], found)):
                places[i] = place
        place = np.array(places, np.int64)[which]
        sizes = self.starts[place + 1] - self.starts[place] if len(place) else np.zeros(0, np.int64)
        before = np.concatenate([[0], np.cumsum(sizes)])
        doc = np.arange(len(at) - 1)
        out = np.full(before[-1] + len(doc), END, np.uint32)
        gather = np.repeat(self.starts[place] - before[:-1], sizes) + np.arange(before[-1])
        # One END for each document that is already complete.
        shift = np.repeat(np.repeat(doc, np.diff(at)), sizes)
        out[np.arange(before[-1]) + shift] = self.ids[gather]
        return out, before[at] + np.arange(len(at))


_kept: dict[str, WordIds] = {}


def pieces_of(vocabulary: str, size: int):
    """doc_id, text to pieces with part (the task) and nth (before it in the task, of its length)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _kept:
            _kept[vocabulary] = WordIds(vocabulary)
        part, seen = TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            for lo, hi in runs(offsets):
                own = offsets[lo : hi + 1]
                ids, at = _kept[vocabulary].encoded(data[own[0] : own[-1]], own - own[0])
                n = np.diff(at)
                count = -(-n // size)
                doc = np.repeat(np.arange(lo, hi), count)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                start = piece * size
                length = np.minimum(np.repeat(n, count) - start, size)
                raw, first = ids.astype("<u4").tobytes(), np.repeat(at[:-1], count) + start
                crc = [zlib.crc32(raw[4 * a : 4 * (a + b)]) for a, b in zip(first.tolist(), length.tolist())]
                order = np.argsort(length, kind="stable")
                ordered = length[order]
                nth = np.empty(len(order), np.int64)
                nth[order] = np.arange(len(order)) - np.searchsorted(ordered, ordered) + seen[ordered]
                seen += np.bincount(length, minlength=size + 1)
                taken = batch.select(["doc_id"]).take(pa.array(doc))
                yield pa.RecordBatch.from_arrays(
                    [*taken.columns, pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length),
                     pa.array(crc, pa.int64()), pa.array(np.full(len(doc), part, np.int32)), pa.array(nth)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"],
                )

    return run


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The lengths, and how often, whose sum is largest without being above room.

    Longer lengths are tried first and the search ends as soon as the room can be filled.
    """
    reach, mask, tried = 1, (1 << (room + 1)) - 1, []
    for length in sorted(counts, reverse=True):
        most = min(counts[length], room // length)
        if not most:
            continue
        tried.append((length, reach))
        step = 1
        while most:
            take = min(step, most)
            reach |= (reach << (length * take)) & mask
            most, step = most - take, 2 * step
        if reach >> room & 1:
            break
    left, chosen = reach.bit_length() - 1, {}
    for length, before in reversed(tried):
        while not before >> left & 1:
            chosen[length] = chosen.get(length, 0) + 1
            left -= length
    return chosen


class Layout(NamedTuple):
    """Which bins the pieces of a length go to: one row per length and combination.

    Of the pieces of `key`'s length from `key`'s rank on, each `each` go to one more bin, from
    `bin` on, with the first one at `offset`.
    """

    key: np.ndarray
    each: np.ndarray
    bin: np.ndarray
    offset: np.ndarray
    bins: int


def fill_bins(counts: dict[int, int], size: int) -> Layout:
    """Minimum bin slack from the number of pieces per length."""
    counts, used, rows, bins = dict(counts), {}, [], 0
    while counts:
        longest = max(counts)
        left = {n: c for n, c in counts.items() if n <= size - longest}
        if longest in left:
            left[longest] -= 1
        chosen = fullest({n: c for n, c in left.items() if c}, size - longest)
        chosen[longest] = chosen.get(longest, 0) + 1
        times = min(counts[n] // c for n, c in chosen.items())
        offset = 0
        for length, each in sorted(chosen.items(), reverse=True):
            rows.append((length << RANK_BITS | used.get(length, 0), each, bins, offset))
            offset += length * each
            used[length] = used.get(length, 0) + each * times
            counts[length] -= each * times
            if not counts[length]:
                del counts[length]
        bins += times
    columns = np.array(sorted(rows), np.int64).reshape(-1, 4).T
    return Layout(*columns, bins)


def placed(layout):
    """Adds the bin and the offset of each piece, from its length and rank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = layout.value
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            row = np.searchsorted(at.key, length << RANK_BITS | rank, "right") - 1
            times, nth = np.divmod(rank - (at.key[row] & ((1 << RANK_BITS) - 1)), at.each[row])
            kept = batch.select(batch.schema.names[:-1])
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(at.bin[row] + times), pa.array(at.offset[row] + nth * length)],
                names=[*kept.schema.names, "sequence_id", "offset"],
            )

    return run


def pack(df: DataFrame, size: int = SIZE, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of df's texts."""
    kind = df.schema["doc_id"].dataType.simpleString()
    own = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint"
    # Written once: the rank of a piece is that of this writing.
    pieces = cut(df.select("doc_id", "text").mapInArrow(pieces_of(vocabulary, size), f"{own}, part int, nth bigint"))
    totals = pieces.groupBy("length", "part").agg((F.max("nth") + 1).alias("n"))
    # At most `size` rows, whatever the input.
    counts = {r.length: r.n for r in totals.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    layout = df.sparkSession.sparkContext.broadcast(fill_bins(counts, size))
    # One row per task and length.
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = pieces.join(shifts, ["length", "part"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank")
    )
    return ranked.mapInArrow(placed(layout), f"{own}, sequence_id bigint, offset bigint")


def op13_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Sequence and place of every piece of every document."""
    return pack(table(spark, folder, "documents"))
