"""Passages of benchmark items in training documents, also edited or paraphrased ones.

Words are runs of letters, digits and bytes beyond ASCII, in lower case A-Z. Seeds are runs of three
words of an item, of two for items of fewer than SHORT words, and the whole item below four.

1. A bit set with two places for each item run, of some 64 bits a run (2**MOST_BITS at most), is
   broadcast. Every whole document is looked up in it; a document with as many different hits as any
   item needs goes on with their positions and its words as hashes.
2. Documents with the same hits are joined to the seeds once, by hash of the set of hits, and
   counted by set and item. Rare runs make the pairs: one that more than SHARED items have makes none,
   as long as at least half of the item's runs are rarer, and then counts as given. A pair
   goes on with the number of different seeds that `seeds_needed` tells, and with every document of the set.
   How many documents have a run does not matter: what many copied is common by that.
3. Around each stretch of hits on the item, words of item and document are aligned (Smith-Waterman: equal
   words MATCH, others MISMATCH, left out or put in GAP). The score is the best alignment's
   share of the item aligned with itself. From THRESHOLD on, and with LEAST points (three matching
   words, or the item), the document holds the item.

Against the alignment of every document with every item, recall is 1 for items with one word
changed or left out, from four words on, and at least 0.9 where a fifth of the words of an item are
changed, left out or put in at random (tested per length). Items of SHORT and more words of which
exactly every third word is changed share no run of three and are lost.

Null or empty texts hold nothing; items without words are held by nothing. Repeated rows give one
result per document id and item, the best. Rows of a null id are a document too, or an item; ids of
any type pass through. Very long texts are looked up and aligned whole. Empty tables give an empty
result. Only the ids and texts are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import cut, table
from .quality import _kinds
from .words import buffers, hashed, lowered, ngrams, runs, spans

RUN = 3
SHORT, SHORT_RUN = 12, 2
SEEDS = 2
SHARED = 64
LEAST_BITS, MOST_BITS = 25, 30
#: Odd factors by which a hash gives its two places in the bit set.
PLACES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
MATCH, MISMATCH, GAP = 2, -1, -1
THRESHOLD, LEAST = 0.5, 5


def run_size(n: int) -> int:
    """Words of the runs of an item of n words."""
    return n if n <= RUN else SHORT_RUN if n < SHORT else RUN


def seeds_needed(n: int) -> int:
    """Different runs that a document shares with an item of n words which it holds.

    An alignment of m words in s parts, where words were changed or left out between the parts, has
    2 m - (s - 1) >= n and m + s - 1 <= n, so at least n / 3 - 1 pairs of neighbours; one less is asked for.
    """
    return max(1, -(-n // 3) - 2) if n < SHORT else SEEDS


def least_score(n: int) -> float:
    """Points from which an alignment with an item of n words counts."""
    return max(THRESHOLD * MATCH * n, min(MATCH * n, LEAST))


def text_words(column: pa.Array) -> Iterator[np.ndarray]:
    """The word hashes of each text."""
    data, offsets = buffers(column)
    for first, last in runs(offsets):
        part = offsets[first : last + 1]
        low = lowered(data[part[0] : part[-1]])
        starts, ends = spans((_kinds[low] == 1).view(np.uint8), part - part[0])
        yield from np.split(hashed(low, starts, ends), np.searchsorted(starts, part[1:-1] - part[0]))


def word_runs(words: np.ndarray) -> np.ndarray:
    return ngrams(words, run_size(len(words))) if len(words) else words


def item_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every item and its key, with its words, its runs and their size, and the seeds needed."""
    for batch in batches:
        words = list(text_words(batch.column("text")))
        found = [word_runs(w).view(np.int64) for w in words]
        need = [min(seeds_needed(len(w)), len(np.unique(f))) for w, f in zip(words, found)]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("item"), batch.column("item_id"), pa.array([w.tobytes() for w in words], pa.binary()),
                pa.array(found, pa.list_(pa.int64())), pa.array([run_size(len(w)) for w in words], pa.int32()), pa.array(need, pa.int32()),
            ],
            names=["item", "item_id", "item_words", "runs", "size", "need"],
        )


def set_bits(width: int):
    """Runs to the bytes of a bit set of 2**width bits and the two bits that each run has in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = batch.column("run").to_numpy().view(np.uint64)
            place = np.concatenate([(runs * np.uint64(p)) >> np.uint64(64 - width) for p in PLACES]).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array((place >> 3).astype(np.int32)), pa.array((1 << (place & 7)).astype(np.int32))], names=["byte", "bits"]
            )

    return run


def looked_up(shared, sizes: list[int], least: int):
    """Documents with at least so many different hits: their positions and runs of the given sizes, and their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        width = len(bits).bit_length() + 2
        for batch in batches:
            rows: list[list] = [[], [], [], []]
            for i, words in enumerate(text_words(batch.column("text"))):
                all_at, all_runs = [], []
                for size in sizes:
                    found = ngrams(words, size)
                    at = np.arange(len(found))
                    for p in PLACES:
                        place = (found[at] * np.uint64(p)) >> np.uint64(64 - width)
                        at = at[bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & 1 > 0]
                    all_at.append(at.astype(np.int32))
                    all_runs.append(found[at].view(np.int64))
                if sum(map(len, all_at)) >= least and len(np.unique(np.concatenate(all_runs))) >= least:
                    row = (i, np.concatenate(all_at), np.concatenate(all_runs), words.tobytes())
                    for values, value in zip(rows, row):
                        values.append(value)
            taken = batch.select(["doc_id"]).take(pa.array(rows[0], pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*taken.columns, pa.array(rows[1], pa.list_(pa.int32())), pa.array(rows[2], pa.list_(pa.int64())), pa.array(rows[3], pa.binary())],
                names=["doc_id", "at", "runs", "words"],
            )

    return run


def aligned(item: np.ndarray, words: np.ndarray) -> tuple[int, int, int]:
    """Score, first and last + 1 word of the best local alignment."""
    steps = np.arange(len(words) + 1) * -GAP
    rows = np.zeros((len(item) + 1, len(words) + 1), np.int64)
    for i, word in enumerate(item):
        best = np.maximum(rows[i, 1:] + GAP, rows[i, :-1] + np.where(words == word, MATCH, MISMATCH))
        np.maximum(best, 0, out=rows[i + 1, 1:])
        # A gap in the item: the best of all cells to the left, each minus its distance.
        rows[i + 1] = np.maximum.accumulate(rows[i + 1] + steps) - steps
    i, j = np.unravel_index(rows.argmax(), rows.shape)
    score, end = int(rows[i, j]), int(j)
    while i and j and rows[i, j]:
        if rows[i, j] == rows[i - 1, j - 1] + (MATCH if item[i - 1] == words[j - 1] else MISMATCH):
            i, j = i - 1, j - 1
        elif rows[i, j] == rows[i - 1, j] + GAP:
            i -= 1
        else:
            j -= 1
    return score, int(j), end


def stretches(at: np.ndarray, length: int, total: int) -> Iterator[tuple[int, int]]:
    """Parts of the document around hits: an item's length before and after, merged if they touch."""
    at = np.sort(at)
    first, last = at - length, at + RUN + length
    new = np.concatenate([[True], first[1:] > last[:-1]])
    ends = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(at) - 1]])
    for lo, hi in zip(first[new].tolist(), last[ends].tolist()):
        yield max(0, lo), min(total, hi)


def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[list] = [[], [], [], []]
        for i in range(len(batch)):
            item = np.frombuffer(batch.column("item_words")[i].as_py(), np.uint64)
            words = np.frombuffer(batch.column("words")[i].as_py(), np.uint64)
            at, found, sought = (batch.column(c)[i].values.to_numpy() for c in ("at", "runs", "item_runs"))
            at = at[np.isin(found, sought)]
            best = (0, 0, 0)
            for lo, hi in stretches(at, len(item), len(words)):
                # Long stretches (the item many times over) go in overlapping parts.
                for part in range(lo, hi, 8 * len(item)):
                    near = words[part : min(hi, part + 10 * len(item))]
                    # Words that the part lacks can't match.
                    if np.isin(item, near).sum() < THRESHOLD * len(item):
                        continue
                    score, a, b = aligned(item, near)
                    best = max(best, (score, part + a, part + b), key=lambda x: x[0])
            if best[0] >= least_score(len(item)):
                for values, value in zip(rows, (i, best[0] / (MATCH * len(item)), best[1], best[2])):
                    values.append(value)
        taken = batch.select(["doc_id", "item_id"]).take(pa.array(rows[0], pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [*taken.columns, pa.array(rows[1], pa.float64()), pa.array(rows[2], pa.int32()), pa.array(rows[3], pa.int32())],
            names=["doc_id", "item_id", "score", "first_word", "last_word"],
        )


def seeds(each: DataFrame) -> DataFrame:
    """(run, item, need): the runs that make pairs, and how many of them are needed.

    An item of which at least half of the runs are rarer goes without those that more than SHARED items
    have; they count as found, but for one seed.
    """
    shared = each.groupBy("run").agg(F.count("*").alias("_items")).where(F.col("_items") > SHARED)
    marked = each.join(shared, "run", "left")
    counts = marked.groupBy("item").agg(F.count("*").alias("_all"), F.count("_items").alias("_shared"))
    rare = F.col("_all") >= 2 * F.col("_shared")
    need = F.when(rare, F.greatest(F.lit(1), F.col("need") - F.col("_shared"))).otherwise(F.col("need"))
    return marked.join(counts, "item").where(F.col("_items").isNull() | ~rare).select("run", "item", need.cast("int").alias("need"))


def join_documents(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Every document of a set of hits with the items of the set.

    The second key keeps Spark from taking the grouping by set for the join's, so that it may split a set
    that very many documents have.
    """
    sought = pairs.withColumnRenamed("held", "sought")
    return sought.join(found, F.expr("sought = held AND xxhash64(sought) = xxhash64(held)"))


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, score and the words [first_word, last_word) of every item held by a document."""
    id_type, item_type = docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    known = cut(
        items.select(F.xxhash64("item_id", "text").alias("item"), "item_id", "text")
        .mapInArrow(item_runs, f"item bigint, item_id {item_type}, item_words binary, runs array<bigint>, size int, need int")
        .where("size(runs) > 0")
        .dropDuplicates(["item"])
    )
    each = known.select("item", "need", F.explode(F.array_distinct("runs")).alias("run"))
    of_items = known.agg(F.sum(F.size("runs")), F.collect_set("size"), F.min("need")).first()
    sizes, least = sorted(of_items[1]), of_items[2] or 1
    width = min(MOST_BITS, max(LEAST_BITS, (64 * (of_items[0] or 0)).bit_length()))
    # The distinct places of the bit set, at most 2**width of them, in parts.
    where = each.select("run").distinct().mapInArrow(set_bits(width), "byte int, bits int")
    filled = where.groupBy("byte").agg(F.expr("bit_or(bits)").alias("bits")).toArrow()
    bits = np.zeros(1 << (width - 3), np.uint8)
    bits[filled.column("byte").to_numpy()] = filled.column("bits").to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    found = cut(
        docs.select("doc_id", "text")
        .mapInArrow(looked_up(shared, sizes, least), f"doc_id {id_type}, at array<int>, runs array<bigint>, words binary")
    )
    found = found.withColumn("held", F.xxhash64(F.array_sort(F.array_distinct("runs"))))
    # Copies of a passage have the same hits: they are joined to the items' runs once.
    sets = found.select("held", F.array_distinct("runs").alias("runs")).dropDuplicates(["held"])
    pairs = (
        sets.select("held", F.explode("runs").alias("run"))
        .join(seeds(each), "run")
        .groupBy("held", "item")
        .agg(F.count("*").alias("seeds"), F.first("need").alias("need"))
        .where("seeds >= need")
        .select("held", "item")
    )
    items_of = known.select("item", "item_id", "item_words", F.col("runs").alias("item_runs"))
    both = join_documents(pairs.join(items_of, "item"), found.select("held", "doc_id", "at", "runs", "words"))
    scored = both.select("doc_id", "item_id", "at", "runs", "item_runs", "item_words", "words").mapInArrow(
        align, f"doc_id {id_type}, item_id {item_type}, score double, first_word int, last_word int"
    )
    best = F.max(F.struct("score", -F.col("first_word"), -F.col("last_word"))).alias("best")
    return scored.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", F.col("best.score").alias("score"),
        (-F.col("best.col2")).alias("first_word"), (-F.col("best.col3")).alias("last_word"),
    )


def op1_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Every document that holds a benchmark item, with the item, the score and the place."""
    return contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
