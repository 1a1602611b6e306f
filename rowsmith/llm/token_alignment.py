"""Alignment of two tokenizers: which tokens end together, and how often over the whole corpus.

Side A is a byte-level vocabulary, side B a sentencepiece model. Both tokenize a blank and the text.
Offsets in bytes where tokens of both sides end cut the text into groups; the two tokens that end
there are a link. The count of a pair of ids is the number of its links in all documents.

1. A task tokenizes its documents once and gathers blocks of about BLOCK_BYTES of text. A block's
   pair-document records are sorted by radix (a hash of the B id), B id, A id and document, and
   written to the shared folder as zstd runs: per radix a head (pairs and their links in the
   block) and a tail (documents and links of each pair). Rows of documents are written beside them.
2. Heads are dealt out by radix. A task takes one radix after another and merges its heads over a
   heap of their next B ids, FAN at a time, so it holds the counts of one radix and FAN heads:
   at most one radix's share of all pairs of the two vocabularies, whatever the corpus. As
   a B id's pairs come together, their maximum is known when they have been counted.
3. The counts answer the heads of their radix, one after another. Answers, tails and rows of
   documents are dealt out by block and pass in that order, so that a task holds one block: the
   tail's documents get their sums, and their rows go out whole.

A pair that is in every document is one record per block and radix, not one per document, on its way.

Null and empty texts, and texts whose tokens do not spell a blank and the text (as with U+2581 in
them), have no tokens: zeros and an empty string. Repeated rows are documents of their own, and so
are rows of a null id; ids of any type pass through. Very long texts are a block of their own. An
empty table gives an empty result. Only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import cut, table
from .secret_scan import PIECES
from .words import buffers, mixed, runs

VOCABULARY_A = "/opt/tokenizers/byte_bpe_50k.json"
VOCABULARY_B = "/opt/tokenizers/piece_bpe_32k.model"
BLOCK_BYTES = 8 << 20
BLOCK_DOCS = 1 << 16
RADIX_BITS = 8
FAN = 64
#: A pair is one number: radix, B id, A id.
ID_BITS = 24

BLOB = "block bigint, radix int, turn int, part binary"
NUMBERS = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint"


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as one zstd frame, each by bytes of equal weight."""
    parts = [np.array([len(a) for a in arrays], np.int64).tobytes()]
    for a in arrays:
        parts.append(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes())
    return zstandard.compress(b"".join(parts), 1)


def unpacked(data: bytes, kinds: Sequence[str]) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    sizes, at, arrays = raw[: 8 * len(kinds)].view(np.int64), 8 * len(kinds), []
    for n, kind in zip(sizes.tolist(), kinds):
        width = np.dtype(kind).itemsize
        planes = raw[at : at + n * width].reshape(width, n)
        arrays.append(np.ascontiguousarray(planes.T).view(kind).reshape(n))
        at += n * width
    return arrays


def run_of(keys: np.ndarray, counts: np.ndarray) -> bytes:
    return packed(np.diff(keys, prepend=0), counts)


def read_run(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    steps, counts = unpacked(data, ("i8", "i8"))
    return np.cumsum(steps), counts


def sides(keys: np.ndarray) -> np.ndarray:
    """The B ids of pairs, with their radix."""
    return keys >> ID_BITS


class Tokens:
    """Both tokenizers, and the bytes and the written forms of their ids."""

    def __init__(self, vocabulary_a: str, vocabulary_b: str):
        with open(vocabulary_a, encoding="utf-8") as file:
            known = json.load(file)
        special = {t["id"] for t in known["added_tokens"] if t["special"]}
        # The alphabet of byte-level vocabularies: printable bytes stand for themselves,
        # the others follow from U+0100 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in shown]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}
        ranks = {bytes(byte[c] for c in t): i for t, i in known["model"]["vocab"].items() if i not in special}
        self.a = tiktoken.Encoding("a", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=vocabulary_b)
        spelled_a = {i: t for t, i in ranks.items()}
        self.bytes_a = [spelled_a.get(i, b"") for i in range(max(spelled_a) + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in enumerate(pieces)
        ]
        self.sizes_a, self.sizes_b = (np.array(list(map(len, b)), np.int64) for b in (self.bytes_a, self.bytes_b))
        # Written forms: id and sign, A's inside and at the end of a group, then B's.
        forms = [(self.bytes_a, ",|"), (self.bytes_b, ",;")]
        self.forms = [f"{i}{sign}".encode() for ids, signs in forms for i in range(len(ids)) for sign in signs]
        self.first_b = 2 * len(self.bytes_a)

    def encoded(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """The ids of both sides; none for texts that they do not spell."""
        raw = [f" {t}".encode() if t else None for t in texts]
        a = [self.a.encode_ordinary(f" {t}") if t else [] for t in texts]
        b = self.b.encode(texts, num_threads=1) if texts else []
        bytes_a, bytes_b = self.bytes_a.__getitem__, self.bytes_b.__getitem__
        for i, r in enumerate(raw):
            if r is None or b"".join(map(bytes_a, a[i])) != r or b"".join(map(bytes_b, b[i])) != r:
                a[i], b[i] = [], []
        return a, b


def flat(ids: list[list[int]], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All ids, the n + 1 offsets of the texts, and where each token ends in all bytes."""
    every = np.fromiter(chain.from_iterable(ids), np.int64)
    return every, np.concatenate([[0], np.cumsum(list(map(len, ids)))]).astype(np.int64), np.cumsum(sizes[every])


def aligned(tokens: Tokens, texts: list[str]):
    """Per text: numbers of tokens of A and B, of groups, and the groups' digest; then the links.

    Links are the text's number, B's and A's id.
    """
    a, b = tokens.encoded(texts)
    (ids_a, at_a, ends_a), (ids_b, at_b, ends_b) = flat(a, tokens.sizes_a), flat(b, tokens.sizes_b)
    place = np.minimum(np.searchsorted(ends_a, ends_b), max(len(ends_a) - 1, 0))
    last_b = np.flatnonzero(ends_a[place] == ends_b) if len(ends_a) else np.zeros(0, np.int64)
    last_a = place[last_b]
    docs = np.searchsorted(at_b, last_b, "right") - 1
    # Both sides in one order: a group's tokens of A, then those of B.
    code_a, code_b = 2 * ids_a, 2 * ids_b + tokens.first_b
    code_a[last_a] += 1
    code_b[last_b] += 1
    order_a = np.arange(len(ids_a)) + np.concatenate([[0], last_b + 1])[np.searchsorted(last_a, np.arange(len(ids_a)))]
    order_b = np.arange(len(ids_b)) + (last_a + 1)[np.searchsorted(last_b, np.arange(len(ids_b)))]
    codes = np.empty(len(ids_a) + len(ids_b), np.int64)
    codes[order_a], codes[order_b] = code_a, code_b
    form, at = tokens.forms.__getitem__, at_a + at_b
    digests = [
        hashlib.sha256(b"".join(map(form, codes[x:y].tolist()))[:-1]).hexdigest() if y > x else ""
        for x, y in zip(at[:-1].tolist(), at[1:].tolist())
    ]
    numbers = np.diff(at_a), np.diff(at_b), np.bincount(docs, minlength=len(texts))
    return numbers, digests, (docs, ids_b[last_b], ids_a[last_a])


class Block:
    """Documents and links of one block, until it is written."""

    def __init__(self) -> None:
        self.rows: list[pa.RecordBatch] = []
        self.links: list[tuple[np.ndarray, np.ndarray]] = []
        self.bytes = self.docs = 0

    def add(self, ids: pa.Array, numbers, digests: list[str], links, size: int) -> None:
        docs, b, a = links
        radix = (mixed(b.astype(np.uint64)) >> np.uint64(64 - RADIX_BITS)).astype(np.int64)
        self.links.append((((radix << ID_BITS | b) << ID_BITS) | a, docs + self.docs))
        nth = pa.array(np.arange(len(ids)) + self.docs)
        n_a, n_b, groups = (pa.array(n.astype(np.int64)) for n in numbers)
        self.rows.append(pa.record_batch(
            [ids, nth, n_a, n_b, groups, groups, pa.array(digests, pa.string())],
            names=["doc_id", "nth", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"],
        ))
        self.bytes, self.docs = self.bytes + size, self.docs + len(ids)

    def parts(self) -> Iterator[tuple[int, bytes, bytes]]:
        """(radix, head, tail) of the block's records."""
        keys, docs = (np.concatenate(x) for x in zip(*self.links))
        if not len(keys):
            return
        pairs, which = np.unique(keys, return_inverse=True)
        records, links = np.unique(which * np.int64(self.docs) + docs, return_counts=True)
        which, docs = np.divmod(records, self.docs)
        radix = pairs >> (2 * ID_BITS)
        cuts = np.flatnonzero(np.diff(radix, prepend=-1, append=-1))
        held = np.searchsorted(which, np.arange(len(pairs) + 1))
        totals = np.add.reduceat(links, held[:-1])
        for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            own = slice(held[x], held[y])
            tail = packed(np.diff(held[x : y + 1]).astype(np.uint32), docs[own].astype(np.uint32), links[own].astype(np.uint32))
            yield int(radix[x]), run_of(pairs[x:y], totals[x:y]), tail


def split(first: int, last: int) -> Iterator[tuple[int, int]]:
    """A run of texts in parts that a block can hold."""
    for lo in range(first, last, BLOCK_DOCS):
        yield lo, min(last, lo + BLOCK_DOCS)


_tokens: dict[tuple[str, str], Tokens] = {}
HEAD, TAIL, ROWS = 1, 2, 3


def blocks_of(vocabulary_a: str, vocabulary_b: str, fields: pa.Schema):
    """Documents to the parts of blocks: rows of `BLOB` and the columns of documents."""

    def out(block: int, done: Block) -> Iterator[pa.RecordBatch]:
        blobs = [(r, turn, part) for r, *both in done.parts() for turn, part in zip((HEAD, TAIL), both)]
        for rows in (*done.rows, None):
            n = len(blobs) if rows is None else len(rows)
            columns = {
                "block": np.full(n, block),
                "radix": [r for r, _, _ in blobs] if rows is None else np.full(n, 1 << RADIX_BITS),
                "turn": [t for _, t, _ in blobs] if rows is None else np.full(n, ROWS),
                "part": [p for _, _, p in blobs] if rows is None else None,
            }
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(f.name) if rows is not None and f.name in rows.schema.names
                    else pa.nulls(n, f.type) if columns.get(f.name) is None
                    else pa.array(columns[f.name], f.type)
                    for f in fields
                ],
                schema=fields,
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = vocabulary_a, vocabulary_b
        if names not in _tokens:
            _tokens[names] = Tokens(*names)
        number, block = TaskContext.get().partitionId() << 32, Block()
        for batch in batches:
            column = batch.column("text")
            _, offsets = buffers(column)
            for lo, hi in (p for r in runs(offsets) for p in split(*r)):
                if block.docs and (block.bytes >= BLOCK_BYTES or block.docs + hi - lo > BLOCK_DOCS):
                    yield from out(number, block)
                    number, block = number + 1, Block()
                texts = [t or "" for t in column.slice(lo, hi - lo).to_pylist()]
                block.add(batch.column("doc_id").slice(lo, hi - lo), *aligned(_tokens[names], texts), int(offsets[hi] - offsets[lo]))
        if block.docs:
            yield from out(number, block)

    return run


def merged(heads: Iterable[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(pairs, counts) of one B id after another, from heads ordered by pair."""
    held, heap = [], []
    for head in heads:
        keys, counts = read_run(head)
        if len(keys):
            ids = sides(keys)
            cuts = np.flatnonzero(np.diff(ids, prepend=-1, append=-1)).tolist()
            heapq.heappush(heap, (int(ids[0]), len(held), 0))
            held.append((keys, counts, ids[cuts[:-1]].tolist(), cuts))
    while heap:
        b, found = heap[0][0], []
        while heap and heap[0][0] == b:
            _, n, step = heap[0]
            keys, counts, ids, cuts = held[n]
            found.append((keys[cuts[step] : cuts[step + 1]], counts[cuts[step] : cuts[step + 1]]))
            if step + 1 < len(ids):
                heapq.heapreplace(heap, (ids[step + 1], n, step + 1))
            else:
                heapq.heappop(heap)
        if len(found) == 1:
            yield found[0]
            continue
        keys, which = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
        counts = np.zeros(len(keys), np.int64)
        np.add.at(counts, which, np.concatenate([c for _, c in found]))
        yield keys, counts


def one_run(heads: list[bytes]) -> bytes:
    if len(heads) == 1:
        return heads[0]
    found = list(merged(heads))
    return run_of(np.concatenate([k for k, _ in found]), np.concatenate([c for _, c in found]))


def by_radix(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple]:
    for batch in batches:
        for i in range(len(batch)):
            yield tuple(batch.column(c)[i].as_py() for c in columns)


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Heads ordered by radix to one row per radix: pairs and counts, negative for the highest of a B id."""

    def total(radix: int, heads: list[bytes]) -> pa.RecordBatch:
        keys, counts = [], []
        for k, c in merged(heads):
            keys.append(k)
            counts.append(np.where(c == c.max(), -c, c))
        row = [[radix], [run_of(np.concatenate(keys), np.concatenate(counts))]]
        return pa.RecordBatch.from_arrays([pa.array(row[0], pa.int32()), pa.array(row[1], pa.binary())], names=["radix", "part"])

    now, heads = None, []
    for radix, head in by_radix(batches, ["radix", "part"]):
        if radix != now and heads:
            yield total(now, heads)
            heads = []
        now = radix
        heads.append(head)
        if len(heads) == FAN:
            heads = [one_run(heads)]
    if heads:
        yield total(now, heads)


def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a radix, then its heads: the counts of each head's pairs."""
    known: tuple[np.ndarray, np.ndarray] = (np.zeros(0), np.zeros(0))
    for batch in batches:
        rows: list[list] = [[], [], []]
        for block, radix, turn, part in by_radix(iter([batch]), ["block", "radix", "turn", "part"]):
            if turn != HEAD:
                known = read_run(part)
                continue
            keys, _ = read_run(part)
            found = known[1][np.searchsorted(known[0], keys)]
            for values, value in zip(rows, (block, radix, packed(found))):
                values.append(value)
        kinds = (pa.int64(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows, kinds)], names=["block", "radix", "part"])


def summed(fields: pa.Schema):
    """Answer and tail of each radix of a block, then the block's rows, which get their sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, counts, best, total = None, None, None, None
        for batch in batches:
            blocks, turns = batch.column("block").to_numpy(), batch.column("turn").to_numpy()
            cuts = np.flatnonzero((np.diff(blocks, prepend=-1) != 0) | (np.diff(turns, prepend=-1) != 0) | (turns != ROWS))
            for x, y in zip(cuts.tolist(), [*cuts[1:].tolist(), len(batch)]):
                if blocks[x] != now:
                    now = blocks[x]
                    best, total = np.zeros(BLOCK_DOCS, np.int64), np.zeros(BLOCK_DOCS, np.int64)
                if turns[x] == 0:
                    (counts,) = unpacked(batch.column("part")[x].as_py(), ["i8"])
                elif turns[x] == TAIL:
                    sizes, docs, links = unpacked(batch.column("part")[x].as_py(), ("u4", "u4", "u4"))
                    each, links = np.repeat(counts, sizes), links.astype(np.int64)
                    np.add.at(total, docs, np.abs(each) * links)
                    np.add.at(best, docs, np.where(each < 0, links, 0))
                else:
                    rows = batch.slice(x, y - x)
                    nth = rows.column("nth").to_numpy()
                    sums = {"n_best": pa.array(best[nth]), "count_sum": pa.array(total[nth])}
                    yield pa.RecordBatch.from_arrays(
                        [sums[f.name] if f.name in sums else rows.column(f.name) for f in fields], schema=fields
                    )

    return run


def align_tokens(df: DataFrame, vocabulary_a: str = VOCABULARY_A, vocabulary_b: str = VOCABULARY_B) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row of df."""
    kind = df.schema["doc_id"].dataType.simpleString()
    own = f"doc_id {kind}, {NUMBERS}, groups_sha256 string"

    def schema(ddl: str) -> pa.Schema:
        return to_arrow_schema(T.StructType.fromDDL(ddl))

    parts = f"{BLOB}, nth bigint, {own}"
    written = cut(df.select("doc_id", "text").mapInArrow(blocks_of(vocabulary_a, vocabulary_b, schema(parts)), parts))
    heads = written.where(F.col("turn") == HEAD).select("block", "radix", "turn", "part")
    counts = cut(
        heads.select("radix", "part").repartition("radix").sortWithinPartitions("radix")
        .mapInArrow(counted, "radix int, part binary")
    )
    asked = counts.select(F.lit(0).cast("bigint").alias("block"), "radix", F.lit(0).alias("turn"), "part").unionAll(heads)
    answers = (
        asked.repartition("radix").sortWithinPartitions("radix", "turn")
        .mapInArrow(answered, "block bigint, radix int, part binary")
    )
    rest = written.where(F.col("turn") != HEAD)
    answers = answers.withColumn("turn", F.lit(0))
    both = rest.unionByName(answers, allowMissingColumns=True)
    whole = f"doc_id {kind}, {NUMBERS}, n_best bigint, count_sum bigint, groups_sha256 string"
    return (
        both.repartition("block").sortWithinPartitions("block", "radix", "turn")
        .mapInArrow(summed(schema(whole)), whole)
    )


def op12_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens, groups and links of every document, and how common its links are over all documents."""
    return align_tokens(table(spark, folder, "documents"))
