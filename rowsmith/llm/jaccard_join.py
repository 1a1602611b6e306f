"""Exact Jaccard self-join of documents on word shingles, and its connected components.

A document's set is its distinct runs of five words (A-Z lowered; fewer words: the whole
sequence; none: the empty set, linked with nothing). Two documents link if the shingles in
both are at least 75 % of those in either. Documents of equal sets are one class from the
start (a class is known by a 64-bit hash of its set, a shingle by
40 bits and its bucket, one in 2**40 at most of those compared is mistaken for another).

1. Shingles meet by hash in binary blocks, one row per block and reducer. There each shingle
   learns in how many classes it is. Those of one class can't be in two sets: only their
   number counts from here on.
2. The shared shingles return to their class. Ordered rare first (those of one class come
   before all), a set of n has a prefix of n - ceil(0.75 n) + 1, and two sets that link have a
   shingle in both prefixes. A class whose prefix holds no shared shingle links with nothing.
3. Prefix shingles are joined. In each group of equal shingles one class, the hub, meets the
   others, which is linear in the group. Pairs must pass a length filter, a positional filter
   (what may still be in both after this shingle) and a suffix filter (how the rest falls
   into eight parts by hash). Each pair is verified once, on all shared shingles of both.
4. Components of the links so far make most groups of one piece. Groups of more than one
   go on with their next hub; after HUBS rounds all pairs across pieces that are left in a
   group are joined, so no link between components is missed.

Very common shingles: a shingle in more than one class in COMMON is found in the first pass,
before anything is shuffled (locally frequent ones are counted up). It takes no part in step 1,
and its rank is last, so no reducer gathers its classes. There are COMMON / 2 times the mean
set size of them at most.

Null texts are empty. Rows of a null id have no component. Repeated rows are one class and
share the smallest id, in the order of the id's type (integers, or text). Very long texts are cut into
words whole. Empty tables give empty results. Other columns pass through `deduplicate`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from .common import cut, table
from .words import mixed, shingle_sets

WORDS = 5
#: Links need this percentage.
PERCENT = 75
#: Rounds with one hub per group before the comparison in blocks.
HUBS = 2
#: Classes in a block of the comparison that follows.
BLOCK = 1024
COMMON = 128
#: Shingles of one task are sent on when so many are gathered.
GATHERED = 1 << 21
PARTS = 8
#: Bytes of a shingle that are sent besides its bucket. Two shingles of two sets that may link
#: are taken for one with a chance of 2**-40 at most.
SENT = 5
#: Shingles in a bucket, about, if there are more of them than shuffle partitions have room for.
BUCKET = 1 << 22
TOP = np.iinfo(np.int32).max

SETS = "text_hash bigint, class bigint, n bigint, shingle bigint, times bigint"
BLOCKS = "bucket int, classes binary, sizes binary, counts binary, shingles binary, common boolean"
SHARED = "bucket int, classes binary, sizes binary, shingles binary, times binary"
SIDES = "node bigint, other bigint"
RECORDS = "class bigint, n int, alone int, shared array<bigint>, prefix int, suffixes array<array<int>>"


def class_of(shingles: np.ndarray) -> int:
    """The class of a set: a hash of its sum, its mixed sum and its size."""
    a = int(shingles.sum(dtype=np.uint64))
    b = int(mixed(shingles).sum(dtype=np.uint64))
    both = mixed(np.array([a, b ^ len(shingles)], np.uint64))
    return int(mixed(both[:1] * np.uint64(31) + both[1:]).astype(np.int64)[0])


def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Class and size of each document, and locally common shingles with their counts."""
    for batch in batches:
        classes, sizes, found = [], [], {}
        for shingles in shingle_sets(batch.column("text"), WORDS):
            sizes.append(len(shingles))
            classes.append(class_of(shingles) if len(shingles) else None)
            if len(shingles):
                found[classes[-1]] = shingles
        ids = batch.column("id")
        none = pa.nulls(len(ids), pa.int64())
        known = [ids, batch.column("text_hash"), pa.array(classes, pa.int64()), pa.array(sizes, pa.int64())]
        yield pa.RecordBatch.from_arrays([*known, none, none], names=SETS_NAMES)
        if len(found) >= COMMON // 4:
            values, times = np.unique(np.concatenate(list(found.values())), return_counts=True)
            often = times * COMMON >= len(found)
            none = pa.nulls(int(often.sum()), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(none), ids.type), none, none, none, pa.array(values[often].view(np.int64)), pa.array(times[often])], names=SETS_NAMES
            )


SETS_NAMES = ["id", "text_hash", "class", "n", "shingle", "times"]


def packed(values: np.ndarray) -> bytes:
    """The low SENT bytes of each value: the bucket stands for the high ones."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :SENT].tobytes()


def unpacked(data: list[bytes], bucket: int) -> np.ndarray:
    low = np.frombuffer(b"".join(data), np.uint8).reshape(-1, SENT)
    out = np.zeros((len(low), 8), np.uint8)
    out[:, :SENT] = low
    return out.view("<u8").ravel() | np.uint64(bucket << 8 * SENT)


def blocks(buckets: int, common: np.ndarray):
    """Shingles of classes in blocks by bucket; common ones by class, marked."""

    def rows(sizes: list[int], classes: list[int], shingles: np.ndarray) -> pa.RecordBatch:
        lengths = np.array(sizes)
        of = np.repeat(np.arange(len(lengths)), lengths)
        known = np.array(classes, np.int64)
        is_common = np.isin(shingles, common) if len(common) else np.zeros(len(shingles), bool)
        # The low bytes travel; the bucket, set from the high ones, stands for them.
        bucket = ((shingles >> np.uint64(8 * SENT)) % np.uint64(buckets)).astype(np.int64)
        bucket[is_common] = known.view(np.uint64)[of[is_common]] % np.uint64(buckets)
        order = np.lexsort((of, bucket + buckets * is_common))
        key = (bucket + buckets * is_common)[order]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else []
        columns: list[list] = [[], [], [], [], [], []]
        for lo, hi in zip(starts, [*starts[1:], len(key)]):
            members, counts = np.unique(of[order[lo:hi]], return_counts=True)
            hashes = shingles[order[lo:hi]]
            often = bool(key[lo] >= buckets)
            row = (
                int(key[lo] % buckets), known[members].tobytes(), lengths[members].astype(np.int32).tobytes(),
                counts.astype(np.int32).tobytes(), hashes.tobytes() if often else packed(hashes), often,
            )
            for values, value in zip(columns, row):
                values.append(value)
        types = [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.bool_()]
        return pa.RecordBatch.from_arrays(
            [pa.array(v, t) for v, t in zip(columns, types)], names=["bucket", "classes", "sizes", "counts", "shingles", "common"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        total = 0
        for batch in batches:
            for shingles in shingle_sets(batch.column("text"), WORDS):
                if len(shingles):
                    held[class_of(shingles)] = shingles
                    total += len(shingles)
                if total >= GATHERED:
                    yield rows([len(x) for x in held.values()], list(held), np.concatenate(list(held.values())))
                    held, total = {}, 0
        if held:
            yield rows([len(x) for x in held.values()], list(held), np.concatenate(list(held.values())))

    return run


def ints(column: pa.Array, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def count_classes(buckets: int):
    """Of the blocks of one bucket: the shingles that are in two classes or more, by class."""

    def run(group: pa.Table) -> pa.Table:
        bucket = group.column("bucket")[0].as_py()
        common = group.column("common").to_numpy()
        parts = []
        for often in (False, True):
            part = group.filter(pa.array(common == often))
            data = part.column("shingles").to_pylist()
            shingles = ints(part.column("shingles"), "<u8") if often else unpacked(data, bucket)
            counts = ints(part.column("counts"), np.int32)
            classes = np.repeat(ints(part.column("classes"), np.int64), counts)
            sizes = np.repeat(ints(part.column("sizes"), np.int32), counts)
            if not often:
                # A shingle that is here once is in one class only.
                order = np.argsort(shingles, kind="stable")
                ranked = shingles[order]
                twice = np.zeros(len(ranked), bool)
                same = ranked[1:] == ranked[:-1]
                twice[1:] |= same
                twice[:-1] |= same
                order = order[twice]
                shingles, classes, sizes = shingles[order], classes[order], sizes[order]
            order = np.lexsort((classes, shingles))
            shingles, classes, sizes = shingles[order], classes[order], sizes[order]
            if len(shingles):
                # Copies of a text are one class.
                new = np.concatenate([[True], (shingles[1:] != shingles[:-1]) | (classes[1:] != classes[:-1])])
                shingles, classes, sizes = shingles[new], classes[new], sizes[new]
            first = np.concatenate([[True], shingles[1:] != shingles[:-1]])[: len(shingles)]
            times = np.bincount(np.cumsum(first) - 1, minlength=1)[np.cumsum(first) - 1] if len(shingles) else np.zeros(0, int)
            times = np.full(len(times), TOP) if often else times
            keep = times > 1
            parts.append((classes[keep], sizes[keep], shingles[keep], times[keep].astype(np.int32)))
        classes, sizes, shingles, times = (np.concatenate(x) for x in zip(*parts))
        home = classes.view(np.uint64) % np.uint64(buckets)
        columns: list[list] = [[], [], [], [], []]
        order = np.argsort(home, kind="stable")
        cuts = np.flatnonzero(np.concatenate([[True], np.diff(home[order].astype(np.int64)) != 0]))[: len(order)] if len(order) else []
        for lo, hi in zip(cuts, [*cuts[1:], len(order)]):
            at = order[lo:hi]
            row = (int(home[at[0]]), classes[at].tobytes(), sizes[at].tobytes(), shingles[at].tobytes(), times[at].tobytes())
            for values, value in zip(columns, row):
                values.append(value)
        types = [pa.int32()] + [pa.binary()] * 4
        return pa.table([pa.array(v, t) for v, t in zip(columns, types)], names=["bucket", "classes", "sizes", "shingles", "times"])

    return run


def records(group: pa.Table) -> pa.Table:
    """Of the shared shingles of one bucket of classes: classes whose prefix holds any."""
    classes, sizes = ints(group.column("classes"), np.int64), ints(group.column("sizes"), np.int32)
    shingles, times = ints(group.column("shingles"), "<u8"), ints(group.column("times"), np.int32)
    order = np.lexsort((shingles, times, classes))
    classes, sizes, shingles = classes[order], sizes[order].astype(np.int64), shingles[order]
    starts = np.flatnonzero(np.concatenate([[True], classes[1:] != classes[:-1]]))[: len(classes)]
    n, k = sizes[starts], np.diff([*starts, len(classes)])
    prefix = n - (n * PERCENT + 99) // 100 + 1 - (n - k)
    rows = []
    for at, size, count, length in zip(starts.tolist(), n.tolist(), k.tolist(), prefix.tolist()):
        if length > 0:
            own = shingles[at : at + count]
            part = np.eye(PARTS, dtype=np.int32)[(own & np.uint64(PARTS - 1)).astype(np.int64)]
            after = part.sum(0) - np.cumsum(part[:length], 0)
            rows.append((int(classes[at]), size, size - count, own.view(np.int64), length, after.tolist()))
    types = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.int32(), pa.list_(pa.list_(pa.int32()))]
    names = ["class", "n", "alone", "shared", "prefix", "suffixes"]
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


def prefix_records(docs: DataFrame, common: np.ndarray, buckets: int) -> DataFrame:
    """Steps 1 and 2: the classes that may link, with their shared shingles, rare first."""
    sent = docs.mapInArrow(blocks(buckets, common), BLOCKS)
    shared = sent.groupBy("bucket").applyInArrow(count_classes(buckets), SHARED)
    return shared.groupBy("bucket").applyInArrow(records, RECORDS)


PERCENT_OF = f"100 * {{both}} >= {PERCENT} * (a.n + b.n - {{both}})"
#: rank: the place among the shared shingles, from 1. Before it at most rank - 1 are in both.
MAY_LINK = " AND ".join([
    f"100 * least(a.n, b.n) >= {PERCENT} * greatest(a.n, b.n)",
    PERCENT_OF.format(both="(least(a.rank, b.rank) + least(a.k - a.rank, b.k - b.rank))"),
    PERCENT_OF.format(both="(least(a.rank, b.rank) + aggregate(zip_with(a.suffix, b.suffix, (x, y) -> least(x, y)), 0, (s, x) -> s + x))"),
])


def links(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are alike enough: both are counted on the shared shingles."""
    sides = known.select("class", "n", "shared")
    return (
        pairs.join(sides.toDF("a", "a_n", "a_shared"), "a")
        .join(sides.toDF("b", "b_n", "b_shared"), "b")
        .withColumn("both", F.size(F.array_intersect("a_shared", "b_shared")))
        .where(f"100 * both >= {PERCENT} * (a_n + b_n - both)")
        .select("a", "b")
    )


def smallest(a: np.ndarray, b: np.ndarray, nodes: int) -> np.ndarray:
    """The smallest of the nodes 0, 1, ... that each is connected with by the edges (a, b)."""
    root = np.arange(nodes)
    while True:
        a, b = root[a], root[b]
        apart = a != b
        if not apart.any():
            return root
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]


def stars(two: bool):
    """The edges (node, other) of a task as stars: all nodes that they connect with the smallest of these.

    Whatever edges a task holds, these stars connect the same nodes. two: each comes from both ends, else the
    larger end is the node. At most GATHERED edges are held at a time.
    """

    def joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        nodes, place = np.unique(np.concatenate([x.column(i).to_numpy() for i in (0, 1) for x in held]), return_inverse=True)
        root = smallest(*np.split(place, 2), len(nodes))
        high = np.flatnonzero(root != np.arange(len(nodes)))
        high, low = nodes[high], nodes[root[high]]
        sides = [(high, low), (low, high)] if two else [(high, low)]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*sides)], names=["node", "other"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) >= GATHERED:
                yield joined(held)
                held = []
        if held:
            yield joined(held)

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of an edge (of two nodes): root is the smallest node it is connected with.

    Tasks turn their edges into stars: as they lie, met in both their nodes, and met in their larger one.
    Mostly each component is one star then. If not, rounds follow on what is left, each of which gives a
    node the smallest root among its neighbours, then the root of that root; these are logarithmic in
    practice. A round is many stages, and the driver keeps something of every task.
    """
    met = edges.select(F.col("b").alias("node"), F.col("a").alias("other")).mapInArrow(stars(True), SIDES)
    for two in (False, True):
        # Any dealing is right, so adaptive execution may split the edges of a node that very many have.
        met = met.hint("rebalance", F.col("node")).mapInArrow(stars(two), SIDES)
    both = cut(met).toDF("a", "b")
    ends = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"), F.max("b").alias("high")))
    roots = ends.select("node", F.least("node", "low").alias("root"))
    # In a star all neighbours are larger, or there is one.
    if ends.where("low < node AND low < high").isEmpty():
        return roots
    while True:
        near = both.join(roots, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("least"))
        lower = roots.join(near, F.col("node") == F.col("a"), "left").select(
            "node", F.col("root").alias("old"), F.least("root", F.coalesce("least", "root")).alias("root")
        )
        up = roots.select(F.col("node").alias("of"), F.col("root").alias("above"))
        jumped = cut(
            lower.join(up, F.col("root") == F.col("of"), "left")
            .select("node", "old", F.least("root", F.coalesce("above", "root")).alias("root"))
        )
        roots = jumped.select("node", "root")
        if jumped.where("root < old").isEmpty():
            return roots


def connect(roots: DataFrame, made: DataFrame) -> DataFrame:
    """The components (node, root) after more edges."""
    if made.isEmpty():
        return roots
    return components(made.union(roots.where("root < node").select("root", "node")))


def connected(known: DataFrame) -> DataFrame:
    """Steps 3 and 4: (node, root) of the classes that link with another."""
    entries = cut(
        known.select(
            "class", "n", (F.col("n") - F.col("alone")).alias("k"),
            F.posexplode(F.arrays_zip(F.expr("slice(shared, 1, prefix)").alias("shingle"), F.col("suffixes").alias("suffix"))).alias("at", "e"),
        ).select("class", "n", "k", F.col("e.shingle").alias("shingle"), (F.col("at") + 1).alias("rank"), F.col("e.suffix").alias("suffix"))
    )
    roots = None
    left = entries.withColumn("root", F.col("class"))
    for turn in range(HUBS + 1):
        groups = left.groupBy("shingle").agg(
            F.min("root").alias("low"), F.max("root").alias("high"),
            F.min(F.struct("class", "root", "n", "k", "rank", "suffix")).alias("hub"),
        ).where("low < high")
        # The hash beside the key lets adaptive execution split a shingle that many classes have.
        same = F.expr("b.shingle = of AND xxhash64(b.shingle) = xxhash64(of)")
        open_ = left.alias("b").join(groups.select(F.col("shingle").alias("of"), "hub"), same).where("b.class > hub.class")
        if turn == HUBS:
            families = components(open_.select(F.col("hub.class").alias("a"), F.col("b.class").alias("b")))
            return connect(roots, cut(blockwise(families, roots, known)))
        met = open_.where("b.root <> hub.root").where(MAY_LINK.replace("a.", "hub."))
        pairs = met.select(F.col("hub.class").alias("a"), F.col("b.class").alias("b")).distinct()
        made = cut(links(pairs, known))
        roots = components(made) if roots is None else connect(roots, made)
        # Hubs are done with; the others go on where their group is not yet one piece.
        rest = open_.select("b.class", "b.n", "b.k", "b.shingle", "b.rank", "b.suffix")
        left = cut(
            rest.join(roots, F.col("class") == F.col("node"), "left")
            .select(rest["*"], F.coalesce("root", "class").alias("root"))
        )
        if left.isEmpty():
            return roots


def compare(group: pa.Table) -> pa.Table:
    """Links between pieces in one pair of blocks; one for every two pieces that have any.

    Shared shingles are counted by an index of the blocks. Classes of the largest piece needn't
    be looked up: the others meet them.
    """
    classes, pieces = group.column("class").to_numpy(), group.column("piece").to_numpy()
    sizes, own = group.column("n").to_numpy().astype(np.int64), group.column("own").to_numpy()
    across = group.column("i")[0].as_py() != group.column("j")[0].as_py()
    shared = group.column("shared").combine_chunks()
    flat, lengths = shared.flatten().to_numpy(), shared.value_lengths().to_numpy()
    ends = np.cumsum(lengths)
    _, place = np.unique(flat, return_inverse=True)
    index = np.repeat(np.arange(len(classes)), lengths)[np.argsort(place, kind="stable")]
    held = np.bincount(place)
    starts = np.cumsum(held) - held
    _, piece, counts = np.unique(pieces, return_inverse=True, return_counts=True)
    found = {}
    for x in np.flatnonzero(piece != counts.argmax()):
        mine = place[ends[x] - lengths[x] : ends[x]]
        hit = np.concatenate([index[starts[p] : starts[p] + held[p]] for p in mine]) if len(mine) else mine
        both = np.bincount(hit, minlength=len(classes))
        linked = (100 * both >= PERCENT * (sizes + sizes[x] - both)) & (piece != piece[x])
        if across:
            linked &= own != own[x]
        for y in np.flatnonzero(linked):
            found.setdefault((min(piece[x], piece[y]), max(piece[x], piece[y])), (classes[x], classes[y]))
    rows = list(found.values())
    return pa.table({"a": pa.array([min(r) for r in rows], pa.int64()), "b": pa.array([max(r) for r in rows], pa.int64())})


def blockwise(families: DataFrame, roots: DataFrame, known: DataFrame) -> DataFrame:
    """Links between pieces among the classes of a family, found block by block.

    A family holds all classes that may link through the groups that are left. It is dealt into
    blocks of about BLOCK classes, and each pair of blocks is one task's work; only links come out.
    """
    sizes = families.groupBy(F.col("root").alias("of")).agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    members = (
        families.withColumnRenamed("root", "family").join(sizes, F.expr("family = of AND xxhash64(family) = xxhash64(of)"))
        .join(roots.toDF("at", "piece"), F.col("node") == F.col("at"), "left")
        .withColumn("own", F.expr("pmod(xxhash64(node), blocks)"))
        .select("family", "node", F.coalesce("piece", "node").alias("piece"), "own", F.expr("explode(sequence(0L, blocks - 1))").alias("other"))
        .join(known.select("class", "n", "shared"), F.col("node") == F.col("class"))
        .select("family", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "class", "piece", "own", "n", "shared")
    )
    return members.groupBy("family", "i", "j").applyInArrow(compare, "a bigint, b bigint")


def id_of(df: DataFrame, key: str) -> Column:
    """The key, integers as the widest of them; others stay as they are and are ordered as Spark orders them."""
    integers = (T.ByteType, T.ShortType, T.IntegerType)
    return df[key].cast("bigint") if isinstance(df.schema[key].dataType, integers) else df[key]


def jaccard_components(df: DataFrame, key: str = "doc_id", text: str = "text", pieces: bool = False) -> DataFrame:
    """id, text_hash, n_shingles and component_id (the smallest id reachable by links) of every row.

    text_hash is Spark's xxhash64 of the text: with the id it tells rows of one id apart. With
    pieces, also a class of the component, the same for all its rows; null for empty sets.
    """
    piece = ["piece"] if pieces else []
    spark = df.sparkSession
    docs = df.select(id_of(df, key).alias("id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    first = cut(docs.mapInArrow(sets, f"id {docs.schema['id'].dataType.simpleString()}, {SETS}"))
    rows = first.where("n IS NOT NULL").select("id", "text_hash", "class", "n")
    total, shingles = rows.agg(F.count("class"), F.coalesce(F.sum("n"), F.lit(0))).first()
    # Buckets grow with the shingles, so that one task holds a bounded number at a time.
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = min(1 << 8 * (8 - SENT), max(partitions, -(-shingles // BUCKET)))
    often = first.where("shingle IS NOT NULL").groupBy("shingle").agg(F.sum("times").alias("times"))
    # At most COMMON times the mean set size.
    common = often.where(F.col("times") * COMMON >= total).select("shingle").toArrow().column(0).to_numpy()
    known = cut(prefix_records(docs.select("text"), np.sort(common.view(np.uint64)), buckets))
    roots = connected(known)
    least = rows.where("class IS NOT NULL").groupBy("class").agg(F.min("id").alias("least"))
    joined = roots.join(least, F.col("node") == F.col("class"))
    whole = joined.groupBy(F.col("root").alias("of")).agg(F.min("least").alias("whole"))
    places = cut(roots.join(whole, F.col("root") == F.col("of")).select(F.col("node"), "whole", *[F.col("root").alias(p) for p in piece]))
    classes = cut(least.join(places, F.col("class") == F.col("node"), "left").select(F.col("class").alias("of"), F.coalesce("whole", "least").alias("component"), *[F.coalesce(p, "class").alias(p) for p in piece]))
    return rows.join(classes, F.col("class") == F.col("of"), "left").select(
        "id", "text_hash", F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"), *piece,
    )


def op6_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """Set size and component of every document."""
    found = jaccard_components(table(spark, folder, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def deduplicate(df: DataFrame) -> DataFrame:
    """One row of each component: that of the smallest doc_id, of its texts that of the smallest hash.

    Rows without an id come after all others. Empty sets are linked with nothing: equal rows of
    them stay once. All columns stay.
    """
    found = cut(jaccard_components(df, pieces=True).select("id", "text_hash", "component_id", "piece"))
    # Few rows of a component can be the one that stays, unless ids are null or repeated.
    left = found.where("piece IS NOT NULL AND (id IS NULL OR id = component_id)").select("id", "text_hash", "piece").distinct()
    best = left.groupBy(F.col("piece").alias("of")).agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_hash")).alias("best"))
    others = left.join(best, F.col("piece") == F.col("of")).where("NOT (id <=> best.id AND text_hash = best.text_hash)")
    gone = found.where("id <> component_id").select("id", "text_hash").union(others.select("id", "text_hash"))
    gone = gone.select(F.col("id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    rows = df.select(F.struct(*[df[c] for c in df.columns]).alias("row"), id_of(df, "doc_id").alias("id"), F.xxhash64("text").alias("hash"))
    kept = rows.join(gone, F.expr("id <=> _id AND hash = _hash"), "left_anti")
    once = Window.partitionBy("id", "hash").orderBy(F.lit(0))
    kept = kept.withColumn("copy", F.row_number().over(once)).where("copy = 1")
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in df.columns])


#: All pairs that share a shingle, counted; then what is reachable from each document.
OP6_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM w
), t AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s
), l AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM t a JOIN t b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))
), r AS (
  SELECT doc_id AS x, doc_id AS y FROM s
  UNION
  SELECT r.x, l.y FROM r JOIN l ON r.y = l.x
)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, c.component_id
FROM s JOIN (SELECT x, min(y) AS component_id FROM r GROUP BY x) c ON c.x = s.doc_id"""
