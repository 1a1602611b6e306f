"""Bottom-k fingerprints of documents, from Spark's own functions only.

A document's set is its distinct runs of five words (lower case, words between white
space; fewer words: the whole sequence as one run; no words: the empty set). Its fingerprint
is the K smallest 64-bit hashes of the set, in unsigned order, or all if there are fewer.

The K smallest of the union of sets are the K smallest of their fingerprints, so
fingerprints of parts merge into that of the whole (`merge_by`). Of the K smallest of two
fingerprints together, the share that is in both estimates resemblance; with the counts of
distinct shingles this gives containment. A fingerprint of fewer than K hashes is the whole
set, and its figures are exact.

Nulls and empty texts have the empty fingerprint; two empty ones have resemblance 1, an
empty and another 0. Equal texts have equal fingerprints, so have repeated rows. Rows of a null id
come after all others in `with_next`. Very long texts are hashed whole. An empty table gives an empty
result. Columns of df other than those named may have any name that does not begin with an underscore.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import bounds, bucket, order_key, table, text_or_empty

K = 128
WORDS = 5


def word_hashes(text: Column) -> Column:
    """The hashes of the words in order."""
    words = F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def sketch(hashes: str, size: int = WORDS, k: int = K) -> Column:
    """The fingerprint, an ascending array<bigint>, from a column of word hashes.

    xxhash64 is signed; its signed order serves as well as the unsigned one.
    """
    run = ", ".join(f"{hashes}[i + {n}]" for n in range(size))
    return F.expr(
        f"""CASE WHEN size({hashes}) = 0 THEN cast(array() AS array<bigint>)
        WHEN size({hashes}) < {size} THEN array(xxhash64({hashes}))
        ELSE slice(sort_array(array_distinct(
          transform(sequence(0, size({hashes}) - {size}), i -> xxhash64({run})))), 1, {k}) END"""
    )


def resemblance(a: str, b: str, k: int = K) -> Column:
    """The estimated share of the union of two sets that is in both."""
    return F.expr(
        f"""CASE WHEN size({a}) = 0 AND size({b}) = 0 THEN 1D
        WHEN size({a}) = 0 OR size({b}) = 0 THEN 0D
        ELSE cast(size(array_intersect(slice(sort_array(array_union({a}, {b})), 1, {k}),
                                       array_intersect({a}, {b}))) AS double)
             / least({k}, size(array_union({a}, {b}))) END"""
    )


def distinct_count(a: str, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below k, else from the k-th hash."""
    place = f"((element_at({a}, {k}) / 18446744073709551616D) + 0.5D)"
    return F.expr(f"CASE WHEN size({a}) < {k} THEN cast(size({a}) AS double) ELSE {k - 1} / {place} END")


def containment(a: str, b: str, k: int = K) -> Column:
    """Estimated share of the first set that is in the second; 0 for an empty first set.

    With resemblance r and counts m and n, the intersection is r * (m + n) / (1 + r).
    """
    r, m, n = resemblance(a, b, k), distinct_count(a, k), distinct_count(b, k)
    return F.when(m == 0, 0.0).otherwise(F.least(F.lit(1.0), r * (m + n) / (1 + r) / m))


def encoded(a: str) -> Column:
    """A fingerprint as text: base64 of its hashes, eight bytes each."""
    return F.base64(F.unhex(F.array_join(F.transform(F.col(a), lambda h: F.lpad(F.hex(h), 16, "0")), "")))


def merge_by(df: DataFrame, by: str, fingerprint: str, k: int = K) -> DataFrame:
    """One fingerprint per value of `by`: that of the union of its sets.

    Equal hashes fall together before the shuffle, and the rank is limited before it, so a
    value with a third of all rows sends k hashes from each task.
    """
    each = df.select(by, F.explode(fingerprint).alias("_hash")).groupBy(by, "_hash").count()
    rank = F.row_number().over(Window.partitionBy(by).orderBy("_hash"))
    least = each.withColumn("_rank", rank).where(F.col("_rank") <= k)
    merged = least.groupBy(by).agg(F.sort_array(F.collect_list("_hash")).alias(fingerprint))
    empty = df.groupBy(by).count().select(F.col(by).alias("_by"))
    return empty.join(merged, F.col("_by").eqNullSafe(F.col(by)), "left").select(
        F.col("_by").alias(by),
        F.coalesce(fingerprint, F.array().cast("array<bigint>")).alias(fingerprint),
    )


def with_next(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Each row with next_<column> of the row after it by key; after the last comes the first.

    Rows go once through a shuffle, to their order bucket. The first row of a bucket also
    goes to the bucket before it, as its end, and is not returned there. Rows without a key
    come last; equal keys are ordered by the checksum of the first column, then by the columns. Keys
    that are no integers go by hash.
    """
    tie = F.crc32(F.col(columns[0]).cast("binary"))
    placed = df.withColumns({"_order": order_key(df, key), "_tie": tie})
    placed = placed.withColumn("_bucket", bucket(F.col("_order"), bounds(df, key), F.col("_tie")))
    # One row per order bucket.
    starts = sorted((r[0], r[1]) for r in placed.groupBy("_bucket").agg(F.min("_order")).collect())
    heads = [b for b, _ in starts] or [0]
    pairs = ", ".join(f"{b}L, {heads[i - 1]}L" for i, b in enumerate(heads))
    before = F.expr(f"map({pairs})")
    first = F.col("_order").isNull() | F.col("_order").isin([m for _, m in starts if m is not None])
    here = F.struct(F.col("_bucket").alias("bucket"), F.lit(False).alias("end"))
    there = F.struct(F.element_at(before, F.col("_bucket")).alias("bucket"), F.lit(True).alias("end"))
    spread = placed.withColumn("_place", F.explode(F.when(first, F.array(here, there)).otherwise(F.array(here))))
    order = Window.partitionBy("_place.bucket").orderBy(
        "_place.end", F.col("_order").asc_nulls_last(), "_tie", *[F.col(c).asc_nulls_first() for c in columns]
    )
    nexts = [F.lead(c).over(order).alias(f"next_{c}") for c in columns]
    return spread.select("*", *nexts).where("NOT _place.end").drop("_bucket", "_place", "_order", "_tie")


def edited(text: str, after: str) -> Column:
    """The text whose last quarter (rounded down) is the first as many of the next text."""
    part = f"char_length({text}) div 4"
    return F.expr(
        f"concat(substring({text}, 1, int(char_length({text}) - {part})), substring({after}, 1, int({part})))"
    )


def op3_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness."""
    docs = table(spark, folder, "documents").select("doc_id", text_or_empty().alias("text"))
    docs = docs.select("doc_id", "text", word_hashes(F.col("text")).alias("words"))
    docs = docs.select("doc_id", "text", sketch("words").alias("print"))
    pairs = with_next(docs, "doc_id", ["text", "print"])
    pairs = pairs.withColumn("edited", edited("text", "next_text"))
    pairs = pairs.select(
        "doc_id", F.char_length("text").cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        "print", "next_print", word_hashes(F.col("edited")).alias("words"),
    )
    pairs = pairs.select("*", sketch("words").alias("edited_print"))
    return pairs.select(
        "doc_id", "n_chars", "edited_sha256",
        encoded("print").alias("fingerprint"), encoded("edited_print").alias("edited_fingerprint"),
        resemblance("print", "edited_print").alias("near_edited"),
        resemblance("print", "next_print").alias("near_next"),
        containment("print", "edited_print").alias("contained_edited"),
        distinct_count("print").alias("n_shingles"),
    )
