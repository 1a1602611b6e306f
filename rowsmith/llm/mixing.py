"""Mixing sources to target weights by systematic sampling.

Sources in the order of their names (by code point, null last) weigh 5, 2, 1, repeating.
They share BUDGET times the words of all documents by weight; no source gives more than
CAP times its own words, and what it can't give is shared by the others, by weight. So the
target of a source is the smaller of CAP times its words and weight times one common level.

Within a source every document has the same expected number of copies, target / words. In
the order of size class, doc_id and checksum, their running sum plus one random offset per
source is taken, and a document is emitted once for each integer crossed. As neighbours in
that order are alike in size, the words taken miss the target by about one document.

Ranks come from totals: documents are counted per (source, size class, order bucket), the
counts are summed within the source (at most CLASSES * buckets of them, whatever the size of
the source), and documents are ranked within their group. Copies are exact integer
arithmetic, so reruns agree.

Nulls: a null text has no words, a null source is a source of its own, a null id is last in
its group, an id that is no integer goes by hash. Documents without words are emitted at the rate
of their source. If no document has words, nothing is emitted. Repeated rows are documents of their
own. Very long texts are a size class of few. An empty table gives an empty result. Other columns
pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import bounds, bucket, cut, order_key, table, text_or_empty

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
CAP = 2
SEED = "mix"
#: Copies per document are kept in units of 2**-RATE_BITS.
RATE_BITS = 24


def word_count(text: str = "text") -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def size_class(size: str) -> Column:
    """Sizes of one class differ by an eighth at most: the bit length and the next three bits."""
    return F.expr(
        f"(char_length(bin({size})) * 16 + ({size} * 16) div shiftleft(1L, char_length(bin({size}))))"
    ).cast("int")


def targets(sizes: DataFrame, source: str = "source", words: str = "words") -> DataFrame:
    """Columns source, words, target: the words to take from each source.

    sizes has one row per source. A source is full if its cap is below the common level; in
    the order of cap per weight, the full ones come first. The windows are over sources.
    """
    rank = F.row_number().over(Window.orderBy(F.col(source).asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), ((rank - 1) % len(WEIGHTS) + 1).cast("int"))
    first = Window.orderBy(F.col("_cap") / F.col("_weight"), F.col(source).asc_nulls_last())
    before, after = first.rowsBetween(Window.unboundedPreceding, -1), first.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    shared = (
        sizes.select(source, words, (F.col(words) * CAP).alias("_cap"), weight.alias("_weight"))
        .withColumn("_total", F.sum(words).over(everything) * F.lit(BUDGET))
        .withColumn("_left", F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0)))
        .withColumn("_weights", F.sum("_weight").over(after))
        .withColumn("_open", F.col("_cap") * F.col("_weights") > F.col("_left") * F.col("_weight"))
        # The level at the first source that is not full holds for all after it.
        .withColumn("_at", F.when(F.col("_open"), F.struct((F.col("_cap") / F.col("_weight")).alias("_ratio"), "_left", "_weights")))
        .withColumn("_level", F.min("_at").over(everything))
    )
    level = F.col("_level._left") * F.col("_weight") / F.col("_level._weights")
    return shared.select(
        source, words, F.when(F.col("_open"), level).otherwise(F.col("_cap")).cast("double").alias("target")
    )


def mix_counts(df: DataFrame, size: Column, tie: Column, key: str = "doc_id", source: str = "source") -> DataFrame:
    """Every row of df as struct `row`, with size, source_size, target and copies."""
    rows = df.select(
        F.struct(*[df[c] for c in df.columns]).alias("row"), F.col(source).alias("source"),
        size.alias("size"), order_key(df, key).alias("key"), tie.alias("tie"),
        F.coalesce(F.concat(F.lit("="), source), F.lit("null")).alias("tag"),
        bucket(order_key(df, key), bounds(df, key), tie).alias("bucket"),
    ).withColumn("class", size_class("size"))
    group = ["tag", "class", "bucket"]
    counts = rows.groupBy(group).agg(F.count("*").alias("n"), F.sum("size").alias("words"), F.first("source").alias("source"))
    sources = targets(counts.groupBy("tag").agg(F.sum("words").alias("words"), F.first("source").alias("source")))
    ahead = Window.partitionBy("tag").orderBy("class", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    unit = 1 << RATE_BITS
    digits = F.substring(F.md5(F.concat(F.lit(SEED), F.coalesce("source", F.lit("")))), 1, RATE_BITS // 4)
    rates = sources.select(
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("null")).alias("tag"),
        F.col("words").alias("source_size"), "target",
        F.when(F.col("words") > 0, F.floor(F.col("target") / F.col("words") * unit)).otherwise(0).alias("rate"),
        F.conv(digits, 16, 10).cast("bigint").alias("offset"),
    )
    facts = (
        counts.select(*group, F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
        .join(rates, "tag")
    )
    order = Window.partitionBy(*group).orderBy(F.col("key").asc_nulls_last(), "tie", "size")
    ranked = rows.withColumn("rank", F.row_number().over(order)).drop("source", "key", "tie")
    upto = (F.col("before") + F.col("rank")) * F.col("rate") + F.col("offset")
    copies = F.shiftright(upto, RATE_BITS) - F.shiftright(upto - F.col("rate"), RATE_BITS)
    return ranked.join(facts, group).select("row", "size", "source_size", "target", copies.alias("copies"))


def mix(df: DataFrame, size: Column, tie: Column, key: str = "doc_id", source: str = "source") -> DataFrame:
    """The rows of the mix, with the columns of df; a document of two copies comes twice."""
    counted = mix_counts(df, size, tie, key, source).where("copies > 0")
    each = counted.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return each.select(*[F.col(f"row.`{c}`").alias(c) for c in df.columns])


def op7_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Size, target of the source and words taken of every document."""
    docs = table(spark, folder, "documents").select(
        "doc_id", "source", word_count().alias("words"), F.crc32(text_or_empty().cast("binary")).alias("crc")
    )
    # Words are counted once: what is written is a few numbers per document.
    return mix_counts(cut(docs), F.col("words"), F.col("crc")).select(
        "row.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


#: The same in one window over each source, without buckets. Equal ids would need crc32.
OP7_SQL = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS words, sum(size)::BIGINT * {CAP} AS cap,
    CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM d GROUP BY source
), f AS (
  SELECT *, sum(words) OVER ()::DOUBLE * {BUDGET}
      - coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS rest,
    (sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS weights
  FROM s WINDOW w AS (ORDER BY cap::DOUBLE / weight, source ASC NULLS LAST)
), o AS (
  SELECT *, cap * weights > rest * weight AS open FROM f
), l AS (
  SELECT *, min(CASE WHEN open THEN {{'a': cap::DOUBLE / weight, 'b': rest, 'c': weights}} END) OVER () AS lvl FROM o
), t AS (
  SELECT source, words, (CASE WHEN open THEN lvl.b * weight / lvl.c ELSE cap END)::DOUBLE AS target FROM l
), r AS (
  SELECT *, CASE WHEN words > 0 THEN floor(target / words * {1 << RATE_BITS})::BIGINT ELSE 0 END AS rate,
    ('0x' || substr(md5('{SEED}' || coalesce(source, '')), 1, {RATE_BITS // 4}))::BIGINT AS shift
  FROM t
), n AS (
  SELECT d.*, r.words, r.target, r.rate, r.shift, row_number() OVER (
      PARTITION BY d.source
      ORDER BY length(bin(size)) * 16 + (size * 16) // (1::BIGINT << length(bin(size))), doc_id ASC NULLS LAST) AS rank
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
)
SELECT doc_id, size, words AS source_size, target,
  size * (((rank * rate + shift) >> {RATE_BITS}) - (((rank - 1) * rate + shift) >> {RATE_BITS})) AS taken
FROM n"""
