"""Sharding, mixing and fingerprints."""

import binascii
import hashlib
import os
import zlib
from collections import Counter

import pytest
from oracle import compare, connect
from pyspark.sql import functions as F

from corpus import FOLDER, ODD, empty, odd, shingles, write
from rowsmith.llm import common, fingerprints, mixing, sharding
from rowsmith.llm.queries import ORACLE, QUERIES

needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@needs_tables
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, name):
    compare(spark, connect(FOLDER), name, QUERIES[name], ORACLE[name], FOLDER)


@pytest.mark.parametrize("rows", [1 << 16, 4])
@pytest.mark.parametrize("keys", [[], [5], [1, 2, 3], list(range(0, 9000, 3)), [7] * 50, [-5, None, 2**62, 2**62, -(2**63)], [None] * 40 + [3] * 40 + list(range(99))])
def test_buckets_keep_the_order(spark, monkeypatch, keys, rows):
    monkeypatch.setattr(common, "ROWS", rows)
    monkeypatch.setattr(common, "STEP", 32 if rows > 4 else 4)
    df = spark.createDataFrame([(k, zlib.crc32(str(n).encode())) for n, k in enumerate(keys)], "k bigint, tie bigint")
    cuts = common.bounds(df, "k")
    assert list(cuts.values) == sorted(set(cuts.values)) and set(cuts.heavy) <= set(cuts.values)
    got = df.select("k", "tie", common.bucket(F.col("k"), cuts, F.col("tie")).alias("b")).collect()
    got = sorted((r["k"] is None, r["k"] or 0, r["tie"], r["b"]) for r in got)
    whole = 1 << common.TIE_BITS
    assert [b // whole for *_, b in got] == [len(cuts.values) + 1 if null else sum(c <= k for c in cuts.values) for null, k, _, _ in got]
    assert [b for *_, b in got] == sorted(b for *_, b in got)


@pytest.mark.parametrize("key", ["null", "one", "text"])
def test_no_bucket_holds_a_hot_key(spark, key):
    """All ids null or equal, or texts: the rows are parted by checksum or hash."""
    ids = {"null": "cast(null AS bigint)", "one": "7L", "text": "concat('id-', id)"}[key]
    df = spark.range(40_000).selectExpr(f"{ids} AS doc_id", "concat('text ', id) AS text")
    tie = sharding.checksum()
    placed = df.select(common.bucket(common.order_key(df, "doc_id"), common.bounds(df, "doc_id"), tie).alias("b"))
    assert placed.groupBy("b").count().agg(F.max("count")).first()[0] < 200
    shards = sharding.shard(df, sharding.byte_size(), tie).groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("last"), F.sum("size").alias("size")).collect()
    assert len(shards) == 16 and all(r["n"] == r["last"] + 1 for r in shards)
    assert max(r["size"] for r in shards) - min(r["size"] for r in shards) < 40
    nexts = fingerprints.with_next(df.limit(3000), "doc_id", ["text"]).select("text", "next_text").collect()
    after = dict(map(tuple, nexts))
    text, seen = nexts[0][0], 0
    while seen < 3000:
        text, seen = after[text], seen + 1
    assert len(after) == 3000 and text == nexts[0][0] and len(set(after.values())) == 3000
    mixed = mixing.mix(df.withColumn("source", F.lit("s")), mixing.word_count(), tie)
    assert abs(mixed.count() - 60_000) <= 2


def check_shards(rows, shards):
    total = sum(r["_size"] for r in rows)
    placed = sorted(rows, key=lambda r: (r["_shard"], r["_slot"]))
    at, end = Counter(), 0
    for r in placed:
        assert r["_slot"] == at[r["_shard"]]
        at[r["_shard"]] += 1
        # Contiguous: the middle of each row lies in its shard's part.
        assert r["_shard"] == min(shards - 1, (2 * end + r["_size"]) * shards // (2 * total))
        end += r["_size"]
    ids = [r["doc_id"] for r in placed]
    assert ids == sorted(ids, key=lambda i: (i is None, i or 0))


def test_shards(spark):
    got = sharding.shard(odd(spark), sharding.byte_size(), sharding.checksum())
    # Names that were taken get an underscore; the old columns stay.
    assert {"_size", "_shard", "_slot", "size", "Shard", "slot", "row"} <= set(got.columns)
    rows = got.collect()
    assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter((i, t) for i, t, *_ in ODD)
    assert all(r["_size"] == len((r["text"] or "").encode()) + 1 for r in rows)
    check_shards(rows, 16)
    many = spark.range(0, 3000, 3, 7).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")).alias("text"))
    rows = sharding.shard(many, sharding.byte_size(), sharding.checksum(), shards=7).collect()
    rows = [{"doc_id": r["doc_id"], "_size": r["size"], "_shard": r["shard"], "_slot": r["slot"]} for r in rows]
    check_shards(rows, 7)
    sizes = Counter()
    for r in rows:
        sizes[r["_shard"]] += r["_size"]
    assert max(sizes.values()) - min(sizes.values()) <= 100
    assert sharding.shard(empty(spark), sharding.byte_size(), sharding.checksum()).count() == 0


def test_sharding_query(spark, tmp_path):
    folder = write(spark, tmp_path, documents=odd(spark))
    rows = sharding.op5_sharding(spark, folder).collect()
    want = Counter((i, len((t or "").encode()) + 1, binascii.crc32((t or "").encode())) for i, t, *_ in ODD)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    assert {(r["law"], r["grown_shard"]) for r in rows} == {("bytes", None)}


def plain_targets(words):
    """Shares by weight, again and again, until no source is above its cap."""
    order = sorted(words, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[n % 3] for n, s in enumerate(order)}
    target, left, open_ = {}, 1.5 * sum(words.values()), set(order)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * words[s]}
        if not full:
            return target | {s: level * weight[s] for s in open_}
        for s in full:
            target[s] = 2.0 * words[s]
            left -= target[s]
        open_ -= full
    return target


@pytest.mark.parametrize("words", [{"a": 10, "b": 1000, None: 40}, {"a": 5}, {"x": 100, "y": 100, "z": 100, "é": 3, "zz": 9000}, {"a": 1, "b": 1, "c": 1}])
def test_targets(spark, words):
    got = mixing.targets(spark.createDataFrame(list(words.items()), "source string, words bigint")).collect()
    assert {r["source"]: pytest.approx(r["target"]) for r in got} == plain_targets(words)


def test_mix(spark, tmp_path):
    folder = write(spark, tmp_path, documents=odd(spark))
    rows = mixing.op7_mixing(spark, folder).collect()
    assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter((i, len((t or "").split())) for i, t, *_ in ODD)
    assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in rows)
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.op7_mixing(spark, folder).collect()), key=str)
    copies = mixing.mix(odd(spark), mixing.word_count(), sharding.checksum())
    assert copies.columns == odd(spark).columns
    assert mixing.mix(empty(spark), mixing.word_count(), sharding.checksum()).count() == 0
    wordless = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id bigint, text string, source string")
    assert mixing.mix(wordless, mixing.word_count(), sharding.checksum()).count() == 0


def test_mix_comes_near_its_targets(spark):
    docs = spark.range(4000).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.pmod(F.hash("id"), F.lit(7)).cast("string")).alias("source"),
        F.repeat(F.lit("w "), F.pmod(F.hash(-F.col("id")), F.lit(90)).cast("int")).alias("text"),
    )
    got = mixing.mix_counts(docs, mixing.word_count(), sharding.checksum())
    sums = got.groupBy("row.source", "target").agg(F.sum(F.expr("copies * size")).alias("taken"), F.max("copies").alias("most")).collect()
    assert all(abs(r["taken"] - r["target"]) <= 200 and r["most"] <= 2 for r in sums)


def test_fingerprints(spark, tmp_path):
    folder = write(spark, tmp_path, documents=odd(spark).where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]))
    rows = {r["doc_id"]: r for r in fingerprints.op3_fingerprints(spark, folder).collect()}
    texts = {i: t or "" for i, t, *_ in ODD if i is not None}
    ids = sorted(texts)
    assert sorted(rows) == ids

    def likeness(a, b):
        return 1.0 if not a and not b else len(a & b) / len(a | b)

    for n, i in enumerate(ids):
        text, after = texts[i], texts[ids[(n + 1) % len(ids)]]
        part = len(text) // 4
        changed = text[: len(text) - part] + after[:part]
        assert rows[i]["n_chars"] == len(text)
        assert rows[i]["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        # All sets here are smaller than a fingerprint, so its figures are exact.
        assert rows[i]["near_edited"] == likeness(shingles(text), shingles(changed))
        assert rows[i]["near_next"] == likeness(shingles(text), shingles(after))
        assert rows[i]["n_shingles"] == len(shingles(text))
    assert rows[1]["fingerprint"] == rows[2]["fingerprint"] != rows[3]["fingerprint"]
    assert rows[4]["fingerprint"] == rows[5]["fingerprint"] == ""
    assert fingerprints.op3_fingerprints(spark, write(spark, tmp_path / "none", documents=empty(spark))).count() == 0
    repeated = odd(spark).where("doc_id = 7 OR doc_id IS NULL")
    assert fingerprints.op3_fingerprints(spark, write(spark, tmp_path / "more", documents=repeated)).count() == 4


def test_estimates_and_merging(spark):
    """Sets of known size and overlap; the merged fingerprint is that of the union."""
    words = spark.createDataFrame([(1, 0, 3000), (1, 1000, 4000), (2, 2000, 5000), (3, 0, 0)], "part int, lo int, hi int")
    hashes = F.expr("CASE WHEN hi > lo THEN transform(sequence(lo, hi - 1), x -> xxhash64(x)) ELSE cast(array() AS array<bigint>) END")
    each = words.withColumn("words", hashes).select("part", "lo", fingerprints.sketch("words", size=1).alias("print"))
    merged = fingerprints.merge_by(each, "part", "print")
    whole = spark.createDataFrame([(1, 0, 4000), (2, 2000, 5000), (3, 0, 0)], "part int, lo int, hi int").withColumn("words", hashes)
    whole = whole.select("part", fingerprints.sketch("words", size=1).alias("print"))
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, whole.collect()))
    pair = whole.where("part = 1").select(F.col("print").alias("a")).crossJoin(whole.where("part = 2").select(F.col("print").alias("b")))
    got = pair.select(
        fingerprints.resemblance("a", "b").alias("r"), fingerprints.containment("b", "a").alias("c"), fingerprints.distinct_count("a").alias("n"),
    ).first()
    assert abs(got["r"] - 0.4) < 0.13 and abs(got["c"] - 2 / 3) < 0.2 and abs(got["n"] - 4000) < 1200
    assert len(fingerprints.encoded.__doc__) and whole.where("part = 3").first()["print"] == []


def test_fingerprints_stay_native(spark, tmp_path):
    folder = write(spark, tmp_path, documents=odd(spark))
    plan = fingerprints.op3_fingerprints(spark, folder)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
