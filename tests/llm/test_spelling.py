"""Familiar spelling against plain counting, and texts that must be told apart."""

import math
import os
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from corpus import FOLDER, empty, odd
from rowsmith.llm import spelling

needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def classes(text):
    def one(b):
        c = chr(b).lower()
        if c in LETTERS:
            return 1 + LETTERS.index(c)
        if c in "0123456789":
            return 27
        if 33 <= b < 128:
            return 28
        return 0 if b < 128 else b - 99 if b < 224 else 125 + min((b - 224) // 16, 2)

    return [one(b) for b in (text or "").encode()]


def plain(sample, texts):
    """Scores by dictionaries of counts."""
    three, n = Counter(), spelling.CLASSES
    for text in sample:
        own = [0, 0, *classes(text)]
        three.update(zip(own, own[1:], own[2:]))
    two, before, context = Counter(), Counter(), Counter()
    for (a, b, c), k in three.items():
        two[b, c] += k
        before[b] += k
        context[a, b] += k

    def bits(a, b, c):
        short = (two[b, c] + spelling.FLOOR) / (before[b] + spelling.FLOOR * n)
        return math.log2((three[a, b, c] + spelling.BACKOFF * short) / (context[a, b] + spelling.BACKOFF))

    mean = sum(k * bits(*t) for t, k in three.items()) / max(1, sum(three.values()))
    out = []
    for text in texts:
        own, raw = [0, 0, *classes(text)], (text or "").encode()
        good = size = at = 0
        while at < len(raw):
            end = at
            while end < len(raw) and raw[end] not in b" \t\n\v\f\r":
                end += 1
            if end > at:
                total = sum(bits(*own[i : i + 3]) - mean for i in range(at, end))
                good += (end - at) * (total >= -spelling.STRANGE * (end - at))
                size += end - at
            at = max(end, at + 1) if end > at else at + 1
        out.append((good + spelling.DRAWN) / (size + spelling.DRAWN))
    return out


def test_scores_as_by_plain_counts(spark):
    rnd = random.Random(2)
    sample = [" ".join("".join(rnd.choice("abcé1.A") for _ in range(rnd.randrange(1, 9))) for _ in range(rnd.randrange(0, 30))) for _ in range(40)]
    texts = sample[:20] + ["", None, "z", " zq  xx\nabc ", "日本 語", "é" * 9, "ABC abc 11", "\x00\x7f a"]
    docs = spark.createDataFrame([(n, t, "en") for n, t in enumerate(sample)] + [(90, None, "en"), (91, "zzzz", None)], "doc_id int, text string, lang string")
    table = spelling.fit(docs.repartition(3))
    want = plain(sample, texts)
    got = np.concatenate(list(spelling.scores(table, pa.array(texts))))
    assert got == pytest.approx(want)
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    scored = rows.select("n", spelling.scorer(spark, table)(rows["text"]).alias("s")).collect()
    assert [r["s"] for r in sorted(scored)] == pytest.approx(want)
    assert spelling.fit(empty(spark)) is None
    assert odd(spark).select(spelling.scorer(spark, None)("text").alias("s")).distinct().collect()[0]["s"] == 1.0


STRANGE = {
    "Russian": "Это обычный русский текст, который не должен пройти, так как этот язык не изучен.",
    "Japanese": "これは日本語の普通の文章です。学習されていません。だから残ってはいけません。",
    "Greek": "Η ελληνική γλώσσα είναι μία από τις αρχαιότερες γλώσσες του κόσμου.",
    "keys": "asdkj qwlekjr zxmcnb oiuqwe lkjasd mnzxbc qpwoei rutyal skdjfh zxcvbn qwrtyp",
    "base64": "k3JhbmRvbSBieXRlcw== q8Zx0PvT7LmN2bRf YtGhJkL9wQxZ a0S1d2F3g4H5j6K7",
}


@needs_tables
def test_texts_of_no_learned_language_go(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    odd_ones = [(10**6 + n, t, lang, "x", len(t)) for n, t in enumerate(STRANGE.values()) for lang in [None]]
    odd_ones += [(2 * 10**6, f"{docs.first()['text'][:300]} {STRANGE['keys'][:30]}", None, "x", 330)]
    both = docs.unionByName(spark.createDataFrame(odd_ones, docs.schema))
    kept = {r["doc_id"] for r in corpus_pipeline.language_stage(spark, both, FOLDER).select("doc_id").collect()}
    assert kept == {r["doc_id"] for r in docs.select("doc_id").collect()} | {2 * 10**6}


def test_stage_learns_from_every_labelled_document(spark, tmp_path):
    """A language of few documents, which a sample of 2048 by hash leaves out, is learned and stays."""
    from pyspark.sql import functions as F
    from rowsmith.llm import lang_id
    from rowsmith.llm.common import crc_fold

    order = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 30))
    ids = spark.range(1, 6001).select(F.col("id").alias("doc_id"))
    late = ids.where(crc_fold("doc_id", lang_id.FOLDS) != lang_id.HELD_OUT).orderBy(order.desc()).limit(4)
    rare = sorted(r["doc_id"] for r in late.collect())
    is_rare = F.col("doc_id").isin(rare)
    russian = "мама мыла раму и папа мыл раму и мы мыли раму " * 40
    docs = ids.select(
        "doc_id", F.when(is_rare, russian).otherwise("the cat sat on the mat and saw the dog").alias("text"),
        F.when(is_rare, "ru").otherwise("en").alias("lang"),
    )
    net = lang_id.fit_all(docs)
    assert net.languages == ("en", "ru")
    kept = {r["doc_id"] for r in corpus_pipeline.language_stage(spark, docs, str(tmp_path)).collect()}
    assert set(rare) <= kept and len(kept) == 6000
    # The network itself moves with a document outside the sample.
    other = docs.withColumn("text", F.when(is_rare, "кот " * 400).otherwise(F.col("text")))
    assert any((a != b).any() for a, b in zip(lang_id.parameters(net), lang_id.parameters(lang_id.fit_all(other))))
    found = docs.select("doc_id", "lang", lang_id.labeller(spark, net)(F.col("text")).alias("f")).where("f.lang <> lang")
    assert found.where("lang = 'en'").count() == 0
