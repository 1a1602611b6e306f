"""Periodic runs against all periods tried one by one."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpus import DOCS, empty, odd
from rowsmith.llm.common import table
from rowsmith.llm.periodic_runs import find_runs, op11_periodic_runs, periodic_runs


def plain_runs(words, least=12):
    """(start, period, length) of every maximal stretch, of its smallest period."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        x = 0
        while x + q < len(words):
            if words[x] != words[x + q]:
                x += 1
                continue
            start = x
            while x + q < len(words) and words[x] == words[x + q]:
                x += 1
            if x + q - start >= max(least, 2 * q):
                found.setdefault((start, x + q - start), q)
    return sorted((s, q, n) for (s, n), q in found.items())


def planted(words, doc_id):
    crc = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if crc % 10 == 0 and words:
        g = crc // 10
        a = g % len(words)
        p = 1 + (len(words) - a) // (3 + g % 8)
        return words[:a] + [words[a + (i - a) % p] for i in range(a, len(words))]
    return words


def expected(doc_id, text):
    words = planted(re.findall("[^\x20\x09-\x0d]+", text or ""), doc_id)
    found = plain_runs(words)
    gone = {x for s, q, n in found for x in range(s + q, s + n)}
    rest = " ".join(w for i, w in enumerate(words) if i not in gone)
    best = min(((-n, s, q) for s, q, n in found), default=None)
    lines = "".join(f"{s},{n},{q}\n" for s, q, n in found)
    told = (None,) * 4 if best is None else (best[1], -best[0], best[2], -best[0] * 1000 // best[2])
    return (doc_id, len(found), *told, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(rest.encode()).hexdigest())


def test_random_words():
    rng = np.random.default_rng(3)
    for _ in range(150):
        docs = []
        for _ in range(12):
            words = rng.integers(0, rng.integers(1, 7), rng.integers(0, 90)).tolist()
            for _ in range(rng.integers(0, 3)):
                a, b = sorted(rng.integers(0, len(words) + 1, 2).tolist())
                words[a:b] = words[a:b] * int(rng.integers(1, 4)) + words[a:b][: rng.integers(0, 9)]
            docs.append(words[:300])
        at = np.cumsum([0] + [len(d) for d in docs])
        least = int(rng.choice([2, 12]))
        got = list(zip(*(x.tolist() for x in find_runs(np.array(sum(docs, []), np.uint64), at, least))))
        for d, words in enumerate(docs):
            own = [(s - at[d], q, e - s) for s, e, q in got if at[d] <= s < at[d + 1]]
            assert own == plain_runs(words, least)


@pytest.mark.parametrize("words,want", [
    ("x " * 11, []), ("x " * 12, [(0, 1, 12)]), ("a b " * 6 + "a", [(0, 2, 13)]), ("a b c d e f g " * 2, [(0, 7, 14)]),
    ("a a b " * 9, [(0, 3, 27)]), ("one two three " * 4 + "x " * 13 + "one two", [(0, 3, 12), (12, 1, 13)]),
])
def test_known_runs(words, want):
    words = words.split()
    numbers = np.array([hash(w) % 2**63 for w in words], np.uint64)
    assert list(zip(*(x.tolist() for x in find_runs(numbers, np.array([0, len(words)]))))) == [(s, s + n, q) for s, q, n in want]


def test_query(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = [expected(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = [tuple(r) for r in op11_periodic_runs(spark, "/root/testdata/sf0.001").collect()]
    assert sorted(got) == sorted(rows) and any(r[1] for r in rows)


def test_odd_rows(spark, tmp_path):
    # Repeated, null and very long texts, repeated and null ids, columns with the names used here.
    odd(spark).selectExpr("*", "doc_id AS found", "text AS runs", "lang AS collapsed").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in op11_periodic_runs(spark, str(tmp_path)).collect()]
    docs = [(r.doc_id, r.text) for r in odd(spark).collect() if len(r.text or "") < 1000]
    short = {expected(*d) for d in docs}
    assert short <= set(got) and len(got) == odd(spark).count()
    assert {r[0] for r in got if r not in short} == {10}
    found = periodic_runs(odd(spark)).where("row.doc_id = 10").first()
    assert [tuple(r) for r in found.runs] == [(0, 120_000, 2)] and found.collapsed == "x y"
    assert periodic_runs(empty(spark)).count() == 0


def test_text_ids(spark):
    df = spark.createDataFrame([("a", "v w " * 8)], DOCS.split(",")[0].replace("bigint", "string") + ", text string")
    assert periodic_runs(df).select(F.size("runs"), "collapsed").first()[:] == (1, "v w")
