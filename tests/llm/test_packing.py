"""Packing against whole-text tokenization and one-bin-at-a-time subset sums."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from corpus import empty, odd
from rowsmith.llm.common import table
from rowsmith.llm.packing import VOCABULARY, WordIds, fill_bins, op13_packing, pack
from rowsmith.llm.words import buffers

#: White space of all kinds, contractions, composed and split accents, special tokens, digits, case.
TEXTS = [
    "a  b", "don't 's ''s o'clock'll", "é é ́x é l'été", "ΑΣ ΣΑΣ. Σ", " x　y\xa0 z", "<|endoftext|> a<|startoftext|>b",
    "日本語 テスト", "İstanbul İ ǅ ﬁ", "\x00 \x0b\x0c\x85  q\x7fr", "1234 5 ٣٤ a1b22", "", "   ", "😀👍🏽 a😀",
    "ÀÖØ×÷ß ÿ", "x" * 300, "--- a,b;c... (d) --e", "A\r\nB\tC", "ÉCOLE Été,été",
]


def whole(texts):
    tokenizer = Tokenizer.from_file(VOCABULARY)
    tokenizer.encode_special_tokens = True
    return [e.ids + [0] for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def one_by_one(counts, size):
    """Bins of minimum slack, one at a time, by sets of reachable sums."""
    left, bins = Counter(counts), 0
    while +left:
        longest = max(+left)
        left[longest] -= 1
        sums = {0: ()}
        for n in sorted(+left, reverse=True):
            for _ in range(min(left[n], (size - longest) // n)):
                for s, c in list(sums.items()):
                    if s + n <= size - longest and s + n not in sums:
                        sums[s + n] = (*c, n)
        left -= Counter(sums[max(sums)])
        bins += 1
    return bins


def check(rows, docs, size=2048):
    """Pieces are those of the tokenized texts, sequences are gapless; the number of sequences."""
    expected = Counter()
    for (doc_id, _), ids in zip(docs, whole([t for _, t in docs])):
        for piece, start in enumerate(range(0, len(ids), size)):
            part = ids[start : start + size]
            expected[doc_id, piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= size
    return len(places)


def test_words_are_tokenized_as_in_whole_texts():
    known = WordIds(VOCABULARY)
    for _ in range(2):
        ids, at = known.encoded(*buffers(pa.array(TEXTS)))
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == whole(TEXTS)


@pytest.mark.parametrize("seed", range(12))
def test_bins_one_at_a_time(seed):
    rng = np.random.default_rng(seed)
    size = int(rng.integers(5, 60))
    counts = Counter(rng.integers(1, size + 1, rng.integers(0, 120)).tolist())
    layout = fill_bins(counts, size)
    assert layout.bins == one_by_one(counts, size) >= -(-sum(n * c for n, c in counts.items()) // size)


def test_few_combinations_for_many_pieces():
    counts = {n: 10**9 // n for n in range(1, 2049)}
    layout = fill_bins(counts, 2048)
    total = sum(n * c for n, c in counts.items())
    assert layout.bins == -(-total // 2048) and len(layout.key) < 50_000


def test_query(spark):
    docs = [tuple(r) for r in table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").collect()]
    rows = op13_packing(spark, "/root/testdata/sf0.001").collect()
    total = sum(r.length for r in rows)
    sequences = check(rows, docs)
    assert -(-total // 2048) <= sequences == one_by_one(Counter(r.length for r in rows), 2048)


def test_odd_rows(spark):
    df = odd(spark).selectExpr("*", "doc_id AS part", "text AS nth", "lang AS length", "lang AS sequence_id").repartition(5)
    rows = pack(df).collect()
    check(rows, [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])
    assert {r.length for r in rows if r.doc_id in (4, 5, 6)} == {1}
    assert pack(empty(spark)).collect() == []
    copies = spark.createDataFrame([("same", "a b c")] * 5000 + [(None, None)] * 3000, "doc_id string, text string").repartition(7)
    assert check(pack(copies).collect(), [(r.doc_id, r.text) for r in copies.collect()]) == 12
