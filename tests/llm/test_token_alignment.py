"""Token alignment against sets of offsets and plain counters."""

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from corpus import empty, odd
from rowsmith.llm import token_alignment as ta
from rowsmith.llm.common import table

SPLIT = "<|endoftext|> a", "▁x", "日本語 메뉴", "a  b\n\n c d", "<0x0A> <s>", "naïve café don't", "\x00 \r\n", "ab" * 400, " lead"


@pytest.fixture(scope="module")
def both():
    a = Tokenizer.from_file(ta.VOCABULARY_A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=ta.VOCABULARY_B)


def shown_bytes():
    shown = [b for b in range(256) if 33 <= b < 127 or 161 <= b < 173 or b >= 174]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def plain(rows, both):
    """The result of (doc_id, text) rows, as a multiset."""
    a, b = both
    byte, docs, counts = shown_bytes(), [], Counter()
    for doc_id, text in rows:
        ids_a = a.encode(f" {text}", add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        bytes_a = [bytes(byte[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not text or {b"".join(bytes_a), b"".join(bytes_b)} != {f" {text}".encode()}:
            ids_a, ids_b, bytes_a, bytes_b = [], [], [], []
        ends_a = np.cumsum([len(x) for x in bytes_a]).tolist()
        ends_b = np.cumsum([len(x) for x in bytes_b]).tolist()
        links = [(x, y) for e, x in zip(ends_a, ids_a) for f, y in zip(ends_b, ids_b) if e == f] if len(ids_a) < 3000 else [
            (ids_a[n], ids_b[ends_b.index(e)]) for n, e in enumerate(ends_a) if e in set(ends_b)]
        groups, at = [], 0
        for cut in sorted(set(ends_a) & set(ends_b)):
            part = [",".join(str(i) for i, e in zip(ids, ends) if at < e <= cut) for ids, ends in ((ids_a, ends_a), (ids_b, ends_b))]
            groups.append("|".join(part))
            at = cut
        counts.update(links)
        docs.append((doc_id, len(ids_a), len(ids_b), len(groups), links, ";".join(groups)))
    top = Counter()
    for (_, y), n in counts.items():
        top[y] = max(top[y], n)
    return Counter(
        (i, n_a, n_b, n, len(links), sum(counts[x] == top[x[1]] for x in links), sum(counts[x] for x in links),
         hashlib.sha256(g.encode()).hexdigest() if g else "")
        for i, n_a, n_b, n, links, g in docs
    )


def test_query(spark, both):
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    short = [tuple(r) for r in docs.where("length(text) < 4000 OR text IS NULL").collect()]
    df = spark.createDataFrame(short, "doc_id bigint, text string").repartition(6)
    assert Counter(tuple(r) for r in ta.align_tokens(df).collect()) == plain(short, both)
    assert ta.op12_token_alignment(spark, "/root/testdata/sf0.001").count() == docs.count()


def test_odd_rows(spark, both):
    df = odd(spark).selectExpr("*", "doc_id AS block", "text AS radix", "lang AS part", "lang AS nth").where("coalesce(doc_id, 0) <> 10")
    df = df.select(*df.columns).repartition(5)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert Counter(tuple(r) for r in ta.align_tokens(df).collect()) == plain(rows, both)
    assert ta.align_tokens(empty(spark)).collect() == []
    texts = [(t[:3], t) for t in SPLIT] * 3 + [(None, None)]
    df = spark.createDataFrame(texts, "doc_id string, text string").repartition(4)
    got = Counter(tuple(r) for r in ta.align_tokens(df).collect())
    assert got == plain(texts, both) and sum(n for r, n in got.items() if r[1] == 0) == 4


def test_very_long_text(spark):
    (row,) = ta.align_tokens(odd(spark).where("doc_id = 10")).collect()
    assert row.n_links == row.n_groups > 100_000 and row.count_sum > row.n_links


def test_heads_merge_in_any_number():
    rng = np.random.default_rng(5)
    counts, heads = Counter(), []
    for _ in range(40):
        keys = np.unique(rng.integers(0, 40, 60) << ta.ID_BITS | rng.integers(0, 9, 60))
        held = rng.integers(1, 9, len(keys))
        counts.update(dict(zip(keys.tolist(), held.tolist())))
        heads.append(ta.run_of(keys, held))
    for parts in (1, 3, 40):
        some = [ta.one_run(heads[i::parts]) for i in range(parts)]
        found = list(ta.merged(some))
        assert [k for keys, _ in found for k in keys.tolist()] == sorted(counts)
        assert all(counts[k] == n for keys, c in found for k, n in zip(keys.tolist(), c.tolist()))
        assert [int(ta.sides(k)[0]) for k, _ in found] == sorted({k >> ta.ID_BITS for k in counts})


def test_blocks_part_long_tasks():
    block = ta.Block()
    block.add(pa.array([1, 2]), (np.array([1, 1]),) * 3, ["", ""], (np.array([0, 1, 1]), np.array([5, 5, 6]), np.array([7, 7, 8])), 9)
    found = {}
    for radix, head, tail in block.parts():
        keys, counts = ta.read_run(head)
        sizes, docs, links = ta.unpacked(tail, ("u4", "u4", "u4"))
        at = np.repeat(keys, sizes) & ((1 << 2 * ta.ID_BITS) - 1)
        found |= {(int(k) >> 24, int(k) & 0xFFFFFF, int(d)): int(n) for k, d, n in zip(at, docs, links)}
        assert counts.sum() == links.sum()
    assert found == {(5, 7, 0): 1, (5, 7, 1): 1, (6, 8, 1): 1}
