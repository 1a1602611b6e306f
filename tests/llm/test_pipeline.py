"""The stages one by one against plain Python, and the whole run."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpus import FOLDER, ODD, components, empty, odd, write
from rowsmith.llm import decontamination, lang_id, mixing
from test_order import check_shards, plain_targets

needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def stepped(spark, folder, docs, tmp_path):
    """The rows after each stage, written and read again as the pipeline's contract says."""
    out = []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/stage{n}")
        docs = spark.read.parquet(f"{tmp_path}/stage{n}")
        out.append(docs)
    return out


def ids(df):
    return Counter(r["doc_id"] for r in df.select("doc_id").collect())


@needs_tables
def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    named, single, clean, mixed, sharded = stepped(spark, FOLDER, docs, tmp_path)
    assert all(df.columns == docs.columns for df in (named, single, clean, mixed))
    # Every document has text in a known language.
    assert ids(named) == ids(docs)
    groups = components([(r["doc_id"], r["text"]) for r in named.collect()])
    assert ids(single) == Counter(i for i, _, c in groups if i == c) and sum(ids(single).values()) < 200
    items = [list(w) for w in decontamination.text_words(spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("text").toArrow()["text"].combine_chunks())]
    for r, words in zip(single.collect(), decontamination.text_words(single.select("text").toArrow()["text"].combine_chunks())):
        best = max(decontamination.aligned(i, words)[0] / (2 * len(i)) for i in map(decontamination.np.array, items))
        assert (r["doc_id"] in ids(clean)) == (best < decontamination.THRESHOLD)
    words = Counter()
    for r in clean.select("source", mixing.word_count().alias("n")).collect():
        words[r["source"]] += r["n"]
    taken = {r["source"]: r["n"] for r in mixed.groupBy("source").agg(F.sum(mixing.word_count()).alias("n")).collect()}
    largest = max(r[0] for r in clean.select(mixing.word_count()).collect())
    targets = plain_targets(words)
    assert all(abs(taken.get(s, 0) - t) <= largest for s, t in targets.items())
    assert max(ids(mixed).values()) <= 2 and set(ids(mixed)) <= set(ids(clean))
    rows = [{"doc_id": r["doc_id"], "_size": r["size"], "_shard": r["shard"], "_slot": r["slot"]} for r in sharded.collect()]
    assert Counter(r["doc_id"] for r in rows) == ids(mixed)
    check_shards(rows, 16)
    assert ids(corpus_pipeline.run(spark, FOLDER)) == ids(mixed)


def test_odd_rows(spark, tmp_path):
    items = spark.createDataFrame([(1, "no id"), (2, None)], "item_id bigint, text string")
    folder = write(spark, tmp_path / "tables", benchmark=items)
    named, single, clean, mixed, sharded = stepped(spark, folder, odd(spark), tmp_path)
    assert all(df.columns == odd(spark).columns for df in (named, single, clean, mixed))
    letters = [(i, t) for i, t, *_ in ODD if t and any(c.isalpha() for c in t)]
    assert set(ids(named)) <= {i for i, _ in letters} and 4 not in ids(named) and 11 not in ids(named)
    assert not {2, 3, 8} & set(ids(single)) and max(ids(single).values()) == 1
    assert None not in ids(clean) and 1 in ids(clean)
    assert sharded.count() == mixed.count()


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], "item_id bigint, text string")
    folder = write(spark, tmp_path / "tables", benchmark=none, documents=empty(spark))
    assert [df.count() for df in stepped(spark, folder, empty(spark), tmp_path)] == [0] * 5
    assert corpus_pipeline.run(spark, folder).count() == 0
    assert lang_id.fit(empty(spark)) is None
