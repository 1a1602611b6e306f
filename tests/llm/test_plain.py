"""Features, scores and probabilities against plain Python, one word and one number at a time."""

import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpus import ODD, odd
from rowsmith.llm import lang_id, linear, quality, toxicity
from rowsmith.llm.words import buffers

BITS = 40


def mixed_texts(seed):
    rnd = random.Random(seed)
    pool = ["the", "The", "THE", "cat", "cats", "sat.", "12", "a1", "naïve", "don't", "!!", "--", "x", "wonderful", "wonderfully", "I"]
    texts = [" ".join(rnd.choice(pool) for _ in range(rnd.randrange(0, 25))) for _ in range(30)]
    return texts + [t for _, t, *_ in ODD if len(t or "") < 1000]


def quality_features(text):
    raw = (text or "").encode()
    words = [m[0] for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x20\x09-\x0d]+", raw)]
    shapes, seen = [], set()
    for i, w in enumerate(words):
        upper, digits = len(re.findall(rb"[A-Z]", w)), len(re.findall(rb"[0-9]", w))
        sign = not re.match(rb"[0-9A-Za-z\x80-\xff]", w)
        kind = 10 if sign else 20 if digits else 30 if not upper else 40 if upper > 1 else 50
        again = 2 if i and words[i - 1] == w else 1 if w in seen and len(w) >= 4 else 0
        seen.add(w)
        shapes.append((kind + min(9, int(math.log2(len(w)))), again))
    out = {("w", w) for w in words} | {("ww", *p) for p in zip(words, words[1:])}
    out |= {("s", s) for s in shapes} | {("ss", *p) for p in zip(shapes, shapes[1:])}
    return out | {("sss", *p) for p in zip(shapes, shapes[1:], shapes[2:])}


def toxicity_features(text):
    words = re.findall(rb"[0-9a-z\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    out = {("w", w) for w in words}
    out |= {(step, a, b) for step in (1, 2, 3) for a, b in zip(words, words[step:])}
    return out | {("stem", size, w[:size]) for size in toxicity.STEMS for w in words if len(w) > size}


@pytest.mark.parametrize("module, plain", [(quality, quality_features), (toxicity, toxicity_features)])
@pytest.mark.parametrize("seed", [1, 2])
def test_features(module, plain, seed):
    """As many places as plain features, shared by two texts exactly where these are."""
    texts = mixed_texts(seed)
    places = [set(p.tolist()) for p in linear.each_text(pa.array(texts), module.features, BITS)]
    wanted = [plain(t) for t in texts]
    assert [len(p) for p in places] == [len(w) for w in wanted]
    for a, b in itertools.combinations(range(len(texts)), 2):
        assert len(places[a] & places[b]) == len(wanted[a] & wanted[b])


@pytest.mark.parametrize("module", [quality, toxicity])
def test_scores_are_sums_of_weights(spark, module):
    texts = mixed_texts(3)
    rng, bits = np.random.default_rng(1), module.SETTINGS.bits
    every = list(linear.each_text(pa.array(texts), module.features, bits))
    used = np.unique(np.concatenate(every))[::2]
    weights = linear.Weights(0.3, used.astype(np.int32), rng.normal(0, 1, len(used)).astype(np.float32))
    value = dict(zip(used.tolist(), weights.values.tolist()))
    want = []
    for own in every:
        total = sum(value.get(p, 0.0) for p in own.tolist())
        total /= math.sqrt(max(1, len(own))) if module.SETTINGS.unit else 1
        want.append(1 / (1 + math.exp(-(0.3 + total))))
    df = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    score = linear.scorer(df, weights, module.features, module.SETTINGS)
    got = [r["s"] for r in sorted(df.select("n", score(F.col("text")).alias("s")).collect())]
    assert got == pytest.approx(want, rel=1e-5)


def plain_probabilities(net, window):
    """One window, one gate at a time."""
    def sigmoid(x):
        return 1 / (1 + math.exp(-x))

    def run(inputs, recurrent, data):
        size = recurrent.shape[1]
        state, out = [0.0] * size, []
        for byte in data:
            drive = [sum(float(recurrent[g, h]) * state[h] for h in range(size)) for g in range(3 * size)]
            own = [float(inputs[g, byte]) for g in range(3 * size)]
            new = []
            for h in range(size):
                update, reset = sigmoid(own[h] + drive[h]), sigmoid(own[size + h] + drive[size + h])
                candidate = math.tanh(own[2 * size + h] + reset * drive[2 * size + h])
                new.append(update * state[h] + (1 - update) * candidate)
            state = new
            out.append(state)
        return out

    forth = run(net.inputs[0], net.recurrent[0], window)
    back = run(net.inputs[1], net.recurrent[1], window[::-1])[::-1]
    rows = []
    for f, b in zip(forth, back):
        scores = [sum(float(w) * x for w, x in zip(net.output[c], f + b)) + float(net.bias[c]) for c in range(len(net.languages))]
        top = max(scores)
        each = [math.exp(s - top) for s in scores]
        rows.append([e / sum(each) for e in each])
    return rows


def test_probabilities_and_pooling():
    texts = ["the cat sat on the mat, and it slept " * 3, "der hund", "é è", "12 34 !", ""]
    net = lang_id.train([t.encode() for t in texts[:3]], ["a", "b", "c"], steps=4)
    got = lang_id.pooled(net, *buffers(pa.array(texts)))
    for text, row in zip(texts, got):
        raw = text.encode()
        total, letters = [0.0] * 3, 0
        for at in range(0, len(raw), lang_id.WINDOW):
            window = raw[at : at + lang_id.WINDOW].ljust(lang_id.WINDOW, b" ")
            for byte, p in zip(window, plain_probabilities(net, window)):
                if chr(byte).isascii() and chr(byte).isalpha() or byte >= 128:
                    total, letters = [x + y for x, y in zip(total, p)], letters + 1
        assert row.tolist() == pytest.approx([x / max(1, letters) for x in total], abs=1e-4)


@pytest.mark.parametrize("module, name", [(quality, "quality"), (toxicity, "toxic")])
def test_columns_of_clashing_names(spark, tmp_path, module, name):
    docs = odd(spark).selectExpr("*", *[f"doc_id AS `{c}`" for c in ("score", "held_out", "_label", "_order", "places", name)])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    marks = spark.createDataFrame([(i, i % 2, "x", 1) for i in range(1, 15)], f"doc_id bigint, {name} int, text string, _order int")
    marks.write.parquet(f"{tmp_path}/labels.parquet")
    query = quality.op2_quality if module is quality else toxicity.op4_toxicity
    assert query(spark, str(tmp_path)).count() == len(ODD)
