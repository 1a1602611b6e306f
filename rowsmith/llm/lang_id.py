"""Language of whole texts by a bidirectional gated recurrent network over bytes.

Two recurrent layers of HIDDEN gated units read the UTF-8 bytes forwards and backwards; at
every byte both states give a probability for each language. A document's probabilities are
the mean over its letter bytes (ASCII letters and all bytes beyond ASCII). The network is
trained in numpy by backpropagation through time, on windows of a bounded sample of labelled
documents, every language equally often, with the label of the document at every position.
`fit_all` goes on from there over every window of all labelled documents, in the workers.

Texts are read whole, in windows of WINDOW bytes that start with empty states. Null texts and
texts without a letter are `und` with score 0. Repeated rows get equal results. Without
labelled rows every text is `und`. Labels that are null are not learned from. Very long texts are
read whole. An empty table gives an empty result. Other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import crc_fold, table
from .words import buffers, runs

HIDDEN = 8
WINDOW = 64
#: Labelled documents that are learned from, about; those with the smallest hashes.
SAMPLE = 2048
STEPS, BATCH, RATE = 200, 256, 0.02
#: Windows of a step and its rate, where workers go on learning.
SIDE, SLOW = 512, 0.002
#: Windows that are read side by side.
ABREAST = 4096
FOLDS, HELD_OUT = 4, 2

_letters = np.zeros(256, bool)
_letters[ord("A") : ord("Z") + 1] = _letters[ord("a") : ord("z") + 1] = _letters[128:] = True


@dataclass(frozen=True)
class Network:
    """Per direction: a column of gate inputs for each byte (3H x 256) and the recurrent
    weights (3H x H) of update, reset and candidate; and the output weights (C x 2H) and bias."""

    languages: tuple[str, ...]
    inputs: tuple[np.ndarray, np.ndarray]
    recurrent: tuple[np.ndarray, np.ndarray]
    output: np.ndarray
    bias: np.ndarray


def sigmoid(x: np.ndarray) -> np.ndarray:
    return np.tanh(x * 0.5) * 0.5 + 0.5


def states(inputs: np.ndarray, recurrent: np.ndarray, windows: np.ndarray, keep: bool = False):
    """States after each byte, (length, H, windows); keep: also what the way back needs."""
    length, count = windows.shape
    size = recurrent.shape[1]
    out = np.zeros((length + 1, size, count), np.float32)
    kept = []
    a, m = np.empty((3 * size, count), np.float32), np.empty((3 * size, count), np.float32)
    for t in range(length):
        np.take(inputs, windows[t], axis=1, out=a, mode="clip")
        np.matmul(recurrent, out[t], out=m)
        gates = a[: 2 * size]
        gates += m[: 2 * size]
        gates *= 0.5
        np.tanh(gates, out=gates)
        gates *= 0.5
        gates += 0.5
        update, reset, new = a[:size], a[size : 2 * size], a[2 * size :]
        if keep:
            kept.append((update.copy(), reset.copy(), m[2 * size :].copy()))
        m[2 * size :] *= reset
        new += m[2 * size :]
        np.tanh(new, out=new)
        if keep:
            kept[-1] += (new.copy(),)
        np.subtract(out[t], new, out=out[t + 1])
        out[t + 1] *= update
        out[t + 1] += new
    return (out, kept) if keep else out


def backwards(windows, recurrent, out, kept, given) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the inputs and recurrent weights; given: those of the states, per step."""
    size = recurrent.shape[1]
    into, rec = np.zeros((len(windows), 3 * size, windows.shape[1]), np.float32), np.zeros_like(recurrent)
    back = np.zeros_like(out[0])
    for t in range(len(windows) - 1, -1, -1):
        update, reset, drive, new = kept[t]
        g = given[t] + back
        g_new = g * (1 - update) * (1 - new * new)
        g_update = g * (out[t] - new) * update * (1 - update)
        g_reset = g_new * drive * reset * (1 - reset)
        through = np.concatenate([g_update, g_reset, g_new * reset])
        rec += through @ out[t].T
        back = g * update + recurrent.T @ through
        into[t] = np.concatenate([g_update, g_reset, g_new])
    flat, bytes_ = into.transpose(1, 0, 2).reshape(3 * size, -1), windows.ravel()
    return np.stack([np.bincount(bytes_, row, 256) for row in flat]).astype(np.float32), rec


def probabilities(net: Network, windows: np.ndarray, turned: np.ndarray) -> np.ndarray:
    """(languages, length, windows): of the bytes (length, windows) and the same turned round."""
    forth = states(net.inputs[0], net.recurrent[0], windows)[1:]
    back = states(net.inputs[1], net.recurrent[1], turned)[1:][::-1]
    size = forth.shape[1]
    scores = net.output[:, :size] @ forth.transpose(1, 0, 2).reshape(size, -1)
    scores += net.output[:, size:] @ back.transpose(1, 0, 2).reshape(size, -1)
    scores += net.bias[:, None]
    scores -= scores.max(0)
    np.exp(scores, out=scores)
    scores /= scores.sum(0)
    return scores.reshape(len(net.languages), *windows.shape)


def gradients(params: list[np.ndarray], windows: np.ndarray, lang: np.ndarray, weight: np.ndarray | None = None) -> list[np.ndarray]:
    """Of the mean cross entropy over the letters of windows (length, windows), which may have weights."""
    h = params[2].shape[1]
    turned = np.ascontiguousarray(windows[::-1])
    forth, kept_f = states(params[0], params[2], windows, True)
    back, kept_b = states(params[1], params[3], turned, True)
    both = np.concatenate([forth[1:], back[1:][::-1]], 1)
    scores = np.einsum("ch,thb->tcb", params[4], both) + params[5][None, :, None]
    scores = np.exp(scores - scores.max(1, keepdims=True))
    g = scores / scores.sum(1, keepdims=True)
    g[:, lang, np.arange(len(lang))] -= 1
    letter = _letters[windows]
    share = letter / max(1, letter.sum())
    g *= (share if weight is None else share * weight)[:, None, :]
    g = g.astype(np.float32)
    to_state = np.einsum("ch,tcb->thb", params[4], g)
    grads = [None] * 6
    grads[0], grads[2] = backwards(windows, params[2], forth, kept_f, to_state[:, :h])
    grads[1], grads[3] = backwards(turned, params[3], back, kept_b, to_state[::-1, h:])
    grads[4], grads[5] = np.einsum("tcb,thb->ch", g, both), g.sum((0, 2))
    return grads


def adam(params, grads, first, second, step: int, rate: float) -> None:
    for p, q, m, v in zip(params, grads, first, second):
        q = np.clip(q, -1, 1)
        m += 0.1 * (q - m)
        v += 0.01 * (q * q - v)
        p -= rate * (m / (1 - 0.9 ** (step + 1))) / (np.sqrt(v / (1 - 0.99 ** (step + 1))) + 1e-6)


def network(languages: tuple[str, ...], params: list[np.ndarray]) -> Network:
    return Network(languages, (params[0], params[1]), (params[2], params[3]), params[4], params[5])


def parameters(net: Network) -> list[np.ndarray]:
    return [*net.inputs, *net.recurrent, net.output, net.bias]


def train(
    texts: list[bytes], labels: list[str], steps: int = STEPS, seed: int = 7, languages: tuple[str, ...] = ()
) -> Network:
    """Adam on the mean cross entropy of all letter positions of random windows.

    Of `languages` also those get an output that no text here has.
    """
    rng = np.random.default_rng(seed)
    languages = languages or tuple(sorted(set(labels)))
    by = [[x for x, y in zip(texts, labels) if y == lang and x] for lang in languages]
    by = [x or [b" "] for x in by]
    h, c = HIDDEN, len(languages)
    shapes = [(3 * h, 256), (3 * h, 256), (3 * h, h), (3 * h, h), (c, 2 * h), (c,)]
    scale = [0.3, 0.3, h**-0.5, h**-0.5, 0.3, 0]
    params = [rng.normal(0, s, shape).astype(np.float32) if s else np.zeros(shape, np.float32) for s, shape in zip(scale, shapes)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(steps):
        lang = rng.integers(0, c, BATCH)
        windows = np.full((BATCH, WINDOW), 32, np.uint8)
        for i, of in enumerate(lang):
            text = by[of][rng.integers(len(by[of]))]
            at = rng.integers(max(1, len(text) - WINDOW + 1))
            part = np.frombuffer(text[at : at + WINDOW], np.uint8)
            windows[i, : len(part)] = part
        grads = gradients(params, np.ascontiguousarray(windows.T), lang)
        adam(params, grads, first, second, step, RATE * min(1.0, 2 * (1 - step / steps)))
    return network(languages, params)


def pooled(net: Network, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, languages): the mean probabilities over the letter bytes of each text."""
    texts = len(offsets) - 1
    sizes = np.diff(offsets)
    count = -(-sizes // WINDOW)
    of = np.repeat(np.arange(texts), count)
    start = offsets[:-1][of] + (np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)) * WINDOW
    total, letters = np.zeros((texts, len(net.languages))), np.zeros(texts)
    padded = np.concatenate([data, np.full(WINDOW, 32, np.uint8)])
    for lo in range(0, len(of), ABREAST):
        at, own = start[lo : lo + ABREAST], of[lo : lo + ABREAST]
        place = at[:, None] + np.arange(WINDOW)
        windows = padded[place]
        windows[place >= offsets[own + 1][:, None]] = 32
        windows = np.ascontiguousarray(windows.T)
        p = probabilities(net, windows, np.ascontiguousarray(windows[::-1]))
        letter = _letters[windows].astype(np.float32)
        letters += np.bincount(own, letter.sum(0), texts)
        for i in range(len(net.languages)):
            total[:, i] += np.bincount(own, np.einsum("tb,tb->b", p[i], letter), texts)
    return total / np.maximum(1, letters)[:, None]


def fit(docs: DataFrame, key: str = "doc_id", sample: int = SAMPLE, languages: tuple[str, ...] = ()) -> Network | None:
    """Learn from the rows of (key, text, lang) whose lang and text are not null.

    The sample is a hash threshold set from a count of all such rows.
    """
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL").withColumn(
        "_order", F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1 << 30))
    )
    total = known.count()
    chosen = known.where(F.col("_order") < int((1 << 30) * min(1.0, sample / max(1, total))))
    rows = chosen.select("_order", "lang", "text").toArrow().sort_by([("_order", "ascending"), ("lang", "ascending"), ("text", "ascending")])
    if not len(rows):
        return None
    return train([x.encode() for x in rows.column("text").to_pylist()], rows.column("lang").to_pylist(), languages=languages)


def whole_windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every window of the texts (windows, WINDOW), filled up with blanks, and its text."""
    count = -(-np.diff(offsets) // WINDOW)
    of = np.repeat(np.arange(len(count)), count)
    start = offsets[:-1][of] + (np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)) * WINDOW
    place = start[:, None] + np.arange(WINDOW)
    windows = np.concatenate([data, np.full(WINDOW, 32, np.uint8)])[place]
    windows[place >= offsets[of + 1][:, None]] = 32
    return windows, of


def learner(net: Network, weights: np.ndarray):
    """Steps over every window of a task's rows (text, lang); out come its parameters times its windows."""
    number = {lang: i for i, lang in enumerate(net.languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        params = [p.copy() for p in parameters(net)]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        steps = seen = 0
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            lang = np.array([number[x] for x in batch.column("lang").to_pylist()], np.int64)
            for lo, hi in runs(offsets):
                part = offsets[lo : hi + 1]
                windows, of = whole_windows(data[part[0] : part[-1]], part - part[0])
                # Neighbours are of one text; a step takes windows from all over the run.
                for at in range(-(-len(windows) // SIDE)):
                    chosen = slice(at, None, -(-len(windows) // SIDE))
                    own = lang[lo + of[chosen]]
                    grads = gradients(params, np.ascontiguousarray(windows[chosen].T), own, weights[own])
                    adam(params, grads, first, second, steps, SLOW * len(own) / SIDE)
                    steps, seen = steps + 1, seen + len(own)
        if seen:
            flat = np.concatenate([p.ravel() for p in params]).astype(float)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat * seen), pa.array(np.full(len(flat), seen))],
                names=["place", "total", "seen"],
            )

    return run


def fit_all(docs: DataFrame, key: str = "doc_id") -> Network | None:
    """Learn from every byte of the rows of (key, text, lang) whose lang and text are not null.

    The network that `fit` learns is where all tasks start. Each goes on over every window of its rows,
    rare languages weighing more, and the result is the mean of what the tasks have, by their windows.
    Spark adds the parameters up, so one network comes to the driver, however many tasks there are.
    """
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.sum(F.octet_length("text").cast("bigint")).alias("n")).collect()}
    languages = tuple(sorted(sizes))
    start = fit(docs, key, languages=languages)
    if start is None and languages:  # the sample's threshold may leave a few rows out
        start = train([b" "], [languages[0]], languages=languages)
    if start is None or not sum(sizes.values()):
        return start
    weights = np.array([sum(sizes.values()) / (len(languages) * max(1, sizes[x])) for x in languages], np.float32)
    moved = known.select("text", "lang").mapInArrow(learner(start, weights), "place int, total double, seen bigint")
    means = moved.groupBy("place").agg((F.sum("total") / F.sum("seen")).alias("mean")).toArrow().sort_by("place")
    flat, at, params = means.column("mean").to_numpy().astype(np.float32), 0, []
    for p in parameters(start):
        params.append(flat[at : at + p.size].reshape(p.shape))
        at += p.size
    return network(languages, params)


def labeller(spark: SparkSession, net: Network | None) -> Callable[[Column], Column]:
    """A function from a text column to struct<lang, score>."""
    if net is None:
        return lambda text: F.struct(F.lit("und").alias("lang"), F.lit(0.0).alias("score"))
    shared = spark.sparkContext.broadcast(net)

    @F.arrow_udf("struct<lang:string,score:double>")
    def label(column: pa.Array) -> pa.Array:
        net = shared.value
        data, offsets = buffers(column)
        parts = [np.zeros((0, len(net.languages)))]
        for first, last in runs(offsets):
            part = offsets[first : last + 1]
            parts.append(pooled(net, data[part[0] : part[-1]], part - part[0]))
        p = np.concatenate(parts)
        best = p.argmax(1) if len(p) else np.zeros(0, int)
        names = pa.array([net.languages[i] for i in best], pa.string())
        return pa.StructArray.from_arrays([names, pa.array(np.clip(p.max(1, initial=0), 0, 1))], ["lang", "score"])

    def checked(text: Column) -> Column:
        found = label(text)
        und = F.struct(F.lit("und").alias("lang"), F.lit(0.0).alias("score"))
        return F.when(text.rlike(r"\p{L}"), found).otherwise(und)

    return checked


def op9_lang_id(spark: SparkSession, folder: str) -> DataFrame:
    """Language and score of every document; the held-out quarter's labels are never read."""
    docs = table(spark, folder, "documents")
    fold = crc_fold("doc_id", FOLDS) == HELD_OUT
    net = fit(docs.where(~fold).select("doc_id", "text", "lang"))
    found = docs.select("doc_id", fold.alias("held_out"), labeller(spark, net)(F.col("text")).alias("found"))
    return found.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))
