"""Secrets in whole texts: three plain patterns, and strings that a tokenizer finds random.

A vocabulary learned from ordinary text covers ordinary strings with few, long tokens; a
random string breaks into short ones. Runs of letters, digits and + / = _ - of MIN_RUN
characters or more are random if they have at most MAX_RATIO characters per token. Not tested:
known digests (hexadecimal, with the length of a usual hash function), numbers, and
identifiers: their parts between signs, digits and changes of case are mostly long, and these have
WORD_RATIO characters per token or more. Letters of one case may be short words joined by signs:
there only the pieces between signs that are no tokens themselves are tested. UUIDs part a run.
In a run that is not random as a whole, words are set aside, and what lies between them is tested
alike. A run inside one of the plain spans is not told again.

Spans count code points, end exclusive, and cover whole matches. Null and empty texts have
no spans, repeated rows the same ones, also of a null id. Very long texts are scanned whole. An empty
table gives an empty result. Only the text is read, so other columns may have any name. The vocabulary file is read by the driver, from a path
that is a parameter, and broadcast (its size is fixed).
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import table
from .words import buffers, runs, spans

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the vocabulary's tokenizer cuts text before it merges bytes. Fixed value.
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MIN_RUN = 16
MAX_RATIO = 2.2
WORD_RATIO = 3.0
KINDS = ("assign", "access", "hex", "random")

ASSIGN = re.compile(
    r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
RUN = re.compile(rf"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/=_-]{{{MIN_RUN},}}")
KEYWORDS = ("passw", "secret", "token", "api")
#: Lengths in hexadecimal digits of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512. Fixed values.
DIGESTS = {32, 40, 56, 64, 96, 128}
UUID = re.compile(r"(?<![0-9A-Za-z])[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}(?![0-9A-Za-z])")
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")

_run_bytes = np.zeros(256, np.uint8)
for _sign in b"+/=_-":
    _run_bytes[_sign] = 1
for _first, _last in (("0", "9"), ("A", "Z"), ("a", "z")):
    _run_bytes[ord(_first) : ord(_last) + 1] = 1

_span_list = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())]))

_encoders: dict[int, tiktoken.Encoding] = {}


def worded(run: str, tokens: Callable[[str], int]) -> bool:
    """Whether a run consists mostly of words: long parts that take few tokens, in their own or lower case."""
    parts = PART.findall(run)
    long = [p for p in parts if len(p) >= 4]
    size = sum(map(len, long))
    if not long or size < 0.7 * sum(map(len, parts)):
        return False
    return size >= WORD_RATIO * sum(min(tokens(p), tokens(p.lower()), tokens(f" {p.lower()}")) for p in long)


def digest(run: str) -> bool:
    return len(run) in DIGESTS and bool(re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", run))


def known(run: str, tokens: Callable[[str], int]) -> bool:
    """Whether a run is a digest, a number or an identifier made of words."""
    if digest(run) or not re.search(r"[A-Za-z]", run):
        return True
    return worded(run, tokens)


def one_case(run: str) -> bool:
    """Whether a run has letters of one case, perhaps with a capital at the start of words, and no digit."""
    return not re.search(r"\d|[a-z][A-Z]|[A-Z]{2}[a-z]", run)


def unworded(run: str, tokens: Callable[[str], int]) -> Iterator[tuple[int, int]]:
    """(start, end) of the random pieces of letters of one case, joined by signs where several follow each other."""
    pieces = [(m.start(), m.end()) for m in re.finditer("[A-Za-z]+", run)]
    count = [min(tokens(run[a:b]), tokens(f" {run[a:b].lower()}")) for a, b in pieces]
    start = 0
    for i in range(len(pieces) + 1):
        if i == len(pieces) or count[i] == 1 or worded(run[slice(*pieces[i])], tokens):
            if start < i:
                a, b = pieces[start][0], pieces[i - 1][1]
                letters = sum(y - x for x, y in pieces[start:i])
                if b - a >= MIN_RUN and letters <= MAX_RATIO * sum(count[start:i]):
                    yield a, b
            start = i + 1


def between_words(run: str, tokens: Callable[[str], int]) -> Iterator[tuple[int, int]]:
    """(start, end) of the random stretches between the words of a run.

    Short pieces and numbers don't part a stretch, as base64 has signs too, but are not evidence
    at its ends.
    """
    pieces = [(m.start(), m.end()) for m in re.finditer("[A-Za-z0-9]+", run)]
    stretch: list[tuple[int, int]] = []
    for a, b in [*pieces, (0, 0)]:
        piece = run[a:b]
        if piece and not worded(piece, tokens) and not digest(piece):
            stretch.append((a, b))
            continue
        firm = [n for n, (x, y) in enumerate(stretch) if y - x >= 4 and not run[x:y].isdigit()]
        if firm:
            first, last = stretch[firm[0]][0], stretch[firm[-1]][1]
            if last - first >= MIN_RUN and last - first <= MAX_RATIO * tokens(run[first:last]):
                yield stretch[0][0], stretch[-1][1]
        stretch = []


def pieces_of(run: str) -> Iterator[tuple[int, int]]:
    """(start, end) of what UUIDs leave of a run, without signs at the ends."""
    at = 0
    for a, b in [*[m.span() for m in UUID.finditer(run)], (len(run), len(run))]:
        piece = run[at:a].strip("=-_/+")
        if len(piece) >= MIN_RUN:
            start = run.index(piece, at)
            yield start, start + len(piece)
        at = b


def assignments(text: str) -> list[tuple[int, int, int]]:
    """Texts without a long run can only hold assignments: the other kinds are long runs."""
    if ("=" in text or ":" in text) and any(k in text.lower() for k in KEYWORDS):
        return [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    return []


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three plain patterns."""
    found = assignments(text)
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    return found + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]


def random_spans(text: str, tokens: Callable[[str], int], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the runs that the tokenizer finds random."""
    found = []
    for m in RUN.finditer(text):
        for a, b in pieces_of(m[0]):
            run, start = m[0][a:b], m.start() + a
            if one_case(run):
                parts = list(unworded(run, tokens))
            elif digest(run) or not re.search("[A-Za-z]", run):
                continue
            elif not known(run, tokens) and len(run) <= MAX_RATIO * tokens(run):
                parts = [(0, len(run))]
            else:
                parts = list(between_words(run, tokens))
            told = [(start + x, 3, start + y) for x, y in parts]
            found += [t for t in told if not any(x <= t[0] and t[2] <= y for x, _, y in base)]
    return found


def long_runs(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts have a run long enough for the hexadecimal or random kind."""
    starts, ends = spans(_run_bytes[data], offsets)
    far = ends - starts >= MIN_RUN
    held = np.zeros(len(offsets) - 1, bool)
    held[np.searchsorted(offsets, starts[far], "right") - 1] = True
    return held


def scanner(spark: SparkSession, vocabulary: str = VOCABULARY) -> Callable[[Column], Column]:
    """A function from a text column to its spans, array<struct<start, kind, end>>."""
    with open(vocabulary, "rb") as file:
        shared = spark.sparkContext.broadcast(file.read())

    @F.arrow_udf("array<struct<start:bigint,kind:string,end:bigint>>")
    def scan(column: pa.Array) -> pa.Array:
        def tokens(run: str) -> int:
            if 0 not in _encoders:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, shared.value.splitlines())}
                _encoders[0] = tiktoken.Encoding("runs", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
            return len(_encoders[0].encode_ordinary(run))

        def each() -> Iterator[list[dict]]:
            data, offsets = buffers(column)
            for first, last in runs(offsets):
                part = offsets[first : last + 1]
                held = long_runs(data[part[0] : part[-1]], part - part[0])
                for i in range(first, last):
                    text = column[i].as_py() or ""
                    found = base_spans(text) if held[i - first] else assignments(text)
                    if held[i - first]:
                        found += random_spans(text, tokens, found)
                    yield [{"start": a, "kind": KINDS[k], "end": b} for a, k, b in sorted(found)]

        return pa.array(each(), _span_list)

    return scan


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    return F.array_join(F.transform(spans, one), ",")


def op10_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of the plain kinds, a digest of their spans, and all spans of every document."""
    docs = table(spark, folder, "documents")
    found = docs.select("doc_id", scanner(spark)(F.col("text")).alias("found"))

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(written(F.filter("found", lambda s: s["kind"] != "random")), 256).alias("base_sha256"),
        written(F.col("found")).alias("spans"), count("random"),
    )
