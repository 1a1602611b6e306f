"""The main text of web pages, by a minimum cut between content and boilerplate.

A page is read into blocks: text between tags that start or end a block. Each block has a cost
of being called content and one of being called boilerplate, the capacities of its edges to
the two terminals. They come from a logistic regression on what the text looks like (length,
links, sentences, kind of element, neighbours) and on what is around it: classes and ids with words
of two lists, forms and the number of their controls. These are features, learned from the sample;
none of them decides alone. A named element or form counts the less, the more of the page's prose it
holds, as what holds nearly all of it is no sidebar. Elements whose meaning is their tag (nav, footer,
article, ...) add EVIDENCE; that of article and main is weaker in a named element or form inside them.
Neighbours in page order are joined by an edge, and more strongly if they have the same parent,
so that a short line between paragraphs goes with them. The maximum flow gives the cheapest
labelling; the content side of the cut, in page order, is the text.

The regression is trained on a bounded sample of pages with article or main: blocks inside are
content, those outside boilerplate. Its weights are drawn to PLAIN, which holds where the sample says nothing.

Scripts, styles, comments of the markup, forms' controls and the head are never text; nor is
noscript, which is a notice to readers without scripts, nor what audio, video, object and canvas hold
for browsers that can't show them. An aside is a sidebar, also inside an article. Character
references are decoded and white space in a block is one blank. Null and empty pages, and those
without content, have empty text. Cut-off tags end the page. Repeated rows are read alike. Very long
and deeply nested pages take time in proportion to their length, but for the flow. An empty table
gives an empty result. Columns beside url and html may have any name.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from html import unescape
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import table

#: Pages that are learned from, about; those with the smallest hashes.
SAMPLE = 512
#: Blocks of one page that are learned from, those with the smallest hashes of their text.
SAMPLE_BLOCKS = 256
#: In units of the regression's log odds: what elements around a block say, and the two edges.
EVIDENCE, NEIGHBOUR, SIBLING = 6.0, 0.6, 0.9
#: The regression alone decides less than an element that says what it is.
MOST = 3.0
#: How strongly the weights are drawn to PLAIN; a page weighs 1.
RIDGE = 0.5
#: How far the names of a section's id count, as it is often a slug of its heading: alone and outside
#: article and main, and else.
SECTION, SLUG = 0.9, 0.35

DROPPED = "script|style|noscript|template|title|svg|iframe|object|canvas|audio|video|select|textarea|button"
#: Without an end tag these reach to the end of the page; of others only the tag is dropped.
TO_END = {"script", "style", "textarea", "title"}
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{DROPPED})(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*>"
    r"|<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[!?/a-z][^>]*(?:>|\Z)|(?P<text>[^<]+|<)",
    re.S | re.I,
)
ENDS = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in DROPPED.split("|")}
NAMES = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

SENTENCE_ENDS = ".!?…:;\"'”»)"
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup p pre search section "
    "summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that end by themselves where one of these starts inside them.
ENDED_BY = {"p": BLOCKS - {"td", "th", "tr"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}}
SET_APART = set("nav footer aside head menu search dialog".split())
CONTENT_TAGS = {"article", "main"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
APART_NAMES = set(
    "ad ads adv advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments consent "
    "cookie cookies copyright dialog disqus discussion foot footer form gdpr header legal links login masthead menu "
    "modal nav navbar navigation newsletter notice notification overlay pager pagination paywall popup promo promotion "
    "recommended recommendations register related replies reply respond search share sharing sidebar signup skip social "
    "sponsor sponsored subscribe subscription tags teaser toolbar topbar widget widgets".split()
)
CONTENT_NAMES = set("article articlebody content entry main post story body text".split())
#: Words that say nothing inside article or main, which have headers of their own.
OWN_NAMES = {"header", "head", "masthead"}
CONTROLS = re.compile(r"input|select|textarea|button", re.I)


class Level(NamedTuple):
    """An open element, with what holds for the text in it."""

    tag: str
    number: int
    #: What the elements around say: 1 content, -1 set apart; whether that is final; inside article or main.
    said: float = 0.0
    firm: bool = False
    inside: bool = False
    content: bool = False
    #: The innermost named element or form, in the list of marks.
    mark: int = -1


class Mark:
    """A named element or form: how much it counts, the mark around it, its prose and controls."""

    def __init__(self, form: bool, strength: float, outer: int):
        self.form, self.strength, self.outer = form, strength, outer
        self.prose = self.words = self.controls = 0.0


class Block(NamedTuple):
    text: str
    tag: str
    parent: int
    linked: int
    said: float
    #: How much named elements, forms, and controls of forms count; a content name; inside article or main.
    apart: float
    form: float
    controls: float
    content: bool
    inside: bool


@lru_cache(4096)
def named(tag: str, rest: str, inside: bool) -> tuple[float, bool]:
    """How strongly class and id set an element apart, and whether they call it content."""
    given = [(n[0].lower() == "id", w.lower()) for n in NAMES.findall(rest) for w in WORD.findall(" ".join(n[1:]))]
    names, ids = ({w for k, w in given if k == kind} for kind in (False, True))
    if tag in HEADINGS:
        ids = set()
    if tag == "form":
        names, ids = names - {"form"}, ids - {"form"}
    own = OWN_NAMES if inside else set()
    content = bool((names | ids) & CONTENT_NAMES)
    if content:
        return 0.0, not (names | ids) & (APART_NAMES - own)
    if names & APART_NAMES - own:
        return 1.0, False
    if ids & APART_NAMES - own:
        return (1.0 if tag != "section" else SECTION if ids <= APART_NAMES and not inside else SLUG), False
    return 0.0, False


def prose(text: str, linked: int) -> int:
    """Words of a block that reads like sentences."""
    words = text.count(" ") + 1
    return words if words >= 4 and text[-1] in SENTENCE_ENDS and 2 * linked < len(text) else 0


def weighed(found: list[tuple], marks: list[Mark]) -> list[Block]:
    """Blocks with what the marks around them say."""
    total = words = 0
    for text, _, _, linked, level in found:
        own = prose(text, linked)
        total, words = total + own, words + text.count(" ") + 1
        if level.mark >= 0:
            marks[level.mark].prose += own
            marks[level.mark].words += text.count(" ") + 1
    for m in reversed(marks):
        if m.outer >= 0:
            outer = marks[m.outer]
            outer.prose, outer.words = outer.prose + m.prose, outer.words + m.words
    says: list[tuple[float, float, float]] = []
    for m in marks:
        share = m.prose / total if total else m.words / max(1, words)
        weight = m.strength * (1 - share**4)
        apart, form, controls = says[m.outer] if m.outer >= 0 else (0.0, 0.0, 0.0)
        if m.form:
            form, controls = max(form, weight), float(np.log1p(m.controls)) * weight
        else:
            apart = max(apart, weight)
        says.append((apart, form, controls))
    none = (0.0, 0.0, 0.0)
    return [
        Block(text, tag, parent, linked, level.said, *(says[level.mark] if level.mark >= 0 else none), level.content, level.inside)
        for (text, tag, parent, linked, level) in found
    ]


def opened(tag: str, number: int, rest: str, around: Level, marks: list[Mark]) -> Level:
    """The level of a new element, from the one around it."""
    said, firm, inside, content, mark = around[2:]
    if tag in SET_APART or (tag == "header" and said <= 0):
        said, firm, inside = -1.0, True, False
    elif tag in CONTENT_TAGS:
        said, firm, inside = 1.0, False, True
    if tag == "form":
        marks.append(Mark(True, 1.0, mark))
        mark = len(marks) - 1
    if "=" in rest and tag not in ("body", "html") and not firm:
        strength, calls = named(tag, rest, inside)
        content = calls or (content and not strength)
        if strength:
            marks.append(Mark(False, strength, mark))
            mark = len(marks) - 1
    return Level(tag, number, said, firm, inside, content, mark)


def blocks(page: str) -> list[Block]:
    """Every block with text, in page order."""
    found: list[tuple] = []
    marks: list[Mark] = []
    root = Level("", 0)
    stack = [root]
    open_tags: dict[str, int] = {}
    # The last form that was opened: controls belong to it wherever its end tag stands.
    form = -1
    count, links, linked, in_body = 0, 0, 0, False
    parts: list[str] = []

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                found.append((text, stack[-1].tag, stack[-2].number if len(stack) > 1 else 0, linked, stack[-1]))
            parts.clear()
        linked = 0

    def close() -> None:
        open_tags[stack.pop().tag] -= 1

    def control(tag: str, rest: str) -> None:
        if form >= 0 and CONTROLS.fullmatch(tag) and "hidden" not in rest.lower():
            marks[form].controls += 1

    at, open_ended = 0, set()
    while m := TOKEN.match(page, at):
        at = m.end()
        if raw := m["raw"]:
            raw = raw.lower()
            control(raw, "")
            if raw == "svg" and m[0].endswith("/>"):
                continue
            end = None if raw in open_ended else ENDS[raw].search(page, at)
            if end:
                at = end.end()
            elif raw in TO_END:
                at = len(page)
            else:
                open_ended.add(raw)
            continue
        if (text := m["text"]) is not None:
            parts.append(text)
            if links:
                linked += len(text)
            continue
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag not in BLOCKS:
            if tag == "br":
                parts.append(" ")
            elif tag == "a":
                links = 0 if m["end"] else 1
            elif not m["end"]:
                control(tag, m["rest"])
            continue
        flush()
        if m["end"]:
            if open_tags.get(tag):
                while stack[-1].tag != tag:
                    close()
                close()
                links = 0
                form = -1 if tag == "form" else form
            continue
        while len(stack) > 1 and tag in ENDED_BY.get(stack[-1].tag, ()):
            close()
        if tag == "hr":
            continue
        if tag == "body" and not in_body:
            in_body = True
            while len(stack) > 1 and open_tags.get("head"):
                close()
        count += 1
        stack.append(opened(tag, count, m["rest"] or "", stack[-1], marks))
        open_tags[tag] = open_tags.get(tag, 0) + 1
        if tag == "form":
            form = next(i for i in range(len(marks) - 1, -1, -1) if marks[i].form)
    flush()
    return weighed(found, marks)


def features(found: list[Block]) -> np.ndarray:
    """What the regression sees of each block."""
    length = np.array([len(b.text) for b in found], float)
    words = np.array([b.text.count(" ") + 1 for b in found], float)
    log = np.log1p(words)
    ends = np.array([b.text[-1] in SENTENCE_ENDS for b in found], float)
    commas = np.array([b.text.count(",") + b.text.count(". ") for b in found]) / words
    linked = np.minimum(1, np.array([b.linked for b in found]) / length)
    kinds = [np.array([b.tag in k for b in found], float) for k in (("p", "blockquote", "pre"), ("h1", "h2", "h3", "h4", "h5", "h6"), ("li", "td", "th", "dd", "dt"))]
    before, after = np.concatenate([[0], log[:-1]]), np.concatenate([log[1:], [0]])
    around = [np.array([getattr(b, c) for b in found], float) for c in ("apart", "form", "controls", "content")]
    return np.stack([np.ones(len(found)), log, ends, np.minimum(1, commas * 5), linked, *kinds, before, after, *around], 1)


#: What the weights are drawn to: long sentences without links are content; named elements, forms and
#: controls are not.
PLAIN = np.array([-3.0, 0.8, 1.0, 0.5, -4.0, 0.8, 0.2, -0.8, 0.1, 0.1, -4.0, -4.0, -0.5, 1.0])


def labelled(page: str) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of some of the blocks of a page whose prose is mostly in article or main."""
    found = blocks(page)
    total = sum(prose(b.text, b.linked) for b in found)
    if not found or 2 * sum(prose(b.text, b.linked) for b in found if b.inside) < max(1, total):
        return np.zeros((0, len(PLAIN))), np.zeros(0)
    # Named elements and forms inside the article are not known to be content.
    chosen = [i for i, b in enumerate(found) if not b.inside or max(b.apart, b.form) < 0.5]
    chosen = sorted(sorted(chosen, key=lambda i: crc32(f"{found[i].text} {i}".encode()))[:SAMPLE_BLOCKS])
    return features(found)[chosen], np.array([float(found[i].inside) for i in chosen])


def train(samples: list[tuple[np.ndarray, np.ndarray]], rounds: int = 30) -> np.ndarray:
    """Weights of a logistic regression with a ridge around PLAIN, by Newton's method.

    Pages count equally, so long ones don't outweigh the others.
    """
    samples = [(x, y) for x, y in samples if len(y)]
    y = np.concatenate([np.zeros(0), *[s[1] for s in samples]])
    if not 0 < y.sum() < len(y):
        return PLAIN
    x = np.concatenate([s[0] for s in samples])
    w = np.concatenate([np.full(len(s[1]), 1 / len(s[1])) for s in samples])
    # Both kinds weigh the same.
    w = w * np.where(y > 0, 0.5 / w[y > 0].sum(), 0.5 / w[y == 0].sum())
    weights, ridge = PLAIN.copy(), RIDGE / len(samples)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (w * (p - y)) + ridge * (weights - PLAIN)
        curve = (x * (w * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(weights))
        weights = weights - np.linalg.solve(curve, slope)
    return weights


def minimum_cut(excess: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes are on the source side of the cheapest cut.

    excess: capacity from the source less that to the sink, as what both have in common flows
    straight through. edges: undirected. Maximum flow by shortest layered paths (Dinic).
    """
    n = len(excess)
    rest = list(excess)
    to: list[int] = []
    capacity: list[float] = []
    at: list[list[int]] = [[] for _ in range(n)]
    for u, v, c in edges:
        at[u].append(len(to))
        at[v].append(len(to) + 1)
        to += (v, u)
        capacity += (c, c)
    small = 1e-9
    while True:
        level = [0 if x > small else -1 for x in rest]
        queue = [v for v in range(n) if level[v] == 0]
        sinks = False
        for v in queue:
            for e in at[v]:
                u = to[e]
                if level[u] < 0 and capacity[e] > small:
                    level[u] = level[v] + 1
                    queue.append(u)
                    sinks = sinks or rest[u] < -small
        if not sinks:
            return [x >= 0 for x in level]
        step = [0] * n
        for source in [v for v in range(n) if level[v] == 0]:
            path: list[int] = []
            v = source
            while rest[source] > small:
                if rest[v] < -small:
                    push = min([rest[source], -rest[v], *[capacity[e] for e in path]])
                    for e in path:
                        capacity[e] -= push
                        capacity[e ^ 1] += push
                    rest[source] -= push
                    rest[v] += push
                    path, v = [], source
                    continue
                edges_of = at[v]
                while step[v] < len(edges_of):
                    e = edges_of[step[v]]
                    if capacity[e] > small and level[to[e]] == level[v] + 1:
                        break
                    step[v] += 1
                if step[v] < len(edges_of):
                    path.append(edges_of[step[v]])
                    v = to[path[-1]]
                elif path:
                    v = to[path.pop() ^ 1]
                    step[v] += 1
                else:
                    break


def main_text(page: str, weights: np.ndarray) -> str:
    found = blocks(page)
    if not found:
        return ""
    odds = np.clip(features(found) @ weights, -MOST, MOST)
    said = np.array([b.said * (1 - max(b.apart, b.form) if b.said > 0 else 1) for b in found])
    excess = (odds + EVIDENCE * said).tolist()
    edges = []
    last: dict[int, int] = {}
    for i, b in enumerate(found):
        if i:
            near = b.parent == found[i - 1].parent
            edges.append((i - 1, i, NEIGHBOUR + SIBLING * near))
            if not near and b.parent in last:
                # Blocks of one parent, with those of other elements between them.
                edges.append((last[b.parent], i, SIBLING))
        last[b.parent] = i
    kept = minimum_cut(excess, edges)
    return "\n".join(b.text for b, k in zip(found, kept) if k)


def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages to the features and labels of their blocks."""
    for batch in batches:
        found = [labelled(x.as_py() or "") for x in batch.column("html")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("at"), pa.array([x.tobytes() for x, _ in found], pa.binary()), pa.array([y.tobytes() for _, y in found], pa.binary())],
            names=["at", "x", "y"],
        )


def fit(pages: DataFrame, key: str = "url", html: str = "html", sample: int = SAMPLE) -> np.ndarray:
    """Learn from about `sample` pages with text, by a hash threshold on key and page.

    The workers read the pages; what comes to the driver is at most SAMPLE_BLOCKS rows of features of each.
    """
    known = pages.where(F.length(html) > 0)
    order = F.pmod(F.xxhash64(key, html), F.lit(1 << 30))
    total = known.count()
    chosen = known.select(order.alias("at"), F.col(html).alias("html")).where(
        F.col("at") < int((1 << 30) * min(1.0, sample / max(1, total)))
    )
    rows = chosen.mapInArrow(sampled, "at bigint, x binary, y binary").toArrow()
    rows = rows.sort_by([("at", "ascending"), ("y", "ascending")])
    return train([
        (np.frombuffer(x).reshape(-1, len(PLAIN)), np.frombuffer(y))
        for x, y in zip(rows.column("x").to_pylist(), rows.column("y").to_pylist())
    ])


def extractor(spark: SparkSession, weights: np.ndarray) -> Callable[[Column], Column]:
    """A function from a column of pages to their main text; null is empty."""
    shared = spark.sparkContext.broadcast(weights)

    @F.arrow_udf("string")
    def extract(column: pa.Array) -> pa.Array:
        return pa.array((main_text(x.as_py() or "", shared.value) for x in column), pa.string())

    return extract


def op8_html(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, folder, "pages")
    extract = extractor(spark, fit(pages))
    return pages.select("page_id", "url", extract(F.col("html")).alias("text")).withColumn(
        "n_chars", F.char_length("text").cast("bigint")
    )
