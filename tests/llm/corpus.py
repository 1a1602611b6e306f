"""Small tables with odd rows, and plain Python versions of what the operators compute."""

import re
from collections import defaultdict

FOLDER = "/root/testdata/sf0.001"

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
BASE = " ".join(f"word{n}" for n in range(60))
NEAR = BASE.replace("word30 ", "other ")
ODD = [
    (1, BASE, "en", "a", 1), (2, BASE.upper(), "en", "a", 1), (3, NEAR, "en", "b", 1),
    (4, None, None, None, None), (5, "", "en", "a", 0), (6, " \n\t ", "en", "b", 3),
    (7, "two words", "en", None, 9), (8, "Two\tWORDS ", "en", None, 9), (9, "é" * 5, "fr", "b", 5),
    (10, "x y " * 60_000, "en", "a", 240_000), (11, "123 456 !!", "en", "b", 10),
    (7, "two words", "en", None, 9), (None, "no id", "en", "a", 5), (None, None, None, None, None),
    (12, "a b c d", "en", "b", 7), (13, "a b c d e", "en", "b", 9), (14, "a b c d e f", "en", "b", 11),
]
LOWER = {n: n + 32 for n in range(65, 91)}


def odd(spark):
    """With columns whose names the operators use themselves."""
    df = spark.createDataFrame(ODD, DOCS)
    names = {"size": "doc_id", "Shard": "text", "slot": "lang", "row": "doc_id", "hash": "lang", "_key": "text", "copies": "doc_id", "class": "text", "words": "text"}
    return df.selectExpr("*", *[f"{v} AS `{k}`" for k, v in names.items()])


def empty(spark):
    return spark.createDataFrame([], DOCS)


def write(spark, folder, **tables):
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def shingles(text, size=5):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    runs = [tuple(words[i : i + size]) for i in range(len(words) - size + 1)] or ([tuple(words)] if words else [])
    return frozenset(runs)


def components(rows):
    """rows: (id, text). The smallest id reachable by links of 75 % over all pairs of rows."""
    sets = [shingles(t) for _, t in rows]
    of = list(range(len(rows)))

    def root(x):
        while of[x] != x:
            x = of[x]
        return x

    held = defaultdict(list)
    for n, s in enumerate(sets):
        meets = {m for g in s for m in held[g]}
        for m in meets:
            both = len(s & sets[m])
            if 100 * both >= 75 * (len(s) + len(sets[m]) - both):
                of[root(n)] = root(m)
        for g in s:
            held[g].append(n)
    least = {}
    for n, (i, _) in enumerate(rows):
        if i is not None:
            least[root(n)] = min(i, least.get(root(n), i))
    return [(i, len(s), None if i is None else least[root(n)]) for n, ((i, _), s) in enumerate(zip(rows, sets))]
