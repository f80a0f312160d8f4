"""Small tables with every awkward case, shared by the tests of this folder."""

from __future__ import annotations

import random

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int, words: int = 300) -> str:
    r = random.Random(seed)
    vocabulary = [f"{a}{b}{c}" for a in "bdklmnprst" for b in "aeiou" for c in "lmnrstx"][:words]
    out = []
    while len(out) < n:
        size = min(r.randint(4, 12), n - len(out))
        sentence = [r.choice(vocabulary) for _ in range(size)]
        sentence[0] = sentence[0].capitalize()
        out += [*sentence[:-1], sentence[-1] + "."]
    return " ".join(out)


def rows(texts: list, source: str = "s") -> list[tuple]:
    return [(i, t, "en", source, len(t) if t is not None else None) for i, t in enumerate(texts)]


def documents(spark, texts: list):
    return spark.createDataFrame(rows(texts), DOC)


def awkward(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, equal ids, clashing extra columns."""
    long = " ".join(f"w{i % 997}" for i in range(60_000))
    data = [
        (1, None, None, None, None), (None, None, "en", "s", 0), (None, prose(1, 80), "en", "s", 1), (2, "", "en", "s", 0),
        (3, " \n\t\n", "en", None, 4), (4, long, "en", "s", len(long)), (5, prose(2, 90), "en", "s", 1), (5, prose(2, 90), "en", "s", 1),
        (5, prose(3, 90), "en", "s", 1), (6, "x", "en", "s", 1), (7, "é" * 30_000, "fr", "s", 30_000), (8, "\x00 \x1c a", "en", "s", 5),
    ]
    names = ["_id", "_th", "_doc", "row", "n", "ids", "hash", "label", "_text", "spans", "kept", "host", "class_id", "_host", "_bad", "low"]
    schema = DOC + "".join(f", `{n}` string" for n in names)
    return spark.createDataFrame([(*d, *names) for d in data], schema)


def empty(spark):
    return spark.createDataFrame([], DOC)
