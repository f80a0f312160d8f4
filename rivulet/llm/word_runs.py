"""Stretches of a text that repeat with a period, and the text with each repetition written once.

A run is a stretch of words in which words ``period`` apart are equal, ``period`` being its smallest period, of at
least six words and four periods, that cannot be extended on either side. Words are read from left to right. Each word
lengthens the match on the lags (diagonals) at which what it ends was seen before; a diagonal that the next word
does not lengthen ends, and is a run when its match is long enough.

The table of diagonals is sparse. A run of period q in [s, 2s) repeats stretches of 3s words at lag q, and between two
such stretches no third one lies: it would give the run a smaller period. So a word needs, for every s = 2, 4, 8, ...,
only the nearest earlier place where the same 3s words end, and counts when that is at least s and less than 2s
words back; for the period 1 it is the word before. That finds every run, and none twice, with at most one live diagonal
per power of two, whatever the text: n log n steps also for one word repeated a million times.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the definition: the shortest run in words, and in periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
# Words that are searched together; a longer text is searched alone.
SLICE = 300_000
RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _ranks(keys: np.ndarray) -> np.ndarray:
    """Numbers that are equal where the keys are; -1 where a key occurs once."""
    order = np.argsort(keys, kind="stable")
    first = np.ones(len(keys), bool)
    first[1:] = keys[order[1:]] != keys[order[:-1]]
    group = np.cumsum(first) - 1
    out = np.empty(len(keys), np.int64)
    out[order] = np.where(np.bincount(group, minlength=1)[group] > 1, group, -1)
    return out


def earlier(ids: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, lag, words matched so far) for the lags that matter, in the order of the words.

    ``ids`` numbers the words of one or more texts, apart for each text; ``place`` is the place inside its text.
    """
    n = len(ids)
    at = np.flatnonzero((ids[1:] == ids[:-1]) & (place[1:] > 0)) + 1
    found = [(at, np.ones(len(at), np.int64), np.ones(len(at), np.int64))]
    rank, at, size = _ranks(ids), np.arange(n), 1

    def longer(rank: np.ndarray, at: np.ndarray, step: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of the stretches of ``size`` words that end at each word, from those of fewer words, ``step`` apart."""
        at = at[(place[at] >= size - 1) & (rank[at] >= 0)]
        at = at[rank[at - step] >= 0]
        out = np.full(n, -1, np.int64)
        if len(at):
            out[at] = _ranks(rank[at - step] * n + rank[at])
        return out, at[out[at] >= 0]

    rank, at = longer(rank, at, 1, 2)
    rank, at = longer(rank, at, 1, 3)
    size, scale = 3, 1
    while len(at):
        rank, at = longer(rank, at, size, 2 * size)
        size, scale = 2 * size, 2 * scale
        order = at[np.argsort(rank[at], kind="stable")]
        lag = order[1:] - order[:-1]
        near = (rank[order[1:]] == rank[order[:-1]]) & (lag >= scale) & (lag < 2 * scale)
        found.append((order[1:][near], lag[near], np.full(near.sum(), size, np.int64)))
    word, lag, matched = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(word, kind="stable")
    return word[order], lag[order], matched[order]


def diagonals(word: np.ndarray, lag: np.ndarray, matched: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(start, length, period) of the runs, each as soon as its diagonal ends."""
    live: dict[int, list[int]] = {}
    now = -1
    for i, q, m in zip(word.tolist(), lag.tolist(), matched.tolist()):
        if i != now:
            for p in [p for p, (last, _) in live.items() if last < i - 1]:
                yield from _ended(p, *live.pop(p))
            now = i
        if q in live:
            live[q][0] = i
            live[q][1] += 1
        else:
            live[q] = [i, m]
    for p, d in live.items():
        yield from _ended(p, *d)


def _ended(period: int, last: int, matched: int) -> Iterator[tuple[int, int, int]]:
    length = matched + period
    if length >= max(LEAST_WORDS, LEAST_PERIODS * period):
        yield last - length + 1, length, period


def find(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs of each text, given as words, by start and period."""
    sizes = np.array([len(t) for t in texts], np.int64)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    n = int(sizes.sum())
    if not n:
        return out
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for t in texts for w in t), np.int64, n)
    begin = np.cumsum(sizes) - sizes
    text = np.repeat(np.arange(len(texts)), sizes)
    for start, length, period in diagonals(*earlier(text * len(known) + ids, np.arange(n) - begin[text])):
        t = text[start]
        out[t].append((int(start - begin[t]), length, period))
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in out]


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by spaces, without those that a run holds after its first period."""
    if not runs:
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return b" ".join(compress(words, (np.cumsum(edge[:-1]) == 0).tolist()))


def slices(texts: list, limit: int = SLICE) -> Iterator[list[list[bytes]]]:
    """Words of the texts, some texts at a time; a null has none. ``bytes.split`` parts at x20 and x09 to x0D."""
    held, n = [], 0
    for t in texts:
        words = (t or "").encode().split()
        if held and n + len(words) > limit:
            yield held
            held, n = [], 0
        held.append(words)
        n += len(words)
    if held:
        yield held


def scan(docs: DataFrame, text: str = "text", into: str = "repeats") -> DataFrame:
    """Add ``into``: ``runs`` (start, length and period in words, by start) and ``collapsed``, the text without repetition.

    A null or empty text has no runs and collapses to the empty text. Rows are judged one by one, so repeated rows get
    equal results and an empty table gives no rows. Other columns pass through; one named ``into`` is replaced.
    """
    kind = pa.struct([("runs", RUNS), ("collapsed", pa.string())])

    @F.arrow_udf("struct<runs:array<struct<start:long,length:long,period:long>>,collapsed:string>")
    def repeats(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = []
            for words in slices(batch.to_pylist()):
                for w, runs in zip(words, find(words)):
                    rows.append({"runs": [dict(zip(("start", "length", "period"), r)) for r in runs], "collapsed": collapse(w, runs).decode()})
            yield pa.array(rows, kind)

    return docs.withColumn(into, repeats(F.col(text)))


def replanted(text: Column, id: Column) -> Column:
    """Every tenth text, by the checksum of its id, made periodic from some word on; the others as they are.

    A row without an id stays as it is.
    """
    @F.arrow_udf("string")
    def periodic(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, checksums in batches:
            rows = texts.to_pylist()
            for i, h in enumerate(checksums.to_pylist()):
                words = rows[i].encode().split() if rows[i] and h is not None and h % 10 == 0 else []
                if words:
                    g, n = h // 10, len(words)
                    a = g % n
                    p = 1 + (n - a) // (3 + g % 8)
                    rows[i] = b" ".join(words[:a] + (words[a:a + p] * ((n - a) // p + 1))[:n - a]).decode()
            yield pa.array(rows, pa.string())

    return periodic(text, F.crc32(id.cast("string").cast("binary")))


def report(docs: DataFrame) -> DataFrame:
    """Per row of ``documents``, every tenth made periodic: number of runs, the longest one, digests of runs and collapsed text."""
    found = scan(docs.select("doc_id", replanted(F.col("text"), F.col("doc_id")).alias("text"))).select("doc_id", "repeats.*")
    longest = F.get(F.array_sort("runs", lambda x, y: (
        F.when(x["length"] != y["length"], F.when(x["length"] > y["length"], -1).otherwise(1))
        .when(x["start"] != y["start"], F.when(x["start"] < y["start"], -1).otherwise(1))
        .when(x["period"] < y["period"], -1).when(x["period"] > y["period"], 1).otherwise(0))), 0)
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    top = found.withColumn("_top", longest)
    return top.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        F.col("_top.start").alias("start"), F.col("_top.length").alias("length"), F.col("_top.period").alias("period"),
        F.expr("_top.length * 1000 div _top.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )
