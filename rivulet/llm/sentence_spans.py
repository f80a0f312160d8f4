"""Passages that repeat across documents: every run of several consecutive sentences is hashed and joined globally.

A sentence ends at a stop, at a line break, and after words chosen by their hash, so that both copies of a passage are
cut at the same places however the words around it join on. From every sentence starts one run: the shortest with at
least ``SENTENCES`` sentences and ``WORDS`` words. Sentences may be long or few, so there are runs of exactly ``WORDS``
words besides: of every ``GAP`` such runs that start one after another, the one with the smallest hash. The words inside
alone decide which that is, so any ``WORDS + GAP - 1`` words that repeat share a run, whatever their stops and lines.
In scripts without spaces every character is a word. Of equal runs the one that is first by document and place stays; the
sentences under all others are removed. Only runs that occur twice are ever sent with their place: a first pass counts
hashes, a bitmap of the repeated ones lets the second pass drop the rest where they are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from ..session import settle
from .common import hash_filter, mix, original_id, passes, with_key

SENTENCES, WORDS = 3, 20
# Of so many neighbouring runs of WORDS words one is taken.
GAP = 16
# One word in so many ends a sentence by its hash.
CUT = 16
MEMORY, TOGETHER = 400_000, 200_000
EDGES = re.compile(r"^\W+|\W+$")
LINE = "\x00"
# Characters of scripts that put no spaces between words: Thai, Lao, Burmese, Khmer, kana, Han.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
ALONE = re.compile(f"[{UNSPACED}]")
TOKEN = re.compile(rf"[{UNSPACED}]|[^\s{UNSPACED}]+")
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
WORD, END = 1, 2


class Words(dict):
    """``hash << 2 | ends a sentence << 1 | is a word`` of a token, found once."""

    def __missing__(self, token: str) -> int:
        inner = token if ALONE.match(token) else EDGES.sub("", token).lower()
        h = xxh3_64_intdigest(inner) >> 3
        ends = token[-1] in ".!?。！？" + LINE or bool(inner) and h % CUT == 0
        out = h << 2 | ends << 1 | bool(inner)
        if len(self) >= MEMORY:
            self.clear()
        self[token] = out
        return out


def tokens_of(text: str) -> list[str]:
    """The tokens of a text; those of :func:`cut_ranges` and the line breaks."""
    text = text.replace(LINE, "�").replace("\n", f" {LINE} ")
    return text.split() if text.isascii() or not ALONE.search(text) else TOKEN.findall(text)


def smallest(h: np.ndarray, inside: np.ndarray, gap: int) -> np.ndarray:
    """Which values are the smallest of any ``gap`` neighbours that start where ``inside`` says."""
    m = len(inside)
    low, high = h[:m].copy(), np.zeros(m + 2 * gap - 2, np.uint64)
    for k in range(1, gap):
        np.minimum(low, h[k:m + k], out=low)
    high[gap - 1:m + gap - 1] = np.where(inside, low, np.uint64(0))
    top = high[:m + gap - 1].copy()
    for k in range(1, gap):
        np.maximum(top, high[k:m + gap - 1 + k], out=top)
    return (top == h) & (top > 0)


class Runs:
    """Runs of several texts: for each its text, hash, second hash, and first and last token."""

    def __init__(self, texts: list[str], words: Words, sentences: int = SENTENCES, least: int = WORDS):
        parts = [tokens_of(t) for t in texts]
        n = [len(p) for p in parts]
        coded = np.fromiter(map(words.__getitem__, chain.from_iterable(parts)), np.int64, sum(n))
        lines = np.fromiter((t == LINE for t in chain.from_iterable(parts)), bool, sum(n))
        owner = np.repeat(np.arange(len(texts)), n)
        token = np.concatenate([[0], np.cumsum(~lines)])  # line breaks are no tokens of the text
        start = np.searchsorted(owner, np.arange(len(texts)))
        ends = coded & END != 0
        if len(owner):
            ends |= np.concatenate([owner[1:] != owner[:-1], [True]])
        sentence = np.cumsum(ends) - ends
        is_word = np.flatnonzero(coded & WORD != 0)
        self.texts = len(texts)
        self.owner = self.hash = self.check = self.first = self.last = np.zeros(0, np.int64)
        if not len(is_word):
            return
        s = sentence[is_word]
        opens = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        counts = np.diff(np.append(opens, len(s)))
        by = owner[is_word]
        with np.errstate(over="ignore"):
            word = mix((coded[is_word] >> 2).view(np.uint64))
            power = np.full(len(word) + 1, BASE, np.uint64)
            back = np.full(len(word) + 1, INVERSE, np.uint64)
            power[0] = back[0] = 1
            power, back = np.multiply.accumulate(power), np.multiply.accumulate(back)
            upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(word * power[:-1], dtype=np.uint64)])
            upto2 = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(word ^ np.uint64(BASE)) * power[:-1], dtype=np.uint64)])
            total = np.append(opens, len(s))
            i = np.arange(len(counts))
            j = np.maximum(i + sentences, np.searchsorted(total, total[:-1] + least))
            i, j = i[j <= len(counts)], j[j <= len(counts)]
            i, j = total[i], total[j]  # from sentences to words
            inside = by[i] == by[j - 1]
            i, j = i[inside], j[inside]
            m = len(s) - least + 1
            if m >= GAP:
                h = mix((upto[least:] - upto[:m]) * back[:m] + np.uint64(least))
                taken = smallest(h, by[:m - GAP + 1] == by[least + GAP - 2:], GAP)
                taken[i[j - i == least]] = False
                more = np.flatnonzero(taken)
                i, j = np.concatenate([i, more]), np.concatenate([j, more + least])
            self.hash = mix((upto[j] - upto[i]) * back[i] + (j - i).astype(np.uint64)).view(np.int64)
            self.check = (mix((upto2[j] - upto2[i]) * back[i]) >> np.uint64(32)).astype(np.uint32).view(np.int32)
        self.owner = by[i]
        base = token[start[self.owner]]
        self.first = token[is_word[i]] - base
        self.last = token[is_word[j - 1]] - base


def in_groups(texts: list[str | None]) -> Iterator[list[str]]:
    group, size = [], 0
    for t in texts:
        t = t or ""
        group.append(t)
        size += len(t) // 4
        if size > TOGETHER:
            yield group
            group, size = [], 0
    if group:
        yield group


def run_hashes(keyed: DataFrame, text: str) -> DataFrame:
    """One row per run of every text: its hash. What shares one by chance passes the bitmap and is told apart later."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            for texts in in_groups(batch.column(0).to_pylist()):
                runs = Runs(texts, words)
                yield pa.record_batch([pa.array(runs.hash)], ["hash"])

    return keyed.select(text).mapInArrow(find, "hash long")


def runs_that_pass(keyed: DataFrame, text: str, bitmap: np.ndarray) -> DataFrame:
    """(_id, _th, hash, check, first, last) of the runs whose hash passes the bitmap."""
    shipped = keyed.sparkSession.sparkContext.broadcast(bitmap)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            ids, hashes, done = batch.column(0), batch.column(1), 0
            for texts in in_groups(batch.column(2).to_pylist()):
                runs = Runs(texts, words)
                hit = np.flatnonzero(passes(shipped.value, runs.hash))
                at = pa.array(runs.owner[hit] + done)
                yield pa.record_batch([
                    ids.take(at), hashes.take(at), pa.array(runs.hash[hit]), pa.array(runs.check[hit], pa.int32()),
                    pa.array(runs.first[hit], pa.int32()), pa.array(runs.last[hit], pa.int32()),
                ], ["_id", "_th", "hash", "check", "first", "last"])
                done += len(texts)

    return keyed.select("_id", "_th", text).mapInArrow(find, "_id long, _th long, hash long, check int, first int, last int")


def repeated(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Per document with a repeated run that is not the first: ranges of tokens, and the documents that hold the firsts.

    Columns: ``_id``, ``_th`` (see :func:`common.with_key`), ``ranges`` (first and last token), ``sources`` (ids of the
    documents whose passage stays). Equal rows are one document and do not repeat each other; null and empty texts
    and texts shorter than a run hold no runs. Repeats inside one document count as well.
    """
    keyed = with_key(docs.select(F.col(id).alias("doc_id"), F.col(text).alias("_text")), "_text")
    twice = run_hashes(keyed, "_text").groupBy("hash").count().where("count > 1").select("hash")
    met = settle(runs_that_pass(keyed, "_text", hash_filter(settle(twice), "hash")))
    firsts = settle(met.groupBy("hash", "check").agg(F.min(F.struct("_id", "_th", "first")).alias("f"))
                    .select("hash", "check", F.col("f._id").alias("f_id"), F.col("f._th").alias("f_th"), F.col("f.first").alias("f_first")))
    later = met.join(firsts, ["hash", "check"]).where("_id != f_id or _th != f_th or first != f_first")
    return later.groupBy("_id", "_th").agg(
        F.collect_set(F.struct("first", "last")).alias("ranges"), F.sort_array(F.collect_set(original_id("f_id"))).alias("sources"))


def cut_ranges(text: str, ranges: list[dict]) -> tuple[str, list[dict], int]:
    """The text without the tokens of the ranges, the removed stretches in code points, and the number of tokens."""
    where = [m.span() for m in TOKEN.finditer(text)]
    gone = np.zeros(len(where) + 2, np.int64)
    for r in ranges:
        gone[r["first"]] += 1
        gone[r["last"] + 1] -= 1
    gone = np.cumsum(gone)[:len(where)] > 0
    kept, spans, at = [], [], 0
    edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
        start = where[a][0]
        end = where[b][0] if b < len(where) else len(text)
        kept.append(text[at:start])
        spans.append({"start": start, "end": end})
        at = end
    kept.append(text[at:])
    return "".join(kept), spans, int(gone.sum())


def remove_repeats(docs: DataFrame, found: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """The documents of ``found`` with their shortened text, the removed stretches and the number of removed words."""

    @F.arrow_udf("struct<text:string,spans:array<struct<start:int,end:int>>,words:long>")
    def cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        kind = pa.struct([("text", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("words", pa.int64())])
        for texts, ranges in batches:
            rows = (cut_ranges(t, r) for t, r in zip(texts.to_pylist(), ranges.to_pylist()))
            yield pa.array([{"text": t, "spans": s, "words": n} for t, s, n in rows], kind)

    keyed = with_key(docs.select(F.col(id).alias("doc_id"), F.col(text).alias("_text")), "_text")
    return keyed.join(found, ["_id", "_th"]).withColumn("_cut", cut("_text", "ranges")).select(
        "doc_id", F.col("_cut.words").alias("n_words_removed"), F.col("_cut.spans").alias("spans"), "sources", F.col("_cut.text").alias("text"))


def repeats(docs: DataFrame) -> DataFrame:
    """One row per document that loses sentences."""
    return remove_repeats(docs, repeated(docs))
