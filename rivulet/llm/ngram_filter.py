"""Language-model scores from a log-frequency Bloom filter of n-gram counts.

Every n-gram of the training texts is counted; its count is quantised to a level (1, 2, 3, then steps of a half more), and
the n-gram is put into a Bloom filter together with each level up to its own. To read a count, levels are probed from 1 on
until one is missing, so a count is never read too low. An n-gram whose shorter parts are absent is absent, and none is read
more often than its parts, which takes away most of what the filter lets through by chance. Probabilities are smoothed from
the shorter history to the longer one: ``(count + PRIOR * shorter) / (history + PRIOR)``, at the bottom the base estimate of
single tokens.

The filter is as large as the n-grams need (twelve bits for each level of each n-gram, for single tokens twice as many). It is dealt by hash into
segments, each built in one task from counts that were summed per slice of texts before. Segments that together stay
within ``SENT_BYTES`` are sent to the workers, which then need no shuffle; beyond that the distinct n-grams of each slice of texts go to their
segments and come back with their levels. Scores are the same either way.

Exact counts of single tokens, for the base score: the most frequent ones, at most ``HEAD``, are sent to the workers,
a token that the filter does not hold has the count 0, and the others are joined.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import join_skewed
from ..session import condense, settle
from .common import mix

ORDER = 2
# Levels: counts grow by this factor from one to the next. Bits probed for each entry, all in one word of 64, and bits of room for it:
# an entry that is not there is found once in a hundred times.
STEP, PROBES, ROOM = 1.5, 5, 12
PRIOR = 20.0
# Tokens that are counted together, and scored together; text bytes per segment.
SLICE, AT_ONCE, SEGMENT_BYTES = 250_000, 100_000, 8_000_000
# Rows of a batch that are held as Python strings at a time.
ROWS = 256
# Bytes of the filter and single tokens that may be sent to the workers; bytes of the filter that pass the driver at a time.
SENT_BYTES, HEAD, FETCHED = 128_000_000, 500_000, 12_000_000
# Text bytes whose n-grams are dealt to the segments at a time.
DEALT = 1_000_000_000
# Two marks that no word can be, as words hold no spaces.
START, END = b" start", b" end"
SPREAD = np.uint64(0x9E3779B97F4A7C15)


def _of_level(keys: np.ndarray, level: int) -> np.ndarray:
    """The hash of the entry that says: these n-grams reach this level."""
    return mix(keys + np.uint64(int(SPREAD) * level & (1 << 64) - 1))


def _word_keys(words) -> np.ndarray:
    return mix(np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64))


START_KEY, END_KEY = (int(k) for k in _word_keys([START, END]).view(np.int64))


@dataclass
class Slice:
    """Some texts as one sequence: ``keys[o]`` is the key of the o tokens that end at each place, ``place`` the place in the text.

    Place 0 is the mark of the start; the tokens and the end follow. ``keys[o]`` holds where ``place >= o - 1``. ``words`` are the keys
    of the distinct tokens, ``ids`` tells which of them stands at each place.
    """

    words: np.ndarray
    ids: np.ndarray
    keys: dict[int, np.ndarray]
    place: np.ndarray
    begin: np.ndarray


@dataclass
class Tokens:
    """Texts as words: how many each has, and the words one after another."""

    sizes: np.ndarray
    words: pa.Array


def tokens_of(texts: pa.Array) -> Tokens:
    """Null texts have no words."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    sizes, words = lists.value_lengths().to_numpy(), lists.flatten()
    # Spaces at the ends of a text part words that are not there.
    there = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
    if not there.all():
        sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[there], minlength=len(sizes))
        words = words.filter(pa.array(there))
    return Tokens(sizes.astype(np.int64), words)


def slice_of(texts: list[Tokens], order: int) -> Slice:
    sizes = np.concatenate([t.sizes for t in texts]) + 2
    coded = pa.concat_arrays([t.words for t in texts]).dictionary_encode()
    begin = np.cumsum(sizes) - sizes
    ids = np.empty(int(sizes.sum()), np.int64)
    inner = np.ones(len(ids), bool)
    inner[begin], inner[begin + sizes - 1] = False, False
    ids[begin], ids[begin + sizes - 1], ids[inner] = 0, 1, coded.indices.to_numpy() + 2
    words = _word_keys([START, END, *coded.dictionary.cast(pa.binary() if pa.types.is_string(coded.dictionary.type) else pa.large_binary()).to_pylist()])
    word = words[ids]
    keys = {1: word}
    for o in range(2, order + 1):
        keys[o] = word.copy()
        keys[o][1:] = mix(keys[o - 1][:-1] * SPREAD + word[1:] + np.uint64(o))
    return Slice(words, ids, keys, np.arange(len(ids)) - np.repeat(begin, sizes), begin)


def split(texts: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, list[Tokens]]]:
    """(first row, rows, their tokens) of stretches of one batch; a text beyond the limit stands alone."""
    held: list[Tokens] = []
    n = first = 0
    for at in range(0, len(texts), ROWS):
        part = tokens_of(texts.slice(at, ROWS))
        ends, low = np.concatenate([[0], np.cumsum(part.sizes)]), 0
        while low < len(part.sizes):
            high = int(np.searchsorted(ends, ends[low] + limit - n, side="right")) - 1
            if high <= low and held:
                yield first, at + low - first, held
                held, n, first = [], 0, at + low
                continue
            high = max(high, low + 1)
            held.append(Tokens(part.sizes[low:high], part.words.slice(ends[low], ends[high] - ends[low])))
            n, low = n + int(ends[high] - ends[low]), high
    if held:
        yield first, len(texts) - first, held


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and their counts added up."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def level_of(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(counts.astype(float)) / math.log(STEP) + 1e-9).astype(np.int64)


def _values() -> np.ndarray:
    """The count that a level stands for: the mean of the counts of that level; 0 for level 0."""
    edge = [math.ceil(STEP ** j - 1e-9) for j in range(110)]
    return np.array([0.0] + [max(lo, (lo + hi - 1) / 2) for lo, hi in zip(edge, edge[1:])])


VALUES = _values()


def _entries(keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """For these n-grams at this level: a number below 2**32 that chooses the word, and the bits in it."""
    h = _of_level(keys, level)
    bits = np.zeros(len(h), np.uint64)
    for i in range(PROBES):
        bits |= np.uint64(1) << (h >> np.uint64(6 * i) & np.uint64(63))
    return h >> np.uint64(32), bits


def _scaled(x: np.ndarray, n: np.ndarray | int) -> np.ndarray:
    """Numbers below 2**32 scaled to numbers below n."""
    return (x * (np.uint64(n) if isinstance(n, int) else n) >> np.uint64(32)).astype(np.int64)


def segment_of(keys: np.ndarray, n: int) -> np.ndarray:
    return _scaled(keys >> np.uint64(32), n)


def twin(keys: np.ndarray) -> np.ndarray:
    """Other keys of the same n-grams."""
    return mix(keys ^ SPREAD)


def segment(keys: np.ndarray, counts: np.ndarray) -> tuple[bytes, int]:
    """The filter of these n-grams, and its number of bits."""
    levels = level_of(counts)
    words = max(1, math.ceil(int(levels.sum()) * ROOM / 64))
    table = np.zeros(words, np.uint64)
    for j in range(1, int(levels.max(initial=0)) + 1):
        x, bits = _entries(keys[levels >= j], j)
        at = _scaled(x, words)
        order = np.argsort(at, kind="stable")
        at = at[order]
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        table[at[first]] |= np.bitwise_or.reduceat(bits[order], first)
    return table.tobytes(), 64 * words


@dataclass
class Filter:
    """Segments side by side: the words of the i-th begin at ``offset[i]``, ``words[i]`` are there."""

    table: np.ndarray
    offset: np.ndarray
    words: np.ndarray

    def levels(self, keys: np.ndarray, single: bool = False) -> np.ndarray:
        """Levels of the keys. Single tokens are entered twice: as histories they weigh on all that follows them."""
        seg = segment_of(keys, len(self.words))
        read = self._read(keys, seg)
        return np.minimum(read, self._read(twin(keys), seg)) if single else read

    def _read(self, keys: np.ndarray, seg: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), np.int64)
        left, level = np.flatnonzero(self.words[seg]), 1
        while len(left):
            x, bits = _entries(keys[left], level)
            s = seg[left]
            left = left[self.table[self.offset[s] + _scaled(x, self.words[s])] & bits == bits]
            out[left] = level
            level += 1
        return out


def empty_filter(sizes: dict[int, int], n: int) -> Filter:
    """Room for ``n`` segments of these numbers of bits; those that are not named are empty."""
    words, offset, end = np.zeros(n, np.uint64), np.zeros(n, np.int64), 0
    for i, bits in sizes.items():
        words[i], offset[i] = bits // 64, end
        end += bits // 64
    return Filter(np.zeros(max(1, end), np.uint64), offset, words)


def fill(table: Filter, i: int, segment: bytes) -> None:
    at = int(table.offset[i])
    part = np.frombuffer(segment, np.uint64)
    table.table[at:at + len(part)] = part


def joined(segments: list[tuple[int, bytes, int]], n: int) -> Filter:
    """A filter of ``n`` segments, given as (number, table, bits)."""
    out = empty_filter({i: k for i, _, k in segments}, n)
    for i, table, _ in segments:
        fill(out, i, table)
    return out


def sent(parts: DataFrame, n: int) -> list[Broadcast[Filter]]:
    """The segments of a written table on their way to the workers, some at a time: the driver never holds them all.

    Of k pieces the i-th holds the segments i, i + k, i + 2 k and so on.
    """
    segments = parts.where(F.col("bits").isNotNull())
    sizes = {r.segment: r.bits for r in segments.select("segment", "bits").collect()}
    turns = max(1, -(-sum(sizes.values()) // 8 // FETCHED))
    out = []
    for k in range(turns):
        piece = empty_filter({i: b for i, b in sizes.items() if i % turns == k}, n)
        got = segments.where(F.pmod("segment", F.lit(turns)) == k).select("segment", "table").toArrow()
        for i, table in zip(got.column("segment"), got.column("table")):
            fill(piece, i.as_py(), table.as_buffer())
        out.append(parts.sparkSession.sparkContext.broadcast(piece))
        del got, piece
    return out


def read_levels(pieces: list[Filter], keys: np.ndarray, single: bool = False) -> np.ndarray:
    """Levels of the keys, each from the piece that holds its segment."""
    piece = segment_of(keys, len(pieces[0].words)) % len(pieces)
    out = np.zeros(len(keys), np.int64)
    for k, table in enumerate(pieces):
        at = np.flatnonzero(piece == k)
        out[at] = table.levels(keys[at], single)
    return out


@dataclass
class Totals:
    """Training tokens, distinct ones, segments, and the most frequent tokens with their exact counts, in order of their keys."""

    tokens: int
    distinct: int
    segments: int
    head: np.ndarray
    head_counts: np.ndarray

    @property
    def whole(self) -> float:
        return self.tokens + 0.5 * (self.distinct + 1)


# Levels of keys; the second value says whether they are single tokens.
Lookup = Callable[[np.ndarray, bool], np.ndarray]


def per_position(s: Slice, lookup: Lookup, whole: float, order: int) -> tuple[np.ndarray, np.ndarray]:
    """log10 probability of every place of the slice (0 at the start marks), and the level of its token."""
    single = last = lookup(s.words, True)[s.ids]
    p = (VALUES[single] + 0.5) / whole
    for o in range(2, order + 1):
        at = np.flatnonzero(s.place >= o - 1)
        # Shorter parts: what ends here without the first token, and the history without this token.
        at = at[(last[at] > 0) & (last[at - 1] > 0)]
        now = np.zeros(len(s.place), np.int64)
        # Frequent n-grams have many levels: each is read once.
        distinct, of = np.unique(s.keys[o][at], return_inverse=True)
        now[at] = np.minimum(lookup(distinct, False)[of], np.minimum(last[at], last[at - 1]))
        history = np.zeros(len(s.place))
        seen = np.flatnonzero(s.place >= o - 1)
        history[seen] = VALUES[last[seen - 1]]
        p = np.where(history > 0, (VALUES[now] + PRIOR * p) / (history + PRIOR), p)
        last = now
    return np.where(s.place > 0, np.log10(p), 0.0), single


def scored(s: Slice, lookup: Lookup, totals: Totals, order: int) -> dict[str, list]:
    """For each text: tokens, score, and of the base score and the known tokens what can be told here; ``tail`` is to be joined."""
    logs, single = per_position(s, lookup, totals.whole, order)
    word = s.words.view(np.int64)
    at = np.minimum(np.searchsorted(totals.head, word), max(len(totals.head) - 1, 0))
    frequent = totals.head[at] == word if len(totals.head) else np.zeros(len(word), bool)
    count = np.where(frequent, totals.head_counts[at], 0)[s.ids] if len(totals.head) else np.zeros(len(s.ids))
    frequent, token = frequent[s.ids], s.keys[1].view(np.int64)
    real = s.place > 0
    sure = real & (frequent | (single == 0))
    base = np.where(sure, np.log10((count + 0.5) / totals.whole), 0.0)
    total = lambda x: np.add.reduceat(x, s.begin).tolist()
    tail = real & ~sure
    ends = np.cumsum(total(tail.astype(np.int64)))
    tokens = token[tail]
    return {
        "n_tokens": total(real.astype(np.int64)), "score": total(logs), "base": total(base), "known": total((frequent & real).astype(np.int64)),
        "tail": [tokens[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())],
    }


COUNTS = "segment long, single boolean, keys binary, counts binary"
PARTS = "segment long, table binary, bits long, token long, count long"
SCORED = "n_tokens long, score double, base double, known long, tail array<long>"


def counted(texts: DataFrame, segments: int, order: int) -> DataFrame:
    """Segments of the filter, and the exact count of every single token, from a table with the column ``text``."""
    kind = pa.schema([("segment", pa.int64()), ("single", pa.bool_()), ("keys", pa.binary()), ("counts", pa.binary())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, words in split(batch.column(0)):
                s = slice_of(words, order)
                rows: list[tuple] = []
                for o, keys in s.keys.items():
                    distinct, n = (s.words, np.bincount(s.ids, minlength=len(s.words))) if o == 1 else np.unique(keys[s.place >= o - 1], return_counts=True)
                    distinct, n = distinct[n > 0], n[n > 0]
                    for once in (True, False):
                        part, many = distinct[(n == 1) == once], n[(n == 1) == once].astype(np.uint32)
                        at = segment_of(part, segments)
                        by = np.argsort(at, kind="stable")
                        cut = np.flatnonzero(np.diff(at[by], prepend=-1))
                        for a, b in zip(cut, [*cut[1:], len(by)]):
                            rows.append((int(at[by[a]]), o == 1, part[by[a:b]].tobytes(), b"" if once else many[by[a:b]].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kind)], schema=kind)

    out = pa.schema([("segment", pa.int64()), ("table", pa.binary()), ("bits", pa.int64()), ("token", pa.int64()), ("count", pa.int64())])

    def build(table: pa.Table) -> pa.Table:
        sides = {True: ([], []), False: ([], [])}
        for single, keys, counts in zip(*(table.column(c).to_pylist() for c in ("single", "keys", "counts"))):
            k = np.frombuffer(keys, np.uint64)
            sides[single][0].append(k)
            sides[single][1].append(np.frombuffer(counts, np.uint32).astype(np.int64) if counts else np.ones(len(k), np.int64))
        found = {s: summed(np.concatenate(k or [np.zeros(0, np.uint64)]), np.concatenate(c or [np.zeros(0, np.int64)])) for s, (k, c) in sides.items()}
        bits, n = segment(np.concatenate([found[True][0], twin(found[True][0]), found[False][0]]), np.concatenate([found[True][1], found[True][1], found[False][1]]))
        tokens, counts = found[True][0].view(np.int64), found[True][1]
        at = table.column("segment")[0].as_py()
        return pa.Table.from_arrays([
            pa.array([at] * (len(tokens) + 1), pa.int64()), pa.array([bits] + [None] * len(tokens), pa.binary()), pa.array([n] + [None] * len(tokens), pa.int64()),
            pa.array([None, *tokens.tolist()], pa.int64()), pa.array([None, *counts.tolist()], pa.int64())], schema=out)

    return settle(texts.select("text").mapInArrow(count, COUNTS).groupBy("segment").applyInArrow(build, PARTS))


def totals_of(parts: DataFrame, segments: int, head: int = HEAD) -> Totals:
    """Sums over all training tokens, and the frequent ones: as many whole count levels as the bound holds."""
    tokens = parts.where(F.col("token").isNotNull() & (F.col("token") != START_KEY))
    # The levels are few whatever the input: one row each reaches the driver.
    by_level = tokens.groupBy(F.floor(F.log2("count")).alias("level")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("count").alias("total")).orderBy(F.desc("level")).collect()
    n, least = 0, None
    for r in by_level:
        n += r.n
        if n > head:
            break
        least = r.level
    chosen = tokens.where(F.floor(F.log2("count")) >= least).select("token", "count").toPandas() if least is not None else None
    keys, counts = (chosen["token"].to_numpy(np.int64), chosen["count"].to_numpy(np.int64)) if chosen is not None else (np.zeros(0, np.int64),) * 2
    order = np.argsort(keys)
    return Totals(sum(r.total for r in by_level), sum(r.n for r in by_level), segments, keys[order], counts[order])


def _rows(columns: dict[str, list]) -> list[pa.Array]:
    return [pa.array(columns["n_tokens"], pa.int64()), pa.array(columns["score"], pa.float64()), pa.array(columns["base"], pa.float64()),
            pa.array(columns["known"], pa.int64()), pa.array(columns["tail"], pa.list_(pa.int64()))]


def _by_sent_filter(rows: DataFrame, parts: DataFrame, totals: Totals, order: int) -> DataFrame:
    """``rows`` (row, text) with what the sent filter says, as a written table. Its size was checked."""
    pieces, frequent = sent(parts, totals.segments), rows.sparkSession.sparkContext.broadcast(totals)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, totals = [p.value for p in pieces], frequent.value
        for batch in batches:
            for first, n, words in split(batch.column("text"), AT_ONCE):
                row = batch.column("row").slice(first, n)
                yield pa.RecordBatch.from_arrays([row, *_rows(scored(slice_of(words, order), lambda keys, single: read_levels(tables, keys, single), totals, order))], names=["row", *(c.split()[0] for c in SCORED.split(", "))])

    found = settle(rows.mapInArrow(score, f"row long, {SCORED}"))
    for b in (*pieces, frequent):
        b.unpersist()
    return found


def _asked(s: Slice, single: bool) -> np.ndarray:
    """The distinct keys of a slice in order, whatever the order of its texts; their segments ascend with them."""
    return np.sort(s.words) if single else np.unique(np.concatenate([np.zeros(0, np.uint64), *(k[s.place >= o - 1] for o, k in s.keys.items() if o > 1)]))


def _stretches(turns: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of the stretches of equal numbers."""
    cut = np.flatnonzero(np.diff(turns, prepend=-1)).tolist()
    return list(zip(cut, [*cut[1:], len(turns)]))


def _by_segments(rows: DataFrame, parts: DataFrame, totals: Totals, order: int) -> DataFrame:
    """The same with a filter of any size: distinct n-grams of a slice go to their segments, levels come back to the slice.

    What is asked takes several times the room of the texts: it is made for some of them at a time.
    """
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    turns = max(1, -(-size // DEALT))
    own = lambda k: rows.where(F.pmod(F.xxhash64("row"), F.lit(turns)) == k)
    return reduce(DataFrame.unionByName, [condense(rows.sparkSession, lambda: _dealt(own(k), parts, totals, order)) for k in range(turns)])


def _dealt(rows: DataFrame, parts: DataFrame, totals: Totals, order: int) -> DataFrame:
    shipped = rows.sparkSession.sparkContext.broadcast(totals)
    n = totals.segments
    kind = pa.schema([("slice", pa.int64()), ("row", pa.int64()), ("text", pa.string()), ("segment", pa.int64()), ("single", pa.bool_()), ("keys", pa.binary())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows: int, **columns) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(rows, f.type) for f in kind], schema=kind)

        for batch in batches:
            for first, rows, words in split(batch.column("text")):
                row, s = batch.column("row").slice(first, rows), slice_of(words, order)
                # The first row's number names the slice.
                name = row[0].as_py()
                of = lambda rows: pa.array([name] * rows, pa.int64())
                yield made(rows, slice=of(rows), row=row, text=pc.fill_null(batch.column("text").slice(first, rows), "").cast(pa.string()))
                for single in (True, False):
                    keys = _asked(s, single)
                    at = segment_of(keys, n)
                    cut = np.flatnonzero(np.diff(at, prepend=-1))
                    parts = [keys[a:b].tobytes() for a, b in zip(cut, [*cut[1:], len(at)])]
                    yield made(len(cut), slice=of(len(cut)), segment=pa.array(at[cut], pa.int64()), single=pa.array([single] * len(cut)), keys=pa.array(parts, pa.binary()))

    dealt = settle(rows.select("row", "text").mapInArrow(deal, "slice long, row long, text string, segment long, single boolean, keys binary"))

    def answer(asked: pa.Table, segments: pa.Table) -> pa.Table:
        # The only segment of a filter of one: whatever its number, all these keys belong to it.
        table = joined([(0, segments.column("table")[0].as_py(), segments.column("bits")[0].as_py())], 1) if segments.num_rows else None
        levels: list[bytes] = []
        for kind, at in ((k, np.flatnonzero(asked.column("single").to_numpy() == k)) for k in (True, False)):
            own = asked.take(pa.array(at)).column("keys")
            sizes = pc.binary_length(own).to_numpy() // 8
            # Many slices at a time: a few keys each would cost more in calls than in reads.
            turns = np.cumsum(sizes) // SLICE
            for a, b in _stretches(turns):
                keys = np.frombuffer(b"".join(own.slice(a, b - a).to_pylist()), np.uint64)
                read = (table.levels(keys, kind) if table else np.zeros(len(keys))).astype(np.uint8)
                levels += [x.tobytes() for x in np.split(read, np.cumsum(sizes[a:b])[:-1])]
        by = np.argsort(~asked.column("single").to_numpy(), kind="stable")
        told = asked.select(["slice", "segment", "single"]).take(pa.array(by))
        return told.append_column("levels", pa.array(levels, pa.binary()))

    asked = dealt.where(F.col("keys").isNotNull()).select("slice", "segment", "single", "keys")
    segments = parts.where(F.col("table").isNotNull()).select("segment", "table", "bits")
    # The slice makes its keys again: only their levels come back.
    answers = asked.groupBy("segment").cogroup(segments.groupBy("segment")).applyInArrow(answer, "slice long, segment long, single boolean, levels binary")

    def score(texts: pa.Table, known: pa.Table) -> pa.Table:
        names = ["row", *(c.split()[0] for c in SCORED.split(", "))]
        if not texts.num_rows:
            return pa.Table.from_arrays([pa.array([], pa.int64()), *_rows(dict.fromkeys(names[1:], []))], names=names)
        s = slice_of([tokens_of(chunk) for chunk in texts.column("text").chunks], order)
        found: dict[bool, tuple[np.ndarray, np.ndarray]] = {}
        known = known.sort_by("segment")
        for single in (True, False):
            own = known.filter(pc.equal(known.column("single"), single))
            found[single] = _asked(s, single), np.frombuffer(b"".join(own.column("levels").to_pylist()), np.uint8).astype(np.int64)
        lookup = lambda k, single: found[single][1][np.searchsorted(found[single][0], k)]
        return pa.Table.from_arrays([texts.column("row").combine_chunks(), *_rows(scored(s, lookup, shipped.value, order))], names=names)

    texts = dealt.where(F.col("keys").isNull()).select("slice", "row", "text")
    return texts.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(score, f"row long, {SCORED}")


def score_texts(rows: DataFrame, training: Column, order: int = ORDER, sent_bytes: int = SENT_BYTES, head: int = HEAD,
                segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """(row, n_tokens, n_known, train_tokens, base_score, score) for a written table with a unique ``row`` and a ``text``.

    ``training`` says which rows the model learns from. Letters A to Z are lower-cased, words are parted by spaces,
    every text ends with one end token; a null text is empty. Without training rows every token is unknown.
    """
    learned = rows.where(training)
    # Text bytes tell how many segments are needed before anything is counted.
    size = learned.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    segments = max(1, -(-size // segment_bytes))
    parts = counted(learned, segments, order)
    totals = totals_of(parts, segments, head)
    bits = parts.agg(F.sum("bits")).first()[0] or 0
    way = _by_sent_filter if bits // 8 <= sent_bytes else _by_segments
    found = way(rows.select("row", "text"), parts, totals, order)
    # Tokens that are neither frequent nor surely unknown: a few of each text.
    tail = found.where(F.size("tail") > 0).select("row", F.explode("tail").alias("token"))
    counts = parts.where(F.col("token").isNotNull()).select("token", "count")
    logs = F.log10((F.coalesce("count", F.lit(0)) + 0.5) / F.lit(totals.whole))
    rest = join_skewed(tail, counts, "token", F.col("row"), "left").groupBy("row").agg(
        F.sum(logs).alias("_base"), F.count("count").alias("_known"))
    return found.join(rest, "row", "left").select(
        "row", "n_tokens", (F.col("known") + F.coalesce("_known", F.lit(0))).alias("n_known"), F.lit(totals.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("_base", F.lit(0.0))).alias("base_score"), "score")


def held_out(id: Column) -> Column:
    """One in five by the checksum of the id; a row without an id has the checksum of the empty text, 0."""
    return F.crc32(F.coalesce(id.cast("string"), F.lit("")).cast("binary")) % 5 == 1


def report(docs: DataFrame, **options) -> DataFrame:
    """Per row of ``documents``: base score and model score, learned from the rows that are not held out.

    Repeated rows are scored and counted each; an empty table gives no rows; other columns are not read.
    """
    rows = settle(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id"), F.col("text")))
    scores = score_texts(rows.withColumn("held_out", held_out(F.col("doc_id"))), ~F.col("held_out"), **options)
    return rows.select("row", "doc_id", held_out(F.col("doc_id")).alias("held_out")).join(scores, "row").drop("row")
