"""Benchmark items in documents, also with other numbers, names or units.

Texts are reduced to templates: numbers, names and units become typed placeholders, all else lower case. Windows of
template tokens are hashed and joined with those of the benchmark. Windows that lie on one diagonal (same distance
between document and item) are an alignment; it holds when its slots are consistent: every value of the item stands
for one value of the document and the other way round; of windows that contradict each other the larger part stays. Equal values are a verbatim copy, others a re-parameterised
question.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from ..session import settle
from .common import hash_filter, mix, original_id, packed, passes, unpacked, with_key

# Tokens of a window, and how many of them must be no placeholders.
WINDOW, LITERALS = 8, 4
# An item counts as found when aligned windows cover this share of its windows, or when a verbatim run is this long.
COVER, VERBATIM = 0.5, 13
# Words a worker remembers.
MEMORY = 400_000

NUMERAL = re.compile(r"\d[\d.,:/]*([°%€$£]?[^\W\d_]*)")
EDGES = re.compile(r"^\W+|\W+$")
STOPS = ".,;:!?"
# Units, which count as such after a number only.
UNITS = frozenset("""
m km cm mm mi mile miles ft foot feet inch inches yd yard yards g kg mg t ton tons lb lbs oz pound pounds l ml litre litres
liter liters gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year
years % percent ° degree degrees c f k v w kw hz khz mhz ghz kb mb gb tb mph kmh € $ £ euro euros dollar dollars cent cents
""".split())
# What may be glued to a number besides a unit.
SUFFIXES = frozenset("x st nd rd th °c °f °k".split())
# Words that may stand for a number.
NUMBER_WORDS = frozenset("""
zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen
twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion
""".split())
# The last three are possible placeholders: a word in the strict reading of a text, a number or name in the loose one; a
# capital that is a unit's sign as well is one after a number.
WORD, NUMBER, UNIT, NAME, SKIP, LIKE_NUMBER, LIKE_NAME, LIKE_SIGN = range(8)
STRICT, LOOSE, RAW = range(3)
LISTED = dict.fromkeys(NUMBER_WORDS, LIKE_NUMBER) | dict.fromkeys(UNITS, UNIT)
PLACEHOLDERS = mix(np.arange(1, 6, dtype=np.uint64))
STEP = np.uint64(0x9E3779B97F4A7C15)
# Texts are worked on together until they hold so many tokens.
TOGETHER = 200_000


def bare(token: str) -> str:
    """A token without the marks around it, in lower case."""
    return EDGES.sub("", token).lower()


class Words(dict):
    """``hash << 4 | ends a sentence << 3 | class`` of a token, found once; UNIT and NAME are only possible classes."""

    def __missing__(self, token: str) -> int:
        # Most tokens are small letters with a stop behind them at most.
        inner = token.rstrip(STOPS)
        if not inner.isalpha():
            inner = EDGES.sub("", token)
        low = inner.lower()
        kind = LISTED.get(low, WORD)
        if kind == UNIT:
            kind = LIKE_SIGN if inner.isupper() and len(inner) == 1 else UNIT
        elif kind == WORD and inner != low:
            if inner[0].isupper() and inner[1:].islower():
                kind = NAME
            elif inner[0].isupper() and (len(inner) == 1 and inner not in "AI" or any(map(str.islower, inner))):
                kind = LIKE_NAME
        if not inner:
            kind = SKIP
        elif low[0].isdecimal():
            numeral = NUMERAL.fullmatch(low)
            if numeral and (not numeral[1] or numeral[1] in UNITS or numeral[1] in SUFFIXES):
                kind = NUMBER
        out = xxh3_64_intdigest(low) >> 5 << 4 | (token[-1] in ".!?") << 3 | kind
        if len(self) >= MEMORY:
            self.clear()
        self[token] = out
        return out


@lru_cache
def words_of_worker() -> Words:
    """What this process remembers from one task to the next."""
    return Words()


class Templates:
    """Template tokens of several texts: 64-bit codes, classes, raw tokens, and the text each belongs to.

    A text is read strictly and loosely; loosely, a name that opens a sentence, a number word, an initial and a name with
    capitals inside are placeholders too. The raw reading has no placeholders.
    """

    def __init__(self, texts: list[str], words: Words):
        parts = [t.replace("\n", " . ").split() for t in texts]
        tokens = list(chain.from_iterable(parts))
        coded = np.fromiter(map(words.__getitem__, tokens), np.int64, len(tokens))
        owner = np.repeat(np.arange(len(texts)), [len(p) for p in parts])
        kind = coded & 7
        # A capital opens a sentence at the start and after a stop; elsewhere it makes a name.
        first = np.concatenate([[True], owner[1:] != owner[:-1]]) if len(tokens) else np.zeros(0, bool)
        before = np.concatenate([[0], coded[:-1]]) if len(tokens) else coded
        opens = first | (before & 8 != 0)
        after_number = ~first & (before & 7 == NUMBER)
        after_like = ~first & (before & 7 == LIKE_NUMBER)
        sign = kind == LIKE_SIGN
        kind = np.where(sign, np.where(after_number, UNIT, LIKE_NAME), kind)
        strict = np.where((kind == NAME) & opens | (kind == UNIT) & ~after_number | (kind > SKIP), WORD, kind)
        loose = np.where((kind == UNIT) & ~after_number & ~after_like, WORD, kind)
        loose = np.where(kind == LIKE_NUMBER, NUMBER, np.where(kind == LIKE_NAME, np.where(sign & after_like, UNIT, NAME), loose))
        self.place = np.flatnonzero(kind != SKIP)
        self.kinds = {STRICT: strict[self.place], LOOSE: loose[self.place]}
        self.owner, self.tokens = owner[self.place], tokens
        raw = coded[self.place].view(np.uint64) >> np.uint64(4)
        self.codes = {r: np.where(k == WORD, raw, PLACEHOLDERS[k]) for r, k in self.kinds.items()} | {RAW: raw}
        self.start = np.searchsorted(self.owner, np.arange(len(texts)))
        self.size = np.bincount(self.owner, minlength=len(texts))

    def hashes(self, reading: int, at: np.ndarray, size: int) -> np.ndarray:
        """Hashes of the windows of ``size`` tokens from ``at``."""
        code, n = self.codes[reading], len(self.owner) - size + 1
        h = np.full(len(at), (0 if size == WINDOW else size) + (reading == RAW) * WINDOW, np.uint64)
        dense = 2 * len(at) > n
        if dense:
            h = np.full(n, h[0], np.uint64)
        for k in range(size):
            h *= STEP
            h += code[k:n + k] if dense else code[at + k]
        return mix(h[at] if dense else h)

    def readings(self, lengths: frozenset[int] | None = None, raw: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First tokens, hashes, readings and sizes of the windows.

        Windows have ``WINDOW`` tokens; shorter ones are made of the given lengths everywhere, or, if none are given, of the
        whole of a shorter text. A window with enough literal tokens is hashed in the strict reading, and in the
        loose one where that differs and leaves enough; others are hashed raw.
        """
        n = len(self.owner)
        literal = {r: np.concatenate([[0], np.cumsum(k == WORD)]) for r, k in self.kinds.items()}
        differs = np.concatenate([[0], np.cumsum(self.kinds[STRICT] != self.kinds[LOOSE])])
        out = []
        for size in range(1, WINDOW + 1):
            if size == WINDOW or lengths is not None and size in lengths:
                at = np.flatnonzero(self.owner[:max(n - size + 1, 0)] == self.owner[size - 1:])
            elif lengths is None:
                at = self.start[self.size == size]
            else:
                continue
            enough = {r: c[at + size] - c[at] >= min(LITERALS, size) for r, c in literal.items()}
            other = differs[at + size] > differs[at]
            chosen = [(STRICT, at[enough[STRICT]]), (LOOSE, at[enough[LOOSE] & other]), (RAW, at[~enough[STRICT]] if raw else at[:0])]
            out += [(a, self.hashes(r, a, size), np.full(len(a), r), np.full(len(a), size)) for r, a in chosen if len(a)]
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, hashes, reading, sizes = map(np.concatenate, zip(*out))
        return at, hashes.view(np.int64), reading, sizes

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """First tokens and hashes of the windows with enough literal tokens; a shorter text is one window."""
        at, hashes, _, _ = self.readings(raw=False)
        return at, hashes

    def slots(self, first: int, reading: int, size: int) -> list[dict]:
        """Placeholders of a window: type and value, in order."""
        if reading == RAW:
            return []
        kind = self.kinds[reading]
        return [{"kind": int(kind[i]), "value": bare(self.tokens[self.place[i]])} for i in range(first, first + size) if kind[i] != WORD]

    def found(self, table: np.ndarray | None, lengths: frozenset[int] | None, raw: bool) -> list[list[dict]]:
        """For each text the windows that pass the bitmap."""
        at, hashes, reading, sizes = self.readings(lengths, raw)
        if table is not None:
            hit = np.flatnonzero(passes(table, hashes))
            at, hashes, reading, sizes = at[hit], hashes[hit], reading[hit], sizes[hit]
        out: list[list[dict]] = [[] for _ in self.size]
        places = (at - self.start[self.owner[at]]).tolist()
        for first, d, p, h, r, n in zip(at.tolist(), self.owner[at].tolist(), places, hashes.tolist(), reading.tolist(), sizes.tolist()):
            out[d].append({"pos": p, "hash": h, "size": n, "raw": r == RAW, "slots": self.slots(first, r, n)})
        return out


def in_groups(texts: list[str | None]) -> Iterator[list[str]]:
    """Runs of texts of bounded total size; a null text is empty."""
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


KIND = "array<struct<pos:int,hash:long,size:int,raw:boolean,slots:array<struct<kind:int,value:string>>>>"
ARROW = pa.list_(pa.struct([("pos", pa.int32()), ("hash", pa.int64()), ("size", pa.int32()), ("raw", pa.bool_()),
                            ("slots", pa.list_(pa.struct([("kind", pa.int32()), ("value", pa.string())])))]))


def template_windows(rows: DataFrame, text: str, into: str, bitmap: np.ndarray | None = None,
                     lengths: frozenset[int] | None = None, raw: bool = True) -> DataFrame:
    """Add ``into``: the windows of the whole text (:meth:`Templates.readings`), only those that pass the bitmap if one is given."""
    shipped = rows.sparkSession.sparkContext.broadcast(bitmap)

    @F.arrow_udf(KIND)
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words, table = words_of_worker(), shipped.value
        for batch in batches:
            out = []
            for texts in in_groups(batch.to_pylist()):
                out += Templates(texts, words).found(table, lengths, raw)
            yield pa.array(out, ARROW)

    return rows.withColumn(into, find(F.col(text)))


def judge(windows: list[dict]) -> dict:
    """The consistent windows of a diagonal, whether their values are equal, and the tokens of its longest verbatim run.

    Where values conflict, windows whose values have the most support go first and equal values before others; a window that
    contradicts those before it is left out. The verbatim run is that of windows with equal values, whatever the rest says.
    """
    read = sorted((w["ipos"], sorted((p["kind"], p["theirs"], p["ours"]) for p in w["pairs"]), w["size"], w["counts"]) for w in windows)
    support = Counter(chain.from_iterable(set(pairs) for _, pairs, _, _ in read))
    equal = [all(t == o for _, t, o in pairs) for _, pairs, _, _ in read]
    theirs, ours, at, same = {}, {}, set(), True
    for k in sorted(range(len(read)), key=lambda k: (-min((support[p] for p in read[k][1]), default=len(read)), not equal[k], k)):
        ipos, pairs, _, counts = read[k]
        if not counts:
            continue
        forth, back = {}, {}
        if all(theirs.get((c, t), o) == forth.setdefault((c, t), o) == o and ours.get((c, o), t) == back.setdefault((c, o), t) == t for c, t, o in pairs):
            theirs |= forth
            ours |= back
            at.add(ipos)
            same &= equal[k]
    run = begin = end = 0
    for (ipos, _, size, _), plain in zip(read, equal):
        if plain:
            begin = begin if end and ipos <= end else ipos
            end = ipos + size
            run = max(run, end - begin)
    return {"at": sorted(at), "same": same, "run": run}


def judged(windows: str) -> Column:
    @F.arrow_udf("struct<at:array<int>,same:boolean,run:int>")
    def judge_all(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.struct([("at", pa.list_(pa.int32())), ("same", pa.bool_()), ("run", pa.int32())])
        for batch in batches:
            yield pa.array([judge(w) for w in batch.to_pylist()], kind)

    return judge_all(F.col(windows))


def find_leaks(docs: DataFrame, benchmark: DataFrame, cover: float = COVER, text: str = "text", id: str = "doc_id",
               item: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document and benchmark item found in it.

    ``_id`` and ``_th`` are the key of :func:`common.with_key`, ``doc_id`` the id, ``kind`` verbatim or
    reparameterised, ``coverage`` the share of the item's windows that are aligned. Texts that are null, empty or
    without words hold nothing; an item without words is never found. Items shorter than a window are found whole, one with too few
    literal tokens for a template (sums, lists of names) is found verbatim. Equal rows share one result, an item that is
    repeated under several ids is found under each.
    """
    items = benchmark.select(F.col(item).alias("item_id"), F.col(item_text).alias("_text")).distinct()
    # Raw windows extend verbatim runs; they count for the coverage where an item has no others.
    plain = F.filter("_w", lambda w: ~w["raw"])
    counted = F.when(F.size(plain) > 0, plain).otherwise(F.col("_w"))
    index = settle(template_windows(items, "_text", "_w").select(
        "item_id", F.size(F.array_distinct(F.transform(counted, lambda w: w["pos"]))).alias("n_windows"), (F.size(plain) > 0).alias("_plain"),
        F.explode("_w").alias("w"))
        .select("item_id", "n_windows", F.col("w.pos").alias("ipos"), F.col("w.hash").alias("hash"), F.col("w.size").alias("size"),
                F.col("w.raw").alias("raw"), (~F.col("_plain") | ~F.col("w.raw")).alias("counts"), F.col("w.slots").alias("islots")))
    sizes = index.select("size", "raw").distinct().collect()  # at most WINDOW sizes
    lengths, raw = frozenset(r["size"] for r in sizes if r["size"] < WINDOW), any(r["raw"] for r in sizes)
    keyed = with_key(docs.select(F.col(id).alias("_doc"), F.col(text).alias("_text")), "_text", "_doc")
    found = template_windows(keyed, "_text", "_w", hash_filter(index, "hash"), lengths, raw).select(
        "_id", "_th", F.explode("_w").alias("w")).select(
        "_id", "_th", F.col("w.pos").alias("pos"), F.col("w.hash").alias("hash"), F.col("w.slots").alias("slots"))
    met = found.join(index, "hash").where(F.size("slots") == F.size("islots"))
    pairs = F.transform(F.arrays_zip("islots", "slots"), lambda z: F.struct(
        z["islots"]["kind"].alias("kind"), z["islots"]["value"].alias("theirs"), z["slots"]["value"].alias("ours")))
    aligned = met.withColumn("pairs", pairs).groupBy("_id", "_th", "item_id", (F.col("pos") - F.col("ipos")).alias("diagonal")).agg(
        F.first("n_windows").alias("n_windows"),
        # Bounded by the item: a window of the item lies on a diagonal once.
        F.collect_set(F.struct("ipos", "size", "counts", "pairs")).alias("windows"))
    per_item = aligned.withColumn("_j", judged("windows")).groupBy("_id", "_th", "item_id").agg(
        F.first("n_windows").alias("n_windows"), F.array_distinct(F.flatten(F.collect_list("_j.at"))).alias("at"),
        F.max("_j.run").alias("run"), F.min("_j.same").alias("same"), F.min(F.col("diagonal") + F.get("_j.at", F.lit(0))).alias("start"))
    coverage = F.size("at") / F.col("n_windows")
    return per_item.where((coverage >= cover) | (F.col("run") >= VERBATIM)).select(
        "_id", "_th", original_id().alias("doc_id"), "item_id",
        F.when(F.col("same"), "verbatim").otherwise("reparameterised").alias("kind"),
        F.size("at").cast("long").alias("n_windows"), coverage.alias("coverage"), F.col("start").cast("long").alias("first_token"))


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no benchmark item was found, columns as they came."""
    leaks = find_leaks(docs, benchmark).select("_id", "_th").distinct()
    return unpacked(packed(docs).join(leaks, ["_id", "_th"], "left_anti"), docs)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return find_leaks(docs, benchmark).drop("_id", "_th")
