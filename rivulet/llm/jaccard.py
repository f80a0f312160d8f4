"""Similarity join on word shingles with Bayesian pruning of the candidates.

Each text is its set of five-word shingles; equal sets are one class and go on as one row. MinHash bands name the
classes that may be similar. Within a bucket all pairs are compared a few MinHash values at a time: with a uniform
prior the agreement so far gives the posterior probability that the similarity reaches the threshold, and a pair is
dropped when that falls below the tolerance. What remains connects classes into neighbourhoods; inside each, the pairs
are pruned the same way and the rest verified exactly on the shingle sets. Buckets and neighbourhoods of any size are
cut into blocks, and pairs are counted inside a block as matrices, never emitted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from ..session import settle
from .common import hash_filter, mix, original_id, packed, passes, small, unpacked, with_key
from .components import components
from .sentence_spans import in_groups

SHINGLE, THRESHOLD = 5, 0.8
# Bands of ROWS values each: at similarity 0.8 one pair in two million shares none.
BANDS, ROWS, VALUES = 20, 3, 96
# Pairs whose posterior falls below this are dropped; values compared between two looks.
TOLERANCE, LOOK = 1e-9, 12
# Classes of one block, and of a group whose pairs are listed.
BLOCK, SMALL = 256, 32
# Words a worker remembers; rows of a batch that are worked on at a time.
MEMORY, ROWS_AT_ONCE = 100_000, 512
STEP = np.uint64(0x9E3779B97F4A7C15)
SEEDS = mix(np.arange(1, VALUES + 1, dtype=np.uint64))
FACTORS = mix(np.arange(VALUES + 1, 2 * VALUES + 1, dtype=np.uint64)) | np.uint64(1)
# Shingles worked on at a time.
CACHED = 16_384


class Words(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= MEMORY:
            self.clear()
        h = self[word] = xxh3_64_intdigest(word) >> 1
        return h


def shingles(texts: list[str], words: Words) -> list[np.ndarray]:
    """For each text the distinct 64-bit hashes of all runs of five words in lower case, sorted.

    A text of fewer words is one shingle, one without words has none.
    """
    parts = [t.lower().split() for t in texts]
    sizes = np.array([len(p) for p in parts], np.int64)
    code = np.fromiter(map(words.__getitem__, chain.from_iterable(parts)), np.int64, int(sizes.sum())).view(np.uint64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    many = len(code) - SHINGLE + 1
    if many > 0:
        h = mix(code[:many])
        for k in range(1, SHINGLE):
            h *= STEP
            h += code[k:many + k]
        h = mix(h + np.uint64(SHINGLE))
    out = []
    for s, n in zip(starts.tolist(), sizes.tolist()):
        if n >= SHINGLE:
            out.append(np.unique(h[s:s + n - SHINGLE + 1]))
        elif n:
            own = np.full(1, n, np.uint64)
            for c in code[s:s + n]:
                own = own * STEP + c
            out.append(mix(own))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """The smallest value of each shingle set under each of the hash functions; an empty set has the largest value."""
    low = np.full((VALUES, len(sets)), np.iinfo(np.uint64).max, np.uint64)
    sizes = np.array([len(s) for s in sets], np.int64)
    held = np.flatnonzero(sizes)
    flat = np.concatenate([sets[d] for d in held]) if len(held) else np.zeros(0, np.uint64)
    begin = np.concatenate([[0], np.cumsum(sizes[held])])
    done = 0
    while done < len(held):  # as many sets at a time as stay in the processor's cache; a long set is cut
        last = max(done + 1, int(np.searchsorted(begin, begin[done] + CACHED, "right")) - 1)
        for at in range(int(begin[done]), int(begin[last]), 8 * CACHED):
            part = flat[at:min(at + 8 * CACHED, int(begin[last]))]
            starts = np.maximum(begin[done:last] - at, 0)
            mixed = np.empty_like(part)
            for k in range(VALUES):
                np.bitwise_xor(part, SEEDS[k], out=mixed)
                np.multiply(mixed, FACTORS[k], out=mixed)
                found = np.minimum.reduceat(mixed, starts)
                low[k, held[done:last]] = np.minimum(low[k, held[done:last]], found)
        done = last
    return (low >> np.uint64(32)).astype(np.uint32).T.copy()


def band_keys(low: np.ndarray) -> np.ndarray:
    """The buckets of each row of signatures."""
    wide = low[:, :BANDS * ROWS].astype(np.uint64).reshape(len(low), BANDS, ROWS)
    h = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(low), 1))
    for k in range(ROWS):
        h = mix(h * STEP + wide[:, :, k])
    return h.view(np.int64)


@lru_cache
def needed(tolerance: float = TOLERANCE, threshold: float = THRESHOLD) -> dict[int, int]:
    """For each look the number of equal values below which a pair is dropped.

    With a uniform prior and m of n values equal, the similarity is Beta(m + 1, n - m + 1); the probability that it
    reaches the threshold is that of at most m successes among n + 1 draws at the threshold.
    """
    out = {}
    for n in range(LOOK, VALUES + 1, LOOK):
        reach = 0.0
        for m in range(n + 1):
            reach += math.comb(n + 1, m) * threshold**m * (1 - threshold)**(n + 1 - m)
            if reach >= tolerance:
                out[n] = m
                break
    return out


def survivors(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows of two signature tables that are never dropped."""
    equal = np.zeros(len(i), np.int16)
    for n, least in needed().items():
        for k in range(n - LOOK, n):
            equal += a[i, k] == b[j, k]
        live = equal >= least
        i, j, equal = i[live], j[live], equal[live]
    return i, j


def all_pairs(a: np.ndarray, b: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of two blocks, or of one with itself, that pass the first look; the first values are compared as matrices."""
    first = a[:, :LOOK].T.copy(), b[:, :LOOK].T.copy()
    equal = np.zeros((len(a), len(b)), np.int8)
    for x, y in zip(*first):
        equal += x[:, None] == y[None, :]
    live = equal >= needed()[LOOK]
    return np.nonzero(np.triu(live, 1) if same else live)


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest connected row of each row, by pointer jumping."""
    label = np.arange(n)
    while len(i):
        before = label.copy()
        np.minimum.at(label, i, label[j])
        np.minimum.at(label, j, label[i])
        label = label[label]
        if (label == before).all():
            break
    return label


def exact_links(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs of shingle sets reach the threshold, exactly.

    Where pairs are dense, sets become rows of a matrix over the shingles that occur twice, so that one product
    gives all intersections; other pairs are intersected one by one.
    """
    size = np.array([len(x) for x in sets], np.int64)
    rows, cols = np.unique(i), np.unique(j)
    if len(i) < 64 or len(i) * 8 < len(rows) * len(cols):
        common = np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(i.tolist(), j.tolist())], np.int64)
    else:
        common = np.zeros(len(i), np.int64)
        value = np.concatenate([sets[r] for r in rows] + [sets[c] for c in cols])
        owner = np.repeat(np.arange(len(rows) + len(cols)), np.concatenate([size[rows], size[cols]]))
        order = np.argsort(value, kind="stable")
        value, owner = value[order], owner[order]
        shingle = np.cumsum(np.concatenate([[False], value[1:] != value[:-1]]))
        twice = np.bincount(shingle)[shingle] > 1
        shingle, owner = shingle[twice], owner[twice]
        at_row, at_col = np.searchsorted(rows, i), np.searchsorted(cols, j)
        for low in range(0, int(shingle[-1]) + 1 if len(shingle) else 0, 4096):
            s, e = np.searchsorted(shingle, [low, low + 4096])
            if s == e:
                continue
            dense = np.zeros((len(rows) + len(cols), 4096), np.float32)
            dense[owner[s:e], shingle[s:e] - low] = 1
            common += (dense[:len(rows)] @ dense[len(rows):].T)[at_row, at_col].astype(np.int64)
    union = size[i] + size[j] - common
    # Whole numbers: common / union >= 0.8.
    return common * 5 >= union * 4


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Cut a stream that is sorted by ``keys`` and row into tables of whole groups, with the first row of each.

    Rows that are repeated within a group are handed over once.
    """
    held = None
    pieces = (batch.slice(at, ROWS_AT_ONCE) for batch in batches for at in range(0, batch.num_rows, ROWS_AT_ONCE))
    for batch in chain(pieces, [None]):
        table = held
        if batch is not None:
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        if table is None or not table.num_rows:
            continue
        columns = [table[k].to_numpy() for k in keys]
        new = np.zeros(table.num_rows, bool)
        new[0] = True
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        last = table.num_rows if batch is None else int(np.flatnonzero(new)[-1])
        held = table.slice(last)
        if last:
            row = table["row"].to_numpy()[:last]
            once = new[:last].copy()
            once[1:] |= row[1:] != row[:-1]
            yield table.slice(0, last).filter(pa.array(once)), np.flatnonzero(new[:last][once])


def pairs_to_compare(table: pa.Table, starts: np.ndarray, low: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows that are never dropped: those of all small groups together, then those of each larger block."""
    sizes = np.diff(np.append(starts, table.num_rows))
    bi, bj, mine = (table[c].to_numpy() for c in ("bi", "bj", "mine"))
    plain = (sizes <= SMALL) & (bi[starts] == bj[starts])
    left, right = [], []
    for n in np.unique(sizes[plain & (sizes > 1)]).tolist():
        at = starts[plain & (sizes == n)][:, None]
        i, j = np.triu_indices(n, 1)
        left.append((at + i).ravel())
        right.append((at + j).ravel())
    if left:
        yield survivors(low, low, np.concatenate(left), np.concatenate(right))
    for s, n in zip(starts[~plain].tolist(), sizes[~plain].tolist()):
        a, b = s + np.flatnonzero(mine[s:s + n] == bi[s]), s + np.flatnonzero(mine[s:s + n] == bj[s])
        i, j = survivors(low[a], low[b], *all_pairs(low[a], low[b], bi[s] == bj[s]))
        yield a[i], b[j]


def fixed_size(column: pa.ChunkedArray) -> np.ndarray:
    """A binary column of equal sizes as a table of uint32."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), VALUES)


def in_blocks(rows: DataFrame, key: str, n: str, row: str = "row") -> DataFrame:
    """Cut every group of ``n`` rows into blocks of about BLOCK and deal out all pairs of blocks.

    Adds ``bi <= bj``, the pair of blocks, and ``mine``, the block the row belongs to. A row goes to as many pairs as
    its group has blocks; each pair of rows meets exactly once.
    """
    g = F.ceil(F.col(n) / BLOCK).cast("int")
    return rows.withColumn("mine", F.pmod(F.xxhash64(row), g).cast("int")).withColumn(
        "_d", F.explode(F.sequence(F.lit(0), g - 1))).withColumns({
            "bi": F.least("mine", "_d"), "bj": F.greatest("mine", "_d")}).drop("_d")


def by_block(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.repartition(*keys).sortWithinPartitions(*keys, "row")


def few_at_a_time(batches: Iterator[pa.Array]) -> Iterator[list[str]]:
    """The texts of all batches in order, in runs of bounded number and size."""
    for batch in batches:
        for at in range(0, len(batch), ROWS_AT_ONCE):
            yield from in_groups(batch.slice(at, ROWS_AT_ONCE).to_pylist())


def shingle_sets(docs: DataFrame, text: str, id: str) -> DataFrame:
    """Per document key, set size, 128-bit name of the set, signature and bucket of each band; written once."""

    @F.arrow_udf("struct<n:int,a:long,b:long,low:binary,bands:array<long>>")
    def sets(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words = Words()
        for texts in few_at_a_time(batches):
            found = shingles(texts, words)
            table = signatures(found)
            n = np.array([len(s) for s in found], np.int32)
            names = [np.array([mix(s ^ seed).sum(dtype=np.uint64) for s in found], np.uint64).view(np.int64) for seed in SEEDS[:2]]
            keys = band_keys(table)[n > 0].ravel()
            ends = np.concatenate([[0], np.cumsum((n > 0) * BANDS)]).astype(np.int32)
            yield pa.StructArray.from_arrays([
                pa.array(n), *map(pa.array, names), pa.array([low.tobytes() for low in table], pa.binary()),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(keys))], ["n", "a", "b", "low", "bands"])

    keyed = with_key(docs.select(F.col(id).alias("doc_id"), F.col(text).alias("_text")), "_text")
    return settle(keyed.withColumn("_s", sets("_text")).select("_id", "_th", "_s.*").withColumn("row", F.monotonically_increasing_id()))


def candidate_edges(classes: DataFrame) -> DataFrame:
    """(row, other): a spanning forest of the pairs of classes that share a bucket and are not dropped."""
    entries = classes.select("row", "low", F.explode("bands").alias("key"))
    shared = settle(classes.select(F.explode("bands").alias("key")).groupBy("key").count().where("count > 1"))
    bitmap = classes.sparkSession.sparkContext.broadcast(hash_filter(shared, "key"))

    @F.arrow_udf("boolean")
    def may_share(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for keys in batches:
            yield pa.array(passes(bitmap.value, keys.to_numpy(zero_copy_only=False)))

    large = shared.where(F.col("count") > BLOCK)
    met = entries.where(may_share("key")).join(large, "key", "left").withColumn("n", F.coalesce("count", F.lit(1)))
    blocks = by_block(in_blocks(met, "key", "n").select("key", "bi", "bj", "mine", "row", "low"), ["key", "bi", "bj"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, ["key", "bi", "bj"]):
            low, row = fixed_size(table["low"]), table["row"].to_numpy()
            found = list(pairs_to_compare(table, starts, low))
            if found:
                label = roots(len(row), *(np.concatenate(x) for x in zip(*found)))
                child = np.flatnonzero(label != np.arange(len(row)))
                yield pa.record_batch([pa.array(row[child]), pa.array(row[label[child]])], ["row", "other"])

    return blocks.mapInArrow(link, "row long, other long").distinct()


def verified(members: DataFrame) -> DataFrame:
    """Links inside neighbourhoods, exactly: per row the linked classes and documents, and its block's root.

    ``members``: label, n (rows of the label), row, copies, low, text.
    """
    @F.arrow_udf("array<long>")
    def sets(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words = Words()
        for texts in few_at_a_time(batches):
            yield pa.array([s.view(np.int64) for s in shingles(texts, words)], pa.list_(pa.int64()))

    held = members.withColumn("set", sets("_text")).select("label", "n", "row", "copies", "low", "set")
    blocks = by_block(in_blocks(held, "label", "n").select("label", "bi", "bj", "mine", "row", "copies", "low", "set"), ["label", "bi", "bj"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, ["label", "bi", "bj"]):
            low, row, copies = fixed_size(table["low"]), table["row"].to_numpy(), table["copies"].to_numpy()
            lists = table["set"].combine_chunks()
            flat, offsets = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()
            sets = [flat[s:e] for s, e in zip(offsets, offsets[1:])]
            left, right = [], []
            for i, j in pairs_to_compare(table, starts, low):
                true = exact_links(sets, i, j)
                left.append(i[true])
                right.append(j[true])
            if not left:
                continue
            i, j = np.concatenate(left), np.concatenate(right)
            label = roots(len(row), i, j)
            touched = np.unique(np.concatenate([i, j]))
            count = np.bincount(i, minlength=len(row)) + np.bincount(j, minlength=len(row))
            docs = np.bincount(i, copies[j], len(row)) + np.bincount(j, copies[i], len(row))
            yield pa.record_batch([pa.array(row[touched]), pa.array(row[label[touched]]), pa.array(count[touched]),
                                   pa.array(docs[touched].astype(np.int64))], ["row", "other", "classes", "docs"])

    return blocks.mapInArrow(check, "row long, other long, classes long, docs long")


def similar_classes(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Per document key: ``class_row`` and ``class_id`` of its group, linked documents and linked other classes.

    A link joins two documents whose shingle sets have a similarity of 0.8 or more; groups are what links connect.
    ``copies`` counts the documents with the same set. ``class_id`` is the smallest id of the group (null ids count as
    smallest). Null and empty texts and texts without words have no links and stand alone. ``row`` numbers the rows;
    rows that are repeated are documents of their own.
    """
    sets = shingle_sets(docs, text, id)
    classes = settle(sets.where("n > 0").groupBy("a", "b", "n").agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("copies")))
    firsts = settle(sets.join(classes.select("row", "copies"), "row"))
    edges = settle(candidate_edges(firsts.select("row", "low", "bands")))
    near = settle(components(edges))
    counts = settle(near.groupBy("label").agg(F.count(F.lit(1)).alias("n")))
    members = settle(firsts.select("row", "copies", "low", "_id", "_th").join(small(near), "row").join(small(counts), "label"))
    texts = with_key(docs.select(F.col(id).alias("doc_id"), F.col(text).alias("_text")), "_text").select("_id", "_th", "_text")
    keys = settle(members.select("_id", "_th", "row", "label", "n"))
    wanted = texts.join(small(keys), ["_id", "_th"]).drop("_id", "_th")
    links = settle(verified(wanted.join(small(members.select("row", "copies", "low")), "row")))
    groups = components(links.where("row != other").select("row", "other"))
    summed = links.groupBy("row").agg(F.sum("classes").alias("classes"), F.sum("docs").alias("docs"))
    linked = settle(summed.join(groups, "row"))
    per_class = settle(
        classes.join(linked, "row", "left").select("a", "b", "n", "copies", F.coalesce("label", "row").alias("class_row"),
                                                   F.coalesce("classes", F.lit(0)).alias("classes"), F.coalesce("docs", F.lit(0)).alias("docs")))
    named = sets.join(small(per_class), ["a", "b", "n"], "left").select(
        "_id", "_th", "row", F.coalesce("class_row", "row").alias("class_row"),
        (F.coalesce("copies", F.lit(1)) - 1 + F.coalesce("docs", F.lit(0))).alias("n_links"),
        F.coalesce("classes", F.lit(0)).alias("n_class_links"), F.coalesce("copies", F.lit(1)).alias("copies"))
    named = settle(named)
    ids = settle(named.groupBy("class_row").agg(F.min("_id").alias("_class"), F.min(F.struct("_id", "_th", "row")).alias("_first"),
                                               F.count(F.lit(1)).alias("class_size")))
    return named.join(small(ids), "class_row").withColumns({
        "class_id": original_id("_class"), "first": F.col("_first.row") == F.col("row")}).drop("_class", "_first")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: its group, the size of the group, and its links."""
    return similar_classes(docs).select(
        original_id().alias("doc_id"), "class_id", F.col("class_size").cast("long"), F.col("n_links").cast("long"),
        F.col("n_class_links").cast("long"), F.col("copies").cast("long").alias("n_copies"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group, columns as they came; rows that are repeated whole are one group."""
    kept = settle(similar_classes(docs).where("first").select("_id", "_th"))
    return unpacked(packed(docs).join(small(kept), ["_id", "_th"], "left_semi").dropDuplicates(["_id", "_th"]), docs)
