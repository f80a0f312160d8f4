"""Word-overlap similarity: shared words over the smaller set, floor 8 (exact)."""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WORD_SEPARATOR, word_set
from ..session import discard, settle
from .greedy import Tier
from .nearby import near_pairs, shared
from .overlaps import HITS_PER_WORDS, coded_sets, overlaps
from .skew import hot_keys, if_small, salt_left, salt_right

THRESHOLD = 0.7
FLOOR = 8


def word_sets(rows: DataFrame, separator: str = WORD_SEPARATOR) -> DataFrame:
    """``id, seq, words, n`` for the rows with at least one word."""
    sets = rows.select("id", "seq", word_set(F.col("text"), separator).alias("words"))
    return sets.withColumn("n", F.size("words")).where("n > 0")


def word_hashes(text: Column, separator: str = WORD_SEPARATOR) -> Column:
    return F.transform(word_set(text, separator), lambda w: F.xxhash64(w))


def hashed_sets(rows: DataFrame, separator: str = WORD_SEPARATOR) -> DataFrame:
    """Like ``word_sets`` with each word replaced by its hash."""
    words = word_hashes(F.col("text"), separator)
    return rows.select("id", "seq", words.alias("words")).select("id", "seq", "words", F.size("words").alias("n"))


def set_key(words: Column) -> Column:
    """Digest of a word set, whatever the order of its words."""
    return F.sha2(F.array_join(F.array_sort(words), " "), 256)


def needed(n: Column, threshold: float = THRESHOLD, floor: int = FLOOR) -> Column:
    """Smallest number of shared words that scores above the threshold, found by the comparison that scores."""
    size = F.greatest(n, F.lit(floor))
    near = F.floor(size * F.lit(float(threshold))).cast("int")
    above = lambda o: o / size > threshold
    return F.when(above(near - 1), near - 1).when(above(near), near).when(above(near + 1), near + 1).otherwise(near + 2)


def with_rarity(tokens: DataFrame, counts: DataFrame) -> DataFrame:
    """``tokens (token, id, ...)`` with ``df`` from the settled table ``counts (token, df)``.

    Few different tokens are broadcast. Otherwise both sides are shuffled; as a
    frequent token stands in a large share of all rows, its rows are spread over
    salts, so that no task sees them all.
    """
    hinted = if_small(counts)
    if hinted is not counts:
        return tokens.join(hinted, "token")
    hot = settle(hot_keys(counts, "token", n="df"))
    spread = salt_left(tokens, "token", hot, F.col("id"))
    return spread.join(salt_right(counts, "token", hot), ["token", "salt"]).drop("salt")


def word_entries(sets: DataFrame, threshold: float = THRESHOLD, floor: int = FLOOR) -> DataFrame:
    """Index of hashed word sets: all words are base entries, the rarest ones also probe.

    Two sets sharing o words meet in at least k of the n - o + k rarest words of the
    smaller one, for any k and any fixed order of the words: the smaller set misses
    n - o words at most. A k that grows with the set filters far better than 1.
    Sets too small to reach o can only be equal, and meet under their digest.
    """
    tokens = sets.select("id", "seq", "n", F.explode("words").alias("token"))
    counts = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    ranked = (
        tokens.join(counts, "token")
        .groupBy("id", "seq", "n")
        .agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("ranked"))
        .select("id", "seq", F.col("n").alias("size"), F.posexplode("ranked").alias("pos", "t"))
    )
    overlap = needed(F.col("size"), threshold, floor)
    hits = F.least(overlap, 1 + F.floor(F.col("size") / HITS_PER_WORDS).cast("int"))
    by_word = ranked.select(
        F.col("t.token").alias("key"), "id", "seq", "size", hits.alias("hits"),
        (F.col("pos") < F.col("size") - overlap + hits).alias("probe"), F.lit(True).alias("base"),
    )
    small = sets.where((F.col("n") > 0) & (F.col("n") < needed(F.col("n"), threshold, floor))).select(
        F.xxhash64(F.lit("="), F.array_sort("words")).alias("key"), "id", "seq", F.col("n").alias("size"),
        F.lit(1).alias("hits"), F.lit(True).alias("probe"), F.lit(True).alias("base"),
    )
    return by_word.unionByName(small)


def overlap_tier(rows: DataFrame, threshold: float = THRESHOLD, floor: int = FLOOR,
                 separator: str = WORD_SEPARATOR, name: str = "words", equal_sets: bool = True,
                 min_later: int = 0) -> Tier:
    """Tier over ``rows (id, seq, text)``: overlap above the threshold, or equal word sets.

    Texts shorter than ``min_later`` characters are compared with, but never dropped.

    The sets are compared as 64-bit hashes of the words, which are smaller to move
    than the words; two words of one pair collide with odds below 1e-12.
    """
    sets = hashed_sets(rows, separator)
    texts = rows.select("id", "seq", word_hashes(F.col("text"), separator).alias("words"), (F.length("text") >= min_later).alias("fit"))

    @cache
    def blocks() -> DataFrame:
        hashed = settle(texts.withColumn("n", F.size("words")))
        out = settle(coded_sets(hashed, "fit"))
        discard(hashed)
        return out

    def coded(rows: DataFrame) -> DataFrame:
        return rows if "common" in rows.columns else settle(blocks().join(rows.select("id").distinct(), "id", "left_semi"))

    def best(later: DataFrame, earlier: DataFrame, k: int) -> DataFrame:
        new = coded(later)
        return overlaps(new, new if later is earlier else coded(earlier), threshold, floor, equal_sets, k)

    def match(pdf: pd.DataFrame, later: np.ndarray, earlier: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sets = [np.asarray(w, np.int64) for w in pdf["words"]]
        a, b = [sets[i] for i in later], [sets[i] for i in earlier]
        na, nb = (np.array([len(s) for s in x]) for x in (a, b))
        both = shared(a, b)
        score = both / np.maximum(floor, np.minimum(na[:, None], nb[None, :]))
        hit = (score > threshold) & (both > 0)
        if equal_sets:
            hit |= (both == na[:, None]) & (both == nb[None, :])
        i, j = np.nonzero(hit & pdf["fit"].to_numpy(bool)[later][:, None])
        return i, j, score[i, j]

    def within(horizon: int) -> DataFrame:
        return near_pairs(texts.where("size(words) > 0").withColumn("fit", F.coalesce("fit", F.lit(False))), horizon, match)

    return Tier(name, cache(lambda: word_entries(sets, threshold, floor)), lambda later, earlier: best(later, earlier, 0), symmetric=True, blocks=blocks,
                best=best, within=within)


def keyed_rows(rows: DataFrame, separator: str = WORD_SEPARATOR) -> DataFrame:
    """``id, seq, copy_key``: rows with the same non-empty word set are copies."""
    words = word_set(F.col("text"), separator)
    return rows.select("id", "seq", F.when(F.size(words) > 0, set_key(words)).alias("copy_key"))
