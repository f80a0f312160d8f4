"""Equality on any of several keys, as a similarity tier (ids, access hashes, forward headers)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .greedy import Tier, attach, candidates
from .skew import if_small, join_counted


def decide(entries: DataFrame) -> DataFrame:
    """``id`` of the rows that an earlier kept one shares a value with; ``entries``: ``value, id, seq``.

    Of the rows with one value at most the first open one is kept. A row that is the first at all its values is kept, and those
    that share one of them are dropped; this repeats among the rest. No pair is formed: a round costs the open rows.
    """
    open_rows = settle(entries.where("id IS NOT NULL AND seq IS NOT NULL").select("value", "id", "seq"))
    lost = open_rows.select("id").limit(0)
    while not open_rows.isEmpty():
        firsts = settle(open_rows.groupBy("value").agg(F.min("seq").alias("first"), F.count(F.lit(1)).alias("n")))
        seen = settle(join_counted(open_rows, firsts, "value", F.col("id")))
        kept = settle(seen.groupBy("id").agg(F.bool_and(F.col("seq") == F.col("first")).alias("kept")).where("kept").select("id"))
        taken = settle(seen.join(if_small(kept), "id", "left_semi").select("value", F.lit(True).alias("taken")).distinct())
        met = seen.join(if_small(taken), "value").where(F.col("seq") > F.col("first"))
        gone = settle(met.select("id").distinct())
        lost = lost.unionByName(gone)
        over = settle(gone.unionByName(kept))
        open_rows = settle(open_rows.join(if_small(over), "id", "left_anti"))
    return lost


def key_tier(rows: DataFrame, keys: list[str], name: str = "key") -> Tier:
    """Tier over ``rows (id, seq, *keys)``: two rows match when they agree on any non-null key."""
    entries = None
    for k in keys:
        part = rows.where(F.col(k).isNotNull()).select(
            F.xxhash64(F.lit(k), F.col(k).cast("string")).alias("key"), "id", "seq",
            F.lit(True).alias("probe"), F.lit(True).alias("base"), F.concat_ws("=", F.lit(k), F.col(k).cast("string")).alias("value"))
        entries = part if entries is None else entries.unionByName(part)
    payload = rows.select("id", *keys)

    def pairs(later: DataFrame, earlier: DataFrame) -> DataFrame:
        both = attach(candidates(later, earlier), payload)
        same = F.lit(False)
        for k in keys:
            same = same | F.coalesce(F.col(k) == F.col(f"other_{k}"), F.lit(False))
        return both.where(same).select("id", "other_id", "other_seq", F.lit(1.0).alias("score"))

    return Tier(name, entries, pairs, lose=decide)
