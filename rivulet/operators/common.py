"""Longest run shared by all texts of a group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .skew import join_skewed


def common_stem(members: DataFrame, key: str, order: str, text: str, min_len: int = 5) -> DataFrame:
    """``key, stem``: the longest run of the first text found in all others, the left-most of the longest.

    For every start in the first text each other text yields the longest run it
    contains; the minimum over the texts is what all of them contain. Minima are
    combined on the map side, so the texts of a group never meet in one task.
    """
    head = members.groupBy(key).agg(
        F.min_by(text, order).alias("first"), F.min(order).alias("_o"), (F.count(F.lit(1)) - 1).alias("others")
    )
    pairs = join_skewed(members.select(key, order, text), head, key, F.col(order)).where(F.col(order) != F.col("_o"))

    def fits(i, n):
        return (i + n - 1 <= F.length("first")) & F.contains(F.col(text), F.substring("first", i, n))

    def longest(i, steps):
        # Being contained is monotone in the length: grow it by powers of two.
        return F.aggregate(steps, F.lit(min_len), lambda n, s: F.when(fits(i, n + s), n + s).otherwise(n))

    # Most starts fail with the shortest run. An array of one holds the steps up to the length of the text, so that they are
    # found once per text and not once per start.
    starts = F.filter(F.sequence(F.lit(1), F.length("first")), lambda i: fits(i, F.lit(min_len)))
    powers = F.filter(F.array(*[F.lit(1 << p) for p in range(24, -1, -1)]), lambda s: s <= F.length("first") - min_len)
    runs = F.get(F.transform(F.array(powers), lambda steps: F.transform(starts, lambda i: F.struct(
        i.alias("at"), longest(i, steps).alias("n")))), 0)
    runs = F.when(F.length("first") >= min_len, runs)
    per_start = pairs.select(key, "others", F.explode(runs).alias("r")).groupBy(key, "r.at").agg(
        F.min("r.n").alias("n"), F.count(F.lit(1)).alias("texts"), F.first("others").alias("others"))
    shared = per_start.where(F.col("texts") == F.col("others"))
    best = shared.groupBy(key).agg(F.max(F.struct("n", (-F.col("at")).alias("back"))).alias("b"))
    stem = F.substring("first", -F.col("b.back"), F.col("b.n"))
    return head.join(best, key, "left").select(key, F.coalesce(stem, F.lit("")).alias("stem"))
