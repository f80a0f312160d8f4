"""Ordered operators in two levels: inside bounded blocks, then over block summaries.

A plain window puts all rows of a key into one task. Here the rows are dealt by
ranges of key and order, so that a block ``(key, range)`` holds about ``span``
rows wherever the values of the order column lie. Only one summary row per block
goes through the window over the whole key. A null key is a key like any other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import is_settled, settle
from .skew import if_small

SPAN = 1_000_000
_BLOCK = "_block"


def _blocked(df: DataFrame, keys: list[str], order: str, span: int) -> DataFrame:
    """Add the block of each row: the range it was dealt to, written so that every later step sees the same."""
    ranges = -(-df.count() // span)
    if ranges <= 1:
        return df.withColumn(_BLOCK, F.lit(0))
    return settle(df.repartitionByRange(ranges, *keys, order).withColumn(_BLOCK, F.spark_partition_id()))


def _carried(df: DataFrame, keys: list[str], summaries: dict[str, Column], carries: dict[str, Column]) -> DataFrame:
    """Each row with what all earlier blocks of the same key hand over: a row per block and key, so the rows themselves rarely move."""
    per_block = df.groupBy(*keys, _BLOCK).agg(*[c.alias(n) for n, c in summaries.items()])
    before = Window.partitionBy(*keys).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carry = per_block.select(*[F.col(k).alias(f"_of_{k}") for k in [*keys, _BLOCK]], *[c.over(before).alias(n) for n, c in carries.items()])
    if not is_settled(df):
        # One block: nothing lies before it.
        return df.withColumns({n: F.lit(None).cast(carry.schema[n].dataType) for n in carries})
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in [*keys, _BLOCK]])
    return df.join(if_small(settle(carry)), same).drop(*[f"_of_{k}" for k in [*keys, _BLOCK]])


def row_numbers(df: DataFrame, keys: list[str], order: str, name: str = "rn", span: int = SPAN) -> DataFrame:
    """1-based position of each row within its key."""
    df = _blocked(df, keys, order, span)
    local = F.row_number().over(Window.partitionBy(*keys, _BLOCK).orderBy(order))
    met = _carried(df, keys, {"_n": F.count(F.lit(1))}, {"_before": F.sum("_n")})
    return met.withColumn(name, local + F.coalesce("_before", F.lit(0))).drop(_BLOCK, "_before")


def _running(df: DataFrame, keys: list[str], order: str, value: str, name: str, span: int, fold, join) -> DataFrame:
    df = _blocked(df, keys, order, span)
    upto = Window.partitionBy(*keys, _BLOCK).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    met = _carried(df, keys, {"_part": fold(value)}, {"_before": fold("_part")})
    return met.withColumn(name, join(fold(value).over(upto), F.col("_before"))).drop(_BLOCK, "_before")


def running_max(df: DataFrame, keys: list[str], order: str, value: str, name: str, span: int = SPAN) -> DataFrame:
    """Largest ``value`` up to and including each row."""
    return _running(df, keys, order, value, name, span, F.max, F.greatest)


def running_sum(df: DataFrame, keys: list[str], order: str, value: str, name: str, span: int = SPAN) -> DataFrame:
    """Sum of ``value`` up to and including each row."""
    return _running(df, keys, order, value, name, span, F.sum, lambda own, before: own + F.coalesce(before, F.lit(0)))


def _running_all(df: DataFrame, keys: list[str], order: str, values: dict[str, str], span: int, fold, join) -> DataFrame:
    df = _blocked(df, keys, order, span)
    upto = Window.partitionBy(*keys, _BLOCK).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    met = _carried(df, keys, {f"_part_{n}": fold(v) for n, v in values.items()}, {f"_before_{n}": fold(f"_part_{n}") for n in values})
    carried = {n: join(fold(v).over(upto), F.coalesce(f"_before_{n}", F.lit(0))) for n, v in values.items()}
    return met.withColumns(carried).drop(_BLOCK, *[f"_before_{n}" for n in values])


def running_sums(df: DataFrame, keys: list[str], order: str, values: dict[str, str], span: int = SPAN) -> DataFrame:
    """Several running sums of integers at once: new column -> summed column."""
    return _running_all(df, keys, order, values, span, F.sum, lambda own, before: own + before)


def running_xors(df: DataFrame, keys: list[str], order: str, values: dict[str, str], span: int = SPAN) -> DataFrame:
    """Exclusive or of all values up to and including each row: new column -> column."""
    return _running_all(df, keys, order, values, span, F.bit_xor, lambda own, before: own.bitwiseXOR(before))


def trailing(df: DataFrame, keys: list[str], order: str, value: str, size: int, name: str = "window",
             span: int = SPAN) -> DataFrame:
    """Array of the last ``size`` values up to and including each row, oldest first.

    Each block receives the last ``size - 1`` rows of the blocks before it; a
    block is never empty, so that many preceding blocks are enough.
    """
    df = _blocked(df, keys, order, span)
    newest = Window.partitionBy(*keys, _BLOCK).orderBy(F.desc(order))
    tails = (
        df.select(*keys, _BLOCK, order, value)
        .withColumn("_r", F.row_number().over(newest))
        .where(F.col("_r") < size)
        .groupBy(*keys, _BLOCK)
        .agg(F.array_sort(F.collect_list(F.struct(order, value))).alias("_tail"))
    )
    before = Window.partitionBy(*keys).orderBy(_BLOCK).rowsBetween(-(size - 1), -1)
    carried = (
        tails.withColumn("_all", F.flatten(F.collect_list("_tail").over(before)))
        .withColumn("_c", F.explode(F.slice("_all", F.greatest(F.size("_all") - size + 2, F.lit(1)), size - 1)))
        .select(*keys, _BLOCK, F.col(f"_c.{order}").alias(order), F.col(f"_c.{value}").alias(value),
                F.lit(True).alias("_old"))
    )
    rows = df.withColumn("_old", F.lit(False)).unionByName(carried, allowMissingColumns=True)
    frame = Window.partitionBy(*keys, _BLOCK).orderBy(order).rowsBetween(-(size - 1), 0)
    return rows.withColumn(name, F.collect_list(value).over(frame)).where(~F.col("_old")).drop(_BLOCK, "_old")


def paced(df: DataFrame, keys: list[str], order: str, time: str, gap: float, name: str = "send_at",
          span: int = SPAN) -> DataFrame:
    """Earliest send time (seconds) with at least ``gap`` between two sends of a key, in order.

    send(i) = max over j <= i of (time(j) - gap * j), plus gap * i.
    """
    numbered = row_numbers(df, keys, order, "_rn", span).withColumn("_slack", F.col(time) - gap * F.col("_rn"))
    held = running_max(numbered, keys, order, "_slack", "_most", span)
    return held.withColumn(name, F.col("_most") + gap * F.col("_rn")).drop("_rn", "_slack", "_most")


def newest(df: DataFrame, order: str, n: int) -> DataFrame:
    """The last ``n`` rows; 0 means all of them. A top-k, not a full sort."""
    return df if n == 0 else df.orderBy(F.desc(order)).limit(n)
