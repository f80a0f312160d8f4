"""Joins on keys of which one may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settle

# A key is hot when it holds more rows than this, whatever the size of the table: they are cut into parts of about so many.
FLOOR = 100_000


# Rows, and bytes in memory, of a table that may be sent to every executor.
BROADCAST_ROWS, BROADCAST_BYTES = 2_000_000, 128 << 20


def row_bytes(df: DataFrame) -> Column:
    """What a row takes in the hash table of a join: its fields, and a fixed part for key and pointers."""
    total = F.lit(32 + 8 * len(df.columns)).cast("long")
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        if kind in ("string", "binary"):
            total = total + F.coalesce(F.octet_length(f.name), F.lit(0))
        elif kind == "array" and f.dataType.elementType.typeName() in ("string", "binary"):
            total = total + F.coalesce(F.aggregate(f.name, F.lit(0).cast("long"), lambda n, x: n + 16 + F.coalesce(F.octet_length(x), F.lit(0))), F.lit(0))
        elif kind in ("array", "map"):
            total = total + 16 * F.greatest(F.size(f.name), F.lit(0))
    return total


def if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast when the (already computed) table is small enough in rows and bytes; else join by shuffle."""
    n, size = df.agg(F.count(F.lit(1)), F.sum(row_bytes(df))).first()
    return F.broadcast(df) if n <= rows and (size or 0) <= BROADCAST_BYTES else df


def hot_keys(counts: DataFrame, key: str, n: str = "n", floor: int = FLOOR) -> DataFrame:
    """``(key, salts)`` for the hot keys of a table ``(key, n)`` of row counts."""
    return counts.where(F.col(n) > floor).select(key, F.ceil(F.col(n) / floor).cast("int").alias("salts"))


def salt_left(df: DataFrame, key: str, hot: DataFrame, by: Column) -> DataFrame:
    """Spread the rows of hot keys over their salts; ``hot`` is a written table."""
    tagged = df.join(if_small(hot), key, "left")
    return tagged.withColumn("salt", F.pmod(F.xxhash64(by), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")


def salt_right(df: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """Repeat the rows of hot keys once per salt; ``hot`` is a written table."""
    tagged = df.join(if_small(hot), key, "left")
    salts = F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)
    return tagged.withColumn("salt", F.explode(salts)).drop("salts")


def join_counted(left: DataFrame, right: DataFrame, key: str, by: Column, how: str = "inner", n: str = "n",
                 floor: int = FLOOR) -> DataFrame:
    """``left`` joined to a written ``right`` that holds for each key the number ``n`` of its left rows.

    The left side is read once: no count of its own is needed to find the hot keys.
    """
    hot = settle(hot_keys(right, key, n, floor))
    return salt_left(left, key, hot, by).join(salt_right(right.drop(n), key, hot), [key, "salt"], how).drop("salt")


def join_skewed(left: DataFrame, right: DataFrame, key: str, by: Column, how: str = "inner",
                floor: int = FLOOR) -> DataFrame:
    """``left`` joined to a ``right`` that has few rows per key, safe for hot keys on the left.

    The key counts are combined on the map side. ``by`` spreads the left rows and
    must differ between them.
    """
    hot = settle(hot_keys(left.groupBy(key).agg(F.count(F.lit(1)).alias("n")), key, floor=floor))
    return salt_left(left, key, hot, by).join(salt_right(right, key, hot), [key, "salt"], how).drop("salt")


def meet_skewed(left: DataFrame, right: DataFrame, key: str, left_by: str, right_by: str,
                floor: int = FLOOR) -> DataFrame:
    """Inner join in which a key may be hot on either side.

    The rows a hot key holds on one side are cut into salts, and the rows of the
    other side are repeated once per salt: the pairs of a key are spread over a
    grid of tasks and each pair is formed exactly once. Small inputs are joined
    as they are.
    """
    if left.count() <= floor and right.count() <= floor:
        return left.join(right, key)

    def salts(side: DataFrame, name: str) -> DataFrame:
        counts = side.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
        return hot_keys(counts, key, floor=floor).withColumnRenamed("salts", name)

    hot = if_small(settle(salts(left, "_nl").join(salts(right, "_nr"), key, "full")))

    def spread(side: DataFrame, by: str, own: str, other: str) -> DataFrame:
        n_own, n_other = F.coalesce(f"_n{own}", F.lit(1)), F.coalesce(f"_n{other}", F.lit(1))
        return (
            side.join(hot, key, "left")
            .withColumn(f"_s{own}", F.pmod(F.xxhash64(by), n_own).cast("int"))
            .withColumn(f"_s{other}", F.explode(F.sequence(F.lit(0), n_other - 1)))
            .drop("_nl", "_nr")
        )

    grid = [key, "_sl", "_sr"]
    return spread(left, left_by, "l", "r").join(spread(right, right_by, "r", "l"), grid).drop("_sl", "_sr")
