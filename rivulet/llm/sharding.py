"""A reproducible shuffle into shards without moving the rows: a keyed permutation of global row numbers.

Rows are numbered in the order of id and text. A Feistel network permutes the numbers of the next larger power
of four; a value outside the table is permuted again until it falls inside (cycle walking), which keeps the map a
permutation of the rows. The place ``p`` of a row gives its shard ``p mod shards`` and its slot ``p div shards``: shard
sizes differ by one at most, slots have no gaps, and either direction is computable from the row number alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .common import mix, with_key

ROUNDS = 8


def _half(n: int) -> int:
    """Bits of one half of the smallest balanced domain that holds ``n`` values."""
    return max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)


def _network(x: np.ndarray, half: int, seed: int, inverse: bool) -> np.ndarray:
    mask, h = np.uint64((1 << half) - 1), np.uint64(half)
    left, right = x >> h, x & mask
    order = range(ROUNDS - 1, -1, -1) if inverse else range(ROUNDS)
    for r in order:
        key = mix(np.array([(seed * ROUNDS + r) & (2**64 - 1)], np.uint64))
        if inverse:
            left, right = right ^ (mix(left ^ key) & mask), left
        else:
            left, right = right, left ^ (mix(right ^ key) & mask)
    return (left << h) | right


def permute(rows: np.ndarray, n: int, seed: int, inverse: bool = False) -> np.ndarray:
    """The place of each row number below ``n``, or with ``inverse`` the row at each place."""
    out = _network(rows.astype(np.uint64), _half(n), seed, inverse)
    outside = np.flatnonzero(out >= np.uint64(n))
    while outside.size:
        out[outside] = _network(out[outside], _half(n), seed, inverse)
        outside = outside[out[outside] >= np.uint64(n)]
    return out.astype(np.int64)


def locate(row: int, n: int, shards: int, seed: int = 0) -> tuple[int, int]:
    """Shard and slot of a row number."""
    p = int(permute(np.array([row]), n, seed)[0])
    return p % shards, p // shards


def row_at(shard: int, slot: int, n: int, shards: int, seed: int = 0) -> int:
    """The row number that stands in a slot."""
    return int(permute(np.array([slot * shards + shard]), n, seed, inverse=True)[0])


def number_rows(rows: DataFrame, order: list[str], into: str = "row") -> tuple[DataFrame, int]:
    """Number the rows from 0 in the given order, and count them.

    Rows are dealt by ranges of the order, numbered inside each range, and shifted by the sizes of the ranges in
    front. Only one count per range reaches the driver. Equal rows are told apart by their place in the input, so
    a row that is repeated without end is cut into ranges too; which of them gets which number changes nothing.
    """
    spread = rows.withColumn("_m", F.monotonically_increasing_id()).repartitionByRange(*order, "_m")
    inside = spread.sortWithinPartitions(*order, "_m").withColumn("_i", F.monotonically_increasing_id()).drop("_m")
    table = settle(inside.withColumns({
        "_p": F.shiftright("_i", 33).cast("int"), "_i": F.col("_i").bitwiseAND(F.lit((1 << 33) - 1)),
    }))
    starts, n = [], 0
    for p, count in sorted(table.groupBy("_p").count().collect()):
        starts.append((p, n))
        n += count
    offsets = rows.sparkSession.createDataFrame(starts, "_p int, _start long")
    # One row per range of the shuffle.
    placed = table.join(F.broadcast(offsets), "_p").withColumn(into, F.col("_i") + F.col("_start"))
    return placed.drop("_p", "_i", "_start"), n


def assign_shards(docs: DataFrame, shards: int, seed: int = 0, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Per row its id, size, checksum, global row number, shard and slot.

    Size is the number of UTF-8 bytes of the text plus 8; a null text has no bytes and the checksum 0. Null ids come
    first, repeated rows get places of their own, an empty table gives no rows. Other columns are not read.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    narrow = with_key(docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text")), "text", "doc_id").select(
        "doc_id", "_id", "_th",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
    placed, n = number_rows(narrow, ["_id", "_th"])

    @F.arrow_udf("long")
    def place(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for rows in batches:
            yield pa.array(permute(rows.to_numpy(zero_copy_only=False), n, seed))

    return placed.drop("_id", "_th").withColumn("place", place("row")).select(
        "doc_id", "size", "text_crc32", "row",
        (F.col("place") % shards).cast("int").alias("shard"), F.expr(f"place div {shards}").cast("long").alias("slot"),
    )


def shard_table(docs: DataFrame, shards: int = 24) -> DataFrame:
    """All documents in ``shards`` shards whose row counts are at most one apart."""
    placed = assign_shards(docs, shards)
    return placed.withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")}).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "row")
