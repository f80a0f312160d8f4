"""What several operators of this subpackage share: row keys, hashing and the bounded filter of a join's keys."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bits of the filter that is sent to the executors: 2 MB, whatever the data size.
FILTER_BITS = 1 << 24

MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finalizer of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= MIX_A
    x ^= x >> np.uint64(27)
    x *= MIX_B
    x ^= x >> np.uint64(31)
    return x


def with_key(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Add ``_id`` and ``_th``, which are never null: rows that agree in id and text are one document.

    A null id becomes the smallest long, a null text the empty text. Every decision of the operators
    that use this key depends on id and text alone, so equal rows may share it.
    """
    return docs.withColumns({
        "_id": F.coalesce(F.col(id).cast("long"), F.lit(-(2**63))),
        "_th": F.xxhash64(F.coalesce(F.col(text), F.lit(""))),
    })


def packed(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """The key, the text as ``_text``, and the whole row as ``_doc``, so that no name of the row can clash."""
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_doc"), F.col(id).alias("doc_id"), F.col(text).alias("_text"))
    return with_key(rows, "_text").drop("doc_id")


def unpacked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The rows of :func:`packed` with the columns of ``docs`` again."""
    return rows.select(*[F.col("_doc")[c].alias(c) for c in docs.columns])


def original_id(key: str = "_id") -> Column:
    """The document's id out of the key."""
    return F.when(F.col(key) != F.lit(-(2**63)), F.col(key))


def hash_filter(hashes: DataFrame, column: str, bits: int = FILTER_BITS) -> np.ndarray:
    """A bitmap of the hashes in ``column``: ``bits / 8`` bytes, however many rows there are.

    It lets through every hash of the table and, by chance, some others: what passes is joined exactly.
    """
    words = hashes.groupBy(F.expr(f"pmod({column}, {bits}) div 64").alias("w")).agg(
        F.expr(f"bit_or(shiftleft(1L, cast(pmod({column}, 64) as int)))").alias("b"))
    table = np.zeros(bits // 64, np.int64)
    got = words.toPandas()  # at most bits / 64 rows
    table[got["w"].to_numpy(np.int64)] = got["b"].to_numpy(np.int64)
    return table.view(np.uint64)


def passes(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which int64 hashes may be in the table of :func:`hash_filter`."""
    slot = hashes.astype(np.int64) % (table.size * 64)
    return (table[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1) != 0


# Bytes of a written table that may be sent to every executor, as they lie in memory there.
BROADCAST_BYTES = 32 << 20


def row_bytes(df: DataFrame) -> Column:
    """What a row takes as a value of a join's hash table: its fields, and a fixed part for key and pointers."""
    total = F.lit(48 + 8 * len(df.columns)).cast("long")
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        if kind in ("string", "binary"):
            total = total + F.coalesce(F.octet_length(f.name), F.lit(0))
        elif kind in ("array", "map"):
            total = total + 16 * F.greatest(F.size(f.name), F.lit(0))
    return total


def small(df: DataFrame) -> DataFrame:
    """Hint a broadcast for a written table within the bound; beyond it the join shuffles."""
    return F.broadcast(df) if (df.agg(F.sum(row_bytes(df))).first()[0] or 0) <= BROADCAST_BYTES else df
