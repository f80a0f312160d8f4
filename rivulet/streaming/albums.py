"""Albums whose members arrive one by one, and running tables of a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..sources.sinks import write_batch


def fold_album_stream(members: DataFrame, gap: str = "1 minute", late: str = "1 hour") -> DataFrame:
    """One message per album of members ``ts, chat_id, grouped_id, pos, message, forward``, ``gap`` after the last of them.

    The state of an album is one row, and leaves when the watermark has passed it: an album that is complete is
    written once, members that come later than ``late`` are left out. Files are rows of their own: the members.
    """
    session = F.session_window("ts", gap)
    return (
        members.withWatermark("ts", late)
        .groupBy(session, "chat_id", "grouped_id")
        .agg(
            F.min("pos").alias("id"), F.min_by("message", "pos").alias("message"),
            F.max_by("forward", F.when(F.col("forward").isNotNull(), F.col("pos"))).alias("forward"),
            F.count(F.lit(1)).alias("n_files"),
        )
        .drop("session_window")
    )


def first_seen_stream(messages: DataFrame, keys: list[str], time: str = "ts", late: str = "1 hour") -> DataFrame:
    """Exact repeats dropped while their key is within the watermark."""
    return messages.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def presence_stream(events: DataFrame) -> DataFrame:
    """Last status per service, as it changes."""
    return events.groupBy("service").agg(F.max_by("status", F.struct("ts", "seq")).alias("status"), F.max("ts").alias("ts"))


def upsert_writer(df: DataFrame, out: str, checkpoint: str) -> DataStreamWriter:
    """The changed rows of a result table after each micro-batch, one folder per batch."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, out, batch_id)

    return df.writeStream.outputMode("update").foreachBatch(handle).option("checkpointLocation", checkpoint)


def newest_rows(changes: DataFrame, keys: list[str]) -> DataFrame:
    """The table that :func:`upsert_writer` keeps: for each key the row of its newest batch."""
    others = [c for c in changes.columns if c not in (*keys, "batch")]
    return changes.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("_row")).select(*keys, "_row.*")
