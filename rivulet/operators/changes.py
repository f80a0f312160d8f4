"""What edits and removals of messages do to published records: a feed of inserts, updates and retractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .project import outbox_key


def change_feed(events: DataFrame) -> DataFrame:
    """``seq, chat_id, id, key, op, version, text`` out of ``events (seq, chat_id, id, kind, text)``; kind: new, edit or remove.

    The first version of a message is an ``insert`` (also an edit whose message was not seen), another text an ``update``; a version with the same text
    changes nothing. The first removal retracts what was published; whatever comes later for the message is ignored.
    ``version`` counts the changes of a message, ``key`` is that of its published record.
    """
    message = Window.partitionBy("chat_id", "id")
    order = message.orderBy("seq")
    removed = F.min(F.when(F.col("kind") == "remove", F.col("seq"))).over(message)
    shown = events.withColumn("_removed", removed).where(F.col("_removed").isNull() | (F.col("seq") <= F.col("_removed")))
    # A null text is a text: the version before tells whether there is one.
    step = shown.withColumns({"_before": F.lag(F.struct("text")).over(order), "_first": F.lag("seq").over(order).isNull()})
    op = (
        F.when(F.col("kind") == "remove", F.when(~F.col("_first"), "retract"))
        .when(F.col("_first"), "insert")
        .when(~F.col("_before.text").eqNullSafe(F.col("text")), "update")
    )
    changes = step.withColumn("op", op).where(F.col("op").isNotNull())
    return changes.select(
        "seq", "chat_id", "id", outbox_key(F.lit("MESSAGE"), F.col("chat_id"), F.col("id")).alias("key"), "op",
        F.row_number().over(order).cast("long").alias("version"), F.when(F.col("op") != "retract", F.col("text")).alias("text"))


def current(changes: DataFrame) -> DataFrame:
    """The published records after a feed: the newest version of each key that is not retracted."""
    last = changes.groupBy("key").agg(F.max_by(F.struct("chat_id", "id", "op", "text"), "version").alias("m"))
    return last.where("m.op <> 'retract'").select("key", "m.chat_id", "m.id", "m.text")
