"""Delivery of published records: read the topic, hand each record over once, keep a receipt for every one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from ..operators.project import drop_transport
from ..schema import Options
from ..session import settle
from ..sources.sinks import in_scratch, read_one, write_batch
from ..sources.topics import from_records

RECEIPT = T.StructType([T.StructField("key", T.StringType()), T.StructField("outcome", T.StringType())])


def deliver_stream(records: DataFrame, schema: T.StructType, send: Callable[[DataFrame], None], out: str, checkpoint: str,
                   options: Options = Options(), late: str = "1 day") -> DataStreamWriter:
    """Deliver topic records ``key, value, timestamp`` (transport columns are dropped) whose ``value`` is JSON of ``schema``.

    ``send`` gets the rows of a micro-batch that are to go out. A record that was published again under its key within ``late`` is
    delivered once. ``out/receipts`` notes what became of every other: ``sent``, ``stale`` (published longer than ``stale_hours`` before the newest
    record of its batch) or ``dead_letter``, which is kept in ``out/dead_letters``. The receipts are written after the delivery: a batch
    that fails in between is delivered again, and one whose receipts are there is not.
    """
    once = records.withWatermark("timestamp", late).dropDuplicatesWithinWatermark(["key"])
    rows = from_records(once.select(F.col("key").cast("string").alias("key"), "value", F.col("timestamp").alias("published_at")), schema)

    def work(batch: DataFrame, batch_id: int) -> None:
        held = settle(drop_transport(batch))
        if read_one(batch.sparkSession, f"{out}/receipts", RECEIPT, batch_id).limit(1).count():
            return
        newest = held.agg(F.max("published_at").cast("string")).first()[0]
        old = F.col("published_at") < F.lit(newest).cast("timestamp") - F.expr(f"INTERVAL {options.stale_hours} HOURS")
        judged = held.withColumn("outcome", F.when(F.col("_corrupt").isNotNull(), "dead_letter").when(old, "stale").otherwise("sent"))
        write_batch(judged.where("outcome = 'dead_letter'").select("key", F.col("_corrupt").alias("value")), f"{out}/dead_letters", batch_id)
        send(judged.where("outcome = 'sent'").drop("outcome", "_corrupt", "published_at"))
        write_batch(judged.select("key", "outcome"), f"{out}/receipts", batch_id)

    return rows.writeStream.foreachBatch(in_scratch(work)).option("checkpointLocation", checkpoint)
