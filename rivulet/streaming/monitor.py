"""Progress, lag and failures of running queries as rows of a table."""

from __future__ import annotations

import json
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQueryListener

ROW = T.StructType([
    T.StructField("event", T.StringType()), T.StructField("run_id", T.StringType()), T.StructField("name", T.StringType()),
    T.StructField("at", T.StringType()), T.StructField("batch", T.LongType()), T.StructField("rows", T.LongType()),
    T.StructField("batch_ms", T.LongType()), T.StructField("watermark", T.StringType()), T.StructField("state_rows", T.LongType()),
    T.StructField("waiting", T.LongType()), T.StructField("error", T.StringType()),
])


class Monitor(StreamingQueryListener):
    """Collects one row per start, micro-batch and end of every query of the session; :meth:`flush` writes them to ``path``.

    Rows that were not written yet are bounded by ``hold``: then they are written at once. ``waiting`` is the lag of the
    sources as they report it (files or offsets that are there and were not read yet), null where they do not.
    """

    def __init__(self, spark: SparkSession, path: str, hold: int = 1000):
        self.spark, self.path, self.hold = spark, path, hold
        self.rows: list[tuple] = []
        self.lock = threading.Lock()

    def _add(self, *row) -> None:
        with self.lock:
            self.rows.append(row)
            full = len(self.rows) >= self.hold
        if full:
            self.flush()

    def onQueryStarted(self, event) -> None:
        self._add("started", str(event.runId), event.name, event.timestamp, None, None, None, None, None, None, None)

    def onQueryProgress(self, event) -> None:
        p = json.loads(event.progress.json)
        lags = [int(s["metrics"][m]) for s in p.get("sources", []) for m in ("numFilesOutstanding", "maxOffsetsBehindLatest") if m in (s.get("metrics") or {})]
        self._add("progress", p["runId"], p.get("name"), p["timestamp"], p["batchId"], p.get("numInputRows", 0), p.get("batchDuration"),
                  (p.get("eventTime") or {}).get("watermark"), sum(s["numRowsTotal"] for s in p.get("stateOperators", [])),
                  sum(lags) if lags else None, None)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._add("failed" if event.exception else "ended", str(event.runId), None, None, None, None, None, None, None, None, event.exception)

    def flush(self) -> None:
        """Write what was collected, one new file."""
        with self.lock:
            rows, self.rows = self.rows, []
        if rows:
            self.spark.createDataFrame(rows, ROW).coalesce(1).write.parquet(f"{self.path.rstrip('/')}/part={uuid.uuid4().hex}")


def read_monitor(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ROW).parquet(f"{path.rstrip('/')}/*")


def query_health(rows: DataFrame) -> DataFrame:
    """Per run: name, micro-batches, rows read, the longest batch, the last watermark, and the error if it failed."""
    return rows.groupBy("run_id").agg(
        F.max("name").alias("name"), F.count_if(F.col("event") == "progress").alias("batches"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
        F.max("batch_ms").alias("longest_ms"), F.max_by("watermark", "batch").alias("watermark"),
        F.max_by("waiting", "batch").alias("waiting"), F.max(F.substring("error", 1, 1000)).alias("error"),
        F.max(F.when(F.col("event").isin("ended", "failed"), F.col("event"))).alias("end"))
