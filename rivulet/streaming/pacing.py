"""Paced sending as keyed state with timers: one record of a target leaves at a time, a gap apart."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .signatures import use_rocksdb

OUT = "target string, seq long, send_at timestamp, body string"
# Records of one target that are one entry of the state.
CHUNK = 512
_AT = T.StructType([T.StructField("at", T.LongType())])
# The waiting chunks are numbered ``head`` to ``tail`` - 1; of the first one ``sent`` records have left.
_QUEUE = T.StructType([T.StructField("head", T.LongType()), T.StructField("sent", T.LongType()), T.StructField("tail", T.LongType())])
_CHUNK = T.StructType([
    T.StructField("at", T.ArrayType(T.LongType())), T.StructField("seq", T.ArrayType(T.LongType())), T.StructField("body", T.ArrayType(T.StringType())),
])


def _due(at: int) -> int:
    """Timers count milliseconds; a record never leaves before its time."""
    return -(-at // 1000)


class Pacer(StatefulProcessor):
    """Waiting records of a target in the order in which they leave, in chunks, and one timer for the first of them.

    A gap of a millisecond or more makes their milliseconds differ, so the queue is in order and only its end grows.
    """

    def __init__(self, gap: float):
        self.gap = round(gap * 1_000_000)
        if self.gap < 1000:
            raise ValueError("a gap of at least a millisecond")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", _AT)
        self.queue = handle.getValueState("queue", _QUEUE)
        self.waiting = handle.getMapState("waiting", _AT, _CHUNK)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else None
        head, sent, tail = self.queue.get() if self.queue.exists() else (0, 0, 0)
        # One target's share of one micro-batch, which the trigger bounds, in order.
        pdf = pd.concat(list(rows)).sort_values("seq")
        if pdf.empty:
            return iter(())
        ready = pdf["ready_at"].astype("datetime64[us]").astype("int64")
        leave = []
        for at in ready.tolist():
            last = at if last is None else max(at, last + self.gap)
            leave.append(last)
        if head == tail:
            self.handle.registerTimer(_due(leave[0]))
        seqs, bodies = pdf["seq"].tolist(), pdf["body"].tolist()
        for low in range(0, len(leave), CHUNK):
            part = slice(low, low + CHUNK)
            self.waiting.updateValue((tail,), (leave[part], seqs[part], bodies[part]))
            tail += 1
        self.last.update((last,))
        self.queue.update((head, sent, tail))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        head, sent, tail = self.queue.get()
        while head < tail:
            at, seq, body = self.waiting.getValue((head,))
            upto = bisect_right(at, now, sent, key=_due)
            if upto > sent:
                yield pd.DataFrame({"target": key[0], "seq": seq[sent:upto], "send_at": pd.to_datetime(at[sent:upto], unit="us"), "body": body[sent:upto]})
            sent = upto
            if upto < len(at):
                self.handle.registerTimer(_due(at[upto]))
                break
            self.waiting.removeKey((head,))
            head, sent = head + 1, 0
        self.queue.update((head, sent, tail))

    def close(self) -> None:
        pass


def paced_stream(records: DataFrame, gap: float, late: str = "0 seconds") -> DataFrame:
    """``target, seq, send_at, body`` of records ``target, seq, ready_at, body``, released when event time reaches ``send_at``.

    Records of one target are sent in the order of ``seq`` inside a micro-batch and of micro-batches, at least ``gap`` seconds apart and not
    before they are ready. What waits is state, an entry for ``CHUNK`` records and a timer per target, and survives a restart.
    """
    use_rocksdb(records.sparkSession)
    return records.withWatermark("ready_at", late).groupBy("target").transformWithStateInPandas(
        Pacer(gap), outputStructType=OUT, outputMode="append", timeMode="eventTime")
