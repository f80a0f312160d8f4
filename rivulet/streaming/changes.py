"""The feed of edits and removals as keyed state: one small state per message."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.project import outbox_key
from .signatures import use_rocksdb

_OUT = "seq long, chat_id long, id long, op string, version long, text string"
_NAMES = [c.split()[0] for c in _OUT.split(", ")]
_STATE = T.StructType([
    T.StructField("text", T.StringType()), T.StructField("version", T.LongType()), T.StructField("gone", T.BooleanType()),
])


def _order(event: tuple) -> tuple[bool, int]:
    """By number; events without one come last."""
    seq = event[0]
    return (True, 0) if seq is None or seq != seq else (False, seq)


class Changes(StatefulProcessor):
    """The text last published for a message, how often it changed, and whether it was removed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("published", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # A message has few events and there are many messages: what is done per message counts.
        text, version, gone = self.state.get() or (None, 0, False)
        found, events = [], []
        for pdf in rows:
            events += zip(pdf["seq"].tolist(), pdf["kind"].tolist(), pdf["text"].tolist())
        for seq, kind, new in sorted(events, key=_order):
            new = None if new is None or new != new else new
            if gone:
                break
            if kind == "remove":
                gone, op = True, "retract" if version else None
            else:
                op = "insert" if not version else "update" if new != text else None
                text = new
            if op:
                version += 1
                found.append((seq, key[0], key[1], op, version, None if gone else text))
        self.state.update((None if gone else text, version, gone))
        if found:
            yield pd.DataFrame(dict(zip(_NAMES, map(list, zip(*found)))))

    def close(self) -> None:
        pass


def change_stream(events: DataFrame) -> DataFrame:
    """The same rows as :func:`operators.changes.change_feed`, as the events come; order counts inside a micro-batch and between them."""
    use_rocksdb(events.sparkSession)
    found = events.select("seq", "chat_id", "id", "kind", "text").groupBy("chat_id", "id").transformWithStateInPandas(
        Changes(), outputStructType=_OUT, outputMode="append", timeMode="none")
    return found.withColumn("key", outbox_key(F.lit("MESSAGE"), F.col("chat_id"), F.col("id")))
