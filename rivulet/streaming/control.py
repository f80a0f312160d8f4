"""Gathering under lists that change while the stream runs: commands and messages are two inputs of one query.

Commands take effect between two micro-batches: the messages of a batch are judged by the lists as all earlier batches left
them. The lists are a small table, written whole after every batch; a batch reads the one that the batch before it
wrote, so a replay sees the same lists and writes the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from ..operators.control import parse_commands, switch_state
from ..operators.select import drop_matching, followed
from ..schema import Options
from ..session import settle
from ..sources.sinks import in_scratch, read_one, write_batch

# kind: follow, pattern, switch or clock; value: the number of the command, of the switch, or microseconds.
STATE = T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("name", T.StringType()), T.StructField("value", T.LongType()),
])
SWITCH = "remove_to_ignore"


def changed(state: DataFrame, commands: DataFrame, initial: int = 1) -> DataFrame:
    """The lists after ``commands (seq, text)``; ``state`` as they were. Anything that is no command changes nothing."""
    acts = settle(parse_commands(commands).select("seq", "command", "arg"))
    follows = state.where("kind = 'follow'").select("name", F.lit("follow").alias("command"), F.lit(-1).cast("long").alias("seq")).unionByName(
        acts.where("command in ('follow', 'unfollow')").select(F.col("arg").alias("name"), "command", "seq"))
    last = follows.groupBy("name").agg(F.max_by("command", "seq").alias("command"), F.max("seq").alias("value"))
    patterns = state.where("kind = 'pattern'").select("name", "value").unionByName(
        acts.where("command = 'add_regex_item'").select(F.col("arg").alias("name"), F.col("seq").alias("value")))
    now = switch_of(state, initial)
    flips = switch_state(acts.where(F.col("command") == f"switch {SWITCH}").select("seq", "arg"), now)
    switch = flips.agg(F.max_by("value", "seq").alias("v")).select(
        F.lit("switch").alias("kind"), F.lit(SWITCH).alias("name"), F.coalesce("v", F.lit(now)).cast("long").alias("value"))
    return (
        last.where("command = 'follow'").select(F.lit("follow").alias("kind"), "name", "value")
        .unionByName(patterns.groupBy("name").agg(F.min("value").alias("value")).select(F.lit("pattern").alias("kind"), "name", "value"))
        .unionByName(switch)
    )


def switch_of(state: DataFrame, initial: int = 1) -> int:
    row = state.where(F.col("kind") == "switch").first()
    return initial if row is None else int(row.value)


def lists_before(spark: SparkSession, out: str, batch_id: int) -> DataFrame:
    return read_one(spark, f"{out}/lists", STATE, batch_id - 1)


def timeliness(time: Column, clock: int | None, late: str, stale_hours: int) -> Column:
    """``late``: behind all earlier batches by more than ``late``; ``stale``: by more than ``stale_hours``; else ``on_time``.

    ``clock`` is the newest time of the earlier batches in microseconds; without one everything is on time, as is a row without a time.
    """
    if clock is None:
        return F.lit("on_time")
    now = F.timestamp_micros(F.lit(clock))
    return F.when(time < now - F.expr(f"INTERVAL {stale_hours} HOURS"), "stale").when(time < now - F.expr(f"INTERVAL {late}"), "late").otherwise("on_time")


def gather_stream(messages: DataFrame, commands: DataFrame, out: str, checkpoint: str, options: Options = Options(),
                  late: str = "10 minutes") -> DataStreamWriter:
    """Select messages ``seq, ts, chat_id, text`` by lists that commands ``seq, text`` change while the query runs.

    ``out/selected`` gets the messages of followed channels that no pattern drops and that come in time; it is the input of
    :func:`pipeline.pipeline_stream`. ``out/aside`` gets all others with the reason: ``unfollowed``, ``ad``, ``late`` or
    ``stale``; nothing is lost. ``out/lists`` holds the lists after each batch. A late row is one that earlier batches are
    ahead of by more than ``late``, a stale one by more than the ``stale_hours`` of the options.
    """
    both = messages.select("seq", "ts", "chat_id", "text", F.lit(False).alias("command")).unionByName(
        commands.select("seq", F.lit(None).cast("timestamp").alias("ts"), F.lit(None).cast("long").alias("chat_id"), "text", F.lit(True).alias("command")))

    def work(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = settle(batch)
        lists = settle(lists_before(spark, out, batch_id))
        clock = lists.where("kind = 'clock'").agg(F.max("value")).first()[0]
        arrived = rows.where("not command").drop("command").withColumn("reason", timeliness(F.col("ts"), clock, late, options.stale_hours))
        names = lists.where("kind = 'follow'").select(F.col("name").try_cast("long").alias("chat_id")).where("chat_id is not null")
        wanted = settle(followed(arrived, names))
        patterns = lists.where("kind = 'pattern'").select(F.col("name").alias("pattern"))
        timely = wanted.where("reason = 'on_time'")
        clean = settle(drop_matching(timely, patterns) if options.remove_regexs_from_file else timely)
        write_batch(clean.drop("reason"), f"{out}/selected", batch_id)
        aside = arrived.join(wanted.select("seq"), "seq", "left_anti").withColumn("reason", F.lit("unfollowed")).unionByName(
            wanted.where("reason <> 'on_time'")).unionByName(
            timely.join(clean.select("seq"), "seq", "left_anti").withColumn("reason", F.lit("ad")))
        write_batch(aside, f"{out}/aside", batch_id)
        newest = rows.agg(F.greatest(F.unix_micros(F.max("ts")), F.lit(clock).cast("long")).alias("value"))
        tick = newest.where("value is not null").select(F.lit("clock").alias("kind"), F.lit("").alias("name"), "value")
        write_batch(changed(lists, rows.where("command").select("seq", "text")).unionByName(tick).coalesce(1), f"{out}/lists", batch_id)

    return both.writeStream.foreachBatch(in_scratch(work)).option("checkpointLocation", checkpoint)


def removal_stream(published: DataFrame, deletions: DataFrame, keep: str = "30 days", late: str = "1 hour") -> DataFrame:
    """``new_id, id, ts, text`` of published messages ``new_id, id, ts, text`` that were deleted (``deleted_id, ts``) within ``keep``.

    Both sides are held as long as the other may still come: their state leaves with the watermark. A message that is deleted
    repeatedly comes once. A deletion that is later than ``late`` behind the others finds nothing any more.
    """
    left = published.select("new_id", "id", F.col("ts").alias("published_at"), "text").withWatermark("published_at", late)
    right = deletions.select("deleted_id", F.col("ts").alias("deleted_at")).withWatermark("deleted_at", late)
    inside = (F.col("new_id") == F.col("deleted_id")) & (F.col("deleted_at") >= F.col("published_at")) & (
        F.col("deleted_at") <= F.col("published_at") + F.expr(f"INTERVAL {keep}"))
    return left.join(right, inside).select("new_id", "id", "published_at", "deleted_at", "text")


def blocklist_stream(removals: DataFrame, out: str, checkpoint: str, lists: str | None = None) -> DataStreamWriter:
    """Append the lines of removed messages to ``out``, one folder per batch, while the switch of the ``lists`` is on.

    ``lists`` is the folder of :func:`gather_stream`; its newest state is read when a batch starts, and noted in ``out-switch`` so
    that a replay of the batch does the same. With the switch off nothing is appended. Each message is listed once, with its first deletion.
    """
    def work(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        noted = read_one(spark, f"{out}-switch", STATE, batch_id).first()
        on = int(noted.value) if noted else _newest_switch(spark, lists)
        write_batch(spark.createDataFrame([("switch", SWITCH, on)], STATE), f"{out}-switch", batch_id)
        line = F.replace("text", F.lit("\n"), F.lit(" "))
        # The join runs whatever the switch says: its state has to follow the batch.
        held = settle(batch)
        lines = held.where(F.lit(bool(on)) & (F.col("text") != "")).groupBy("new_id").agg(
            F.min_by(F.struct("id", line.alias("text")), "deleted_at").alias("m")).select("new_id", "m.id", "m.text")
        write_batch(lines, out, batch_id)

    return removals.writeStream.outputMode("append").foreachBatch(in_scratch(work)).option("checkpointLocation", checkpoint)


def _newest_switch(spark: SparkSession, lists: str | None) -> int:
    if lists is None:
        return 1
    full = T.StructType(STATE.fields + [T.StructField("batch", T.LongType())])
    newest = spark.read.schema(full).option("basePath", lists).parquet(lists).where("kind = 'switch'").agg(F.max_by("value", "batch")).first()[0]
    return 1 if newest is None else int(newest)
