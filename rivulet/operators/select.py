"""Which messages take part: followed channels, ads, staleness, content, topics."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import one_line
from ..session import settle
from .skew import BROADCAST_ROWS, if_small, join_counted

# Patterns of one expression, and expressions tested by one filter; a longer list takes several filters one after the other.
PATTERNS_TOGETHER, PATTERNS_PER_FILTER = 500, 200
# What reaches beyond the pattern it stands in: numbered and named groups and references, quotes, flags.
REACHES_OUT = re.compile(r"\\[0-9kQEG]|\(\?(?![:=!>]|<[=!])")
# Flags in front of a pattern, which hold for a group as well.
FLAGS = re.compile(r"\A\(\?([imsu]+)\)")


def followed(messages: DataFrame, channels: DataFrame, key: str = "chat_id") -> DataFrame:
    """Messages of the channels in the one-column table ``channels``."""
    return messages.join(if_small(channels.distinct()), key, "left_semi")


def unfollowed(messages: DataFrame, channels: DataFrame, own: DataFrame, key: str = "chat_id") -> DataFrame:
    """Messages of channels that are neither followed nor our own output."""
    return messages.join(if_small(channels.unionByName(own).distinct()), key, "left_anti")


def channels_to_join(channels: DataFrame, joined: DataFrame, key: str = "chat_id") -> DataFrame:
    return channels.distinct().join(joined.select(key).distinct(), key, "left_anti")


def singles(messages: DataFrame) -> DataFrame:
    """Album members are not single messages."""
    return messages.where(F.col("grouped_id").isNull())


def drop_blocklisted(messages: DataFrame, blocklist: DataFrame, text: str = "text") -> DataFrame:
    """Drop messages whose text, on one line, equals a blocklisted ``text``."""
    blocked = blocklist.select(F.col("text").alias("_line")).where(F.col("_line") != "").distinct()
    return messages.join(if_small(blocked, BROADCAST_ROWS // 20), one_line(F.col(text)) == F.col("_line"), "left_anti")


def _together(listed: list[str]) -> list[str]:
    """The patterns in few expressions: those that cannot disturb each other share one, all others stand alone."""
    shared, alone = [], []
    for p in listed:
        body, flags = FLAGS.sub("", p), FLAGS.match(p)
        inner = f"(?{flags[1]}:{body})" if flags else f"(?:{body})"
        (alone if REACHES_OUT.search(body) else shared).append(p if REACHES_OUT.search(body) else inner)
    return ["|".join(shared[at:at + PATTERNS_TOGETHER]) for at in range(0, len(shared), PATTERNS_TOGETHER)] + alone


def _any_of(listed: list[str], text: Column) -> Column:
    """Whether any expression matches from the first character on; a flat tree, however many there are."""
    hits = [text.rlike(rf"\A(?:{p})") for p in listed] or [F.lit(False)]
    while len(hits) > 1:
        hits = [x | y for x, y in zip(hits[::2], hits[1::2])] + (hits[-1:] if len(hits) % 2 else [])
    return F.coalesce(hits[0], F.lit(False))


def _listed(patterns: DataFrame) -> list[str]:
    """The list is typed in by administrators."""
    return sorted(r[0] for r in patterns.select("pattern").where("pattern is not null").distinct().collect())


def any_match(patterns: DataFrame, text: Column) -> Column:
    """Whether a text matches any ``pattern`` from its first character on; a null text matches none."""
    return _any_of(_together(_listed(patterns)), text)


def drop_matching(messages: DataFrame, patterns: DataFrame, text: str = "text") -> DataFrame:
    """Drop messages that match any ``pattern`` from their first character on.

    Group numbers, group names and flags of a pattern hold inside it only. Patterns without such are tested in one pass over the text.
    """
    listed = _together(_listed(patterns))
    for at in range(0, len(listed), PATTERNS_PER_FILTER):
        messages = messages.where(~_any_of(listed[at:at + PATTERNS_PER_FILTER], F.col(text)))
    return messages


def priority_bypass(messages: DataFrame, priority: DataFrame, keep: Column, key: str = "chat_id") -> DataFrame:
    """Messages that pass ``keep``, or come from a priority channel."""
    flagged = priority.select(key).distinct().withColumn("is_priority", F.lit(True))
    joined = messages.join(if_small(flagged), key, "left")
    joined = joined.withColumn("is_priority", F.coalesce("is_priority", F.lit(False)))
    return joined.where(F.col("is_priority") | keep)


def fresh(messages: DataFrame, as_of: Column, hours: int = 1, time: str = "ts") -> DataFrame:
    return messages.where(F.col(time) >= as_of - F.expr(f"INTERVAL {hours} HOURS"))


def with_content(messages: DataFrame) -> DataFrame:
    """Messages that have a text or a file."""
    return messages.where(F.col("message").isNotNull() | (F.coalesce(F.size("files"), F.lit(0)) > 0))


def text_only_when_protected(noforwards: Column, files: Column) -> Column:
    """Protected channels: the text is copied, the files are not."""
    return F.when(F.coalesce(noforwards, F.lit(False)), F.lit(None)).otherwise(files)


def dispatch(records: DataFrame, gathering: str = "gathering", control: str = "control") -> DataFrame:
    """``route`` of each topic record; unreadable values go to the dead letters."""
    topic = F.col("topic")
    route = (
        F.when(F.col("_corrupt").isNotNull(), "dead_letter")
        .when(topic == control, "control")
        .when(topic == gathering, "gathering")
        .otherwise("unknown")
    )
    return records.withColumn("route", route)


def first_per_key(rows: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """``keys, first_seq, n``: aggregated on the map side, so a hot key costs nothing extra."""
    return rows.groupBy(*keys).agg(F.min(order).alias("first_seq"), F.count(F.lit(1)).alias("n"))


def mark_repeats(rows: DataFrame, key: Column, order: str = "seq") -> DataFrame:
    """``kept`` and ``first_seq`` per row: only the first row of each key is kept; a null key never repeats."""
    keyed = rows.withColumn("_key", F.coalesce(F.sha2(key.cast("string"), 256), F.concat(F.lit("row "), order)))
    firsts = settle(first_per_key(keyed, ["_key"], order))
    marked = join_counted(keyed, firsts, "_key", F.col(order))
    return marked.withColumn("kept", F.col("first_seq") == F.col(order)).drop("_key")


def blocklist_from_removals(deletions: DataFrame, published: DataFrame) -> DataFrame:
    """Texts of published messages that an administrator deleted: the latest one per output id."""
    latest = published.where(F.col("text") != "").groupBy("new_id").agg(
        F.max_by(F.struct("id", "text"), F.struct("ts", "id")).alias("m")
    )
    hit = deletions.select(F.col("deleted_id").alias("new_id")).distinct().join(latest, "new_id")
    return hit.select("new_id", "m.id", one_line(F.col("m.text")).alias("text"))
