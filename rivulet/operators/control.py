"""Control commands, the state they leave behind, and the text of reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import SPAN, newest, running_max, running_sum
from .skew import if_small

# Commands of the control chat (fixed values): anchored at the start, case does not matter.
COMMANDS = [
    ("listchannels", r"listchannels"),
    ("update", r"update"),
    ("listfollows", r"listfollows"),
    ("leave", r"leave (.*)"),
    ("join", r"join (.*)"),
    ("follow", r"follow (.*)"),
    ("unfollow", r"unfollow (.*)"),
    ("add_regex_item", r"add_regex_item (.*)"),
    ("switch remove_to_ignore", r"switch remove_to_ignore(.*)"),
    ("latest_messages", r"latest_messages(.*)"),
    ("show_stats", r"show_stats"),
]


def parse_commands(texts: DataFrame, text: str = "text") -> DataFrame:
    """``command, arg`` of the texts that are commands; ``join`` yields one row per target."""
    command, arg = F.lit(None).cast("string"), F.lit("")
    for name, pattern in reversed(COMMANDS):
        anchored = rf"\A(?i){pattern}"
        hit = F.col(text).rlike(anchored)
        command = F.when(hit, name).otherwise(command)
        if "(" in pattern:
            arg = F.when(hit, F.regexp_extract(text, anchored, 1)).otherwise(arg)
        else:
            arg = F.when(hit, F.lit("")).otherwise(arg)
    found = texts.withColumn("command", command).withColumn("arg", arg).where(F.col("command").isNotNull())
    targets = F.filter(F.split(F.col("arg"), r"\s+"), lambda t: t != "")
    several = (F.col("command") == "join") & (F.size(targets) > 0)
    return found.withColumn("arg", F.explode(F.when(several, targets).otherwise(F.array("arg"))))


def parse_link(link: Column) -> tuple[Column, Column]:
    """Whether a channel link is an invitation, and its name or hash."""
    pattern = r"\Ahttps://t.me/(joinchat/)?(.*)"  # fixed value
    is_link = link.rlike(pattern)
    invited = is_link & (F.regexp_extract(link, pattern, 1) != "")
    return invited, F.when(is_link, F.regexp_extract(link, pattern, 2)).otherwise(link)


def follow_state(commands: DataFrame, dialogs: DataFrame | None = None) -> DataFrame:
    """Channels followed after all commands: the last one per channel counts.

    ``dialogs (name, chat_id)`` turns a name into an id; an unknown name stands for itself.
    """
    acts = commands.where(F.col("command").isin("follow", "unfollow"))
    if dialogs is not None:
        acts = acts.join(if_small(dialogs.select(F.col("name").alias("arg"), "chat_id")), "arg", "left")
        acts = acts.withColumn("channel", F.coalesce(F.col("chat_id").cast("string"), "arg")).drop("chat_id")
    else:
        acts = acts.withColumn("channel", F.col("arg"))
    last = acts.groupBy("channel").agg(F.max_by("command", "seq").alias("last"), F.max("seq").alias("seq"))
    return last.where(F.col("last") == "follow").select("channel", "seq")


def switch_state(commands: DataFrame, initial: int = 1, span: int = SPAN) -> DataFrame:
    """Value of the switch after each command: on and off set it, anything else flips it.

    The value is the last one set, flipped by the parity of the flips since. With
    f = flips so far, a set command stands for the parity (value - f) at its
    place, and later rows add their own f to the last of these parities.
    """
    word = F.lower(F.trim("arg"))
    rows = commands.select("seq", "arg", F.when(word.isin("1", "on"), 1).when(word == "off", 0).alias("_set"), F.lit(0).alias("_all"))
    rows = rows.withColumn("_flip", F.when(F.col("_set").isNull(), 1).otherwise(0))
    rows = running_sum(rows, ["_all"], "seq", "_flip", "_flips", span)
    # The sequence number in front makes the maximum the last one.
    parity = F.pmod(F.col("_set") - F.col("_flips"), F.lit(2))
    rows = rows.withColumn("_mark", F.col("seq") * 2 + parity)
    rows = running_max(rows, ["_all"], "seq", "_mark", "_last", span)
    base = F.coalesce(F.pmod("_last", F.lit(2)), F.lit(initial))
    return rows.select("seq", "arg", F.pmod(base + F.col("_flips"), F.lit(2)).cast("int").alias("value"))


def report_lines(messages: DataFrame, n: int = 0, order: str = "seq") -> DataFrame:
    """``seq, line`` of the last ``n`` messages with text; 0 means all of them."""
    line = F.format_string("%d) %s", F.col("id"), F.col("text"))
    return newest(messages.where(F.col("text") != ""), order, n).select(order, line.alias("line"))


def render(lines: DataFrame, separator: str = "\n\n", order: str = "seq") -> DataFrame:
    """One text of a bounded number of lines."""
    ordered = F.array_sort(F.collect_list(F.struct(order, "line")))
    return lines.agg(F.array_join(F.transform(ordered, lambda s: s["line"]), separator).alias("report"))


def render_stats(stats: DataFrame, key: str = "outcome", value: str = "n") -> DataFrame:
    """The counters as one text, a line for each; there are as many as outcomes."""
    line = F.format_string("%s: %d", F.col(key), F.col(value))
    return render(stats.select(F.col(key).alias("seq"), line.alias("line")), "\n").select(
        F.concat(F.lit("Stats:\n"), F.col("report")).alias("report"))
