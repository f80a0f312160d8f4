"""Queries on control commands and the state they leave."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import control as C
from .base import DOCS, documents, table

QUERIES: dict = {}
SQL: dict = {}


def _register(name: str, sql: str):
    def add(fn):
        QUERIES[name] = fn
        SQL[name] = sql
        return fn
    return add


def _typed(spark, sf):
    """Events read as what an administrator typed."""
    kind, user, value = F.col("event_type"), F.col("user_id").cast("string"), F.col("value")
    text = (
        F.when(kind == "signup", F.concat(F.lit("follow ch"), user))
        .when(kind == "error", F.concat(F.lit("UNFOLLOW ch"), user))
        .when(kind == "click", F.concat(F.lit("switch remove_to_ignore"),
                                        F.when(value > 20, " ON").when(value < 4, " off").otherwise("")))
        .when(kind == "purchase", F.concat(F.lit("Join a"), user, F.lit("  b"), user))
        .otherwise(F.concat(F.lit("please follow ch"), user))
    )
    return table(spark, sf, "events").select(F.col("event_id").alias("seq"), text.alias("text"))


_COMMANDS = """(SELECT event_id AS seq, 'follow' AS command, 'ch' || user_id AS arg FROM events WHERE event_type = 'signup'
UNION ALL SELECT event_id, 'unfollow', 'ch' || user_id FROM events WHERE event_type = 'error'
UNION ALL SELECT event_id, 'switch remove_to_ignore', CASE WHEN value > 20 THEN ' ON' WHEN value < 4 THEN ' off' ELSE '' END
  FROM events WHERE event_type = 'click'
UNION ALL SELECT event_id, 'join', 'a' || user_id FROM events WHERE event_type = 'purchase'
UNION ALL SELECT event_id, 'join', 'b' || user_id FROM events WHERE event_type = 'purchase')"""


@_register("control_commands", f"SELECT seq, command, arg FROM {_COMMANDS}")
def control_commands(spark, sf):
    return C.parse_commands(_typed(spark, sf)).select("seq", "command", "arg")


@_register("follow_state", f"""
WITH l AS (SELECT arg AS channel, arg_max(command, seq) AS last, max(seq) AS seq FROM {_COMMANDS}
  WHERE command IN ('follow', 'unfollow') GROUP BY 1)
SELECT coalesce(CAST(s.s_suppkey AS VARCHAR), channel) AS channel, seq FROM l
LEFT JOIN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) s ON channel = 'ch' || s.s_suppkey WHERE last = 'follow'""")
def follow_state(spark, sf):
    dialogs = table(spark, sf, "supplier").where("s_acctbal > 0").select(
        F.concat(F.lit("ch"), F.col("s_suppkey").cast("string")).alias("name"), F.col("s_suppkey").alias("chat_id"))
    return C.follow_state(C.parse_commands(_typed(spark, sf)), dialogs)


@_register("switch_state", f"""
WITH RECURSIVE c AS (SELECT seq, arg, row_number() OVER (ORDER BY seq) AS n FROM {_COMMANDS} WHERE command LIKE 'switch%'),
s AS (SELECT 0::BIGINT AS n, -1::BIGINT AS seq, '' AS arg, 1 AS value UNION ALL
  SELECT c.n, c.seq, c.arg, CASE WHEN lower(trim(c.arg)) IN ('1', 'on') THEN 1 WHEN lower(trim(c.arg)) = 'off' THEN 0
    ELSE 1 - s.value END FROM s JOIN c ON c.n = s.n + 1)
SELECT seq, arg, CAST(value AS INTEGER) AS value FROM s WHERE n > 0""")
def switch_state(spark, sf):
    switches = C.parse_commands(_typed(spark, sf)).where("command = 'switch remove_to_ignore'")
    return C.switch_state(switches)


@_register("channel_link_parse", """
SELECT page_id AS id, page_id IN (SELECT doc_id FROM labels) AS invited, name FROM (
  SELECT page_id, regexp_extract(url, '^https?://([^/]+)/', 1) AS name FROM pages)""")
def channel_link_parse(spark, sf):
    marked = table(spark, sf, "labels").select(F.col("doc_id").alias("page_id"), F.lit("joinchat/").alias("mark")).distinct()
    host = F.regexp_extract("url", r"^https?://([^/]+)/", 1)
    link = F.concat(F.lit("https://t.me/"), F.coalesce("mark", F.lit("")), host)
    invited, name = C.parse_link(link)
    rows = table(spark, sf, "pages").join(marked, "page_id", "left")
    return rows.select(F.col("page_id").alias("id"), invited.alias("invited"), name.alias("name"))


@_register("latest_messages_report", f"""
WITH t AS (SELECT * FROM {DOCS} WHERE text <> '' ORDER BY seq DESC LIMIT 10)
SELECT string_agg(id || ') ' || text, chr(10) || chr(10) ORDER BY seq) AS report FROM t""")
def latest_messages_report(spark, sf):
    return C.render(C.report_lines(documents(spark, sf), 10))


@_register("latest_messages_all", f"SELECT seq, id || ') ' || text AS line FROM {DOCS} WHERE text <> ''")
def latest_messages_all(spark, sf):
    return C.report_lines(documents(spark, sf), 0)
