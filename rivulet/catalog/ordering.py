"""Queries about order: partitions, pacing, history, signatures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import order as O
from ..operators import signatures as G
from ..schema import Options
from .base import DOCS, SIGNED, documents, signed, table, texts

QUERIES: dict = {}
SQL: dict = {}


def _register(name: str, sql: str):
    def add(fn):
        QUERIES[name] = fn
        SQL[name] = sql
        return fn
    return add


@_register("round_robin_partition", f"""
SELECT id, chat_id, CAST(row_number() OVER (PARTITION BY chat_id ORDER BY id) % 10 AS BIGINT) AS partition FROM {DOCS}""")
def round_robin_partition(spark, sf):
    numbered = O.row_numbers(documents(spark, sf), ["chat_id"], "id")
    return numbered.select("id", "chat_id", (F.col("rn") % Options().partitions).cast("bigint").alias("partition"))


@_register("paced_schedule", """
WITH n AS (SELECT event_id, event_type, epoch(ts) AS t, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn
           FROM events)
SELECT event_id, event_type, round(max(t - 600.0 * rn) OVER (PARTITION BY event_type ORDER BY event_id
  ROWS UNBOUNDED PRECEDING) + 600.0 * rn, 3) AS send_at FROM n""")
def paced_schedule(spark, sf):
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    events = table(spark, sf, "events").select("event_id", "event_type", seconds.alias("t"))
    sent = O.paced(events, ["event_type"], "event_id", "t", 600.0)
    return sent.select("event_id", "event_type", F.round("send_at", 3).alias("send_at"))


@_register("history_window", f"SELECT id, chat_id FROM {DOCS} ORDER BY seq DESC LIMIT 1000")
def history_window(spark, sf):
    return O.newest(documents(spark, sf).select("id", "chat_id", "seq"), "seq", Options().max_latest_messages).drop("seq")


# Longest prefix of the first string found in all others, grown by powers of two as it is monotone.
def _stem_sql(first: str, others: str) -> str:
    found = f"len(list_filter({others}, lambda o: NOT contains(o, left({first}, CAST(%s AS BIGINT))))) = 0"
    grow = (f"list_reduce([5, 16384, 8192, 4096, 2048, 1024, 512, 256, 128, 64, 32, 16, 8, 4, 2, 1], lambda n, s: "
            f"CASE WHEN n + s <= length({first}) AND {found % 'n + s'} THEN n + s ELSE n END)")
    return f"CASE WHEN length({first}) >= 5 AND {found % '5'} THEN left({first}, CAST({grow} AS BIGINT)) ELSE '' END"


@_register("signature_candidates", f"""
WITH w AS (SELECT chat_id, seq, list(text) OVER (PARTITION BY chat_id ORDER BY seq ROWS 3 PRECEDING) AS recent FROM {SIGNED}),
s AS (SELECT chat_id, seq, {_stem_sql('recent[1]', 'recent[2:4]')} AS stem FROM w WHERE len(recent) = 4)
SELECT * FROM s WHERE stem <> ''""")
def signature_candidates(spark, sf):
    return G.signature_candidates(signed(spark, sf))


@_register("signature_candidates_six", f"""
WITH w AS (SELECT chat_id, seq, list(text) OVER (PARTITION BY chat_id ORDER BY seq ROWS 5 PRECEDING) AS recent FROM {SIGNED}),
s AS (SELECT chat_id, seq, {_stem_sql('recent[1]', 'recent[2:6]')} AS stem FROM w WHERE len(recent) = 6)
SELECT * FROM s WHERE stem <> ''""")
def signature_candidates_six(spark, sf):
    """The older window of six texts."""
    return G.signature_candidates(signed(spark, sf), 6)


@_register("signature_apply", f"""
SELECT id, replace(replace(text, chat_title || ' news: ', ''), '. ', '') AS text FROM {SIGNED}""")
def signature_apply(spark, sf):
    profiles = documents(spark, sf).groupBy("chat_id").agg(
        F.array(F.concat(F.any_value("chat_title"), F.lit(" news: ")), F.lit(". ")).alias("signatures"))
    return G.apply_signatures(signed(spark, sf), profiles).select("id", "text")


_STRIP = f"""
RECURSIVE src AS (SELECT chat_id, seq, text, row_number() OVER (PARTITION BY chat_id ORDER BY seq) AS n FROM {SIGNED}),
step AS (
  SELECT chat_id, 0::BIGINT AS n, -1::BIGINT AS seq, []::VARCHAR[] AS win, []::VARCHAR[] AS known, '' AS clean, '' AS learned
  FROM (SELECT DISTINCT chat_id FROM src)
  UNION ALL
  SELECT chat_id, n, seq, win, CASE WHEN learned <> '' THEN list_append(known, learned) ELSE known END AS known,
    CASE WHEN learned <> '' THEN replace(clean, learned, '') ELSE clean END AS clean, learned
  FROM (SELECT chat_id, n, seq, win, known, clean,
          CASE WHEN len(win) = 4 THEN {_stem_sql('win[1]', 'win[2:4]')} ELSE '' END AS learned
        FROM (SELECT chat_id, n, seq, known, clean, list_append(win, clean)[-4:] AS win
              FROM (SELECT s.chat_id, r.n, r.seq, s.win, s.known,
                      list_reduce(list_prepend(r.text, s.known), lambda t, k: replace(t, k, '')) AS clean
                    FROM step s JOIN src r ON r.chat_id = s.chat_id AND r.n = s.n + 1)))
)"""


@_register("signature_strip", f"WITH {_STRIP} SELECT chat_id, seq, clean AS text, learned FROM step WHERE n > 0")
def signature_strip(spark, sf):
    return G.strip_signatures(signed(spark, sf))


@_register("signature_table", f"""WITH {_STRIP} SELECT chat_id, count(*) AS n_messages,
  coalesce(string_agg(learned, '|' ORDER BY seq) FILTER (learned <> ''), '') AS signatures FROM step WHERE n > 0 GROUP BY 1""")
def signature_table(spark, sf):
    profiles = G.signature_profiles(G.strip_signatures(signed(spark, sf)))
    return profiles.select("chat_id", "n_messages", F.array_join("signatures", "|").alias("signatures"))


@_register("word_sets", r"""
SELECT doc_id AS id, list_aggregate(list_sort(list_distinct(list_filter(
    regexp_split_to_array(text, '[^\p{L}\p{N}]+'), lambda w: w <> ''))), 'string_agg', ' ') AS words FROM documents
WHERE regexp_matches(text, '[\p{L}\p{N}]')""")
def word_sets(spark, sf):
    from ..operators.words import word_sets as sets
    return sets(texts(spark, sf)).select("id", F.array_join(F.array_sort("words"), " ").alias("words"))


@_register("retention_filter", """
SELECT event_id, event_type FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR""")
def retention_filter(spark, sf):
    from ..operators.select import fresh
    events = table(spark, sf, "events")
    as_of = events.agg(F.max("ts").cast("string")).first()[0]
    return fresh(events, F.lit(as_of).cast(events.schema["ts"].dataType), 24).select("event_id", "event_type")
