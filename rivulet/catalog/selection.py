"""Queries that select messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import select as S
from ..schema import TOPIC_RECORD  # noqa: F401  (the record layout these queries imitate)
from .base import DOCS, REMOVED, documents, removed_texts, table, texts

QUERIES: dict = {}
SQL: dict = {}


def _register(name: str, sql: str):
    def add(fn):
        QUERIES[name] = fn
        SQL[name] = sql
        return fn
    return add


def _events(spark, sf):
    return table(spark, sf, "events").withColumnRenamed("user_id", "chat_id")


def _followed(spark, sf):
    return table(spark, sf, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("chat_id"))


@_register("followed_filter", """
SELECT event_id, user_id AS chat_id, event_type FROM events
WHERE user_id IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)""")
def followed_filter(spark, sf):
    return S.followed(_events(spark, sf), _followed(spark, sf)).select("event_id", "chat_id", "event_type")


@_register("unfollowed_filter", """
SELECT event_id, user_id AS chat_id, event_type FROM events
WHERE user_id NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)
  AND user_id NOT IN (SELECT r_regionkey FROM region WHERE r_name = 'ASIA')""")
def unfollowed_filter(spark, sf):
    own = table(spark, sf, "region").where("r_name = 'ASIA'").select(F.col("r_regionkey").cast("bigint").alias("chat_id"))
    return S.unfollowed(_events(spark, sf), _followed(spark, sf), own).select("event_id", "chat_id", "event_type")


@_register("channels_to_join", """
SELECT DISTINCT c_custkey AS chat_id FROM customer
WHERE c_acctbal > 0 AND c_custkey NOT IN (SELECT user_id FROM events)""")
def channels_to_join(spark, sf):
    wanted = table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("chat_id"))
    return S.channels_to_join(wanted, _events(spark, sf))


@_register("single_messages", """
SELECT doc_id AS id, length(text) AS n FROM documents""")
def single_messages(spark, sf):
    alone = documents(spark, sf).select("id", "text", F.lit(None).cast("bigint").alias("grouped_id"))
    members = table(spark, sf, "conversations").select(
        F.col("turn").alias("id"), "text", F.col("conv_id").alias("grouped_id"))
    return S.singles(alone.unionByName(members)).select("id", F.length("text").cast("bigint").alias("n"))


@_register("blocklist_exact", f"""
SELECT id, chat_id FROM {DOCS} d WHERE replace(d.text, chr(10), ' ') NOT IN (SELECT line FROM {REMOVED})""")
def blocklist_exact(spark, sf):
    return S.drop_blocklisted(documents(spark, sf), removed_texts(spark, sf)).select("id", "chat_id")


@_register("ad_regex_filter", r"""
WITH p AS (SELECT DISTINCT '(?i)' || regexp_extract(text, '^[A-Za-z]+') || '[ ,]' AS pattern FROM benchmark)
SELECT doc_id AS id, length(text) AS n FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM p WHERE regexp_matches(d.text, '^(?:' || p.pattern || ')'))""")
def ad_regex_filter(spark, sf):
    first = F.regexp_extract("text", "^[A-Za-z]+", 0)
    patterns = table(spark, sf, "benchmark").select(F.concat(F.lit("(?i)"), first, F.lit("[ ,]")).alias("pattern"))
    left = S.drop_matching(documents(spark, sf), patterns)
    return left.select("id", F.length("text").cast("bigint").alias("n"))


@_register("priority_bypass", """
SELECT d.doc_id AS id, l.doc_id IS NOT NULL AS is_priority FROM documents d
LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) l ON d.doc_id = l.doc_id
WHERE l.doc_id IS NOT NULL OR length(d.text) >= 2000""")
def priority_bypass(spark, sf):
    priority = table(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").alias("id"))
    return S.priority_bypass(documents(spark, sf), priority, F.length("text") >= 2000, "id").select("id", "is_priority")


@_register("staleness_filter", """
SELECT event_id, user_id AS chat_id, event_type FROM events
WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def staleness_filter(spark, sf):
    events = _events(spark, sf)
    # The maximum comes first, so that the filter has a literal and reaches the scan.
    as_of = events.agg(F.max("ts").cast("string")).first()[0]
    return S.fresh(events, F.lit(as_of).cast(events.schema["ts"].dataType)).select("event_id", "chat_id", "event_type")


@_register("no_content_filter", """
SELECT d.doc_id AS id, length(d.text) >= 200 AS has_text FROM documents d
WHERE length(d.text) >= 200 OR d.doc_id IN (SELECT doc_id FROM labels)""")
def no_content_filter(spark, sf):
    with_file = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.lit("file").alias("f")).distinct()
    rows = documents(spark, sf).join(with_file, "id", "left").select(
        "id", F.when(F.length("text") >= 200, F.col("text")).alias("message"),
        F.when(F.col("f").isNotNull(), F.array("f")).alias("files"))
    return S.with_content(rows).select("id", F.col("message").isNotNull().alias("has_text"))


@_register("noforward_projection", """
SELECT d.doc_id AS id, length(d.text) AS n_text,
  CASE WHEN coalesce(l.toxic, 0) = 1 THEN NULL ELSE d.n_chars END AS file_size
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def noforward_projection(spark, sf):
    marks = table(spark, sf, "labels").select("doc_id", (F.col("toxic") == 1).alias("noforwards"))
    rows = table(spark, sf, "documents").join(marks, "doc_id", "left")
    return rows.select(F.col("doc_id").alias("id"), F.length("text").cast("bigint").alias("n_text"),
                       S.text_only_when_protected(F.col("noforwards"), F.col("n_chars")).alias("file_size"))


@_register("dedup_guard", """
SELECT doc_id AS id, length(text) > 10 AS stem_test, length(text) >= 10 AS embedding_test FROM documents""")
def dedup_guard(spark, sf):
    n = F.length("text")
    return documents(spark, sf).select("id", (n > 10).alias("stem_test"), (n >= 10).alias("embedding_test"))


def _records(spark, sf):
    kind = F.col("event_type")
    topic = F.when(kind == "signup", "control").when(kind == "purchase", "other").otherwise("gathering")
    broken = (kind == "error") & (F.col("value") > 50)
    body = F.to_json(F.struct(F.col("event_id").alias("id"), F.col("user_id").alias("chat_id")))
    value = F.when(broken, F.concat(F.lit("{broken "), F.col("props"))).otherwise(body)
    parsed = F.from_json("raw", "id long, chat_id long")
    rows = table(spark, sf, "events").select("event_id", topic.alias("topic"), value.alias("raw")).withColumn("p", parsed)
    return rows.withColumn("_corrupt", F.when(F.col("p.id").isNull(), F.col("raw")))


@_register("topic_dispatch", """
SELECT event_id, CASE WHEN event_type = 'error' AND value > 50 THEN 'dead_letter' WHEN event_type = 'signup' THEN 'control'
  WHEN event_type = 'purchase' THEN 'unknown' ELSE 'gathering' END AS route FROM events""")
def topic_dispatch(spark, sf):
    return S.dispatch(_records(spark, sf)).select("event_id", "route")


@_register("dead_letter", """
SELECT event_id, '{broken ' || props AS value FROM events WHERE event_type = 'error' AND value > 50""")
def dead_letter(spark, sf):
    dead = S.dispatch(_records(spark, sf)).where("route = 'dead_letter'")
    return dead.select("event_id", F.col("_corrupt").alias("value"))


@_register("id_dedup", """
SELECT user_id AS chat_id, json_extract_string(props, '$.k') AS id, min(event_id) AS first_seq, count(*) AS n
FROM events GROUP BY ALL""")
def id_dedup(spark, sf):
    rows = _events(spark, sf).withColumn("id", F.get_json_object("props", "$.k"))
    return S.first_per_key(rows, ["chat_id", "id"], "event_id")


@_register("forward_dedup", """
SELECT event_id, event_type = 'view' OR event_id = min(event_id) OVER (PARTITION BY CASE WHEN event_type = 'view'
  THEN 'row ' || event_id ELSE props END) AS kept FROM events""")
def forward_dedup(spark, sf):
    header = F.when(F.col("event_type") != "view", F.col("props"))
    return S.mark_repeats(table(spark, sf, "events"), header, "event_id").select("event_id", "kept")


@_register("exact_text_dedup", f"""
SELECT id, seq = min(seq) OVER (PARTITION BY text) AS kept, min(seq) OVER (PARTITION BY text) AS first_seq FROM {DOCS}""")
def exact_text_dedup(spark, sf):
    return S.mark_repeats(texts(spark, sf), F.col("text")).select("id", "kept", "first_seq")


@_register("image_exact_dup", """
SELECT page_id AS id, page_id = min(page_id) OVER (PARTITION BY sha256(html)) AS kept,
  min(page_id) OVER (PARTITION BY sha256(html)) AS first_seq FROM pages""")
def image_exact_dup(spark, sf):
    files = table(spark, sf, "pages").select("page_id", F.encode("html", "UTF-8").alias("bytes"))
    marked = S.mark_repeats(files, F.sha2("bytes", 256), "page_id")
    return marked.select(F.col("page_id").alias("id"), "kept", "first_seq")


@_register("removal_feedback", """
SELECT DISTINCT p.event_id AS new_id, d.doc_id AS id, replace(d.text, chr(10), ' ') AS text
FROM events p JOIN documents d ON d.doc_id = p.event_id WHERE p.event_type = 'error' AND d.text <> ''""")
def removal_feedback(spark, sf):
    events = table(spark, sf, "events")
    deletions = events.where("event_type = 'error'").select(F.col("event_id").alias("deleted_id"), "ts")
    published = documents(spark, sf).select(F.col("id").alias("new_id"), "id", "text", F.col("seq").alias("ts"))
    return S.blocklist_from_removals(deletions, published)
