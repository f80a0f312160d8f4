"""Queries that shape messages: parsing, albums, cleaning, enrichment, assembly."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions.text import strip_links as strip
from ..operators import changes
from ..operators import enrich as E
from ..operators import project as P
from ..plans.curate import route_forwards
from ..plans.publish import outbox as publish
from ..schema import Options
from .base import CHANGED, DOCS, documents, message_events, table, texts

QUERIES: dict = {}
SQL: dict = {}


def _register(name: str, sql: str):
    def add(fn):
        QUERIES[name] = fn
        SQL[name] = sql
        return fn
    return add


def _raw_json(spark, sf):
    """Documents as raw JSON messages; longer ones carry a photo, non-English ones are forwarded."""
    long, moved = F.length("text") > 2000, F.col("lang") != "en"
    photo = F.struct(
        F.lit("").alias("file_name"), F.length("text").cast("bigint").alias("file_size"), F.col("lang").alias("caption"),
        F.lit("image/jpeg").alias("mime_type"), F.lit(".jpg").alias("file_type"), F.lit("photo").alias("media_kind"),
        F.lit(True).alias("has_stickers"))
    value = F.to_json(F.struct(
        F.struct(F.col("chat_id").alias("id"), F.col("chat_title").alias("title")).alias("chat"), "chat_id", "id",
        F.col("text").alias("message"), F.when(moved, F.col("lang")).alias("fwd_from"),
        F.when(moved, F.create_map(F.lit("from_name"), F.col("lang"), F.lit("_client"), F.lit("x"))).alias("forward"),
        F.when(long, photo).alias("file"), long.alias("has_photo"), F.length("text").alias("views")))
    return documents(spark, sf).select(value.alias("value"))


@_register("parse_message", f"""
SELECT chat_id, id, chat_title, length(text) AS n_text, CAST(length(text) AS INTEGER) AS views,
  CASE WHEN lang <> 'en' THEN 'from_name=' || lang ELSE NULL END AS forward,
  CAST(CASE WHEN length(text) > 2000 THEN 1 ELSE 0 END AS INTEGER) AS n_files,
  CASE WHEN length(text) > 2000 THEN '.jpg' END AS label, CASE WHEN length(text) > 2000 THEN true END AS as_image
FROM {DOCS}""")
def parse_message(spark, sf):
    parsed = P.parse_raw(_raw_json(spark, sf))
    pairs = F.transform(F.map_entries("origin.forward"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    first = F.get("files", F.lit(0))
    return parsed.select(
        "chat_id", "id", "origin.chat_title", F.length("message").cast("bigint").alias("n_text"), "views",
        F.when(F.col("origin.forward").isNotNull(), F.array_join(pairs, ",")).alias("forward"),
        F.size("files").alias("n_files"), P.file_label(first["file_name"], first["file_type"]).alias("label"),
        first["as_image"].alias("as_image"))


@_register("json_roundtrip", f"SELECT chat_id, id, text AS message, CAST(length(text) AS INTEGER) AS views FROM {DOCS}")
def json_roundtrip(spark, sf):
    once = P.parse_raw(_raw_json(spark, sf)).select("chat_id", "id", "message", "views")
    written = once.select(F.to_json(F.struct(*once.columns)).alias("value"))
    return written.select(F.from_json("value", once.schema.simpleString()[7:-1].replace(":", " ")).alias("m")).select("m.*")


@_register("forward_attrs", """
SELECT event_id, 'k=' || json_extract_string(props, '$.k') AS attrs FROM events""")
def forward_attrs(spark, sf):
    attributes = F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("_event"), F.col("event_type")))
    kept = F.transform(F.map_entries(P.visible(attributes)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return table(spark, sf, "events").select("event_id", F.array_join(kept, ",").alias("attrs"))


@_register("redact_payload", """
SELECT page_id AS id, true AS no_bytes, strlen(html) AS file_size, url AS file_name FROM pages""")
def redact_payload(spark, sf):
    body = F.encode("html", "UTF-8")
    files = F.array(F.struct(body.alias("bytes"), F.octet_length(body).cast("bigint").alias("file_size"),
                             F.col("url").alias("file_name")))
    rows = table(spark, sf, "pages").select(F.col("page_id").alias("id"), P.redact(files).alias("files"))
    first = F.col("files")[0]
    return rows.select("id", first["bytes"].isNull().alias("no_bytes"), first["file_size"].alias("file_size"),
                       first["file_name"].alias("file_name"))


@_register("album_fold", """
WITH m AS (SELECT conv_id, turn * 37 AS pos, text, CASE WHEN role = 'assistant' THEN role || turn END AS forward FROM conversations)
SELECT conv_id AS grouped_id, min(pos) AS id, arg_min(text, pos) AS message,
  arg_max(forward, pos) FILTER (forward IS NOT NULL) AS forward, count(*) AS n_files FROM m GROUP BY 1""")
def album_fold(spark, sf):
    return P.fold_albums(_members(spark, sf)).select("grouped_id", "id", "message", "forward", "n_files")


@_register("album_files", """
SELECT conv_id AS grouped_id, turn * 37 AS pos, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS file_pos,
  coalesce(text, 'None') AS caption FROM conversations""")
def album_files(spark, sf):
    return P.album_files(_members(spark, sf)).select("grouped_id", "pos", "file_pos", "caption")


def _members(spark, sf):
    forward = F.when(F.col("role") == "assistant", F.concat("role", "turn"))
    return table(spark, sf, "conversations").select(
        F.lit(0).alias("chat_id"), F.col("conv_id").alias("grouped_id"), (F.col("turn") * 37).alias("pos"),
        F.col("text").alias("message"), forward.alias("forward"), F.col("text").alias("caption"))


@_register("album_all_pass", """
SELECT conv_id AS grouped_id, bool_and(length(text) >= 100) AS all_pass, count(*) AS n FROM conversations GROUP BY 1""")
def album_all_pass(spark, sf):
    return _members(spark, sf).groupBy("grouped_id").agg(
        F.bool_and(F.length("message") >= 100).alias("all_pass"), F.count(F.lit(1)).alias("n"))


@_register("forward_routing", f"""
SELECT id, CASE WHEN lang <> 'en' THEN 'control' END AS target_channel FROM {DOCS}""")
def forward_routing(spark, sf):
    return route_forwards(documents(spark, sf), F.col("lang") != "en", Options()).select("id", "target_channel")


@_register("strip_links", r"""
SELECT d.doc_id AS id, regexp_replace(d.text || ' ' || coalesce(p.url, '') || ' end', 'https?://[^ \t\n\r\f\v]+', '', 'g')
  AS text FROM documents d LEFT JOIN pages p ON d.doc_id = p.page_id""")
def strip_links(spark, sf):
    urls = table(spark, sf, "pages").select(F.col("page_id").alias("id"), "url")
    rows = texts(spark, sf).join(urls, "id", "left")
    linked = F.concat("text", F.lit(" "), F.coalesce("url", F.lit("")), F.lit(" end"))
    return rows.select("id", strip(linked).alias("text"))


def _lexicon(spark, sf):
    words = table(spark, sf, "benchmark").select(F.explode(F.split("text", " ", -1)).alias("word")).distinct()
    return words.where("word <> ''").select("word", F.concat(F.lit("en:"), "word").alias("en"))


_TRANSLATED = """(WITH lex AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS word FROM benchmark),
  tok AS (SELECT doc_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS pos
          FROM documents)
  SELECT doc_id, string_agg(CASE WHEN lex.word IS NOT NULL AND lex.word <> '' THEN 'en:' || w ELSE w END, ' ' ORDER BY pos)
    AS en_message FROM tok LEFT JOIN lex ON tok.w = lex.word GROUP BY 1)"""


@_register("lexicon_translate", f"SELECT doc_id AS id, md5(en_message) AS en_digest FROM {_TRANSLATED}")
def lexicon_translate(spark, sf):
    out = E.lexicon_translate(texts(spark, sf), _lexicon(spark, sf))
    return out.select("id", F.md5("en_message").alias("en_digest"))


@_register("enrich_distinct", "SELECT doc_id AS id, md5('en: ' || text) AS digest FROM documents")
def enrich_distinct(spark, sf):
    out = E.enrich_text(texts(spark, sf), lambda s: "en: " + s)
    return out.select("id", F.md5("en_message").alias("digest"))


def letter_model():
    """A small fixed model: how often the five vowels stand in a text, as a vector of length 1."""
    def predict(found):
        counts = np.array([[t.count(v) for v in "aeiou"] for t in found], dtype=np.float64) + 1
        return counts / np.linalg.norm(counts, axis=1)[:, None]
    return predict


@_register("embed_texts", """
WITH c AS (SELECT doc_id AS id, list_transform(['a', 'e', 'i', 'o', 'u'], lambda v: length(text) - length(replace(text, v, '')) + 1.0) AS n FROM documents)
SELECT id, CAST(g - 1 AS INTEGER) AS pos, round(CAST(n[g] / sqrt(list_sum(list_transform(n, lambda x: x * x))) AS DOUBLE), 5) AS value
FROM c, range(1, 6) t(g)""")
def embed_texts(spark, sf):
    vectors = E.embed(texts(spark, sf), letter_model)
    return vectors.select("id", F.posexplode("vec").alias("pos", "value")).select("id", "pos", F.round("value", 5).alias("value"))


@_register("change_feed", f"SELECT seq, chat_id, id, op, version, text FROM {CHANGED}")
def change_feed(spark, sf):
    return changes.change_feed(message_events(spark, sf)).select("seq", "chat_id", "id", "op", "version", "text")


@_register("published_now", f"""
SELECT chat_id, id, text FROM (SELECT *, row_number() OVER (PARTITION BY chat_id, id ORDER BY version DESC) AS r FROM {CHANGED})
WHERE r = 1 AND op <> 'retract'""")
def published_now(spark, sf):
    return changes.current(changes.change_feed(message_events(spark, sf))).select("chat_id", "id", "text")


@_register("mean_pool_normalize", """
WITH e AS (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings),
m AS (SELECT label, pos, avg(CAST(v AS DOUBLE)) AS mean FROM e GROUP BY ALL),
n AS (SELECT label, sqrt(sum(mean * mean)) AS norm FROM m GROUP BY 1)
SELECT label, CAST(pos AS INTEGER) AS pos, round(mean / norm, 6) AS value FROM m JOIN n USING (label)""")
def mean_pool_normalize(spark, sf):
    pooled = E.mean_pool_normalize(table(spark, sf, "embeddings"), "label", "embedding")
    return pooled.select("label", "pos", F.round("value", 6).alias("value"))


@_register("alias_prefix", f"SELECT id, chat_title || ':' || chr(10) AS pre_msg FROM {DOCS}")
def alias_prefix(spark, sf):
    return documents(spark, sf).select("id", P.alias_prefix(F.col("chat_title")).alias("pre_msg"))


@_register("assemble_message", f"""
SELECT id, left(chat_title || ':' || chr(10) || text, 1000) AS message FROM {DOCS}""")
def assemble_message(spark, sf):
    pre = P.alias_prefix(F.col("chat_title"))
    return documents(spark, sf).select("id", P.assemble(pre, F.col("text"), F.lit(None).cast("string")).alias("message"))


@_register("caption_fallback", """
SELECT conv_id AS grouped_id, turn * 37 AS pos, left(text, 1000) AS caption FROM conversations
WHERE text <> '' AND conv_id IN (SELECT conv_id FROM conversations GROUP BY 1 HAVING count(*) > 1)""")
def caption_fallback(spark, sf):
    return P.album_captions(_members(spark, sf)).select("grouped_id", "pos", "caption")


@_register("file_label", r"""
SELECT page_id AS id, coalesce(nullif(regexp_extract(url, '\?(.*)$', 1), ''), '.html') AS label FROM pages""")
def file_label(spark, sf):
    name = F.regexp_extract("url", r"\?(.*)$", 1)
    return table(spark, sf, "pages").select(F.col("page_id").alias("id"), P.file_label(name, F.lit(".html")).alias("label"))


_KEY = "'MESSAGE_' || md5(chat_id || '/' || id)"


@_register("outbox_key", f"SELECT id, {_KEY} AS key FROM {DOCS}")
def outbox_key(spark, sf):
    return documents(spark, sf).select("id", P.outbox_key(F.lit("MESSAGE"), F.col("chat_id"), F.col("id")).alias("key"))


@_register("outbox", f"""
SELECT id, {_KEY} AS key, CASE WHEN lang <> 'en' THEN 'control' ELSE 'main' END AS target_channel,
  left(chat_title || ':' || chr(10) || text, 1000) AS message, true AS link_preview, false AS force_document
FROM {DOCS}""")
def outbox(spark, sf):
    routed = route_forwards(documents(spark, sf), F.col("lang") != "en", Options())
    kept = routed.select(
        "id", "chat_id", "target_channel", F.col("text").alias("message"), F.lit("MESSAGE").alias("key"),
        P.alias_prefix(F.col("chat_title")).alias("pre_msg"), F.lit("").alias("post_msg"))
    return publish(kept).select("id", "key", "target_channel", "message", "link_preview", "force_document")


@_register("split_long", """
SELECT doc_id AS id, CAST(i AS INTEGER) AS part, substr(text, i * 1000 + 1, 1000) AS piece FROM (
  SELECT doc_id, text, unnest(range((greatest(length(text), 1) - 1) // 1000 + 1)) AS i FROM documents)""")
def split_long(spark, sf):
    return documents(spark, sf).select("id", F.posexplode(P.split_long(F.col("text"))).alias("part", "piece"))
