"""The test tables read as messages, channels and lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table, spread_small


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return read_table(spark, sf, name)


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as messages: the source is the channel, the id the order."""
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.col("doc_id").alias("seq"),
        F.expr("cast(substr(source, 4) as bigint)").alias("chat_id"), F.col("source").alias("chat_title"), "text", "lang",
    )


def texts(spark: SparkSession, sf: str) -> DataFrame:
    """Messages for text work, which is spread over all cores even when the file is one split."""
    return spread_small(documents(spark, sf))


DOCS = """(SELECT doc_id AS id, doc_id AS seq, CAST(substr(source, 4) AS BIGINT) AS chat_id, source AS chat_title,
           text, lang FROM documents)"""


def signed(spark: SparkSession, sf: str) -> DataFrame:
    """Messages that carry their channel's signature in front."""
    return texts(spark, sf).withColumn("text", F.concat("chat_title", F.lit(" news: "), "text"))


SIGNED = f"(SELECT id, seq, chat_id, chat_title, lang, chat_title || ' news: ' || text AS text FROM {DOCS})"


def removed_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Blocklist: texts of the toxic documents, on one line."""
    toxic = table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"))
    docs = documents(spark, sf).join(toxic, "id", "left_semi")
    return docs.select(F.replace("text", F.lit("\n"), F.lit(" ")).alias("text"))


REMOVED = """(SELECT DISTINCT replace(d.text, chr(10), ' ') AS line FROM documents d JOIN labels l ON d.doc_id = l.doc_id
             WHERE l.toxic = 1 AND d.text <> '')"""


def images(spark: SparkSession, sf: str) -> DataFrame:
    """8 x 8 gray images out of the embeddings, each followed by a copy that is a little brighter."""
    emb = spread_small(table(spark, sf, "embeddings"))
    gray = F.transform("embedding", lambda x: F.round(F.lit(127.5) + x.cast("double") * 300.0))
    plain = emb.select((F.col("vec_id") * 2).alias("id"), gray.alias("gray"))
    lighter = plain.select((F.col("id") + 1).alias("id"), F.transform("gray", lambda g, i: g + i % 5).alias("gray"))
    side = F.lit(8)
    return plain.unionByName(lighter).select("id", F.col("id").alias("seq"), "gray", side.alias("height"), side.alias("width"))


IMAGES = """(SELECT vec_id * 2 AS id,
               list_transform(embedding, lambda x: round(127.5 + CAST(x AS DOUBLE) * 300.0)) AS gray FROM embeddings
             UNION ALL
             SELECT vec_id * 2 + 1 AS id,
               list_transform(embedding, lambda x, i: round(127.5 + CAST(x AS DOUBLE) * 300.0) + (i - 1) % 5) AS gray
             FROM embeddings)"""


def message_events(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of a conversation as versions of its three messages: some edits change nothing, some messages are removed early."""
    turn = F.col("turn")
    kind = F.when((turn == 3) & (F.col("conv_id") % 3 == 0), "remove").when(turn >= 6, F.when(F.col("role") == "user", "remove").otherwise("edit")).when(
        turn < 3, "new").otherwise("edit")
    text = F.when((F.length("text") % 4 == 0) | ((F.col("conv_id") % 5 == 0) & (turn % 3 == 1)), F.lit("same")).otherwise(F.col("text"))
    return table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + turn).alias("seq"), F.col("conv_id").alias("chat_id"), (turn % 3).alias("id"), kind.alias("kind"), text.alias("text"))


CHANGED = """(
WITH e AS (SELECT conv_id * 1000 + turn AS seq, conv_id AS chat_id, turn % 3 AS id,
    CASE WHEN turn = 3 AND conv_id % 3 = 0 THEN 'remove' WHEN turn >= 6 THEN CASE WHEN role = 'user' THEN 'remove' ELSE 'edit' END
      WHEN turn < 3 THEN 'new' ELSE 'edit' END AS kind,
    CASE WHEN length(text) % 4 = 0 OR (conv_id % 5 = 0 AND turn % 3 = 1) THEN 'same' ELSE text END AS text FROM conversations),
live AS (SELECT e.* FROM e LEFT JOIN (SELECT chat_id, id, min(seq) AS gone FROM e WHERE kind = 'remove' GROUP BY ALL) r USING (chat_id, id)
  WHERE gone IS NULL OR seq <= gone),
step AS (SELECT *, lag(text) OVER w AS before, lag(seq) OVER w IS NULL AS first FROM live WINDOW w AS (PARTITION BY chat_id, id ORDER BY seq)),
done AS (SELECT *, CASE WHEN kind = 'remove' THEN CASE WHEN NOT first THEN 'retract' END WHEN first THEN 'insert'
  WHEN before IS DISTINCT FROM text THEN 'update' END AS op FROM step)
SELECT seq, chat_id, id, op, row_number() OVER (PARTITION BY chat_id, id ORDER BY seq) AS version,
  CASE WHEN op <> 'retract' THEN text END AS text FROM done WHERE op IS NOT NULL)"""
