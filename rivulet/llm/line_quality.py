"""Lines that a host puts under many of its documents, and documents with little else. Column expressions only.

Normalised lines are hashed, and for every host the distinct documents that carry a line are counted. A line is common,
and removed from all documents of the host, when more than ``SHARE`` of them carry it beyond doubt: when the count less
``DOUBT`` times its square root (its spread if documents carried the line by chance) is above that share. The limit means the same
at every size: of 50 documents 6 must carry a line, of 500 at least 19, of a million 20,285. A document that is left
with fewer words than the base rule asks for is depleted and rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .common import packed, small, unpacked, with_key

# A line is common in more than this share of the documents of its host, by so many standard deviations.
SHARE, DOUBT = 0.02, 2.0
# The fewest words of a document, whole or without its common lines.
LEAST_WORDS = 50
# Fixed value: what separates words.
SPACE = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def with_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of the whole text; a null text has none.

    A word is in a repeated window when three words in a row, it among them, stand in the text twice or more: windows
    are sorted by their hash, neighbours with the same hash are repeated, and every repeated window covers the
    words up to the next one, three at most.
    """
    lines = F.filter(F.split("_t", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    spaceless = F.col("_t")
    for space in " \t\n\x0b\f\r":
        spaceless = F.replace(spaceless, F.lit(space), F.lit(""))
    out = docs.withColumn("_t", F.coalesce(F.col(text), F.lit(""))).withColumn("_w", words(F.col("_t"))).withColumn("_l", lines)
    out = out.withColumns({
        "n_words": F.size("_w").cast("long"),
        "word_chars": F.length(spaceless).cast("long"),
        "n_symbols": (F.length("_t") - F.length(F.regexp_replace("_t", r"[#*$%&|<>]", ""))).cast("long"),
        "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
        "_h": F.when(F.size("_w") > 2, F.transform(
            F.sequence(F.lit(0), F.size("_w") - 3), lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)))),
    })
    # Most texts repeat no window and are not sorted.
    repeats = F.size(F.array_distinct("_h")) < F.size("_h")
    out = out.withColumn("_s", F.when(repeats, F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))))
    twice = F.filter("_s", lambda x, i: (x["h"] == F.get("_s", i - 1)["h"]) | (x["h"] == F.get("_s", i + 1)["h"]))
    out = out.withColumn("_p", F.sort_array(F.transform(twice, lambda x: x["p"])))
    covered = F.transform("_p", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("_p", i + 1) - p, F.lit(3))))
    total = F.aggregate(covered, F.lit(0).cast("long"), lambda acc, x: acc + x)
    return out.withColumn("n_repeat_words", F.coalesce(total, F.lit(0).cast("long"))).drop("_t", "_w", "_l", "_h", "_s", "_p")


def line_hash(line: Column) -> Column:
    """Hash of a line without case, ASCII marks and the values of digits; null for a line of marks only."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]+", "0"), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " "))
    return F.when(plain != "", F.xxhash64(plain))


def measured(docs: DataFrame, text: str, id: str, host: str) -> DataFrame:
    """One narrow row per document, written once: key, host, measures, and hash and words of every line."""
    line = F.transform(F.split(F.coalesce(F.col("text"), F.lit("")), "\n"), lambda x: F.struct(
        line_hash(x).alias("h"), F.regexp_count(x, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("w")))
    narrow = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"), host_key(F.col(host)).alias("_host"))
    rows = with_measures(with_key(narrow)).withColumn("lines", F.filter(line, lambda x: x["h"].isNotNull()))
    return settle(rows.drop("text").withColumn("row", F.monotonically_increasing_id()))


def host_key(host: Column) -> Column:
    """The host, with documents without one in a group of their own."""
    return F.coalesce(F.concat(F.lit("="), host), F.lit("-"))


def common_lines(rows: DataFrame, share: float = SHARE, doubt: float = DOUBT) -> DataFrame:
    """(host, hash, documents) of the lines above their host's limit; rows that agree in id and text are one document."""
    totals = settle(rows.groupBy("_host").agg(F.count_distinct("_id", "_th").alias("total")))
    counts = rows.select("_host", "_id", "_th", F.explode(F.array_distinct("lines.h")).alias("h")).groupBy("_host", "h").agg(
        F.count_distinct("_id", "_th").alias("docs"))
    # What is not common whatever the host holds stays out of the join.
    counts = counts.where(F.col("docs") - doubt * F.sqrt("docs") > 0)
    above = F.col("docs") - doubt * F.sqrt("docs") > F.col("total") * share
    return settle(counts.join(small(totals), "_host").where(above).select("_host", "h", "docs"))


def judged(docs: DataFrame, text: str = "text", id: str = "doc_id", host: str = "source", share: float = SHARE, doubt: float = DOUBT) -> DataFrame:
    """One row per document: key, measures, ``removed_words``, ``bad`` (hashes of its common lines), verdicts.

    ``base_failed``: fewer than 50 words, or more than half of them in repeated windows. ``kept``: neither that nor
    fewer than 50 words left when the common lines are removed. Null and empty texts have no words and fail; documents without a host are
    one host; repeated rows are judged each, alike; an empty table gives no rows.
    """
    rows = measured(docs, text, id, host)
    lines = rows.select("row", "_host", F.explode("lines").alias("x")).select("row", "_host", F.col("x.h").alias("h"), F.col("x.w").alias("w"))
    bad = lines.join(small(common_lines(rows, share, doubt)), ["_host", "h"]).groupBy("row").agg(
        F.sum("w").alias("removed_words"), F.collect_set("h").alias("bad"))
    out = rows.drop("lines").join(settle(bad), "row", "left").withColumns({
        "removed_words": F.coalesce("removed_words", F.lit(0).cast("long")),
        "base_failed": (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
    })
    depleted = (F.col("removed_words") > 0) & (F.col("n_words") - F.col("removed_words") < LEAST_WORDS)
    return out.withColumn("kept", ~F.col("base_failed") & ~depleted)


def verdicts(docs: DataFrame) -> DataFrame:
    """Every document's measures and verdict."""
    return judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words")


def clean(docs: DataFrame, text: str = "text", id: str = "doc_id", host: str = "source") -> DataFrame:
    """The kept documents without their common lines; columns as they came, ``n_chars`` counted anew if there is one."""
    kept = settle(judged(docs, text, id, host).where("kept").groupBy("_id", "_th", "_host").agg(F.first("bad").alias("_bad")))
    rows = packed(docs, text, id).withColumn("_host", host_key(F.col("_doc")[host]))
    lines = F.filter(F.split("_text", "\n"), lambda x: ~F.coalesce(F.array_contains("_bad", line_hash(x)), F.lit(False)))
    left = F.when(F.col("_bad").isNull(), F.col("_text")).otherwise(F.array_join(lines, "\n"))
    out = rows.join(small(kept), ["_id", "_th", "_host"]).withColumn("_doc", F.col("_doc").withField(text, left))
    if "n_chars" in docs.columns:
        counted = F.length(F.col("_doc")[text]).cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("_doc", F.col("_doc").withField("n_chars", F.when(F.col("_bad").isNull(), F.col("_doc.n_chars")).otherwise(counted)))
    return unpacked(out, docs)
