"""Enrichment hooks: one call per distinct text, joined back."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import settle
from .skew import if_small, join_counted, join_skewed


def enrich_text(messages: DataFrame, fn: Callable[[pd.Series], pd.Series], text: str = "text", name: str = "en_message",
                result: str = "string") -> DataFrame:
    """Add ``fn(text)``, called in batches over the distinct texts only.

    A text that a third of all messages share is one row of the lookup; the join
    back is salted.
    """
    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"_key": pdf["_key"], "_n": pdf["_n"], name: fn(pdf["_text"])})

    keyed = messages.withColumn("_key", F.sha2(text, 256))
    distinct = keyed.groupBy("_key").agg(F.any_value(text).alias("_text"), F.count(F.lit(1)).alias("_n"))
    found = settle(distinct.where(F.col("_text").isNotNull()).mapInPandas(apply, f"_key string, _n long, {name} {result}"))
    return join_counted(keyed, found, "_key", F.monotonically_increasing_id(), "left", "_n").drop("_key")


def embed(messages: DataFrame, load: Callable[[], Callable[[np.ndarray], np.ndarray]], text: str = "text", name: str = "vec",
          batch: int = 64) -> DataFrame:
    """Add the vector of every text; null where there is no text.

    ``load`` makes the model: a function from an array of ``batch`` texts to an array of vectors. It is called once per Python
    worker, and the model sees every distinct text once. The join back is salted, as for :func:`enrich_text`.
    """
    model = predict_batch_udf(load, return_type=T.ArrayType(T.DoubleType()), batch_size=batch)
    keyed = messages.withColumn("_key", F.sha2(text, 256))
    distinct = keyed.groupBy("_key").agg(F.any_value(text).alias("_text"), F.count(F.lit(1)).alias("_n"))
    found = settle(distinct.where(F.col("_text").isNotNull()).select("_key", "_n", model("_text").alias(name)))
    return join_counted(keyed, found, "_key", F.monotonically_increasing_id(), "left", "_n").drop("_key")


def _looked_up(words: DataFrame, known: DataFrame, how: str) -> DataFrame:
    """``words (id, word, ...)`` joined to the lexicon; one too long to broadcast is joined by shuffle, safe for frequent words."""
    hinted = if_small(known)
    if hinted is known:
        return join_skewed(words, known, "word", F.struct(*[c for c in words.columns if c != "word"]), how)
    return words.join(hinted, "word", how)


@F.pandas_udf(T.StringType())
def _replaced(text: pd.Series, words: pd.Series, put: pd.Series) -> pd.Series:
    """Texts with each of their ``words`` replaced; the others stay."""
    out = []
    for t, known, new in zip(text, words, put):
        if t is not None and known is not None:
            known = dict(zip(known, new))
            t = " ".join([known.get(w, w) for w in t.split(" ")])
        out.append(t)
    return pd.Series(out, dtype=object)


def lexicon_translate(messages: DataFrame, lexicon: DataFrame, text: str = "text", name: str = "en_message") -> DataFrame:
    """Replace each space-separated word found in ``lexicon (word, en)``; others stay.

    Only the distinct words of a message that the lexicon holds are moved; they
    replace the others where the text is. The texts of messages that share an id make one text, word by word.
    """
    words = F.split(text, " ", -1)
    known = lexicon.groupBy("word").agg(F.min("en").alias("en"))
    shared = settle(messages.where("id IS NOT NULL").groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id"))
    single = messages if shared.isEmpty() else messages.join(if_small(shared), "id", "left_anti")
    found = _looked_up(single.where("id IS NOT NULL").select("id", F.explode(F.array_distinct(words)).alias("word")), known.where("en IS NOT NULL"), "inner")
    pairs = found.groupBy("id").agg(F.collect_list(F.struct("word", "en")).alias("_pairs"))
    lookup = pairs.select("id", F.col("_pairs.word").alias("_words"), F.col("_pairs.en").alias("_put"))
    put = F.when(F.col("id").isNotNull(), F.when(F.col("_words").isNull(), F.col(text)).otherwise(_replaced(F.col(text), F.col("_words"), F.col("_put"))))
    done = single.join(lookup, "id", "left").withColumn(name, put).drop("_words", "_put")
    if single is messages:
        return done
    several = messages.join(if_small(shared), "id", "left_semi")
    each = _looked_up(several.select("id", F.posexplode(words).alias("pos", "word")), known, "left")
    ordered = F.array_sort(F.collect_list(F.struct("pos", F.coalesce("en", "word").alias("w"))))
    joined = each.groupBy("id").agg(F.array_join(F.transform(ordered, lambda s: s["w"]), " ").alias(name))
    return done.unionByName(several.join(joined, "id", "left"))


def mean_pool_normalize(vectors: DataFrame, key: str, vec: str) -> DataFrame:
    """Mean vector per key, scaled to length 1: ``key, pos, value``."""
    means = (
        vectors.select(key, F.posexplode(vec).alias("pos", "v"))
        .groupBy(key, "pos").agg(F.avg(F.col("v").cast("double")).alias("mean"))
    )
    norms = means.groupBy(key).agg(F.sqrt(F.sum(F.col("mean") * F.col("mean"))).alias("norm"))
    return means.join(norms, key).select(key, "pos", (F.col("mean") / F.col("norm")).alias("value"))
