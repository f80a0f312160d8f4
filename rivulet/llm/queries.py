"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import read_table
from . import bpe, decontaminate, html_text, jaccard, line_quality, ngram_filter, pii, secrets, sentence_spans, sharding, turn_trie, url_filter, word_runs

Query = Callable[[SparkSession, str], DataFrame]
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def op1_template_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.leaks(read_table(spark, sf, "documents"), read_table(spark, sf, "benchmark"))


def op2_markov_secrets(spark: SparkSession, sf: str) -> DataFrame:
    return secrets.report(read_table(spark, sf, "documents"))


def op3_feistel_shards(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.shard_table(read_table(spark, sf, "documents"))


def op4_boosted_pii(spark: SparkSession, sf: str) -> DataFrame:
    return pii.report(read_table(spark, sf, "documents"))


def op5_sentence_spans(spark: SparkSession, sf: str) -> DataFrame:
    return sentence_spans.repeats(read_table(spark, sf, "documents"))


def op6_line_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return line_quality.verdicts(read_table(spark, sf, "documents"))


def op7_prefix_bpe(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.digests(read_table(spark, sf, "documents"), VOCABULARY)


def op8_recurrent_html(spark: SparkSession, sf: str) -> DataFrame:
    return html_text.main_texts(read_table(spark, sf, "pages"))


def op9_bayes_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard.near_duplicates(read_table(spark, sf, "documents"))


def op10_wildcard_urls(spark: SparkSession, sf: str) -> DataFrame:
    return url_filter.verdicts(read_table(spark, sf, "pages"))


def op11_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    return word_runs.report(read_table(spark, sf, "documents"))


def op12_bloom_scores(spark: SparkSession, sf: str) -> DataFrame:
    return ngram_filter.report(read_table(spark, sf, "documents"))


def op13_turn_trie(spark: SparkSession, sf: str) -> DataFrame:
    return turn_trie.report(read_table(spark, sf, "conversations"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_template_decontamination, op2_markov_secrets, op3_feistel_shards, op4_boosted_pii, op5_sentence_spans, op6_line_frequency,
    op7_prefix_bpe, op8_recurrent_html, op9_bayes_jaccard, op10_wildcard_urls, op11_periodic_runs, op12_bloom_scores, op13_turn_trie,
)}
SQL: dict[str, str] = {"op10_wildcard_urls": url_filter.SQL}
