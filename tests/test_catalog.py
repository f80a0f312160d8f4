"""Registered queries against their SQL, and the plans they run."""

import pytest

from rivulet.catalog import QUERIES, SQL
from rivulet.operators import stems, words
from rivulet.operators.greedy import attach, counted_candidates

from .oracle import compare, connect

SF = "/root/testdata/sf0.001"
# The others take part in tests/oracle.py, which compares all of them.
SLOW = {"stream_greedy_horizon", "word_overlap_top3_horizon", "stream_pipeline", "word_overlap_best", "word_overlap_top3", "outcome_stats", "middleman_score", "stream_greedy_dedup"}


@pytest.fixture(scope="module")
def con():
    pytest.importorskip("duckdb")
    return connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SLOW))
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, name, SF, QUERIES, SQL) == ""


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_cross_join_and_no_python_in_the_word_path(spark):
    rows = spark.createDataFrame([(1, 1, "a b c")], "id long, seq long, text string")
    tier = words.overlap_tier(rows)
    met = plan(counted_candidates(tier.entries, tier.entries))
    both = plan(attach(spark.createDataFrame([], "id long, other_id long, other_seq long"), words.hashed_sets(rows)))
    for p in (met, both):
        assert "Cartesian" not in p and "Python" not in p and "ArrowEval" not in p


def test_filters_and_columns_reach_the_scan(spark):
    p = plan(QUERIES["followed_filter"](spark, SF))
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint,event_type:string>" in p
    p = plan(QUERIES["dedup_guard"](spark, SF))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in p


def test_stem_index_of_unique_texts_is_empty(spark):
    rows = spark.createDataFrame([(i, i, f"word{i} other{i} third{i} fourth{i} fifth{i} sixth{i} seventh{i}") for i in range(5)],
                                 "id long, seq long, text string")
    assert stems.stem_entries(rows).where("probe").count() == 0
