import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from rivulet.operators import order as O
from rivulet.operators.skew import join_skewed, meet_skewed


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    seqs = rng.sample(range(1000), 200)
    data = [(rng.choice("aaab"), s, float(rng.randint(-9, 9))) for s in seqs]
    return spark.createDataFrame(data, "k string, seq long, v double")


@pytest.mark.parametrize("span", [1, 7, 10_000])
def test_two_levels_equal_one_window(rows, span):
    w = Window.partitionBy("k").orderBy("seq")
    frame = w.rowsBetween(Window.unboundedPreceding, 0)
    want = rows.select("k", "seq", F.row_number().over(w).alias("rn"), F.max("v").over(frame).alias("m"),
                       F.sum("v").over(frame).alias("s"), F.collect_list("v").over(w.rowsBetween(-3, 0)).alias("t"))
    got = O.row_numbers(rows, ["k"], "seq", "rn", span)
    got = O.running_max(got, ["k"], "seq", "v", "m", span)
    got = O.running_sum(got, ["k"], "seq", "v", "s", span)
    got = O.trailing(got, ["k"], "seq", "v", 4, "t", span).select("k", "seq", "rn", "m", "s", "t")
    key = lambda r: (r.k, r.seq)
    assert sorted(map(tuple, got.collect()), key=lambda r: r[:2]) == sorted(map(tuple, want.collect()), key=lambda r: r[:2])
    assert key


def test_pacing(spark):
    df = spark.createDataFrame([("c", i, float(t)) for i, t in enumerate([0, 1, 2, 30, 31])], "k string, seq long, t double")
    sent = O.paced(df, ["k"], "seq", "t", 4.0, span=2).orderBy("seq").collect()
    assert [r.send_at for r in sent] == [0, 4, 8, 30, 34]


def test_newest(rows):
    assert O.newest(rows, "seq", 0).count() == 200
    assert O.newest(rows, "seq", 3).count() == 3


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_equals_join(spark, rows, how):
    right = spark.createDataFrame([("a", 1), ("c", 2)], "k string, x int")
    got = join_skewed(rows, right, "k", F.col("seq"), how, floor=2)
    want = rows.join(right, "k", how)
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_grid_join_forms_each_pair_once(spark, rows):
    left = rows.select("k", F.col("seq").alias("a"))
    right = rows.where("seq % 2 = 0").select("k", F.col("seq").alias("b"))
    got = meet_skewed(left, right, "k", "a", "b", floor=5).select("k", "a", "b")
    want = left.join(right, "k").select("k", "a", "b")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("span", [2, 10_000])
def test_null_keys_and_sparse_orders(spark, span):
    data = [(1, 10**6 * 3, 1.0), (None, 10**6, 2.0), (None, 10**9, 5.0), (None, 7, 1.0), (1, 5, 4.0)]
    df = spark.createDataFrame(data, "k long, seq long, v double")
    got = O.running_sum(O.row_numbers(df, ["k"], "seq", "rn", span), ["k"], "seq", "v", "s", span).collect()
    assert sorted((str(r.k), r.seq, r.rn, r.s) for r in got) == sorted(
        [("1", 5, 1, 4.0), ("1", 3 * 10**6, 2, 5.0), ("None", 7, 1, 1.0), ("None", 10**6, 2, 3.0), ("None", 10**9, 3, 8.0)])


def test_blocks_follow_the_rows_not_the_values(spark):
    rows = spark.range(1000).select(F.lit(0).alias("k"), (F.col("id") * 1_000_003).alias("seq"))
    blocks = O._blocked(rows, ["k"], "seq", 100).groupBy("_block").count().collect()
    assert 5 <= len(blocks) <= 10 and max(b["count"] for b in blocks) < 400
