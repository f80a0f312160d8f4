import random

from pyspark.sql import functions as F

from rivulet.functions import text as X
from rivulet.operators.common import common_stem
from rivulet.operators.signatures import longest_shared_prefix


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_links_end_at_a_no_break_space(spark):
    assert one(spark, X.strip_links(F.lit("a https://x.y/z?q=1&b=2 tail http://u"))) == "a  tail "
    assert one(spark, X.strip_links(F.lit("https://x.y/z\u00a0tail"))) == "\u00a0tail"


def test_word_set_keeps_case_and_drops_empties(spark):
    assert sorted(one(spark, X.word_set(F.lit("  Ab ab, Ab\u05d0-1 ")))) == ["1", "Ab", "Abא", "ab"]
    assert one(spark, X.word_set(F.lit(" .. "))) == []


def test_prefix_stem_boundaries(spark):
    def stem(*texts):
        return one(spark, X.common_prefix_stem(F.lit(texts[0]), F.array(*[F.lit(t) for t in texts[1:]])))

    assert stem("News8: a", "News8: b", "xx News8: c") == "News8: "
    assert stem("News a", "News b") == "News "
    assert stem("New1 a", "New1b") == ""
    assert stem("aJoinUsHere", "bJoinUsHere") == ""  # a shared suffix is not looked for
    assert stem("abc", "abc") == "" and stem("abcde", "") == ""


def test_prefix_stem_of_both_implementations_agree(spark):
    rng = random.Random(1)
    rows = []
    for i in range(200):
        base = "".join(rng.choice("ab") for _ in range(rng.randint(0, 14)))
        rows.append((i, [base[: rng.randint(0, 14)] + "".join(rng.choice("ab") for _ in range(9)) for _ in range(3)]))
    df = spark.createDataFrame(rows, "id long, t array<string>")
    got = df.select("t", X.common_prefix_stem(F.col("t")[0], F.slice("t", 2, 2)).alias("s")).collect()
    for r in got:
        assert r.s == longest_shared_prefix(r.t)
        want = max((r.t[0][:n] for n in range(5, len(r.t[0]) + 1) if all(r.t[0][:n] in o for o in r.t[1:])), key=len, default="")
        assert r.s == want


def longest_common(a, b):
    return max((j - i for i in range(len(a)) for j in range(i + 1, len(a) + 1) if a[i:j] in b), default=0)


def test_common_run_equals_the_definition(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(400):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(11, 24)))
        cut = rng.randint(0, 5)
        b = rng.choice(["x", ""]) + a[cut: cut + rng.randint(6, 24)] + "".join(rng.choice("abc") for _ in range(3))
        rows.append((a, b))
    for r in spark.createDataFrame(rows, "a string, b string").withColumn(
            "hit", X.has_common_run(F.col("a"), F.col("b"))).collect():
        assert r.hit == (longest_common(r.a, r.b) > 0.8 * len(r.a)), (r.a, r.b)


def test_exactly_four_fifths_is_not_a_duplicate(spark):
    a = "abcdefghijklmno"  # 15 characters: 12 are not enough, 13 are
    both = spark.createDataFrame([(a, a[:12] + "zzz"), (a, a[:13] + "zz")], "a string, b string")
    assert [r[0] for r in both.select(X.has_common_run(F.col("a"), F.col("b"))).collect()] == [False, True]


def test_common_stem_of_groups(spark):
    rng = random.Random(3)
    groups = {g: ["".join(rng.choice("ab ") for _ in range(rng.randint(3, 25))) for _ in range(rng.randint(1, 4))] for g in range(40)}
    df = spark.createDataFrame([(g, i, t) for g, ts in groups.items() for i, t in enumerate(ts)], "g long, o long, t string")
    got = {r.g: r.stem for r in common_stem(df, "g", "o", "t").collect()}
    for g, (first, *others) in groups.items():
        want = ""
        if others:
            for i in range(len(first)):
                for j in range(i + 5, len(first) + 1):
                    if j - i > len(want) and all(first[i:j] in o for o in others):
                        want = first[i:j]
        assert got[g] == want, (first, others)


def test_smallest_overlap_is_the_one_that_scores(spark):
    from rivulet.operators.words import needed
    for threshold in (0.5, 0.7, 0.706, 0.707, 0.708, 1 / 3, 0.999):
        got = spark.range(1, 300).select("id", needed(F.col("id"), threshold).alias("o")).collect()
        for r in got:
            size = max(r.id, 8)
            assert r.o == next(o for o in range(size + 3) if o / size > threshold), (threshold, r)
