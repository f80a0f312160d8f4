"""The distributed greedy pass against a serial loop, with so few heads that every group is hot."""

import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rivulet.operators import greedy, horizon, keys, overlaps, stems, vectors, words

from rivulet.session import discard, settle


def serial(ids, similar):
    kept = []
    for a in sorted(ids):
        if not any(similar(a, b) for b in kept):
            kept.append(a)
    return set(kept)


def kept_of(decisions):
    rows = decisions.collect()
    assert len({r.id for r in rows}) == len(rows)
    return {r.id for r in rows if r.kept}


def key_rows(spark, values):
    return spark.createDataFrame([(i, i, p, q) for i, (p, q) in enumerate(values)], "id long, seq long, p long, q long")


def test_chain_keeps_both_ends(spark):
    rows = key_rows(spark, [(1, None), (1, 2), (None, 2)])
    out = {r.id: r for r in greedy.suppress(rows.select("id", "seq"), [keys.key_tier(rows, ["p", "q"])]).collect()}
    assert [out[i].kept for i in range(3)] == [True, False, True]
    assert out[1].matched_id == 0 and out[1].tier == "key" and out[0].matched_id is None


@pytest.mark.parametrize("heads,seed", [(1, 0), (3, 1)])
def test_any_number_of_heads_gives_the_serial_result(spark, heads, seed):
    rng = random.Random(seed)
    values = [(rng.choice([1, 1, 1, rng.randint(2, 12)]), rng.randint(1, 30) if rng.random() < 0.7 else None) for _ in range(120)]
    rows = key_rows(spark, values)

    def similar(a, b):
        return values[a][0] == values[b][0] or (values[a][1] is not None and values[a][1] == values[b][1])

    # The keys of two tiers: the pass has to see both at once.
    tiers = [keys.key_tier(rows, ["p"], "p"), keys.key_tier(rows, ["q"], "q")]
    assert kept_of(greedy.keep_first(rows.select("id", "seq"), tiers, heads)) == serial(range(120), similar)


def text_rows(spark, texts):
    return spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "id long, seq long, text string")


def make_texts(seed, n=90):
    """A third of all texts are near copies of one another; the rest share frequent words."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    hot = [rng.choice(vocab) for _ in range(14)]
    texts = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.35:
            words_ = list(hot)
            for _ in range(rng.randint(0, 5)):
                words_[rng.randrange(len(words_))] = rng.choice(vocab)
        elif kind < 0.5:
            words_ = ["the", "of"] + [rng.choice(vocab[:6]) for _ in range(rng.randint(0, 6))]
        else:
            words_ = ["the"] + [rng.choice(vocab) for _ in range(rng.randint(0, 16))]
        texts.append(" ".join(words_))
    return texts + ["", "..", "the", "the", texts[0]]


@pytest.mark.parametrize("heads", [2, 512])
def test_words_equal_brute_force(spark, heads):
    texts = make_texts(heads)
    sets = [set(t.replace(".", " ").split()) for t in texts]

    def similar(a, b):
        x, y = sets[a], sets[b]
        if not x or not y:
            return False
        return len(x & y) / max(8, min(len(x), len(y))) > 0.7 or x == y

    rows = text_rows(spark, texts)
    tier = words.overlap_tier(rows)
    want = serial(range(len(texts)), similar)
    assert kept_of(greedy.keep_first(words.keyed_rows(rows), [tier], heads)) == want
    assert kept_of(greedy.keep_first(rows.select("id", "seq"), [tier], heads)) == want
    pairs = {(r.id, r.other_id) for r in tier.pairs(tier.entries, tier.entries).collect()}
    assert pairs == {(a, b) for a in range(len(texts)) for b in range(a) if similar(a, b)}


def test_overlap_boundaries(spark):
    ten = [f"a{i}" for i in range(10)]
    texts = [" ".join(ten), " ".join(ten[:7] + ["x", "y", "z"]), "p q r s t", "t s r q p", "p q r s u"]
    rows = text_rows(spark, texts)
    got = {r.id: r.kept for r in greedy.suppress(words.keyed_rows(rows), [words.overlap_tier(rows)]).collect()}
    assert got == {0: True, 1: True, 2: True, 3: False, 4: True}


@pytest.mark.parametrize("heads", [2, 512])
def test_stems_equal_brute_force(spark, heads):
    rng = random.Random(heads)
    base = "".join(rng.choice("abcdef ") for _ in range(60))
    texts = []
    for _ in range(70):
        kind = rng.random()
        if kind < 0.4:
            cut = rng.randint(0, 14)
            texts.append(rng.choice(["", "zz ", "news: "]) + base[cut:] + rng.choice(["", "!", " more words"]))
        elif kind < 0.6:
            texts.append("".join(rng.choice("ab") for _ in range(rng.randint(9, 14))))
        else:
            texts.append(" ".join(rng.choice(["one", "two", "three", "four"]) for _ in range(rng.randint(1, 9))))

    def similar(a, b):
        x, y = texts[a], texts[b]
        m = len(x) * 4 // 5 + 1
        return len(x) > 10 and len(y) > 0 and any(x[i:i + m] in y for i in range(len(x) - m + 1))

    rows = text_rows(spark, texts)
    tier = stems.stem_tier(rows)
    pairs = {(r.id, r.other_id) for r in tier.pairs(tier.entries, tier.entries).collect()}
    assert pairs == {(a, b) for a in range(len(texts)) for b in range(a) if similar(a, b)}
    assert kept_of(greedy.keep_first(stems.keyed_rows(rows), [tier], heads)) == serial(range(len(texts)), similar)


@pytest.mark.parametrize("heads,threshold", [(2, 0.7), (512, 0.3)])
def test_vectors_equal_brute_force(spark, heads, threshold):
    rng = np.random.default_rng(heads)
    v = rng.normal(size=(80, 6))
    v[::3] = v[0] + rng.normal(size=(27, 6)) * 0.35
    v /= np.linalg.norm(v, axis=1)[:, None]
    v[5] = v[40]
    rows = spark.createDataFrame([(i, i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, seq long, vec array<double>")
    tier = vectors.vector_tier(rows, threshold)
    want = serial(range(80), lambda a, b: float(v[a] @ v[b]) > threshold)
    assert kept_of(greedy.keep_first(vectors.keyed_rows(rows, threshold), [tier], heads)) == want
    near = vectors.nearest(rows, rows.select("id"), 2, threshold, earlier_only=False).where("rank = 1").collect()
    for r in near:
        others = [b for b in range(80) if b != r.id]
        assert abs(max(v[r.id] @ v[b] for b in others) - r.score) < 1e-9


def test_drop_reason_is_the_lowest_tier_among_kept_matches(spark):
    # 1 matches 0 in both tiers; 2 matches 1 (dropped) in the first and 0 (kept) in the second.
    rows = spark.createDataFrame([(0, 0, 1, 7, 9), (1, 1, 1, 8, 9), (2, 2, 2, 8, 9)], "id long, seq long, p long, q long, r long")
    tiers = [keys.key_tier(rows, ["p", "q"], "first"), keys.key_tier(rows, ["r"], "second")]
    out = {r.id: r for r in greedy.suppress(rows.select("id", "seq"), tiers).collect()}
    assert (out[1].tier, out[1].matched_id) == ("first", 0)
    assert (out[2].tier, out[2].matched_id) == ("second", 0)


def test_no_rows_at_all(spark):
    rows = text_rows(spark, ["x"]).limit(0)
    tiers = [stems.stem_tier(rows), words.overlap_tier(rows)]
    assert greedy.suppress(words.keyed_rows(rows), tiers).count() == 0


def test_long_group_of_copies_stays_linear(spark):
    """4,000 near copies: far fewer pairs are made than there are pairs in the group."""
    n = 4000
    base = " ".join(f"w{i}" for i in range(30))
    rows = spark.range(n).select("id", F.col("id").alias("seq"), F.concat(F.lit(base + " n"), F.col("id")).alias("text"))
    tier = words.overlap_tier(rows)
    made = []

    def counting(later, earlier):
        out = tier.pairs(later, earlier)
        made.append(out.count())
        return out

    tier2 = greedy.Tier(tier.name, tier.entries, counting, tier.symmetric)
    (tier2,) = greedy.settled([tier2])
    assert kept_of(greedy.keep_first(rows.select("id", "seq"), [tier2], heads=16)) == {0}
    assert sum(made) < 40 * n


def test_keys_are_decided_without_pairs(spark):
    """A group of n rows under a key once made n x n / 2 pairs."""
    r = random.Random(3)
    data = [(i, i // 2 if i < 40 else i, r.choice([None, *range(30)]), r.choice([None, *"abcdefghij"])) for i in range(200)]
    rows = spark.createDataFrame(data, "id long, seq long, p long, q string")
    tier = keys.key_tier(rows, ["p", "q"])
    kept = {}
    for i, seq, p, q in sorted(data, key=lambda x: x[1]):
        kept[i] = not any(kept[j] and s < seq and (p is not None and p == p2 or q is not None and q == q2) for j, s, p2, q2 in data if j in kept)

    def none(later, earlier):
        raise AssertionError("no pairs")

    out = greedy.keep_first(rows.select("id", "seq"), [greedy.replace(tier, pairs=none)])
    assert {x.id: x.kept for x in out.collect()} == kept
    assert 0 < sum(kept.values()) < 200


def test_blocks_of_sets_count_what_brute_force_counts():
    """Frequent words with and without a bitmap, rare ones, sets of one block and of two, both roles of a row."""
    r = np.random.default_rng(1)
    rows = []
    for i in range(160):
        if rows and r.random() < 0.5:
            old = rows[r.integers(len(rows))]
            common, rare = old[1][r.random(len(old[1])) < 0.85], old[2][r.random(len(old[2])) < 0.85]
        else:
            top = r.choice([20, overlaps.DENSE, overlaps.COMMON])
            common, rare = r.integers(0, top, r.integers(1, 80)), r.integers(-2**60, 2**60, r.integers(0, 9))
        rows.append((i, np.unique(common).astype(np.uint16), np.unique(rare).astype(np.int64), i % 7 != 3))
    sets = [{*c.tolist(), *(int(x) + 2**61 for x in k)} for _, c, k, _ in rows]

    def similar(a, b, t):
        both = len(sets[a] & sets[b])
        return bool(sets[a] and sets[b]) and rows[a][3] and (both / max(8, min(len(sets[a]), len(sets[b]))) > t or sets[a] == sets[b])

    frame = pd.DataFrame({"id": range(160), "seq": range(160), "n": [len(s) for s in sets], "common": [c.tobytes() for _, c, _, _ in rows],
                          "rare": [k.tobytes() for _, _, k, _ in rows], "long": [x for *_, x in rows]})
    frame = frame[frame["n"] > 0]
    for t in (0.7, 0.5):
        want = {(a, b) for a in range(160) for b in range(a) if similar(a, b, t)}
        assert len(want) > 50
        for side, whole in ((0 * frame["id"], True), (frame["id"] % 2, True), (frame["id"] % 2, False)):
            found = overlaps.compare(frame.assign(side=side, whole=whole), t, 8, True)
            got = list(zip(found["id"], found["other_id"]))
            crossing = not whole or side.any()
            assert len(got) == len(set(got))
            assert set(got) == {(a, b) for a, b in want if not crossing or (a % 2, b % 2) == (0, 1) or (whole and a % 2 != b % 2)}
            for i, j, s in zip(found["id"], found["other_id"], found["score"]):
                assert s == len(sets[i] & sets[j]) / max(8, min(len(sets[i]), len(sets[j])))
            best = overlaps.compare(frame.assign(side=side, whole=whole), t, 8, True, best=1)
            assert not best["id"].duplicated().any() and set(best["id"]) == set(found["id"])


def test_words_are_counted_in_blocks_and_only_pairs_leave_them(spark, monkeypatch):
    """Every word that two sets shared was a row of a shuffle; now the sets are shuffled, whatever they share."""
    texts = make_texts(7)
    rows = text_rows(spark, texts)
    (tier,) = greedy.settled([words.overlap_tier(rows)])
    whole = {tuple(r) for r in tier.pairs(tier.rows, tier.rows).collect()}
    monkeypatch.setattr(overlaps, "LEAST_WORDS", 60)
    met = tier.pairs(tier.rows, tier.rows)
    assert {tuple(r) for r in met.collect()} == whole and len(whole) > 100
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan


def test_near_rows_are_compared_without_an_index(spark):
    """Every word and anchor was a row of a shuffle, twice; now only the rows are, and the index is not made."""
    r = random.Random(5)
    texts = [" ".join(r.choice(["news", "and", "more", "of", "it", "again"]) for _ in range(r.randint(0, 9))) + r.choice(["", " aaaa", "aaaaaaaaaaaaaaaa"]) for _ in range(160)]
    sets = [set(t.split()) for t in texts]
    rows = settle(text_rows(spark, texts))

    def run(a, b):
        x, y, m = texts[a], texts[b], len(texts[a]) * 4 // 5 + 1
        return len(x) > 10 and any(x[i:i + m] in y for i in range(len(x) - m + 1))

    def words_(a, b):
        x, y = sets[a], sets[b]
        return len(texts[a]) >= 10 and bool(x and y) and (len(x & y) / max(8, min(len(x), len(y))) > 0.7 or x == y)

    def no_index():
        raise AssertionError("no index")

    for span in (3, 40):
        for tier, similar in ((stems.stem_tier(rows), run), (words.overlap_tier(rows, min_later=10), words_)):
            near = horizon.near(greedy.replace(tier, index=no_index), rows, span)
            got = [(x.id, x.other_id) for x in near.pairs(near.entries, near.entries).collect()]
            assert len(got) == len(set(got)) > 0
            assert set(got) == {(a, b) for a in range(160) for b in range(max(0, a - span), a) if similar(a, b)}


def test_null_texts_have_no_best_match(spark, tmp_path):
    """A null text ended the task that met it."""
    from rivulet.catalog import QUERIES

    rows = [(1, "one two three", "en", "src1"), (2, None, "en", "src1"), (3, "three four five", "en", "src2"), (4, "", "en", "src2")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["word_overlap_top3_horizon"](spark, str(tmp_path)).collect()
    assert [(r.id, r["rank"], r.other_id, r.score) for r in got] == [(3, 1, 1, 0.125)]


def test_tokens_of_texts_are_those_of_brute_force():
    """Grams and runs of three whole words, in whole texts and in middles, each text for itself."""
    r = random.Random(2)
    texts = ["", " ", "a", "aaaaaaa", "äöü 😀😀 x", *("".join(r.choice("ab  é😀") for _ in range(r.randint(11, 60))) for _ in range(200))]

    def middle(t):
        window = len(t) * 4 // 5 + 1
        return t[len(t) - window:window]

    def runs(t, part):
        pieces = t.split(" ")[1:-1] if part else t.split(" ")
        return [" ".join(pieces[i:i + 3]) for i in range(len(pieces) - 2)]

    def grams(t, part):
        return [t[i:i + 7] for i in range(len(t) - 6)]

    for kind, brute in ((False, runs), (True, grams)):
        known = {}
        for part in (False, True):
            owner, token = stems._tokens(texts, kind, part)
            for i, t in enumerate(texts):
                want = brute(middle(t) if part else t, part)
                got = token[owner == i].tolist()
                assert len(got) == len(want)
                # One hash for a piece wherever it stands, another one for every other piece.
                assert all(known.setdefault(w, g) == g for w, g in zip(want, got))
        assert len(set(known.values())) == len(known) > 500


def test_texts_with_a_token_of_their_own_leave_no_token(spark):
    """All tokens of all middles were rows of a join, and the grams that were asked for were sorted anew for every text."""
    own = [(i, i, " ".join(f"w{i}x{j}" for j in range(9))) for i in range(40)]
    same = [(40 + i, 40 + i, f"{'x' * i}one two three four five six seven eight nine ten eleven{'y' * i}") for i in range(3)]
    rows = spark.createDataFrame(own + same, "id long, seq long, text string")
    seen = stems._Seen(stems._repeated(stems._exploded(rows)))
    assert {r.id for r in stems._exploded(rows, middle=True, seen=seen, every=True).collect()} == {40, 41, 42}
    (tier,) = greedy.settled([stems.stem_tier(rows)])
    assert {(r.id, r.other_id) for r in tier.pairs(tier.rows, tier.rows).collect()} == {(41, 40), (42, 40), (42, 41)}


def test_a_tier_is_asked_only_about_rows_that_none_before_it_matched(spark):
    """Every tier compared all rows with all kept ones, whatever the tiers before it had found."""
    rows = text_rows(spark, make_texts(3))
    stem, word = greedy.settled([stems.stem_tier(rows), words.overlap_tier(rows)])
    want = {tuple(r) for r in greedy.suppress(stems.keyed_rows(rows), [stem, word], heads=512).collect()}
    log, found = [], {}

    def asked(tier):
        def pairs(later, earlier):
            out = settle(tier.pairs(later, earlier))
            log.append((tier.name, {r.id for r in later.select("id").collect()}, {r.id for r in out.collect()}))
            return out
        return greedy.replace(tier, pairs=pairs, best=None)

    tiers = [asked(stem), asked(word)]
    got = {tuple(r) for r in greedy.suppress(stems.keyed_rows(rows), tiers, heads=8).collect()}
    assert got == want and sum(not r[2] for r in got) > 20
    for name, later, ids in log:
        if name == "stem":
            found["last"] = ids
        elif len(log) > 2 and name == "words" and later:
            found.setdefault("apart", []).append(not (later & found["last"]))
    # The last step is the evidence, those before it the sweeps.
    assert found["apart"][-1] and sum(found["apart"]) > 1


def test_sets_are_shuffled_once_however_many_blocks_they_meet(spark, monkeypatch):
    """Every set was a row of the shuffle once per block of the other side, so that disk grew with the square of the input."""
    rows = text_rows(spark, make_texts(9))
    (tier,) = greedy.settled([words.overlap_tier(rows)])
    sets = tier.rows
    whole = {tuple(r) for r in tier.pairs(sets, sets).collect()}
    first, rest = (settle(sets.where(c)) for c in ("id % 3 = 0", "id % 3 > 0"))
    parted = {tuple(r) for r in tier.pairs(rest, first).collect()}
    monkeypatch.setattr(overlaps, "LEAST_WORDS", 60)
    assert overlaps._blocks(sets, 9) > 2
    for want, met in ((whole, tier.pairs(sets, sets)), (parted, tier.pairs(rest, first))):
        assert {tuple(r) for r in met.collect()} == want and want
        plan = met._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" in plan and "Generate" not in plan and "explode" not in plan


def test_packed_sets_come_back_as_they_were():
    r = np.random.default_rng(4)
    common = [np.unique(r.integers(0, overlaps.COMMON, 9)).astype(np.uint16) for _ in range(5)]
    rare = [np.unique(r.integers(-2**60, 2**60, n)).astype(np.int64) for n in (0, 3, 1, 0, 7)]
    frame = pd.DataFrame({"id": range(5), "seq": range(5), "n": [len(c) + len(k) for c, k in zip(common, rare)],
                          "common": [c.tobytes() for c in common], "rare": [k.tobytes() for k in rare], "long": [True, False, True, True, False]})
    for part in (frame, frame[:0], frame[:1]):
        old = overlaps._Sets(part)
        new = overlaps._Sets.unpacked(pa.py_buffer(old.packed()))
        for x in ("id", "seq", "n", "n_rare", "rare", "order", "common", "long", "common_end", "rare_end"):
            assert getattr(old, x).tolist() == getattr(new, x).tolist()


def test_words_are_coded_alike_in_batches(spark):
    """The codes of a row do not depend on the rows beside it, and rows without a frequent or without a rare word are kept."""
    data = [(0, 0, [5, 7, -9], 3), (1, 1, [7, 5], 2), (2, 2, [11], 1), (3, 3, [], 0), (4, 4, [-9, 5, 13, 2**62], 4)]
    coded = overlaps.coded_sets(spark.createDataFrame(data, "id long, seq long, words array<long>, n int")).collect()
    # 5 stands in three sets; 7 and -9 in two, the smaller one first.
    codes = {5: 0, -9: 1, 7: 2}
    assert sorted(r.id for r in coded) == [0, 1, 2, 4]
    for r in coded:
        words_ = data[r.id][2]
        assert np.frombuffer(r.common, np.uint16).tolist() == sorted(codes[w] for w in words_ if w in codes)
        assert np.frombuffer(r.rare, np.int64).tolist() == sorted(w for w in words_ if w not in codes)


def test_what_a_table_was_made_of_goes_when_it_is_written(spark):
    """Shuffle files and tables of earlier steps stayed until the end of the session."""
    from pathlib import Path

    local = [Path(d) for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()]
    shuffled = lambda: {f.name for d in local for f in d.rglob("shuffle_*.data")}
    before = shuffled()
    table = settle(spark.range(500).repartition(3, "id"))
    assert not shuffled() - before and table.count() == 500
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    at = Path(table._settled_at.removeprefix("file:"))
    assert at.exists()
    discard(table, spark.range(3))
    assert not at.exists()
    # The hashed words are not read after the coded sets are written, nor the rows of a round after those of the next one.
    rows = text_rows(spark, make_texts(11))
    old = set(at.parent.iterdir())
    greedy.suppress(words.keyed_rows(rows), [words.overlap_tier(rows)], heads=4).collect()
    new = [spark.read.parquet(str(p)).columns for p in at.parent.glob("settled-*") if p not in old]
    assert sum("words" in c for c in new) == 0 and sum("common" in c for c in new) == 1
